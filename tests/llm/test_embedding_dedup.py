"""Embedding near-dedup against all pairs."""

import numpy as np

from quantloom.llm.embedding_dedup import embedding_near_duplicates, tables_for


def brute(rows, cosine):
    usable = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i in range(len(rows))}
    for i, x in usable:
        for j, y in usable:
            if i < j and len(x) == len(y) and x @ y >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[i][0], len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


def test_matches_all_pairs(spark):
    r = np.random.default_rng(2)
    rows, at = [], 0
    for spread in (0.0, 0.01, 0.03, 0.05, 0.1, 0.2):  # copies, tight balls, balls near the threshold
        for _ in range(3):
            base = r.standard_normal(24)
            for _ in range(20):
                v = base + spread * np.linalg.norm(base) * r.standard_normal(24) / np.sqrt(24) * r.uniform(0, 2)
                rows.append((at * 11 % 2003, [float(np.float32(x)) for x in v * r.uniform(0.5, 2)]))
                at += 1
    rows += [(at + 5000 + i, [float(x) for x in r.standard_normal(24)]) for i in range(60)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [None, *[1.0] * 23]), (9005, [float("nan")] * 24), (9006, [float("inf"), *[1.0] * 23]), (9007, [1.0, 2.0])]
    rows += [(None, rows[0][1]), rows[1], (9008, [-x for x in rows[2][1]])]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "vec_id long, embedding array<double>, unit string").repartition(4)
    found = embedding_near_duplicates(df).collect()
    assert sorted(((x.vec_id, x.n_links, x.component_id) for x in found), key=str) == brute(rows, 0.95)
    assert all(x.kept == (x.vec_id == x.component_id) for x in found)


def test_empty_table(spark):
    assert embedding_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tables_follow_the_number_of_vectors():
    assert tables_for(10**6, 0.95)[0] > tables_for(10**4, 0.95)[0]


def test_recall_of_pairs_planted_at_the_threshold(spark):
    """Among 3000 vectors, 300 pairs with a cosine between 0.9501 and 0.952 and as many just below: every link and no other."""
    r = np.random.default_rng(12)
    x = r.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(600):
        cosine = r.uniform(0.9501, 0.952) if i < 300 else r.uniform(0.945, 0.9499)
        side = r.standard_normal(48)
        side -= side @ x[i] * x[i]
        x[1000 + i] = cosine * x[i] + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = unit @ unit.T
    np.fill_diagonal(cosines, 0.0)
    expected = (cosines >= 0.95).sum(axis=1)
    assert expected.sum() >= 600
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {f.vec_id: f.n_links for f in embedding_near_duplicates(df).collect()}
    found = np.array([got[i] for i in range(3000)])
    assert (found <= expected).all() and found.sum() >= 0.99 * expected.sum()
