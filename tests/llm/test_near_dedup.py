"""MinHash near-dedup against brute force over all pairs."""

import random
import re

import pytest

from quantloom.llm.near_dedup import near_duplicates
from quantloom.llm.shingles import Shingler, Sketcher, banding


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * a >= num * (len(sets[i]) + len(sets[j]) - a):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, groups=12, copies=12):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(groups):
        base = r.choices(words, k=r.choice([2, 5, 20, 60, 300]))
        for c in range(copies):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((at * 7 % 1009, " ".join(text).upper() if c % 3 == 0 else "  ".join(text)))
            at += 1
    shared = " ".join(r.choices(words, k=60))
    for _ in range(30):  # one passage in many different documents
        rows.append((at * 7 % 1009, shared + " " + " ".join(r.choices(words, k=25))))
        at += 1
    return rows


@pytest.mark.parametrize(("n", "num", "den"), [(3, 85, 100), (5, 4, 5)])
def test_matches_brute_force(spark, n, num, den):
    rows = corpus(n)
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "ONE"), (2005, "a b"), (None, "a b"), (None, "unlike all others"), (2005, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = near_duplicates(docs, words=n, threshold=(num, den)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, n, num, den)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_hub_with_dissimilar_copies(spark):
    """Copies that are near one base but not each other form one group whichever is a bucket's centre."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        text = list(base)
        for p in r.sample(range(3, 147), 3):
            text[p] = f"x{i}_{p}"
        rows.append((i, " ".join(text)))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, threshold=(85, 100)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in found), key=str) == brute(rows, 3, 85, 100)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept string, digest int")
    assert near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c", "x", 2)], "doc_id long, text string, kept string, digest int")
    assert [(r.doc_id, r.component_id, r.kept) for r in near_duplicates(one).collect()] == [(1, 1, True)]


def test_densified_bins_agree_as_often_as_sets_do():
    sketcher, shingler = Sketcher(252, 7), Shingler(1)
    r, agreed = random.Random(1), []
    for _ in range(60):
        words = [f"{r.random()}" for _ in range(40)]
        a, b = shingler(" ".join(words[:36]).encode()), shingler(" ".join(words[4:]).encode())
        agreed.append((sketcher.signature(a) == sketcher.signature(b)).mean())
    assert abs(sum(agreed) / len(agreed) - 32 / 40) < 0.03


def test_banding_misses_at_most_what_it_says():
    for t in (0.8, 0.85, 0.95):
        bands, rows = banding(t)
        assert bands * rows <= 252 and (1 - t**rows) ** bands <= 1e-6
