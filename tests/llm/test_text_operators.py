"""Syncmers, sharding, packing, lines, urls, quality and the pipeline on small fixtures."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import syncmers
from quantloom.llm.line_dedup import drop_boilerplate_lines
from quantloom.llm.packing import pack
from quantloom.llm.quality import gumbel, importance_resample, kth_largest, margin
from quantloom.llm.registry import QUERIES, page_outcomes
from quantloom.llm.sharding import shard_of, shuffled_shards, write_shards
from quantloom.llm.url_filter import domain_and_suffix, beta_tail, judge_urls, probability_above, reputations

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu") for b in ("la", "me", "ni", "ro", "su", "ta")]


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


EDGE = [(None, "no id here", None, None, None), (900, None, None, "s", None), (901, "", "en", "s", 0), (902, " \n ", "en", "s", 3), (903, "one", "en", "s", 3), (903, "one", "en", "s", 3), (904, "long " * 30_000, "en", "s", 150_000)]


def corpus(seed, n):
    r = random.Random(seed)
    return [(i, "\n".join(prose(r, r.randint(3, 40)) for _ in range(r.randint(1, 4))), "en", f"src{min(r.randrange(8), 4)}", None) for i in range(n)]


# syncmers

def expected_next(rows):
    docs = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: -x[0])
    return {docs[k][0]: docs[(k + 1) % len(docs)][1] for k in range(len(docs))}


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_document_and_edit(spark, buckets):
    rows = [r for r in corpus(1, 40) if r[0] % 3] + [r for r in EDGE[1:5]] + [EDGE[6]]
    nxt = expected_next(rows)
    out = syncmers.with_next(documents(spark, rows), buckets).withColumn("edited", syncmers.edited(F.col("text"), F.col("next_text"))).collect()
    assert len(out) == len(rows)
    for r in out:
        cut = len(r.text) // 3
        assert r.next_text == nxt[r.doc_id]
        assert r.edited == r.text[: len(r.text) - cut] + r.next_text[:cut]


def test_next_document_with_null_and_repeated_ids(spark):
    rows = [*EDGE, (None, "second without id", None, None, None), (None, None, None, None, None), (904, "other", "en", "s", 1)]
    out = syncmers.with_next(documents(spark, rows), 4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out) == sorted((i is None, i or 0, t or "") for i, t, *_ in rows)
    # the next ones are the same rows, each followed once, in descending order of ids with null ids last
    assert sorted(r.next_text for r in out) == sorted(r.text for r in out)
    following = {}
    for r in out:
        following.setdefault(r.doc_id, []).append(r.next_text)
    assert set(following[904]) & {"other", EDGE[6][1]} and "one" in following[904] + following[903]
    assert syncmers.with_next(documents(spark, [])).count() == 0


def brute_anchors(spark, text):
    """Closed syncmers by their definition, on Spark's own hashes of the pieces."""
    import re

    pieces = [w for run in re.findall(r"\S+", text) for w in re.findall(r".{1,8}", run, re.S)]
    if not pieces:
        return []
    h = [0] * 4 + [r.h for r in spark.createDataFrame(list(enumerate(pieces)), "i int, w string").orderBy("i").select(F.xxhash64("w").alias("h")).collect()] + [0] * 4
    pairs = spark.createDataFrame([(i, h[i], h[i + 1]) for i in range(len(h) - 1)], "i int, a long, b long")
    s = [r.s for r in pairs.orderBy("i").select(F.xxhash64("a", "b").alias("s")).collect()]
    return [i for i in range(len(h) - 4) if min(s[i], s[i + 3]) <= min(s[i + 1], s[i + 2])]


def test_anchors_are_closed_syncmers(spark):
    text = prose(random.Random(5), 60) + " averyveryverylongword"
    got = spark.createDataFrame([(text,)], "t string").select(syncmers.anchors(F.col("t")).alias("a")).first().a
    assert [a.position for a in got] == brute_anchors(spark, text)


def test_fingerprints_of_equal_and_odd_texts(spark):
    d = documents(spark, [*EDGE, (1, "same text of some words", "en", "s", 1), (2, "same text of some words", "fr", "t", 1)]).withColumn("fingerprint", F.lit("clash"))
    out = {(r.doc_id, r.text): r.fingerprint for r in syncmers.fingerprints(d).collect()}
    assert out[1, "same text of some words"] == out[2, "same text of some words"] != ""
    assert out[900, None] == out[901, ""] == out[902, " \n "] == ""
    assert syncmers.fingerprints(documents(spark, [])).count() == 0


def test_op6_contract(spark, sf_small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    out = QUERIES["op6_closed_syncmers"](spark, sf_small).collect()
    assert len(out) == len(docs)
    for r in out:
        text, nxt = docs[r.doc_id], docs[order[(order.index(r.doc_id) + 1) % len(order)]]
        cut = len(text) // 3
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - cut] + nxt[:cut]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in out if r.n_chars > 600]
    assert min(r.near_edited for r in long) > max(r.near_next for r in long)


def alike(spark, a, b):
    made = spark.createDataFrame([(a, b)], "a string, b string").select(syncmers.sketch(F.col("a")).alias("a"), syncmers.sketch(F.col("b")).alias("b"))
    return made.select(syncmers.likeness(F.col("a"), F.col("b")).alias("x")).first().x


def test_likeness_finds_contained_texts_and_shared_passages(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    a, b, shared = ([word() for _ in range(n)] for n in (8000, 8000, 200))
    assert alike(spark, " ".join(a), " ".join(a[3000:3300])) > 0.9
    near = alike(spark, " ".join(a + shared), " ".join(b[:4000] + shared + b[4000:]))
    assert 0.5 * 200 / 8200 < near < 1.5 * 200 / 8200 and alike(spark, " ".join(a), " ".join(b)) == 0
    mixed = [" ".join(a[i : i + 6]) for i in range(0, 600, 6)]
    assert alike(spark, "x".join(mixed), "x".join(r.sample(mixed, 100))) < 1
    assert alike(spark, "one", "one") == alike(spark, "", " ") == 1 and alike(spark, "one", "") == 0


def test_insertion_in_unbroken_text_stays_local(spark):
    r = random.Random(10)
    text = "".join(r.choices("\u4e00\u4e8c\u4e09\u56db\u4e94abcdefg", k=3000))
    assert alike(spark, text, "z" + text) > 0.95 and alike(spark, text, text[:1500] + "z" + text[1500:]) > 0.95


# sharding

def test_shards_keep_every_row_and_slot(spark, tmp_path):
    rows = [*corpus(2, 300), *EDGE]
    d = documents(spark, rows).withColumn("bucket", F.lit("clash"))
    out = shuffled_shards(d, shards=4, bucket_bytes=4_000)
    got = out.collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, ((r[0], r[1]) for r in rows)))
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sorted(map(repr, got)) == sorted(map(repr, shuffled_shards(d.repartition(7), shards=4, bucket_bytes=4_000).collect()))
    write_shards(out, f"file://{tmp_path}/shards")
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == len(rows)
    assert shuffled_shards(documents(spark, [])).count() == 0


def test_order_does_not_depend_on_the_session(spark, sf_dir):
    """Whatever ran before in the session and however many shuffle partitions it has."""
    spark.range(8).select(F.shuffle(F.array(F.lit(1), F.lit(2)))).collect()
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = []
    for partitions in ("4", "16"):
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            runs.append({r.doc_id: (r.shard, r.bucket, r.slot) for r in shuffled_shards(d, 8, 17, bucket_bytes=40_000).select("doc_id", "shard", "bucket", "slot").collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)
    assert runs[0] == runs[1] and len(runs[0]) == d.count()


def test_rows_equal_in_id_and_text_have_a_fixed_order(spark):
    rows = [(1, "same", i) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, other int")
    one, two = ({r.other: r.slot for r in shuffled_shards(x).collect()} for x in (d, d.orderBy(F.desc("other")).repartition(5)))
    assert one == two and sorted(one.values()) == list(range(40))


def test_shards_and_buckets_by_brute_force(spark):
    """Law and scatter computed again, one row at a time, and the slots of each bucket follow those of the buckets before it."""
    d = documents(spark, corpus(5, 250))
    got = shuffled_shards(d, shards=5, seed=3, bucket_bytes=2_000).collect()
    total = sum(len((r.text or "").encode()) + 1 for r in got)
    per_shard = -(-total // (5 * 2_000))
    for r in got[::9]:
        draws = spark.createDataFrame([(r.doc_id, r.text, s) for s in range(5)], "k long, t string, s int").select("s", F.xxhash64(F.lit(3), "k", "s").alias("draw"), F.xxhash64(F.lit(4), "k", "t").alias("scatter")).collect()
        assert r.shard == max(draws, key=lambda x: x.draw).s and r.bucket == draws[0].scatter % per_shard
    for shard in range(5):
        held = sorted((r.bucket, r.position, r.slot) for r in got if r.shard == shard)
        assert [slot for _, _, slot in held] == list(range(len(held)))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    moved = spark.range(2000).select(shard_of(F.col("id"), 8, 17).alias("a"), shard_of(F.col("id"), 9, 17).alias("b")).where("a != b").collect()
    assert moved and all(r.b == 8 for r in moved)


def test_op5_contract(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in QUERIES["op5_external_shuffle_sharding"](spark, sf_small).collect():
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key") and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)


# packing

def brute_pack(items, capacity):
    """(bin, offset) of each (length, source, cluster): the tightest compatible bin of all, of equals the one that got there first."""
    bins, out, clock = [], [], 0
    for n, s, c in items:
        fits = [b for b in range(len(bins)) if bins[b]["left"] >= n and s not in bins[b]["s"] and (c is None or c not in bins[b]["c"])]
        best = min(fits, key=lambda b: (bins[b]["left"], bins[b]["since"]), default=None)
        if best is None:
            bins.append({"left": capacity, "s": set(), "c": set()})
            best = len(bins) - 1
        one, clock = bins[best], clock + 1
        out.append((best, capacity - one["left"]))
        one["left"] -= n
        one["since"] = clock
        one["s"].add(s)
        one["c"].add(c)
    return out


def packing_order(r):
    return (-r.length, r.doc_id is not None, r.doc_id or 0, r.piece, r.source, (r.cluster is not None, r.cluster or 0))


@pytest.mark.parametrize("group", [60, 10_000])
def test_packing_is_best_fit_without_conflicts(spark, group):
    rows = [*corpus(3, 400), *EDGE, *[(2000 + i, "copy of one text", "en", f"s{i}", 1) for i in range(9)], *[(77, "again and again", "en", "t", 1)] * 50]
    got = pack(documents(spark, rows), capacity=64, group=group).collect()
    words = sum(len((t or "").split()) for _, t, *_ in rows)
    assert sum(r.length for r in got) == words
    bins, groups = {}, {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
        groups.setdefault(r.bin_id >> 32, []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.bin_offset)
        assert sum(r.length for r in b) <= 64 and len({r.source for r in b}) == len(b) == len({r.cluster for r in b})
        assert all(x.bin_offset + x.length == y.bin_offset for x, y in zip(b, b[1:]))
    assert (len(groups) > 5) == (group == 60)
    for number, part in groups.items():
        items = sorted(part, key=packing_order)
        expected = brute_pack([(r.length, r.source, r.cluster) for r in items], 64)
        # pieces that are equal in all are interchangeable
        mine = sorted((packing_order(r), r.bin_id - (number << 32), r.bin_offset) for r in items)
        assert mine == sorted((packing_order(r), *place) for r, place in zip(items, expected))
    again = pack(documents(spark, rows).repartition(5), capacity=64, group=group).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert pack(documents(spark, [])).count() == 0


def test_packing_keeps_large_ids_beside_null_ones_and_takes_given_clusters(spark):
    big = 9_007_199_254_740_993
    rows = [(big, "a b", "s0", big), (None, "a b", "s1", None), (big + 1, "c", "s2", big + 1), (big + 2, "d", "s3", big), (5, "e", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, given long").withColumns({"cluster": F.lit("clash"), "group": F.lit("clash"), "copies": F.lit(1)})
    got = pack(docs, capacity=8, cluster_col="given").collect()
    assert sorted((r.doc_id or 0, r.cluster or 0) for r in got) == sorted((i or 0, c or 0) for i, _, _, c in rows)
    where = {r.doc_id: r.bin_id for r in got}
    assert where[big] != where[big + 2] and len(set(where.values())) == 2


# lines

def test_line_dedup(spark):
    rows = [(i, f"own {i}\n  footer \nmore {i}", "en", "big", 1) for i in range(20)] + [(100 + i, "copied page\nof two lines", "en", "big", 1) for i in range(15)]
    rows += [(200 + i, "footer\nx", "en", "small", 1) for i in range(3)] + [*EDGE]
    out = {(r.doc_id, r.text): r.dropped_lines for r in drop_boilerplate_lines(documents(spark, rows).withColumn("dropped_lines", F.lit("clash"))).collect()}
    assert all(out[i, f"own {i}\nmore {i}"] == 1 for i in range(20))
    assert all(out[100 + i, "copied page\nof two lines"] == 0 for i in range(15))  # copies are one page
    assert all(out[200 + i, "footer\nx"] == 0 for i in range(3))  # one page with copies
    assert out[900, None] == out[901, ""] == out[902, " \n "] == out[903, "one"] == 0
    assert drop_boilerplate_lines(documents(spark, [])).count() == 0


def test_line_dedup_goes_by_evidence_at_every_size(spark):
    r = random.Random(8)
    lines = lambda *planted: "\n".join([prose(r, 30), *planted, prose(r, 30)])
    rows = [(i, lines(*["seldom"] * (i < 3), *["often"] * (i % 20 == 0)), "en", "large", 1) for i in range(400)]
    rows += [(1000 + i, lines("everywhere", *["twice"] * (i < 2)), "en", "nine", 1) for i in range(9)]
    out = {x.doc_id: x for x in drop_boilerplate_lines(documents(spark, rows)).collect()}
    for i, text, *_ in rows:
        left = [x for x in text.split("\n") if x not in ("often", "everywhere")]
        assert out[i].text == "\n".join(left) and out[i].dropped_lines == len(text.split("\n")) - len(left)


# urls

def test_url_verdicts(spark):
    urls = ["http://A.example.org/es/1?x", "https://example.org/en/1", "http://x.org", "http://x.org/", "http://y.com/de/#f", "http://y.com/fr/", "nothing", None, "http://bad.net/a", "http://good.net/a", "http://good.net/a"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("bad.net", 1)] * 60 + [("good.net", 0)] * 60 + [(None, 1), ("good.net", None)], "host string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, outcomes).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2] == ("x.org", "", None, "allow") and got[3][2] == "org/"
    assert got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6] == ("", "", None, "allow") == got[7]
    assert got[8][3] == "block" and got[9] == got[10] and got[9][3] == "allow" and len(got) == len(urls)
    empty = judge_urls(pages, outcomes.limit(0))
    assert empty.where("rule IS NULL AND verdict = 'block'").count() == 0


def test_shrinkage_goes_from_host_to_domain(spark):
    outcomes = [(f"h{i}.bad.net", 1) for i in range(40)] + [(f"h{i}.good.net", 0) for i in range(40)]
    got = {r.host: r.mean for r in reputations(spark.createDataFrame(outcomes, "host string, bad int")).collect()}
    assert got["h0.bad.net"] > 0.6 > 0.4 > got["h0.good.net"]


def test_hosts_without_labels_are_judged_by_their_prior(spark):
    outcomes = [(f"h{i % 4}.bad.net", 1) for i in range(40)] + [(f"h{i % 4}.good.net", 0) for i in range(40)] + [(f"h{i}.d{i}.xyz", 1) for i in range(20)] + [("ok.gov", 0)] * 400
    outcomes = spark.createDataFrame(outcomes, "host string, bad int")
    urls = ["http://new.bad.net/a", "http://new.good.net/a", "http://new.net/a", "http://new.d.xyz/a", "http://new.museum/a", "http:///a", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in judge_urls(pages, outcomes).collect()}
    assert [got[i].verdict for i in range(len(urls))] == ["block", "allow", "allow", "block", "allow", "allow", "allow"]
    known = {r.host: r for r in reputations(outcomes).collect()}
    assert got[0].bad_mean > 0.9 and got[1].bad_mean < 0.1 and abs(got[0].bad_mean - known["h0.bad.net"].mean) < 0.05
    assert abs(got[4].bad_mean - 61 / 502) < 1e-9
    assert got[5].bad_mean is None and got[6].bad_mean is None
    empty = judge_urls(pages.limit(0), outcomes)
    assert empty.count() == 0 and "verdict" in empty.columns


def test_posterior_probability_is_that_of_the_beta_distribution(spark):
    draws = np.random.default_rng(4)
    for a, b in ((0.6, 3.0), (2.5, 2.5), (40.0, 60.0), (900.0, 1100.0), (0.97, 0.03), (0.9, 0.1), (0.1, 0.9), (400_100.0, 600_000.0), (0.02, 200.0)):
        got = spark.range(1).select(probability_above(F.lit(a), F.lit(b), F.lit(0.4)).alias("p")).first().p
        assert abs(got - (draws.beta(a, b, 400_000) > 0.4).mean()) < 0.004, (a, b)
    assert beta_tail(1, 1, 0.3) == pytest.approx(0.7) and beta_tail(2, 1, 0.3) == pytest.approx(0.91) and beta_tail(3, 4, 0.0) == 1.0 and beta_tail(3, 4, 1.0) == 0.0
    assert beta_tail(0.97, 0.03, 0.4) == pytest.approx(0.984, abs=1e-3) and beta_tail(0.1, 0.9, 0.4) == pytest.approx(0.099, abs=1e-3)


def test_planted_bad_hosts_are_blocked_as_in_sql(spark, tmp_path):
    """Hosts and domains of bad pages among good ones, some without labels: the query and its twin block the same pages."""
    import duckdb

    from quantloom.llm.oracles import OP9

    r = random.Random(6)
    pages, labels = [], []
    sites = [(f"good{i}.net", 0.1) for i in range(12)] + [("a.spam.net", 0.9), ("b.spam.net", 0.95), ("shop.mixed.info", 0.5), ("x.mixed.info", 0.1), ("one.biz", 1.0)]
    for host, bad in sites:
        for _ in range({"one.biz": 2}.get(host, 40)):
            n = len(pages)
            pages.append((n, f"http://{host}/en/{n}", None))
            if r.random() < 0.7:
                labels.append((n, int(r.random() >= bad), 0))
    pages += [(10_000, "http://new.spam.net/en/99999999", None), (10_001, "http://new.good0.net/en/x", None), (10_002, "http://other.net/", None), (10_003, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r for r in QUERIES["op9_url_reputation"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    twin = {row[0]: row[1:] for row in con.execute(OP9).fetchall()}
    assert {k: (v.host, v.path, v.rule, v.verdict) for k, v in got.items()} == twin
    blocked = {v.host for v in got.values() if v.verdict == "block"}
    assert {"a.spam.net", "b.spam.net", "new.spam.net"} <= blocked and not any("good" in h or h == "other.net" for h in blocked)


def test_listed_suffixes_decide_the_domain(spark):
    outcomes = spark.createDataFrame([(f"bad.pages.io", 1)] * 30 + [(f"h{i}.pages.io", 0) for i in range(30)] + [("u:1@bad.pages.io:80", 1)], "host string, bad int")
    plain = {r.host: r.mean for r in reputations(outcomes).collect()}
    hosts = spark.createDataFrame([("x.bad.pages.io",), ("new.pages.io",), ("pages.io",)], "host string")
    listed = {r.host: r.mean for r in reputations(outcomes, hosts=hosts, suffixes=spark.createDataFrame([("io",), ("pages.io",), ("pages.io",)], "suffix string")).collect()}
    assert listed["x.bad.pages.io"] > 0.8 and 0.2 < listed["new.pages.io"] < 0.8 and set(plain) < set(listed)

def test_domains_and_suffixes(spark):
    hosts = {"a.b.com": ("b.com", "com"), "u:p@x.y.co.kr:8080": ("y.co.kr", "co.kr"), "gov.uk": ("gov.uk", "gov.uk"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "localhost": ("localhost", "localhost"), "a.de": ("a.de", "de")}
    d = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: (r.d, r.s) for r in d.select("host", *(c.alias(n) for c, n in zip(domain_and_suffix(F.col("host")), "ds"))).collect()} == hosts


def test_repeated_labels_count_once(spark):
    pages = spark.createDataFrame([("http://a.com/x/7",), ("http://a.com/x/8",)], "url string")
    labels = spark.createDataFrame([(7, 1), (7, 0), (7, 1), (8, None)], "doc_id long, quality int")
    assert [tuple(r) for r in page_outcomes(pages, labels).where("bad IS NOT NULL").collect()] == [("a.com", 1)]


# quality

def test_kth_largest_is_exact(spark):
    r = random.Random(6)
    values = [r.gauss(0, 50) for _ in range(3000)] + [1.25] * 500 + [None] * 7
    d = spark.createDataFrame([(v,) for v in values], "x double")
    ranked = sorted((v for v in values if v is not None), reverse=True)
    for k in (1, 2, 700, 1500, 1501, 3499, 3500, 9999):
        assert kth_largest(d, "x", k, exact=50, bins=16) == ranked[min(k, len(ranked)) - 1]
    assert kth_largest(d.limit(0), "x", 5) is None


def test_margin_is_in_the_gap():
    assert margin([5.0, 6.0, 7.0], [1.0, 2.0]) == 3.5
    assert margin([], [1.0]) == float("-inf")


def test_quality_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    shown, hidden = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    got = importance_resample(docs.select("doc_id", "text"), shown, carry=["doc_id"]).join(hidden, "doc_id").select("kept", "quality").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def brute_weights(rows, good, fitted_prior=10.0, excerpt=16):
    """Log weights by dictionaries of n-grams hashed one by one."""
    m64 = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & m64
        x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & m64
        return x ^ (x >> 33)

    def grams(text):
        data = (text or "").encode()
        if not data.strip():
            return [], []
        four = [((int.from_bytes(data[i : i + 4], "big") * 2654435761) & 0xFFFFFFFF) >> 16 for i in range(len(data) - 3)]
        h = [xxhash.xxh3_64_intdigest(w) for w in data.split()]
        two = [0xB5297A4D3F84D5B5 if a == b else mix((a * 3 + b) & m64) for a, b in zip(h, h[1:])]
        return four, [x >> 48 for x in h + two]

    found = {i: grams(t) for i, t in rows}
    out = dict.fromkeys(found, None)
    for family in (0, 1):
        raw = Counter(g for i in found for g in found[i][family])
        target = Counter(g for i in good for g in found[i][family])
        scale = sum(target.values()) / sum(raw.values())
        ratio = {g: math.log((target[g] + fitted_prior) / (raw[g] * scale + fitted_prior)) for g in raw}
        for i, parts in found.items():
            if parts[family]:
                out[i] = (out[i] or 0.0) + excerpt * sum(ratio[g] for g in parts[family]) / len(parts[family])
    return out


def test_quality_equals_brute_force(spark):
    r = random.Random(12)
    rows = [(i, prose(r, 40)) for i in range(60)] + [(100 + i, " ".join(r.choices(["zz", "zz", "qq!", "xj"], k=40))) for i in range(30)] + [(200, None), (201, " ")]
    quality = {i: int(i < 100) for i, t in rows if t and t.strip()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    got = importance_resample(docs, labels, carry=["doc_id"]).collect()
    held_out = {i for i in quality if xxhash.xxh3_64_intdigest(str(i), 11) % 3 == 0}
    expected = brute_weights(rows, [i for i, q in quality.items() if q and i not in held_out])
    for x in got:
        assert (x.log_weight is None) == (expected[x.doc_id] is None) and (x.log_weight is None or math.isclose(x.log_weight, expected[x.doc_id], abs_tol=1e-9))
    weights = {i: w for i, w in expected.items() if w is not None}
    good, bad = ([weights[i] for i in held_out if quality[i] == q] for q in (1, 0))
    values = sorted({*good, *bad})
    cut = min((sum(w < c for w in good) / len(good) + sum(w > c for w in bad) / len(bad), c) for c in [(a + b) / 2 for a, b in zip(values, values[1:])])[1]
    k = sum(w > cut for w in weights.values())
    assert {x.doc_id for x in got if x.kept} == {x.doc_id for x in sorted((x for x in got if x.score is not None), key=lambda x: -x.score)[:k]}


def test_inclusion_follows_the_weights_over_seeds(spark):
    """Gumbel top-1 takes a row with the probability of its weight."""
    share = [0.6, 0.3, 0.1]
    d = spark.range(4000).selectExpr("id AS trial").crossJoin(spark.createDataFrame([(i, math.log(p)) for i, p in enumerate(share)], "item int, w double"))
    scored = d.withColumn("score", F.col("w") + gumbel(F.struct("trial", "item"), 11))
    first = scored.groupBy("trial").agg(F.max_by("item", "score").alias("item")).groupBy("item").count().collect()
    got = {r["item"]: r["count"] / 4000 for r in first}
    assert all(abs(got[i] - p) < 0.03 for i, p in enumerate(share))


def test_noise_decides_between_close_weights(spark):
    r = random.Random(5)
    rows = [(i, prose(r, 12), "en", "s", 1) for i in range(200)] + [(500 + i, "zz qq " * 3 + prose(r, 10), "en", "s", 1) for i in range(100)]
    labels = spark.createDataFrame([(i, int(i < 500)) for i, *_ in rows if i % 2], "doc_id long, quality int")
    kept = [{x.doc_id for x in importance_resample(documents(spark, rows), labels, seed=seed, excerpt=2).where("kept").collect()} for seed in (1, 2, 3)]
    assert kept[0] != kept[1] != kept[2] and all(len(k & set(range(200))) > len(k) * 0.6 for k in kept)


def test_quality_edge_rows(spark):
    rows = [*corpus(7, 50), *EDGE]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    d = documents(spark, rows).withColumn("score", F.lit("clash"))
    out = {(r.doc_id, r.text): r.kept for r in importance_resample(d, labels).collect()}
    assert not out[900, None] and not out[901, ""] and not out[902, " \n "] and out[903, "one"]
    assert importance_resample(documents(spark, []), labels).count() == 0
    assert importance_resample(documents(spark, rows), labels.limit(0)).where("kept").count() == len(rows) - 3


# pipeline

def test_pipeline_stages_in_order(spark, sf_small):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicate", "packing"]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_small)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == list(corpus_pipeline.COLUMNS) and now <= ids and now, name
        ids = now
    packed = corpus_pipeline.packing(spark, docs, sf_small)
    with_words = {r.doc_id for r in docs.collect() if (r.text or "").split()}
    assert {r.doc_id for r in packed.select("doc_id").collect()} == with_words


def test_pipeline_stages_on_edge_rows(spark, sf_small):
    for rows in ([*EDGE, *EDGE], []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert set(stage(spark, docs, sf_small).columns) == set(corpus_pipeline.COLUMNS)
            assert stage(spark, docs, sf_small).count() <= len(rows)
        corpus_pipeline.packing(spark, docs, sf_small).count()
    kept = corpus_pipeline.near_duplicate(spark, documents(spark, [(903, "one", "en", "s", 3)] * 3), sf_small)
    assert kept.count() == 1


def test_near_duplicate_stage_goes_by_rows_not_by_ids(spark, sf_small):
    r = random.Random(9)
    first, other, third = prose(r, 60), prose(r, 60), prose(r, 60)
    rows = [(1, first, "en", "s", 1), (5, first, "en", "t", 1), (5, other, "en", "s", 1), (7, third, "en", "s", 1), (7, prose(r, 50), "en", "s", 1), (None, first, "en", "s", 1), (None, third + " more", "de", "s", 1)]
    rows += [(8, third, "en", "b", 2), (7, third, "en", "a", 2), (9, None, "en", "s", None), (9, None, "en", "s", None), (9, " ", "en", "s", None)]
    kept = [tuple(x) for x in corpus_pipeline.near_duplicate(spark, documents(spark, rows), sf_small).collect()]
    expected = [rows[0], rows[2], rows[8], rows[4], rows[9], rows[10], rows[11]]
    assert sorted(map(repr, kept)) == sorted(map(repr, expected))


def test_pipeline_by_brute_force(spark, tmp_path):
    """Lines, duplicates and packing of the pipeline recomputed from the documents that the first stage keeps."""
    r = random.Random(21)
    rows = [(i, "\n".join(["Site menu", prose(r, 30), prose(r, 30)]), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end", "en", "s0", 1) for i in range(10)] + [(200 + i, " ".join(r.choices(["zz", "qq!"], k=50)), "en", "s1", 1) for i in range(20)]
    folder = f"file://{tmp_path}"
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200)) for i, *_ in rows], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    first = {x.doc_id: x.text for x in corpus_pipeline.quality(spark, documents(spark, rows), folder).collect()}
    assert len(first) == 70 and len([i for i in first if i < 200]) >= 69
    cleaned = {i: "\n".join(x for x in t.split("\n") if x != "Site menu") for i, t in first.items()}
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in cleaned.items()}
    kept = [i for i in sorted(sets) if not any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets)]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted((x.doc_id, x.length) for x in packed) == [(i, len(cleaned[i].split())) for i in kept]
    bins = {}
    for x in packed:
        bins.setdefault(x.bin_id, []).append(x.source)
    assert all(len(set(b)) == len(b) for b in bins.values())
