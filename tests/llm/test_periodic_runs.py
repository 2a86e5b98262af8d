"""Runs against brute force: all periods of all stretches, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm.periodic_runs import find_runs, periodic_runs, runs_of
from quantloom.llm.registry import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def brute_runs(words, least=6, exponent=4):
    """Maximal stretches of each period from the places where words that far apart are equal; the smallest period names one."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q), q)  # a multiple of a period found before spans the same stretch
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 7)), max_size=8), st.sampled_from([(6, 4), (2, 3), (9, 3), (5, 5)]))
def test_automaton_finds_every_run(parts, rule):
    words = [x for part, times in parts for x in part * times]
    expected = brute_runs(words, *rule)
    assert sorted(runs_of(np.array(words, np.int64), *rule)) == expected
    assert sorted(find_runs([[b"%d" % w for w in words]], *rule)[0]) == expected


def test_stretches_of_many_texts_lose_no_run():
    r = random.Random(5)
    texts = []
    for _ in range(300):
        words = []
        while len(words) < r.choice((0, 3, 30, 400)):
            period = [b"%d" % r.randint(0, r.choice((2, 9, 200))) for _ in range(r.randint(1, 30))]
            words += (period * r.randint(1, 6))[: r.randint(1, 90)]
        texts.append(words)
    assert find_runs(texts) == [[*brute_runs(w)] for w in texts]
    assert sum(map(len, find_runs(texts))) > 50


@pytest.mark.parametrize("period", [1, 2, 999])
def test_long_run(period):
    words = [b"%d" % (i % period) for i in range(30_000)]
    assert find_runs([[b"x", *words, b"y"]]) == [[(1, 30_000, period)]]


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n ", None), (None, "a " * 9, "c"), (None, "a " * 9, "c"), (5, "a b " * 3 + "a", "d"), (6, "X\x0by " * 4 + "é", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed).decode()) for r in periodic_runs(docs).collect()), key=repr)
    expected = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 9, [(0, 9, 1)], "a"), (None, 9, [(0, 9, 1)], "a"), (5, 7, [], "a b a b a b a"), (6, 9, [(0, 8, 2)], "X y é")]
    assert got == sorted(expected, key=repr)
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, exponent=2)


def test_query_by_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for doc_id, text in docs:
        for c in SPACE:
            text = (text or "").replace(c, " ")
        words = [w for w in text.split(" ") if w]
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        s, size, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        digest = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2]))).encode()).hexdigest()
        collapsed = hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
        expected[doc_id] = (len(runs), s, size, q, 1000 * size // q if runs else None, digest, collapsed)
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_periodic_run_detection"](spark, sf_small).collect()}
    assert got == expected
    assert sum(v[0] for v in expected.values()) > 5
