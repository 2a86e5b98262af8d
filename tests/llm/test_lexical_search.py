"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from quantloom.llm import lexical_search
from quantloom.llm.lexical_search import index_documents, search
from quantloom.llm.registry import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute_ranks(docs, items, k=10):
    held = [(doc_id, Counter(t), len(t)) for doc_id, text in docs if (t := terms_of(text))]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, tf, n in held:
            m = 25 + (75 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms_of(text) if tf[t])
            if score > 0:
                scores.append((-score, math.inf if doc_id is None else doc_id))
        out += [(item_id, rank, None if d == math.inf else d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def ranked(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query_by_brute_force(spark, sf_small):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{sf_small}/{name}.parquet").select(key, "text").collect()]
    expected = brute_ranks(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert ranked(QUERIES["op12_ranked_lexical_search"](spark, sf_small)) == expected
    assert len(expected) > 100


@pytest.mark.parametrize("segment_terms, at_once, block", [(1 << 21, 1 << 20, 4096), (700, 40, 4096), (5000, 1 << 20, 12)])
def test_segments_passes_and_blocks_change_nothing(spark, monkeypatch, segment_terms, at_once, block):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[int(60 * r.random() ** 2)] for _ in range(n))
    docs = [(i, text(r.choice((3, 20, 20, 150)))) for i in range(900)]
    docs += [(2000 + i, "w3 w4 w59 the same text") for i in range(400)]  # equal scores: the least ids win
    items = [(i, text(r.choice((1, 4, 12)))) for i in range(25)] + [(100, "w59 w3 w3"), (101, "nowhere"), (102, "text same")]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string").repartition(3)
    got = search(index_documents(frame(docs, "doc_id"), segment_terms), frame(items, "item_id"), at_once=at_once)
    assert ranked(got) == brute_ranks(docs, items)


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (None, "alpha beta"), (None, "alpha beta"), (7, "Alpha-BETA"), (7, "gamma"), (8, "Éa éa ÉA x" * 3), (9, "b" * 100_000)]
    docs += [(10 + i, "filler words of no item") for i in range(9)]
    items = [(1, "alpha"), (1, "alpha"), (2, None), (2, "  "), (None, "gamma beta"), (3, "gamma"), (3, "beta alpha alpha"), (4, "É"), (5, "éa Éa"), (6, "B" * 100_000)]
    frame = lambda rows, key: spark.createDataFrame([(a, b, 1, 2) for a, b in rows], f"{key} long, text string, terms int, score int")
    got = search(index_documents(frame(docs, "doc_id")), frame(items, "item_id"))
    assert ranked(got) == brute_ranks(docs, list(dict.fromkeys(items)))
    none = frame(docs, "doc_id").limit(0)
    assert search(index_documents(none), frame(items, "item_id")).count() == 0
    assert search(index_documents(frame(docs, "doc_id")), frame(items, "item_id").limit(0)).count() == 0
