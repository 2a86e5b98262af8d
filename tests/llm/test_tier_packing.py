"""Packing into windows of several sizes: every token once, no padding, tiers filled from shorter pieces."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantloom.llm.registry import QUERIES
from quantloom.llm.tier_packing import balanced_steps, pack_tiers, pack_token_tiers

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def brute_tiers(lengths, longest):
    """The same rule over a plain list of (length, piece, first), searched from end to end."""
    supply = [(n, i, 0) for i, n in enumerate(lengths)]
    newest = []  # of equal lengths, what was put back last comes first, then the least piece
    windows = []

    def take(ok, best):
        fitting = [s for s in newest[::-1] + supply if ok(s[0])]
        if not fitting:
            return None
        n = best(s[0] for s in fitting)
        found = next(s for s in fitting if s[0] == n)
        (newest if found in newest else supply).remove(found)
        return found

    while supply or newest:
        n, piece, first = take(lambda n: True, max)
        size = 1
        while size < n:
            size *= 2
        window, gap = [(piece, first, n)], size - n
        while gap and (supply or newest):
            found = take(lambda n: n <= gap, max)
            if not found:
                n, piece, first = take(lambda n: True, min)
                newest.append((n - gap, piece, first + gap))
                found = (gap, piece, first)
            n, piece, first = found
            window.append((piece, first, n))
            gap -= n
        windows.append(window)
    return windows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_tiers_by_brute_force(lengths):
    got, expected = pack_tiers(lengths, 64), brute_tiers(lengths, 64)
    if expected and sum(n for _, _, n in expected[-1]).bit_count() > 1:  # the last window is cut into powers of two
        expected, last = expected[:-1], expected[-1]
        tail = [x for w in got[len(expected) :] for x in w]
        sizes = [sum(n for _, _, n in w) for w in got[len(expected) :]]
        assert sizes == sorted(sizes, reverse=True) and sum(sizes) == sum(n for _, _, n in last) and all(s.bit_count() == 1 for s in sizes)
        assert [p for p, _, n in tail for _ in range(n)] == [p for p, _, n in last for _ in range(n)]
        got = got[: len(expected)]
    assert got == expected


def test_every_token_lies_in_one_piece():
    r = random.Random(2)
    lengths = [r.choice((r.randint(1, 40), r.randint(1, 4096), 4096)) for _ in range(3000)]
    windows = pack_tiers(lengths)
    seen = defaultdict(list)
    for w in windows:
        assert sum(n for _, _, n in w).bit_count() == 1
        for piece, first, n in w:
            seen[piece].append((first, n))
    for piece, parts in seen.items():
        at = 0
        for first, n in sorted(parts):
            assert first == at
            at += n
        assert at == lengths[piece]
    assert len(seen) == len(lengths)
    # few pieces are cut, and most tokens lie in the longest windows
    assert sum(len(p) for p in seen.values()) < 1.35 * len(lengths)


def test_steps_are_balanced():
    r = random.Random(3)
    windows = pack_tiers([int(min(4095, r.lognormvariate(5.5, 1.2)) + 1) if i % 50 else 4096 for i in range(4000)])
    steps = balanced_steps(windows, 1 << 16)
    tokens, cost = Counter(), Counter()
    for w, s in zip(windows, steps):
        tokens[s] += sum(n for _, _, n in w)
        cost[s] += sum(n * n for _, _, n in w)
    assert max(tokens.values()) - min(tokens.values()) <= 4096 and max(tokens.values()) <= (1 << 16) + 4096
    assert max(cost.values()) < 1.3 * sum(cost.values()) / len(cost)


def check(rows, texts):
    """Pieces of each document cover its ids; sequences are gapless, of one group of steps, powers of two."""
    expected = Counter()
    for doc_id, text in texts:
        expected[(doc_id, (*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2))] += 1
    ids = {k: np.array(k[1], "<u4") for k in expected}
    pieces = Counter()
    by_doc = defaultdict(list)
    for key in expected:
        by_doc[(key[0], len(key[1]))].append(key)
    for r in rows:
        crc = r.ids_crc32 if hasattr(r, "ids_crc32") else zlib.crc32(r.ids)
        keys = by_doc[(r.doc_id, r.doc_tokens)]
        key = next(k for k in keys if zlib.crc32(ids[k][r.start : r.start + r.length].tobytes()) == crc and (len(keys) == 1 or pieces[(k, r.start)] < expected[k]))
        pieces[(key, r.start)] += 1
    covered = Counter()
    for r in rows:
        covered[(r.doc_id, r.doc_tokens)] += r.length
    assert covered == Counter({k: k[1] * sum(expected[x] for x in v) for k, v in by_doc.items()} )
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length, r.tier, r.step_group))
    for parts in sequences.values():
        at = 0
        for offset, length, tier, step in sorted(parts):
            assert offset == at and (tier, step) == parts[0][2:]
            at += length
        assert at == parts[0][2] and at.bit_count() == 1 and at <= 4096


def test_query(spark, sf_small):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op11_hierarchical_packing"](spark, sf_small).collect(), docs)


def test_edge_rows_and_groups(spark):
    texts = [(1, None), (2, ""), (None, "one two"), (None, "one two"), (3, "long text " * 9000), (4, "<|endoftext|> x")] + [(9, "copy of a row")] * 40 + [(i, f"short {i} " * (i % 37)) for i in range(100, 400)]
    docs = spark.createDataFrame([(a, b, 1, 2, "s") for a, b in texts], "doc_id long, text string, length int, copies int, tie string")
    packed = pack_token_tiers(docs, PATH, group_bytes=20_000, hot_rows=10)
    rows = packed.collect()
    check(rows, texts)
    assert len({r.sequence_id >> 32 for r in rows}) > 3
    assert sum(r.length for r in rows if r.doc_id == 9) == 40 * next(r.doc_tokens for r in rows if r.doc_id == 9)
    again = pack_token_tiers(docs.repartition(5), PATH, group_bytes=20_000, hot_rows=10).collect()
    assert Counter(map(repr, rows)) == Counter(map(repr, again))
    assert pack_token_tiers(docs.limit(0), PATH).count() == 0
