"""BPE against the tokenizers library, codes by exact round trips, token files by reading back."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantloom.llm.bpe import Bpe, bpe_decode, bpe_encode
from quantloom.llm.dac import Segment, encode
from quantloom.llm.registry import QUERIES
from quantloom.llm.token_store import LibraryTokenizer, read_documents, tokens_at, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OWN, CACHED = Tokenizer.from_file(PATH), Bpe(PATH), LibraryTokenizer(PATH)
ALPHABET = list("abc ABC'sΣςσİıßﬁ’ \t\n\x0b\x1c\x1f\x85\xa0​ 　éÉǅ漢字١٢½Ⅷ🤗#$%.,!<|>") + ["<|endoftext|>", "<|startoftext|>", "'re", "é", "﻿", "Å"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join))
def test_own_encoding_is_the_library_s(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(OWN.encode(text.encode()), "<u4").tolist() == expected
    assert np.frombuffer(CACHED([text.encode()])[0], CACHED.dtype).tolist() == expected
    assert OWN.decode(np.array(expected, "<u4").tobytes()) == LIBRARY.decode(expected, skip_special_tokens=False)


def test_long_run_without_blanks():
    text = "ab" * 20_000 + "é" * 3_000
    assert np.frombuffer(OWN.encode(text.encode()), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_small_memory_changes_nothing():
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdef", k=r.randint(1, 6))) for _ in range(80)) for _ in range(30)]
    own, cached = Bpe(PATH, remembered_bytes=700), LibraryTokenizer(PATH, remembered_bytes=700)
    for text in texts:
        expected = LIBRARY.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == expected
        assert np.frombuffer(cached([text.encode()])[0], cached.dtype).tolist() == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.sampled_from([8, 16]), st.randoms())
def test_codes_round_trip(values, chunk_bits, r):
    ids = np.array(values, np.uint32)
    segment = Segment(encode(ids, chunk_bits))
    assert len(segment) == len(ids) and (segment.slice(0, len(ids)) == ids).all()
    for _ in range(5):
        a, b = sorted((r.randint(0, len(ids)), r.randint(0, len(ids))))
        assert (segment.slice(a, b) == ids[a:b]).all()
        if len(ids):
            i = r.randrange(len(ids))
            assert segment[i] == ids[i]
    with pytest.raises(IndexError):
        segment[len(ids)]


ROWS = [(5, "Hello there, world"), (1, None), (3, ""), (9, "x" * 3000 + " tail"), (None, "no id"), (3, "again three"), (7, "<|endoftext|>")]


def test_written_files_give_every_document_back(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, ids string").repartition(3)
    path = f"file://{tmp_path}/tokens"
    write_tokens(docs, path, PATH, segment_ids=6)
    found = sorted(read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 1, 3, 3, 5, 7, 9]
    at, flat = 0, []
    by_text = {tuple(LIBRARY.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in ROWS}
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.start, r.n_tokens) == (at, len(ids)) and tuple(ids) in by_text
        at, flat = at + len(ids), flat + ids
    places = spark.createDataFrame([(p,) for p in [*range(len(flat)), -1, len(flat)]], "place long")
    assert sorted((r.place, r.id) for r in tokens_at(spark, path, places).collect()) == list(enumerate(flat))


def test_empty_table_writes_no_segment(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", PATH)
    assert read_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_encode_and_decode_columns(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, decoded string")
    encoded = bpe_encode(docs, PATH)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    found = {(r.doc_id, r.n_tokens, r.decoded) for r in bpe_decode(encoded, PATH).collect()}
    expected = set()
    for doc_id, text in ROWS:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        expected.add((doc_id, len(ids), LIBRARY.decode(ids, skip_special_tokens=False)))
    assert found == expected


def test_queries_on_the_smallest_tables(spark, sf_small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    ids = {k: LIBRARY.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    for r in QUERIES["op7_segment_tree_bpe"](spark, sf_small).collect():
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    start = 0
    for r in sorted(QUERIES["op4_directly_addressable_tokens"](spark, sf_small).collect(), key=lambda r: r.doc_id):
        own = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
