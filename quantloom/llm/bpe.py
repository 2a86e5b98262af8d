"""Byte-pair encoding with a segment tree over adjacent pair ranks, and its decoding."""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import prepare
from .words import Memo, cut

NO_RANK = 1 << 62


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class Bpe:
    """A tokenizer file of kind BPE with byte-level pieces, word ends and lower-casing.

    Steps: the strings of special tokens are cut out; the rest is put in NFC, lower-cased and cut by the file's
    pattern; the bytes of each piece become symbols, the last with the word-end suffix, and adjacent symbols merge.
    """

    def __init__(self, path: str, remembered_bytes: int = 96 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [None] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        characters = byte_characters()
        self.inner = [vocab[c] for c in characters]
        self.last = [vocab[c + suffix] for c in characters]
        self.width = len(self.tokens)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] * self.width + vocab[b]] = (rank, vocab[a + b])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        marks = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        self.special = regex.compile(f"({marks})").split if marks else None
        self.marks = tuple({s[:2].encode() for s in self.specials})
        self.memo = Memo(remembered_bytes)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the leftmost pair of the lowest rank until no pair has a rank.

        Leaf i of the tree holds (rank, i) of the pair that starts at symbol i as one integer, inner nodes the least
        of their children; a merge changes three leaves and the paths above them, as far as a node changes.
        """
        n, width, merges = len(symbols), self.width, self.merges
        if n < 2:
            return symbols
        bits = (n - 1).bit_length()
        leaves, low = 1 << bits, (1 << bits) - 1
        tree = [NO_RANK] * (2 * leaves)
        into = [0] * n  # what the pair that starts here merges into
        for i in range(n - 1):
            found = merges.get(symbols[i] * width + symbols[i + 1])
            if found is not None:
                tree[leaves + i] = found[0] << bits | i
                into[i] = found[1]
        for k in range(leaves - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) < NO_RANK:
            i = root & low
            j = after[i]
            made = symbols[i] = into[i]
            symbols[j] = -1
            tree[leaves + j] = NO_RANK
            k = after[i] = after[j]
            found = None
            if k < n:
                before[k] = i
                found = merges.get(made * width + symbols[k])
            if found is None:
                tree[leaves + i] = NO_RANK
            else:
                tree[leaves + i] = found[0] << bits | i
                into[i] = found[1]
            h = before[i]
            if h >= 0:
                found = merges.get(symbols[h] * width + made)
                if found is None:
                    tree[leaves + h] = NO_RANK
                else:
                    tree[leaves + h] = found[0] << bits | h
                    into[h] = found[1]
            for at in (leaves + j, leaves + i, leaves + h) if h >= 0 else (leaves + j, leaves + i):
                at >>= 1
                while at:
                    left, right = tree[2 * at], tree[2 * at + 1]
                    least = left if left < right else right
                    if tree[at] == least:
                        break
                    tree[at] = least
                    at >>= 1
        return [s for s in symbols if s >= 0]

    def part(self, piece: str) -> list[int]:
        """Ids of one piece of the pattern."""
        data = piece.encode("utf-8", "surrogatepass")
        inner = self.inner
        return self.merge([*(inner[b] for b in data[:-1]), self.last[data[-1]]])

    def word(self, data: bytes) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of a run without blanks."""
        text = data.decode("utf-8", "replace")
        ids: list[int] = []
        for run in self.special(text) if any(m in data for m in self.marks) else (text,):
            if run in self.specials:
                ids.append(self.specials[run])
            elif run:
                lowered = run.lower() if run.isascii() else unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()
                if lowered.isalpha():  # letters only: one piece
                    ids += self.part(lowered)
                else:
                    for piece in self.pieces(lowered):
                        ids += self.part(piece)
        return array("I", ids).tobytes()

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        memo = self.memo
        # where a special token may stand, its letters keep their case and it stays in one piece
        words = text.split() if any(m in text for m in self.marks) else cut(text.lower())
        for word in memo.missing(words):
            memo.put(word, self.word(word))
        ids = b"".join(map(memo.young.__getitem__, words))
        memo.trim()
        return ids

    def decode(self, ids: bytes | None) -> str:
        """The token strings of ids, special ones too, joined by blanks (the file names no decoder); unknown ids are left out."""
        tokens, width = self.tokens, self.width
        return " ".join([t for t in (tokens[i] for i in np.frombuffer(ids or b"", "<u4").tolist() if i < width) if t is not None])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One tokenizer for all tasks of a worker process."""
    return Bpe(path)


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, n_tokens, ids), ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; repeated rows come back as often as they are; other columns are not looked at.
    Tokens never span blanks, so runs between blanks are encoded once and remembered (a bounded number of them),
    whatever the length of the text.
    """
    prepare(docs.sparkSession)

    def run(batches):
        bpe = load(tokenizer_path)
        for batch in batches:
            ids = [bpe.encode(text.as_py()) for text in batch.column(1)]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], names=[id_col, "n_tokens", "ids"])

    source = docs.select(id_col, F.col(text_col).cast("string").cast("binary").alias("__text"))
    return source.mapInArrow(run, f"`{id_col}` {source.dtypes[0][1]}, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded string of ``ids_col`` as ``into`` (replaced if there); null ids decode to an empty string."""
    prepare(encoded.sparkSession)
    source = encoded.select(*(c for c in encoded.columns if c != into))

    def run(batches):
        bpe = load(tokenizer_path)
        for batch in batches:
            decoded = pa.array([bpe.decode(ids.as_py()) for ids in batch.column(ids_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, into])

    return source.mapInArrow(run, f"{', '.join(f'`{name}` {kind}' for name, kind in source.dtypes)}, `{into}` string")
