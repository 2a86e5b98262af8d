"""Runs of repeated word sequences, found with a suffix automaton and merged end-position sets."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import prepare
from .shingles import GOLDEN, U, mixed

FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
AT_ONCE = 200_000  # words that are searched for stretches together


class Automaton:
    """Suffix automaton of a sequence of integers.

    State 0 is the empty word. ``length`` is that of a state's longest word, ``link`` the state of its longest suffix
    with more end positions, ``own`` the end position that a state adds to those of its children (-1 for copies).
    Most states have one transition, kept in two arrays; those with more have a dict for the others.
    """

    def __init__(self, word: list[int]):
        self.length, self.link, self.own = array("q", [0]), array("q", [-1]), array("q", [-1])
        length, link, own = self.length, self.link, self.own
        symbol, target = array("q", [-1]), array("q", [-1])
        others: dict[int, dict[int, int]] = {}
        last = 0
        for place, c in enumerate(word):
            new = len(length)
            length.append(place + 1)
            link.append(0)
            own.append(place)
            symbol.append(-1)
            target.append(-1)
            p, found = last, -1
            while p >= 0:
                if symbol[p] == c:
                    found = target[p]
                    break
                more = others.get(p)
                if more is not None and c in more:
                    found = more[c]
                    break
                if symbol[p] < 0:
                    symbol[p], target[p] = c, new
                elif more is None:
                    others[p] = {c: new}
                else:
                    more[c] = new
                p = link[p]
            last = new
            if found < 0:
                continue
            if length[found] == length[p] + 1:
                link[new] = found
                continue
            copy = len(length)  # takes over the shorter words of ``found``
            length.append(length[p] + 1)
            link.append(link[found])
            own.append(-1)
            symbol.append(symbol[found])
            target.append(target[found])
            if found in others:
                others[copy] = dict(others[found])
            link[found] = link[new] = copy
            while p >= 0:
                if symbol[p] == c:
                    if target[p] != found:
                        break
                    target[p] = copy
                else:
                    more = others.get(p)
                    if more is None or more.get(c) != found:
                        break
                    more[c] = copy
                p = link[p]


def has_period(word: np.ndarray, period: int) -> bool:
    return bool((word[period:] == word[:-period]).all())


def runs_of(word: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least ``least`` symbols and ``exponent`` smallest periods.

    ``exponent`` is 3 or more. States are taken from the longest words down, and each gives its end positions to its
    link, the smaller ordered set into the larger. Where that makes ends x < y neighbours at a state of length n, the
    words that end there agree in their last n symbols and in no more; so with a distance d = y - x of at most n, a
    repetition of period d reaches from x - n to y and no further back, and the greatest y for one (start, d) is where
    the run ends. Neighbours that a later end separates may name a multiple of the smallest period; these are dropped.
    """
    automaton = Automaton(word.tolist())
    length, link, own = automaton.length, automaton.link, automaton.own
    ends: dict[int, list[int]] = {}  # end positions, negated and ascending: a state's own is its least, so it goes last
    last: dict[tuple[int, int], int] = {}
    for state in np.argsort(-np.frombuffer(length, np.int64), kind="stable")[:-1].tolist():
        small = ends.pop(state, None) or [-own[state]]
        parent = link[state]
        if parent <= 0:
            continue
        large = ends.get(parent)
        if large is None:
            large = [-own[parent]] if own[parent] >= 0 else []
        if len(small) > len(large):
            small, large = large, small
        n = length[parent]
        reach = n // (exponent - 1)
        before = 1  # of the smaller set; two of its own ends have met at a longer word
        for x in small:
            at = bisect_left(large, x)
            if at and large[at - 1] != before and x - large[at - 1] <= reach:  # an end after this one
                key = (1 - x - n, x - large[at - 1])
                last[key] = max(last.get(key, 0), -large[at - 1])
            if at < len(large) and large[at] - x <= reach:  # one before it
                key = (1 - large[at] - n, large[at] - x)
                last[key] = max(last.get(key, 0), -x)
            large.insert(at, x)
            before = x
        ends[parent] = large
    out = []
    for (start, period), end in last.items():
        size = end + 1 - start
        if size < max(least, exponent * period):
            continue
        part = word[start : end + 1]
        if not any(period % p == 0 and has_period(part, period // p) for p in prime_factors(period)):
            out.append((start, size, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def stretches(words: np.ndarray, document: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Disjoint (low, high) outside of which no run lies; ``document`` is the ascending number of each word's text.

    In a run of period q, each group of k words that begins after the first q has an equal one at most q before it,
    and there are at least max(least, exponent * q) - q - k + 1 of these in a row. So where m such places follow each
    other, q is at most (m + k - 1) / (exponent - 1), and places whose equal group is farther back cannot belong to a
    run; without them the rows of places get shorter, and so on until nothing changes.
    """
    k = min(4, *(max(least, exponent * q) - q for q in range(1, least + 1)))
    count = len(words) - k + 1
    if count < 1:
        return []
    grams = mixed(document[:count].astype(U) * GOLDEN + U(1))
    for i in range(k):
        grams = mixed(grams * GOLDEN + words[i : i + count].astype(U))
    order = np.argsort(grams, kind="stable")
    back = np.zeros(count, np.int64)  # how far back the nearest equal group is, 0 where there is none
    equal = grams[order[1:]] == grams[order[:-1]]
    back[order[1:][equal]] = (order[1:] - order[:-1])[equal]
    back[document[k - 1 :] != document[:count]] = 0  # a group that reaches into the next text
    places = np.flatnonzero(back)
    while len(places):
        breaks = np.flatnonzero((np.diff(places) > 1) | (document[places[1:]] != document[places[:-1]])) + 1
        first, last = np.append(0, breaks), np.append(breaks, len(places))
        most = (last - first + k - 1) // (exponent - 1)
        kept = back[places] <= np.repeat(most, last - first)
        if kept.all():
            begins = np.searchsorted(document, document[places[first]])  # of the texts
            low, high = np.maximum(places[first] - most, begins), places[last - 1] + k
            out: list[list[int]] = []
            for begin, a, b in sorted(zip(begins.tolist(), low.tolist(), high.tolist())):
                if out and out[-1][0] == begin and a < out[-1][2]:
                    out[-1][2] = max(b, out[-1][2])
                else:
                    out.append([begin, a, b])
            return [(a, b) for _, a, b in out]
        places = places[kept]
    return []


def find_runs(texts: list[list[bytes]], least: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(words) for words in texts], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return found
    words = np.concatenate([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in texts])
    document = np.repeat(np.arange(len(texts)), sizes)
    begins = np.cumsum(sizes) - sizes
    for low, high in stretches(words, document, least, exponent):
        text = int(document[low])
        shift = low - int(begins[text])
        found[text] += [(shift + s, n, p) for s, n, p in runs_of(words[low:high], least, exponent)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    dropped = bytearray(len(words))
    for start, length, period in runs:
        dropped[start + period : start + length] = b"\1" * (length - period)
    return b" ".join([w for w, d in zip(words, dropped) if not d])


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``n_words``, ``runs`` (start, length, period, in words) and ``collapsed`` text, beside ``id_col``.

    Words are the runs of bytes other than space and ``\\x09-\\x0D``. A run is a stretch of words with smallest period
    q, of at least ``least`` words and ``exponent`` (3 or more) periods, that no neighbouring word extends. The
    collapsed text leaves out what a run holds after its first period. Null, empty and blank texts have no words, no
    runs and an empty collapsed text; ids may be null; repeated rows come back as often as they are; other columns are
    not looked at; an empty table gives no rows. Texts are worked on one by one within a task, whole; only the
    stretches that can hold a run (``stretches``) go through the automaton.
    """
    if exponent < 3 or least < 2:
        raise ValueError("runs have at least three periods and two words")
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("__text"))

    def run(batches):
        for batch in batches:
            held, size, done = [], 0, []
            texts = batch.column(1)
            for i in range(len(texts)):
                held.append((texts[i].as_py() or b"").split())
                size += len(held[-1])
                if size >= AT_ONCE or i + 1 == len(texts):
                    done += [(len(w), r, collapsed(w, r)) for w, r in zip(held, find_runs(held, least, exponent))]
                    held, size = [], 0
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r, _ in done], kind)
            columns = [batch.column(0), pa.array([n for n, _, _ in done], pa.int64()), runs, pa.array([c for _, _, c in done], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "runs", "collapsed"])

    return source.mapInArrow(run, f"`{id_col}` {source.dtypes[0][1]}, {FOUND}")
