"""Cutting texts into words that no token spans, and a memory of encoded words, bounded in bytes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: ASCII letters and digits, and ASCII characters that are neither these nor blanks: a piece ends between the two.
ALPHANUMERIC = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
PUNCTUATION = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])


def cut(text: bytes) -> list[bytes]:
    """The text cut at blanks, and before punctuation that follows a letter or digit."""
    raw = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(PUNCTUATION[raw[1:]] & ALPHANUMERIC[raw[:-1]]) + 1
    return (np.insert(raw, ends, 32).tobytes() if len(ends) else text).split()


class Memo:
    """Two generations of entries: when the younger exceeds ``limit`` bytes, it becomes the older and that one is dropped.

    ``young`` can be read directly; ``missing`` moves what it finds in the older generation there, so entries in use stay.
    """

    OVERHEAD = 180  # bytes of an entry besides its word and value
    LONGEST = 60  # bytes of a word that is kept beyond its batch

    def __init__(self, limit: int):
        self.limit, self.used, self.young, self.older, self.long = limit, 0, {}, {}, []

    def put(self, word, value) -> None:
        self.young[word] = value
        if len(word) > self.LONGEST:
            self.long.append(word)
        else:
            self.used += self.OVERHEAD + len(word) + len(value)

    def missing(self, words: Iterable) -> list:
        """Those of ``words`` that are in neither generation; the others are in ``young`` afterwards."""
        out, old = [], self.older.get
        for word in set(words).difference(self.young):
            value = old(word)
            if value is None:
                out.append(word)
            else:
                self.put(word, value)
        return out

    def trim(self) -> None:
        """Forget long words, and the older generation if the younger has grown past the limit."""
        for word in self.long:
            self.young.pop(word, None)
        self.long.clear()
        if self.used > self.limit:
            self.young, self.older, self.used = {}, self.young, 0
