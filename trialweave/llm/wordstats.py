"""Words of packed texts, their distinct forms, and hashed substring features of the distinct forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import Hasher, byte_set, mix, packed, per_text, spans

LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of the Latin-1 block in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.concatenate(([False], data[:-1] == 0xC3))
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


class Words:
    """Runs of letters of a slice of texts: all words in order, and the distinct ones with their features."""

    def __init__(self, column: pa.Array, hasher: Hasher):
        self.raw, self.first = packed(column)
        self.data = folded(self.raw)
        self.start, self.end = spans(self.data, LETTER)
        self.bound = per_text(self.start, self.first)
        self.hash = hasher.load(self.data)
        code = self.hash(self.start, self.end)
        self.distinct, example, self.form = np.unique(code, return_index=True, return_inverse=True)
        self.s, self.e = self.start[example], self.end[example]

    def ends(self, kind: int, size: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place of the distinct word, feature) of the prefix or suffix of ``size`` bytes, for longer words."""
        at = np.flatnonzero(self.e - self.s > size)
        s, e = self.s[at], self.e[at]
        return at, feature(self.hash(e - size, e) if back else self.hash(s, s + size), kind, size)

    def inner(self, kind: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the distinct word, feature) of every substring of ``size`` bytes."""
        count = np.maximum(0, self.e - self.s - size + 1)
        own = np.repeat(np.arange(len(count)), count)
        s = self.s[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        return own, feature(self.hash(s, s + size), kind, size)

    def whole(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(self.distinct)), feature(self.distinct, kind, 0)

    def point(self, at: np.ndarray) -> np.ndarray:
        """Code point offsets in their text of byte positions."""
        lead = np.concatenate(([0], np.cumsum((self.raw & 0xC0) != 0x80)))
        text = np.searchsorted(self.first, at, side="right") - 1
        return lead[at] - lead[self.first[text]]


def feature(code: np.ndarray, kind: int, size: int) -> np.ndarray:
    return mix(code + np.uint64((kind * 1000 + size) * 0xC2B2AE3D27D4EB4F % (1 << 64)))
