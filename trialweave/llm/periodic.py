"""Periodic runs of words inside texts.

A run is a stretch of words with smallest period q and length >= max(12, 2q) that no neighbour extends. On the
diagonal of lag q (word i against word i + q) it is a matching stretch of at least max(12 - q, q) places, so lags
fall into classes: every stretch of lags [2k, 4k) is 2k long or longer and holds a whole k-gram that starts at a
multiple of k (lags below 8 with k = 2). For each class k = 2, 4, 8, ...

- index: k-grams get exact numbers, each from the pair of its halves; a gram that does not recur is dropped at once,
  so ordinary text leaves the index after a few classes;
- seeds: each gram at a multiple of k meets the occurrences of the same gram at the lags of the class: at most 2k
  lags for one gram in k, so at most two pairs for each word and class, also in a text that repeats one word;
- extension: seeds of one lag that follow each other at distance k are one stretch, and the furthest place covered on
  that lag suppresses all of them but the first; the ends lie less than k places out and are found by halving.

A stretch of a lag that is no smallest period has the same bounds as one of a smaller lag and is dropped. The work is
O(n log n) comparisons of numbers for a text of n words, whatever it repeats. Texts are handled whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_set, lists, packed, per_text, spans, with_column

LEAST = 12  # words of a run, and
TIMES = 2  # periods of a run, at least
WORD = byte_set((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))
KIND = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where those of each text begin (one entry more at the end)."""
    data, first = packed(column)
    start, end = spans(data, WORD)
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[WORD[data]]))
    return words, per_text(start, first)


def doubled(name: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the grams of twice ``size`` words from those of ``size``; -1 where a gram occurs once."""
    out = np.full(len(name), -1, np.int32)
    at = np.flatnonzero((name[:-size] >= 0) & (name[size:] >= 0)) if len(name) > size else np.zeros(0, np.int64)
    code, back, count = np.unique(name[at].astype(np.int64) * (len(name) + 1) + name[at + size], return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
    out[at] = number[back]
    return out


def seeds(name: np.ndarray, size: int, low: int, high: int) -> np.ndarray:
    """Sorted codes lag * words + place: grams at multiples of ``size`` that recur at lags [low, high)."""
    n = np.int64(len(name))
    place = np.flatnonzero(name >= 0)
    index = np.sort(name[place] * n + place)
    anchor = place[place % size == 0]
    base = name[anchor] * n
    left = np.searchsorted(index, base + np.minimum(anchor + low, n))
    count = np.searchsorted(index, base + np.minimum(anchor + high, n)) - left
    own = np.repeat(np.arange(len(anchor)), count)
    other = index[np.repeat(left - np.cumsum(count) + count, count) + np.arange(len(own))] - base[own]
    return np.sort((other - anchor[own]) * n + anchor[own])


def same(name: np.ndarray, a: np.ndarray, lag: np.ndarray, size: int) -> np.ndarray:
    """Whether the grams at ``a`` and ``a + lag`` are equal; places outside are not."""
    fine = (a >= 0) & (a + lag + size <= len(name))
    a = np.where(fine, a, 0)
    b = np.where(fine, a + lag, 0)
    return fine & (name[a] >= 0) & (name[a] == name[b])


def stretches(names: list[np.ndarray], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, lag) of the matching stretches that the seeds of one class lie in and that are long enough."""
    n, level = len(names[0]), len(names) - 1
    size = 1 << level
    opens = np.flatnonzero(np.diff(code, prepend=-1 - size) != size)  # a seed that no covered stretch leads to
    closes = np.append(opens[1:], len(code)) - 1 if len(opens) else opens
    lag, first, last = code[opens] // n, code[opens] % n, code[closes] % n
    need = np.maximum(LEAST - lag, (TIMES - 1) * lag)
    able = last - first + 3 * size - 2 >= need
    lag, start, end, need = lag[able], first[able], last[able] + size, need[able]
    for half in reversed(range(level)):
        step = 1 << half
        start = np.where(same(names[half], start - step, lag, step), start - step, start)
        end = np.where(same(names[half], end, lag, step), end + step, end)
    long = end - start >= need
    return start[long], end[long], lag[long]


def runs(form: np.ndarray, text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period; ``form`` numbers the words, ``text`` their texts."""
    _, own = np.unique(text.astype(np.int64) * (len(form) + 1) + form, return_inverse=True)  # texts share no word
    names, found = [own.astype(np.int32)], []
    while True:
        size = 1 << len(names)
        low, high = (1, 8) if size == 2 else (2 * size, 4 * size)
        if TIMES * low > longest:
            break
        names.append(doubled(names[-1], size // 2))
        code = seeds(names[-1], size, low, high)
        if not len(code) and not (names[-1] >= 0).any():
            break
        found.append(stretches(names, code))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))
    length = end - start + period
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])  # the same bounds again: not the smallest period
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def analyse(column: pa.Array) -> pa.StructArray:
    """Runs and collapsed text of every text of an Arrow array."""
    words, bound = words_of(column)
    count = np.diff(bound)
    text = np.repeat(np.arange(len(count)), count)
    form = words.dictionary_encode().indices.to_numpy() if len(words) else np.zeros(0, np.int64)
    start, length, period = runs(form, text, int(count.max(initial=0)))
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    collapsed = pc.binary_join(lists(words.take(pa.array(kept)), np.bincount(text[kept], minlength=len(count))), " ")
    holder = text[start]
    listed = pa.StructArray.from_arrays([pa.array(start - bound[holder]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    return pa.StructArray.from_arrays([lists(listed, np.bincount(holder, minlength=len(count))), collapsed], names=["runs", "collapsed"])


def find_runs(docs: DataFrame, text: str = "text", out: str = "periodic", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``: the runs (word numbers from 0), and the text without what repeats.

    ``collapsed`` holds the words, joined by one space, but for those that lie in a run after its first period. A null
    or empty text, or one of white space, has no run and collapses to the empty text. One row for each row, repeated
    or not; ties cannot arise; a column already called ``out`` is replaced.
    """
    return with_column(docs, text, out, KIND, lambda: analyse, keep)


def planted(ident: Column, text: Column) -> Column:
    """The text with its tail made periodic where crc32 of the id as text is divisible by ten; others as they are.

    From word a = g % n on, g being that number's tenth, word i becomes word a + (i - a) % p, p = 1 + (n - a) div
    (3 + g % 8). The changed text is its words joined by a space; a missing id and a text without words change nothing.
    """
    code = F.crc32(ident.cast("string"))
    g = F.floor(code / 10)

    def change(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.when(n > 0, F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " "))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), change), F.lit(0))  # the words are bound once
    return F.when(code % 10 == 0, F.coalesce(changed, text)).otherwise(text)
