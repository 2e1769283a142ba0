"""Benchmark passages in documents, by Wu-Manber multi-pattern search over words.

* The test strings are the windows of the items: WINDOW consecutive words, or the whole item where it is shorter.
  Words are runs of digits, letters and bytes above 0x7F after folding A-Z.
* The alphabet is the hashed words, a block is two of them. For each window length a shift table over hashed
  blocks says how far the search may jump; where it says zero, windows whose last and first block agree are
  selected from sorted buckets, and the words themselves are compared byte by byte.
* Ranges of end positions are searched side by side, so one long document is no long loop.
* The benchmark is read in blocks of at most BLOCK_BYTES of text (its size is measured first); each block is one
  more pass over the rows and adds to the marks of the last, without any shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import Hasher, byte_set, lists, mix, packed, per_text, slices, spans, trim, with_text

WINDOW = 13
BLOCK_BYTES = 8 << 20  # benchmark text sent to the executors at once
TABLE_BITS = 18
PIECE = 128  # end positions searched by one runner

WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def block_code(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


class Table:
    """Windows of one length: shift table, buckets and the strings for the last comparison."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[str]], hasher: Hasher):
        self.length, self.block = length, min(2, length)
        self.strings = list(windows)
        data = np.frombuffer(b"\n" + b"\n".join(w for s in self.strings for w in s) + b"\n", np.uint8)
        start, end = spans(data, WORD)
        self.words = hasher.load(data)(start, end).reshape(-1, length)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.int16)
        for last in range(self.block - 1, length):
            np.minimum.at(self.shift, self.slot(self.code(self.words, last)), length - 1 - last)
        bucket = self.bucket(self.code(self.words, length - 1), self.code(self.words, self.block - 1))
        order = np.argsort(bucket, kind="stable")
        self.bucket_of, self.words = bucket[order], self.words[order]
        self.strings = [self.strings[i] for i in order.tolist()]
        self.items = [sorted(windows[s]) for s in self.strings]

    def code(self, words: np.ndarray, last: int) -> np.ndarray:
        return words[:, last] if self.block == 1 else block_code(words[:, last - 1], words[:, last])

    @staticmethod
    def slot(code: np.ndarray) -> np.ndarray:
        return (code >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    @staticmethod
    def bucket(last: np.ndarray, head: np.ndarray) -> np.ndarray:
        return mix(last * np.uint64(3) + head)

    def ends(self, h: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Positions where the shift is zero, over all texts."""
        low, high = bound[:-1] + self.length - 1, bound[1:]
        count = np.maximum(0, -(-(high - low) // PIECE))
        own = np.repeat(np.arange(len(low)), count)
        at = low[own] + PIECE * (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count))
        stop = np.minimum(at + PIECE, high[own])
        found = []
        while len(at):
            code = h[at] if self.block == 1 else block_code(h[at - 1], h[at])
            step = self.shift[self.slot(code)].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, h: np.ndarray, bound: np.ndarray, word_at) -> tuple[np.ndarray, np.ndarray]:
        """(end, window) of every occurrence."""
        end = self.ends(h, bound)
        if not len(end):
            return end, end
        first = end - self.length + 1
        if self.block == 1:
            bucket = self.bucket(h[end], h[first])
        else:
            bucket = self.bucket(block_code(h[end - 1], h[end]), block_code(h[first], h[first + 1]))
        low, high = np.searchsorted(self.bucket_of, bucket), np.searchsorted(self.bucket_of, bucket, side="right")
        size = high - low
        end, window = np.repeat(end, size), np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = np.ones(len(end), bool)
        for k in range(self.length):
            same &= h[end - self.length + 1 + k] == self.words[window, k]
        end, window = end[same], window[same]
        sure = [all(word_at(e - self.length + 1 + k) == w for k, w in enumerate(self.strings[i])) for e, i in zip(end.tolist(), window.tolist())]
        sure = np.array(sure, bool)
        return end[sure], window[sure]


def words_of(text: str | None) -> list[bytes]:
    raw = b"\n" + (text or "").encode() + b"\n"
    start, end = spans(np.frombuffer(raw, np.uint8), WORD)
    raw = raw.translate(FOLD)
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]


def windows_of(items: list[tuple[str, str]], window: int) -> dict[int, dict[tuple[bytes, ...], set[str]]]:
    """By length: each window with the items it is from."""
    out: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for k in range(len(words) - length + 1 if length else 0):
            out.setdefault(length, {}).setdefault(tuple(words[k : k + length]), set()).add(item)
    return out


KIND = "struct<n_words:bigint,n_hit:bigint,hits:array<struct<first:bigint,last:bigint>>,items:array<string>>"


def one_pass(part: pa.RecordBatch, place: int, prior: pa.StructArray | None, tables: list[Table], hasher: Hasher) -> pa.StructArray:
    data, first = packed(part.column(place))
    start, end = spans(data, WORD)
    bound, h = per_text(start, first), hasher.load(data)(start, end)
    folded: list[bytes] = []

    def word_at(k: int) -> bytes:
        if not folded:
            folded.append(data.tobytes().translate(FOLD))
        return folded[0][start[k] : end[k]]

    delta = np.zeros(len(start) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(part.num_rows)]
    if prior is not None:
        for k, old in enumerate(prior.to_pylist()):
            items[k].update(old["items"])
            for hit in old["hits"]:
                delta[bound[k] + hit["first"]] += 1
                delta[bound[k] + hit["last"] + 1] -= 1
    for table in tables:
        at, window = table.occurrences(h, bound, word_at)
        np.add.at(delta, at - table.length + 1, 1)
        np.add.at(delta, at + 1, -1)
        for k, i in set(zip((np.searchsorted(bound, at, side="right") - 1).tolist(), window.tolist())):
            items[k].update(table.items[i])
    hit = np.cumsum(delta[:-1]) > 0
    opens = hit.copy()
    opens[1:] &= ~hit[:-1]
    edges = bound[(bound > 0) & (bound < len(hit))]
    opens[edges] |= hit[edges]
    run_first = np.flatnonzero(opens)
    closes = hit.copy()
    closes[:-1] &= ~hit[1:]
    closes[edges - 1] |= hit[edges - 1]
    run_last = np.flatnonzero(closes)
    text_of = np.searchsorted(bound, run_first, side="right") - 1
    runs = pa.StructArray.from_arrays([pa.array(run_first - bound[text_of]), pa.array(run_last - bound[text_of])], names=["first", "last"])
    sums = np.concatenate(([0], np.cumsum(hit)))
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(bound)), pa.array(sums[bound[1:]] - sums[bound[:-1]]), lists(runs, np.bincount(text_of, minlength=part.num_rows)), pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
        names=["n_words", "n_hit", "hits", "items"],
    )


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "passages", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``out``: number of words, of hit words, the hit runs (word positions) and the items found.

    One row for each row, so repeated rows repeat their result. Null or wordless texts have no words and no hits;
    items without id, text or words give no window; rows of one item id are one item; windows that several items
    share count for each. A column already called ``out`` is replaced.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = 1 + int(total // block_bytes)
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    work, inner = with_text(docs, names, text)
    place = work.columns.index(inner)
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        rows = sorted((r["item"], r["text"]) for r in part.collect())
        last = block == blocks - 1
        columns = [*(names if last else work.columns), out] if not block else [*(names if last else work.columns[:-1]), out]
        schema = StructType([*[work.schema[c] for c in columns if c != out], StructField(out, _parse_datatype_string(KIND))])

        def run(batches, rows=rows, columns=columns, again=block > 0):
            hasher = Hasher()
            tables = [Table(n, w, hasher) for n, w in sorted(windows_of(rows, window).items())]
            for part in slices(batches, inner):
                prior = part.column(part.num_columns - 1) if again else None
                found = one_pass(part, place, prior, tables, hasher)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(columns) - 1)], found], names=columns)
            hasher = tables = None
            trim()

        work = work.mapInArrow(run, schema)
    return work


def digest(items: list[str]) -> str:
    """The digest of item ids that the query reports, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
