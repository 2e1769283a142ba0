"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score, ties to the left: the best pair that still
stands is merged and its new neighbours join the agenda. What no piece of the vocabulary spans is independent, so
a text is cut before each run of word marks and around characters that occur in no longer piece; each distinct
unit is merged once per task. Characters outside the vocabulary become their bytes.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import lists, trim, with_column

MARK = "▁"
CACHE_IDS = 1_000_000  # ids of distinct units kept by a task before it forgets them and starts anew
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the model format


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class Vocabulary:
    """Pieces, scores and kinds of a merge-type model file without text normalisation."""

    def __init__(self, raw: bytes):
        self.pieces, self.scores, self.kinds, trainer, normal = [], [], [], {}, {}
        for number, value in fields(raw):
            if number == 1:
                one = dict(fields(value))
                self.pieces.append(one[1].decode())
                self.scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                self.kinds.append(one.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        if trainer.get(3) != 2 or normal.get(1) != b"identity" or normal.get(4, 1) or not trainer.get(35):
            raise ValueError("only merge-type models with byte fallback and identity normalisation are covered")
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not covered")
        self.prefix = MARK if normal.get(3, 1) else ""
        self.unknown = self.kinds.index(UNKNOWN)
        self.surface = trainer.get(44, " ⁇ ".encode())
        self.rank = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        longer = [p for p in self.rank if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in longer):
            raise ValueError("pieces that span words are not covered")
        joining = re.escape("".join(sorted(set("".join(longer)) - {MARK})))
        order = {s: i for i, s in enumerate(sorted({self.scores[self.rank[p]] for p in longer}, reverse=True))}
        pairs = {}
        for p in longer:
            for cut in range(1, len(p)):
                left, right = self.rank.get(p[:cut]), self.rank.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = order[self.scores[self.rank[p]]] << 32 | self.rank[p]
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_value = np.array([pairs[k] for k in self.pair_key.tolist()], np.int64)
        self.units = re.compile(f"{MARK}*[{joining}]+|{MARK}+|.", re.DOTALL)


def merged(unit: str, vocabulary: Vocabulary) -> list[int]:
    """Ids of one unit by the agenda."""
    rank, scores = vocabulary.rank, vocabulary.scores
    symbol, count = list(unit), len(unit)
    before, after = list(range(-1, count - 1)), [*range(1, count), -1]
    agenda: list[tuple[float, int, int, str]] = []

    def offer(left: int, right: int) -> None:
        if left >= 0 and right >= 0:
            piece = symbol[left] + symbol[right]
            at = rank.get(piece)
            if at is not None:
                heapq.heappush(agenda, (-scores[at], left, right, piece))

    for k in range(count - 1):
        offer(k, k + 1)
    while agenda:
        _, left, right, piece = heapq.heappop(agenda)
        if not symbol[left] or not symbol[right] or symbol[left] + symbol[right] != piece or after[left] != right:
            continue  # one of the two has been merged since
        symbol[left], symbol[right], after[left] = piece, "", after[right]
        if after[right] >= 0:
            before[after[right]] = left
        offer(before[left], left)
        offer(left, after[left])
    ids = []
    for s in filter(None, symbol):
        at = rank.get(s)
        ids.extend((at,) if at is not None else (vocabulary.byte[b] for b in s.encode()))
    return ids


NO_PAIR = np.int64(1) << 62


def best_pairs(left: np.ndarray, right: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Order of the score (high bits) and id (low bits) of the piece each pair makes, or NO_PAIR."""
    key = left.astype(np.int64) << 32 | right
    at = np.minimum(np.searchsorted(vocabulary.pair_key, key), len(vocabulary.pair_key) - 1)
    return np.where((vocabulary.pair_key[at] == key) & (left >= 0) & (right >= 0), vocabulary.pair_value[at], NO_PAIR)


def merged_together(symbols: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Ids of many short units at once, a row each, padded with -1.

    A row of ``agenda`` is the agenda of one unit: each step takes its best pair (the leftmost of equal scores),
    merges it, closes the gap and looks up the two new neighbours; rows without a pair are done.
    """
    symbols, live = symbols.copy(), np.arange(len(symbols))
    agenda = best_pairs(symbols[:, :-1], symbols[:, 1:], vocabulary)
    work, column = symbols, np.arange(symbols.shape[1])
    while len(live):
        at = (agenda >> 32).argmin(axis=1)
        row = np.arange(len(live))
        best = agenda[row, at]
        going = best != NO_PAIR
        if not going.all():
            symbols[live[~going]] = work[~going]
            live, work, agenda, at, best = live[going], work[going], agenda[going], at[going], best[going]
            row = np.arange(len(live))
            if not len(live):
                break
        closed = np.concatenate((work[:, 1:], np.full((len(live), 1), -1, work.dtype)), axis=1)
        work = np.where(column[None, :] > at[:, None], closed, work)
        work[row, at] = best & 0xFFFFFFFF
        shut = np.concatenate((agenda[:, 1:], np.full((len(live), 1), NO_PAIR)), axis=1)
        agenda = np.where(column[None, :-1] >= at[:, None], shut, agenda)
        inner = at < work.shape[1] - 1
        agenda[row[inner], at[inner]] = best_pairs(work[row[inner], at[inner]], work[row[inner], at[inner] + 1], vocabulary)
        inner = at > 0
        agenda[row[inner], at[inner] - 1] = best_pairs(work[row[inner], at[inner] - 1], work[row[inner], at[inner]], vocabulary)
    return symbols


SHORT, TOGETHER = 24, 8192  # symbols of a unit that is merged in company; units merged together


class Encoder:
    """Ids of texts; remembers distinct units."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.single = np.full(0x110000, -1, np.int32)
        for piece, at in vocabulary.rank.items():
            if len(piece) == 1:
                self.single[ord(piece)] = at
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.bound = array("i"), array("q", [0])

    def learn(self, units: list[str]) -> None:
        size = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        symbols, first = self.single[points], np.cumsum(size) - size
        apart = (size > SHORT) | (np.minimum.reduceat(symbols, first) < 0)
        order = np.argsort(np.where(apart, SHORT + 1, size), kind="stable")
        together = len(units) - int(apart.sum())
        for low in range(0, together, TOGETHER):
            group = order[low : min(low + TOGETHER, together)]
            column = np.arange(size[group[-1]] + 1)
            within = column[None, :] < size[group][:, None]
            rows = np.where(within, symbols[np.where(within, first[group][:, None] + column, 0)], -1)
            rows = merged_together(rows, self.vocabulary)
            have = rows >= 0
            self.bound.frombytes((len(self.flat) + np.cumsum(have.sum(axis=1))).astype(np.int64).tobytes())
            self.flat.frombytes(rows[have].astype(np.int32).tobytes())
        for k in order[together:].tolist():
            self.flat.extend(merged(units[k], self.vocabulary))
            self.bound.append(len(self.flat))
        known = len(self.known)
        self.known.update(zip(map(units.__getitem__, order.tolist()), range(known, known + len(units))))

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        if len(self.flat) > CACHE_IDS:
            self.forget()
        units, sizes, find, prefix = [], [], self.vocabulary.units.findall, self.vocabulary.prefix
        for t in texts.to_pylist():
            own = find(prefix + t.replace(" ", MARK)) if t else []
            units += own
            sizes.append(len(own))
        fresh = list(set(units).difference(self.known))
        if fresh:
            self.learn(fresh)
        index = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        bound, flat = np.frombuffer(self.bound, np.int64), np.frombuffer(self.flat or array("i", [0]), np.int32)
        length = (bound[1:] - bound[:-1])[index]
        ends = np.concatenate(([0], np.cumsum(length)))
        ids = flat[np.arange(ends[-1]) + np.repeat(bound[index] - ends[:-1], length)]
        per_text = ends[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))]
        return lists(pa.array(ids, pa.int32()), np.diff(per_text))


class Decoder:
    """Texts of ids: pieces end to end, byte pieces as UTF-8, the first word mark dropped."""

    def __init__(self, vocabulary: Vocabulary):
        codecs.register_error("trialweave-byte", lambda error: ("\ufffd", error.start + 1))
        self.vocabulary, out = vocabulary, []
        for piece, kind in zip(vocabulary.pieces, vocabulary.kinds):
            out.append({NORMAL: piece.replace(MARK, " ").encode(), UNKNOWN: vocabulary.surface, CONTROL: b""}.get(kind) if kind != BYTE else bytes([int(piece[3:5], 16)]))
        self.piece = pa.array(out, pa.binary())
        self.spaced = np.array([p.startswith(MARK) and k == NORMAL for p, k in zip(vocabulary.pieces, vocabulary.kinds)])
        self.control = np.array([k == CONTROL for k in vocabulary.kinds])

    def __call__(self, ids: pa.ListArray) -> pa.Array:
        ids = pc.fill_null(ids, pa.scalar([], ids.type)) if ids.null_count else ids
        raw = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.piece.take(ids.values)), b"").to_pylist()
        values, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        out = []
        for k, text in enumerate(raw):
            first = at[k]
            while first < at[k + 1] and self.control[values[first]]:
                first += 1
            if self.vocabulary.prefix and first < at[k + 1] and self.spaced[values[first]]:
                text = text[1:]
            try:
                whole = None if self.control[values[at[k] : at[k + 1]]].any() else text.decode()
            except UnicodeDecodeError:
                whole = None
            if whole is None:
                whole = "".join(self.runs(values[first : at[k + 1]].tolist(), first < at[k + 1] and bool(self.vocabulary.prefix)))
            out.append(whole)
        return pa.array(out, pa.string())

    def runs(self, ids: list[int], leading: bool) -> Iterator[str]:
        """Texts of the pieces, where bytes that make no character become one replacement character each."""
        plain = self.piece
        for is_byte, run in groupby(ids, lambda i: self.vocabulary.kinds[i] == BYTE):
            if is_byte:
                yield b"".join(plain[i].as_py() for i in run).decode("utf-8", "trialweave-byte")
            else:
                text = b"".join(plain[i].as_py() for i in run).decode()
                yield text[1:] if leading and self.spaced[ids[0]] else text
            leading = False


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the ids of each whole text, without begin or end ids; null and empty texts have none.

    Row by row: repeated rows and ties need no rule, an empty table stays empty, ``ids`` replaces a column of that name.
    """
    return with_column(df, text, ids, "array<int>", lambda: Encoder(vocabulary), keep)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of each list of ids (null: empty text); ``text`` replaces a column of that name."""
    base = df.drop(text)
    schema = StructType([*base.schema.fields, StructField(text, StringType())])
    names = base.columns
    place = names.index(ids)

    def run(batches):
        decoder = Decoder(vocabulary)
        for whole in batches:
            step = max(1, (1 << 20) * max(whole.num_rows, 1) // max(1, len(whole.column(place).values)))
            for low in range(0, whole.num_rows, step):
                part = whole.slice(low, step)
                column = part.column(place)
                own = pa.concat_arrays([column]) if column.offset == 0 else pa.array(column.to_pylist(), column.type)
                yield pa.RecordBatch.from_arrays([*part.columns, decoder(own)], names=[*names, text])
        decoder = None
        trim()

    return base.mapInArrow(run, schema)


def checked(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", out: str = "agrees") -> DataFrame:
    """``df`` with whether ``ids`` are those of the sentencepiece library and its decoded text is the whole text."""
    base = df.drop(out)
    names = base.columns

    def run(batches):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_proto=model)
        for part in batches:
            texts = [t or "" for t in part.column(names.index(text)).to_pylist()]
            same = [a == (b or []) for a, b in zip(library.encode(texts, num_threads=1), part.column(names.index(ids)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(same, pa.bool_())], names=[*names, out])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(out, BooleanType())]))
