"""Shared helpers: written intermediates, bounded text slices, byte-level words and their hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from ..session import scratch_path

ARROW_ROWS = 1_000  # rows sent to a Python worker at once, where the session has Spark's default of 10,000
BROADCAST_ROWS = 200_000  # a table of ids up to this long (about 5 MB) is sent to every executor
FILES, FILE_ROWS = 12, 20_000  # files of a short written table, and rows for each further one
SLICE_BYTES = 1 << 20  # text bytes handled at once in a Python worker; one longer text is a slice of its own

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage, with its SQL twin where SQL can state it."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet below the shared folder and read it back.

    ``rows``, an upper bound of its rows where the caller knows one, keeps a short table to a few files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(FILES + rows // FILE_ROWS)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of ids or labels that is known to hold at most ``rows`` rows, if these are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def trim() -> None:
    """Give back what a finished task no longer uses: its worker goes on to serve later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def bounded(spark: SparkSession) -> None:
    """Texts are long: keep Arrow batches small, unless the session has its own setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def with_text(df: DataFrame, names: list[str], text: str) -> tuple[DataFrame, str]:
    """The columns ``names`` of ``df`` and the text as a string, under a name of its own where it is not among them."""
    bounded(df.sparkSession)
    if text in names and df.schema[text].dataType == StringType():
        return df.select(*[F.col(f"`{c}`") for c in names]), text
    inner = free(names, "_text")
    return df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias(inner)), inner


def free(names: list[str], wish: str) -> str:
    """A column name that none of ``names`` clashes with."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish += "_"
    return wish


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose ``column`` holds at most ``limit`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends, first = np.cumsum(size), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first): the texts end to end with a line feed before each and one at the end; null is empty.

    ``first[i]`` is where text i starts and ``first[i + 1] - 1`` where it ends.
    """
    raw = [b"" if t is None else t.encode() for t in column.to_pylist()]
    first = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    return np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8), np.concatenate(([1], first + 1))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Truth table over bytes; both ends belong to a range."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


def spans(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of member bytes; ``data`` starts and ends outside a run."""
    inside = member[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[0::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters(seed: int, fold: bool = True) -> np.ndarray:
    """A random 64-bit code per byte; A-Z share the codes of a-z when folding."""
    code = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        code[65:91] = code[97:123]
    return code


class Hasher:
    """64-bit hashes of any byte ranges of one buffer, from prefix sums of a polynomial."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 7, fold: bool = True):
        self.code = letters(seed, fold)
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> Hasher:
        if len(self.up) <= len(data):
            n = len(data) + 1
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self.up[: len(data)], out=self.total[1:])
        return self

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def per_text(start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bounds of the words of each text among all words: text i has words [b[i], b[i + 1])."""
    return np.searchsorted(start, first)


def with_column(df: DataFrame, text: str, out: str, kind: str, make: Callable, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``out`` computed from ``text`` in Arrow slices.

    ``make()`` runs once in each task and returns a function from a string array to an array of type ``kind``.
    Rows stay as they are, one to one; a column already called ``out`` is replaced.
    """
    names = [c for c in (df.columns if keep is None else keep) if c != out]
    work, inner = with_text(df, names, text)
    place = work.columns.index(inner)
    result = StructType([*[df.schema[c] for c in names], StructField(out, _parse_datatype_string(kind))])

    def run(batches):
        apply = make()
        for part in slices(batches, inner):
            columns = [part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, apply(part.column(place))], names=[*names, out])
        apply = None
        trim()

    return work.mapInArrow(run, result)


def lists(flat: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """List array from its flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), flat)
