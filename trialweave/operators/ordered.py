"""Exact ordered scans that never put a whole key into one task.

A plain window puts every row of its partition key into a single task, which a hot
key does not survive. Here each key is cut into *chunks* that follow the order. The
window runs inside a chunk, a small per-chunk summary is scanned across chunks, and
the carry joins back on (key, chunk). The result equals the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import col
from ..session import durable

UNB_P, UNB_F = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Step:
    """One output column of a scan: local window, chunk summary, carry, and their merge."""

    local: Callable
    summary: Callable
    carry: Callable
    merge: Callable


def row_number() -> Step:
    return Step(
        lambda w: F.row_number().over(w),
        lambda order: F.count(F.lit(1)),
        lambda s, w: F.coalesce(F.sum(s).over(w.rowsBetween(UNB_P, -1)), F.lit(0)),
        lambda local, carry, first, last: local + carry,
    )


def running_sum(value) -> Step:
    return Step(
        lambda w: F.coalesce(F.sum(col(value)).over(w.rowsBetween(UNB_P, 0)), F.lit(0)),
        lambda order: F.coalesce(F.sum(col(value)), F.lit(0)),
        lambda s, w: F.coalesce(F.sum(s).over(w.rowsBetween(UNB_P, -1)), F.lit(0)),
        lambda local, carry, first, last: local + carry,
    )


def previous(value) -> Step:
    return Step(
        lambda w: F.lag(col(value)).over(w),
        lambda order: F.max_by(col(value), order),
        lambda s, w: F.lag(s).over(w),
        lambda local, carry, first, last: F.when(first, carry).otherwise(local),
    )


def following(value) -> Step:
    return Step(
        lambda w: F.lead(col(value)).over(w),
        lambda order: F.min_by(col(value), order),
        lambda s, w: F.lead(s).over(w),
        lambda local, carry, first, last: F.when(last, carry).otherwise(local),
    )


def last_known(value) -> Step:
    return Step(
        lambda w: F.last(col(value), ignorenulls=True).over(w.rowsBetween(UNB_P, 0)),
        lambda order: F.max_by(col(value), F.when(col(value).isNotNull(), order)),
        lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(UNB_P, -1)),
        lambda local, carry, first, last: F.coalesce(local, carry),
    )


def next_known(value) -> Step:
    return Step(
        lambda w: F.first(col(value), ignorenulls=True).over(w.rowsBetween(0, UNB_F)),
        lambda order: F.min_by(col(value), F.when(col(value).isNotNull(), order)),
        lambda s, w: F.first(s, ignorenulls=True).over(w.rowsBetween(1, UNB_F)),
        lambda local, carry, first, last: F.coalesce(local, carry),
    )


def min_from_here(value) -> Step:
    return Step(
        lambda w: F.min(col(value)).over(w.rowsBetween(0, UNB_F)),
        lambda order: F.min(col(value)),
        lambda s, w: F.min(s).over(w.rowsBetween(1, UNB_F)),
        lambda local, carry, first, last: F.least(local, carry),
    )


def scan(df: DataFrame, keys: list[str], chunk, order: list[str], **steps: Step) -> DataFrame:
    """Add the columns of ``steps`` to ``df``.

    ``chunk`` must never decrease along ``order`` inside a key, and ``order`` must
    be a total order inside a key.
    """
    # A chunk's name is one column that is never NULL, so windows and the join share one shuffle and one sort;
    # its digest in front of it keeps the comparisons of the sort short.
    part = F.struct(*keys, "_scan_chunk")
    base = df.withColumn("_scan_chunk", col(chunk)).withColumn("_scan_part", part).withColumn("_scan_at", F.xxhash64("_scan_part"))
    name = ["_scan_at", "_scan_part"]
    inner = Window.partitionBy(*name).orderBy(*order)
    outer = Window.partitionBy(*[F.col(f"_scan_part.{k}") for k in keys]).orderBy("_scan_part._scan_chunk")
    at = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(o) for o in order])

    local = base.withColumns({f"_l_{n}": s.local(inner) for n, s in steps.items()} | {"_scan_rn": F.row_number().over(inner)})
    summary = base.groupBy(*name).agg(
        F.count(F.lit(1)).alias("_scan_size"), *[s.summary(at).alias(f"_s_{n}") for n, s in steps.items()]
    )
    carry = summary.select(*name, "_scan_size", *[s.carry(F.col(f"_s_{n}"), outer).alias(f"_c_{n}") for n, s in steps.items()])
    first, last = F.col("_scan_rn") == 1, F.col("_scan_rn") == F.col("_scan_size")
    joined = local.join(carry, name)
    done = {n: s.merge(F.col(f"_l_{n}"), F.col(f"_c_{n}"), first, last) for n, s in steps.items()}
    return joined.select(*df.columns, *[c.alias(n) for n, c in done.items()])


def number_rows(df: DataFrame, keys: list[str], chunk, order: list[str], out: str) -> DataFrame:
    """Row number along ``order`` inside each key."""
    return scan(df, keys, chunk, order, **{out: row_number()})


CHUNK_ROWS = 100_000  # distinct values per chunk of a distribution
COARSE = 16           # a place is found in two steps of COARSE edges each


def chunk_edges(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _total, _edges, _coarse): up to COARSE^2 - 1 sorted cut values per key.

    Small keys get none, so they pay nothing. Edges are approximate quantiles of the
    distinct values; they decide only the balance of the work, never the result.
    """
    most = COARSE * COARSE
    levels = F.array(*[F.lit((i + 1) / most) for i in range(most - 1)])
    raw = counts.groupBy(*keys).agg(
        F.percentile_approx(value, levels, F.lit(2000)).alias("_all"), F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_d")
    )
    pieces = F.least(F.lit(most), F.ceil(F.col("_d") / CHUNK_ROWS))
    kept = F.filter("_all", lambda e, i: F.floor((i + 1) * pieces / most) > F.floor(i * pieces / most))
    raw = raw.withColumn("_edges", F.array_distinct(kept))
    steps = F.sequence(F.lit(COARSE), F.lit(most), F.lit(COARSE))
    coarse = F.transform(F.filter(steps, lambda n: n <= F.size("_edges")), lambda n: F.get(F.col("_edges"), n - 1))
    return raw.select(*keys, "_total", "_edges", coarse.alias("_coarse"))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _n, _cum, _total): counts of each distinct value and their running sum.

    Ranks, percentiles, medians and step-up adjustments all read this table. Equal
    values are merged first and written, so the input is read once. The cut values are
    written too, so that a recomputed task sees the same ones.
    """
    present = df.where(F.col(value).isNotNull())
    counts = durable(present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    edges = durable(chunk_edges(counts, keys, value))
    cut = counts.join(edges, keys) if keys else counts.join(edges, F.lit(True))  # without keys: one row of edges
    v = F.col(value)
    high = F.size(F.filter("_coarse", lambda e: e < v)) * COARSE
    place = high + F.size(F.filter(F.slice("_edges", high + 1, COARSE), lambda e: e < v))
    cut = cut.withColumn("_place", place).drop("_edges", "_coarse")
    return scan(cut, keys, "_place", [value], _cum=running_sum("_n")).drop("_place")


def value_at(rank: Column, value: str) -> Column:
    """Aggregate over a ``distribution``: the value holding the given 1-based rank."""
    return F.min(F.when(F.col("_cum") >= rank, F.col(value)))


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], rule: str = "linear") -> DataFrame:
    """Exact percentiles per key without holding a group in memory.

    ``linear`` interpolates on 1 + (n-1)p; ``midpoint`` puts the k-th value at (k-0.5)/n.
    A key of at most CHUNK_ROWS values is sorted by one task. A larger one is cut at approximate quantiles, and only
    the chunks that hold a wanted rank are counted by value; the cuts decide the balance of the work, never the result.
    Values that come from distributed sums should be written (``durable``) first, since the rows are read more than once.
    """
    def position(p: float, n: Column) -> Column:
        return (n - 1) * F.lit(p) + 1 if rule == "linear" else F.greatest(F.lit(1.0), F.least(n * F.lit(p) + 0.5, n * F.lit(1.0)))

    rows = df.select(*keys, value).where(F.col(value).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    sizes = durable(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")))
    large = sizes.where(F.col("_total") > CHUNK_ROWS)
    if large.isEmpty():
        whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        dist = rows.withColumns({"_cum": F.row_number().over(whole.orderBy(value)), "_total": F.count(F.lit(1)).over(whole)})
        ranks = [end(position(p, F.col("_total"))) for p in probs.values() for end in (F.floor, F.ceil)]
        dist = dist.where(F.col("_cum").isin(ranks))
    else:
        dist = _wanted_places(rows, keys, value, large, [lambda n, p=p, end=end: end(position(p, n)) for p in probs.values() for end in (F.floor, F.ceil)])
    n = F.col("_total")
    columns, finish = [], {}
    for name, p in probs.items():
        pos = position(p, n)
        low = F.floor(pos)
        columns += [
            value_at(low, value).alias(f"_{name}_lo"),
            value_at(F.ceil(pos), value).alias(f"_{name}_hi"),
            F.max(pos - low).alias(f"_{name}_w"),
        ]
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        finish[name] = lo + F.col(f"_{name}_w") * (hi - lo)
    return dist.groupBy(*keys).agg(*columns).select(*keys, *[c.alias(n_) for n_, c in finish.items()])


def _wanted_places(rows: DataFrame, keys: list[str], value: str, large: DataFrame, ranks: list[Callable]) -> DataFrame:
    """(keys, value, _cum, _total) of the keys of few values and of those chunks of the others that hold one of ``ranks``.

    The tables sent to all tasks have one row of cuts for each CHUNK_ROWS rows of the input, at most.
    """
    most = COARSE * COARSE
    levels = F.array(*[F.lit((i + 1) / most) for i in range(most - 1)])
    on = keys or F.lit(True)
    cuts = rows.join(F.broadcast(large), on).groupBy(*keys).agg(
        F.percentile_approx(value, levels, F.lit(2000)).alias("_all"), F.max("_total").alias("_total"))
    pieces = F.least(F.lit(most), F.ceil(F.col("_total") / CHUNK_ROWS))
    kept = F.array_distinct(F.filter("_all", lambda e, i: F.floor((i + 1) * pieces / most) > F.floor(i * pieces / most)))
    cuts = durable(cuts.select(*keys, "_total", kept.alias("_edges")))
    v = F.col(value)
    placed = rows.join(F.broadcast(cuts), on, "left")
    placed = placed.withColumn("_place", F.when(F.col("_edges").isNotNull(), F.size(F.filter("_edges", lambda e: e < v)))).drop("_edges")
    counts = placed.where("_place IS NOT NULL").groupBy(*keys, "_place").agg(F.count(F.lit(1)).alias("_size"), F.max("_total").alias("_total"))
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_place")  # at most COARSE^2 rows of a key
    counts = counts.withColumn("_before", F.sum("_size").over(order) - F.col("_size"))
    hit = F.lit(False)
    for rank in ranks:
        r = rank(F.col("_total"))
        hit = hit | ((r > F.col("_before")) & (r <= F.col("_before") + F.col("_size")))
    wanted = durable(counts.where(hit).select(*keys, "_place", "_before"))
    found = placed.join(F.broadcast(wanted), [*keys, "_place"], "left").where("_place IS NULL OR _before IS NOT NULL")
    merged = found.groupBy(*keys, "_place", value).agg(F.count(F.lit(1)).alias("_n"), F.max("_total").alias("_total"), F.max("_before").alias("_before"))
    inside = Window.partitionBy(*keys, "_place")
    return merged.select(
        *keys, value, (F.sum("_n").over(inside.orderBy(value)) + F.coalesce("_before", F.lit(0))).alias("_cum"),
        F.coalesce("_total", F.sum("_n").over(inside)).alias("_total"),
    )


FEW_ROWS = 400_000  # a table of at most this many short rows is sent to all tasks


def join_few(df: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with a table of one row per key. Few keys mean few, hot partitions: where the table is short, it
    goes to the rows, which are then neither shuffled nor sorted by the key."""
    few = durable(few)
    return df.join(F.broadcast(few) if few.count() <= FEW_ROWS else few, keys, how)


def tied_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average rank of equal values, joined back to the rows on the exact value.

    Values that come from distributed sums should be written (``durable``) first, so
    that both readings see the same bits.
    """
    ranks = distribution(df, keys, value).select(
        *keys, value, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(out)
    )
    return df.join(ranks, [*keys, value], "left")
