"""Ordered signals: differences, edges, integrals, detrending, frame boundaries.

Every order-dependent step goes through ``ordered.scan``, so one very long run or
key is worked on in chunks by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import col
from .ordered import following, number_rows, percentiles, previous, running_sum, scan


def differences(df: DataFrame, keys: list[str], frame: str, columns: list[str], chunk, prefix: str = "d_") -> DataFrame:
    """Change from the previous frame; the first frame of a run gets zero. Changes that are there already are kept."""
    if {f"{prefix}{c}" for c in columns} <= set(df.columns):
        return df
    out = scan(df, keys, chunk, [frame], **{f"_prev_{c}": previous(c) for c in columns})
    return out.select(*df.columns, *[F.coalesce(F.col(c) - F.col(f"_prev_{c}"), F.lit(0.0)).alias(f"{prefix}{c}") for c in columns])


def framewise_displacement(df: DataFrame, keys: list[str], frame: str, motion: list[str], chunk, radius: float = 50.0) -> DataFrame:
    """Sum of absolute changes; the last three columns are rotations on a sphere of ``radius`` mm."""
    d = differences(df, keys, frame, motion, chunk)
    parts = [F.abs(F.col(f"d_{c}")) * (1.0 if n < 3 else radius) for n, c in enumerate(motion)]
    return d.withColumn("fd", reduce(lambda a, b: a + b, parts)).drop(*[f"d_{c}" for c in motion])


def motion24(df: DataFrame, keys: list[str], frame: str, motion: list[str], chunk, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parameters, changes, and the squares of both; other columns are left out but for those of ``keep``."""
    d = differences(df, keys, frame, motion, chunk)
    changes = [f"d_{c}" for c in motion]
    return d.select(
        *keys, frame, *motion, *changes,
        *[(F.col(c) * F.col(c)).alias(f"sq_{c}") for c in motion], *[(F.col(c) * F.col(c)).alias(f"sq_{c}") for c in changes], *keep,
    )


def rising_edges(df: DataFrame, keys: list[str], order: list[str], value: str, threshold: float, chunk) -> DataFrame:
    """Rows where the value first exceeds the threshold, numbered per key."""
    high = F.col(value) > F.lit(threshold)
    seen = scan(df.withColumn("_high", high), keys, chunk, order, _before=previous("_high"))
    edges = seen.where(F.col("_high") & ~F.coalesce("_before", F.lit(False))).drop("_high", "_before")
    return number_rows(edges, keys, chunk, order, "edge")


def alternate_edges(edges: DataFrame, first: int = 5, edge: str = "edge") -> DataFrame:
    """From ``first`` on: every second edge is an event, the edge before it is its cue."""
    lead = F.col(edge) - F.lit(first - 1)
    return edges.where(lead >= 0).withColumn("role", F.when(lead % 2 == 1, "event").otherwise("cue"))


def first_above(df: DataFrame, keys: list[str], order: str, value: str, threshold: float) -> DataFrame:
    return df.where(F.col(value) > F.lit(threshold)).groupBy(*keys).agg(F.min(order).alias("onset"))


def pad_missing_edges(edges: DataFrame, keys: list[str], t: str, expected: int, chunk, ident: list[str]) -> DataFrame:
    """Prepend (expected - found) edges at the median gap before the first, never before time zero."""
    gaps = scan(edges, keys, chunk, [t, *ident], _before=previous(t)).withColumn("_gap", (F.col(t) - F.col("_before")).cast("double"))
    gap = percentiles(gaps, keys, "_gap", {"gap": 0.5})
    found = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"), F.min(t).alias("_first"))
    steps = F.least(F.lit(expected) - F.col("found"), F.floor(F.col("_first") / F.col("gap")))
    added = (
        found.join(gap, keys).where((F.col("found") < expected) & (F.col("gap") > 0)).withColumn("_steps", steps).where("_steps >= 1")
        .withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_steps").cast("int"))))
        .select(*keys, (F.col("_first") - F.round(F.col("gap") * F.col("_n"))).cast("bigint").alias(t), F.lit(True).alias("added"))
    )
    return edges.select(*keys, t, F.lit(False).alias("added")).unionByName(added)


def flag_negative_onset(df: DataFrame, onset: str, good: str) -> DataFrame:
    return df.withColumn(good, F.when(F.col(onset) < 0, False).otherwise(F.col(good)))


def cumulative_offsets(runs: DataFrame, keys: list[str], order: str, n_frames: str, seconds: float, chunk) -> DataFrame:
    """Seconds of recording before each run."""
    out = scan(runs, keys, chunk, [order], _through=running_sum(n_frames))
    return out.withColumn("offset", (F.col("_through") - F.col(n_frames)) * F.lit(seconds)).drop("_through")


def trapezoid_integral(df: DataFrame, keys: list[str], order: list[str], value: str, rate: float, chunk) -> DataFrame:
    """Cumulative trapezoid divided by the sampling rate; zero at the first sample."""
    seen = scan(df, keys, chunk, order, _before=previous(value))
    area = seen.withColumn("_area", F.coalesce((F.col(value) + F.col("_before")) / 2.0, F.lit(0.0)))
    out = scan(area, keys, chunk, order, _sum=running_sum("_area"))
    return out.withColumn("integral", F.col("_sum") / F.lit(rate)).drop("_before", "_area", "_sum")


def linear_detrend(df: DataFrame, keys: list[str], x: str, value: str, out: str) -> DataFrame:
    """Residual of the least-squares line in each key."""
    line = df.groupBy(*keys).agg(F.regr_slope(value, x).alias("_b"), F.regr_intercept(value, x).alias("_a"))
    return df.join(line, keys).withColumn(out, F.col(value) - (F.col("_a") + F.col("_b") * F.col(x))).drop("_a", "_b")


def joint_outliers(df: DataFrame, keys: list[str], a: str, b: str, ident: list[str], count: int = 12) -> DataFrame:
    """Rows with the largest sum of the two tied ranks."""
    from .ordered import tied_ranks

    ranked = tied_ranks(tied_ranks(df, keys, a, "_ra"), keys, b, "_rb").withColumn("rank_sum", F.col("_ra") + F.col("_rb"))
    return ranked.drop("_ra", "_rb").orderBy(F.desc("rank_sum"), *ident).limit(count)


def regular_intervals(edges: DataFrame, keys: list[str], t: str, nominal: float, tolerance: float, chunk, ident: list[str]) -> DataFrame:
    """Per key: number of edges, gap range, and whether all gaps are within tolerance."""
    gaps = scan(edges, keys, chunk, [t, *ident], _before=previous(t)).withColumn("_gap", F.col(t) - F.col("_before"))
    ok = F.coalesce(F.bool_and(F.abs(F.col("_gap") - F.lit(nominal)) <= tolerance), F.lit(False))
    return gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_edges"), F.min("_gap").alias("min_gap"), F.max("_gap").alias("max_gap"), ok.alias("regular")
    )


def frame_edges(edges: DataFrame, runs: DataFrame, keys: list[str], t: str, nominal: int, tolerance: float, chunk) -> DataFrame:
    """(keys, frame, first, next, method): boundaries of every frame of every run.

    N+1 regular edges are used as they are; N get a last boundary one nominal
    period later; otherwise the run's onset plus nominal periods is used.
    ``runs`` holds (keys, n_frames, onset).
    """
    check = regular_intervals(edges, keys, t, nominal, tolerance, chunk, [])
    plan = runs.join(check, keys, "left")
    regular = F.coalesce("regular", F.lit(False))
    method = (
        F.when(regular & (F.col("n_edges") == F.col("n_frames") + 1), "all_edges")
        .when(regular & (F.col("n_edges") == F.col("n_frames")), "last_extrapolated").otherwise("nominal")
    )
    plan = plan.withColumn("method", method).select(*keys, "n_frames", "onset", "method")
    numbered = scan(edges, keys, chunk, [t], _next=following(t))
    numbered = number_rows(numbered, keys, chunk, [t], "frame")
    own = (
        numbered.join(plan.where("method <> 'nominal'"), keys).where(F.col("frame") <= F.col("n_frames"))
        .select(*keys, "frame", F.col(t).alias("first"), F.coalesce("_next", F.col(t) + nominal).alias("next"), "method")
    )
    steps = plan.where("method = 'nominal'").withColumn("frame", F.explode(F.sequence(F.lit(1), F.col("n_frames").cast("int"))))
    start = (F.col("onset") + (F.col("frame") - 1) * nominal).cast("bigint")
    made = steps.select(*keys, F.col("frame").cast("bigint").alias("frame"), start.alias("first"), (start + nominal).alias("next"), "method")
    return own.withColumn("frame", F.col("frame").cast("bigint")).unionByName(made)


def fill_last_frame(df: DataFrame, keys: list[str], frame: str, n_frames: str, value: str, chunk) -> DataFrame:
    """A missing last frame copies the frame before it; ``status`` tells filled and fatal gaps."""
    seen = scan(df, keys, chunk, [frame], _before=previous(value))
    last = F.col(frame) == F.col(n_frames)
    missing = F.col(value).isNull()
    status = F.when(~missing, "measured").when(last & F.col("_before").isNotNull(), "filled").otherwise("fatal")
    return (
        seen.withColumn("status", status)
        .withColumn(value, F.when(missing & last, F.col("_before")).otherwise(F.col(value))).drop("_before")
    )


def fir_weights(taps: int, cutoff: float, rate: float) -> list[float]:
    """Hamming-windowed low-pass weights with unit gain at zero frequency."""
    import numpy as np

    n = np.arange(taps) - (taps - 1) / 2
    w = np.sinc(2 * cutoff / rate * n) * np.hamming(taps)
    return [float(v) for v in w / w.sum()]


FIR_CHUNK = 1 << 15  # frames filtered by one task at a time


def lowpass_fir(df: DataFrame, keys: list[str], frame: str, value: str, weights: list[float], out: str, chunk: int = FIR_CHUNK) -> DataFrame:
    """Weighted moving sum; at the ends and at gaps the available weights are rescaled to one.

    A key is cut into chunks of frames. Only the border samples of a chunk are copied to its neighbours, so the shuffle
    is about the input whatever the number of taps, and a task holds one chunk and its borders. A missing value has its
    weight but adds nothing; where all values in reach are missing the result is missing too.
    """
    import numpy as np
    import pyarrow as pa

    w = np.asarray(weights, float)
    before = (len(w) - 1) // 2
    reach = max(1, len(w) - 1 - before)
    size = max(chunk, 2 * reach)
    place = lambda f: F.floor(f / size)
    own, names = place(F.col(frame)), df.columns
    touched = F.array_distinct(F.array(place(F.col(frame) - reach), own, place(F.col(frame) + reach)))
    sent = df.withColumn("_chunk", F.explode(touched)).withColumn("_own", F.col("_chunk") == own)
    schema = df.select("*", F.lit(0.0).alias(out)).schema
    schema[out].nullable = True

    def smooth(table: pa.Table) -> pa.Table:
        at = table[frame].to_numpy().astype(np.int64)
        at = at - at.min()
        v = table[value].cast(pa.float64())
        known = ~np.asarray(v.is_null())
        length = int(at.max()) + 1

        def spread(x, by):
            dense = np.bincount(at, x, length)
            return np.convolve(dense, by)[before : before + length]

        total = spread(np.where(known, v.fill_null(0.0).to_numpy(), 0.0), w)
        share, near = spread(np.ones(len(at)), w), spread(known.astype(float), np.ones(len(w)))
        mine = np.flatnonzero(table["_own"].to_numpy())
        got = total[at[mine]] / share[at[mine]]
        kept = table.select(names).take(pa.array(mine))
        return kept.append_column(out, pa.array(got, pa.float64(), mask=near[at[mine]] < 0.5))

    return sent.groupBy(*keys, "_chunk").applyInArrow(smooth, schema)


def spike_columns(df: DataFrame, keys: list[str], frame: str, bad: Column, chunk) -> DataFrame:
    """(keys, frame, spike): one sparse indicator column per bad frame."""
    return number_rows(df.where(bad).select(*keys, frame), keys, chunk, [frame], "spike")


def contiguous_blocks(df: DataFrame, keys: list[str], order: str, n_blocks: int, chunk, out: str = "block") -> DataFrame:
    """Equal consecutive blocks of a numbered series; NULL where the count does not divide."""
    numbered = number_rows(df, keys, chunk, [order], "_rn")
    if keys:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        numbered = numbered.join(sizes, keys)
    else:
        numbered = numbered.join(df.agg(F.count(F.lit(1)).alias("_n")), F.lit(True))
    block = F.when(F.col("_n") % n_blocks == 0, F.ceil(F.col("_rn") / (F.col("_n") / n_blocks)))
    return numbered.withColumn(out, block).drop("_rn", "_n")
