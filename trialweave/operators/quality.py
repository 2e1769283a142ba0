"""Signal quality rules and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import col, finite, pearson
from ..session import durable

# The ten censoring rules (id, kind, displacement mm, robust z).
RULES = [
    ("fd_gt_0p2", "fd", 0.2, None),
    ("fd_gt_0p3", "fd", 0.3, None),
    ("fd_gt_0p5", "fd", 0.5, None),
    ("dvarsz_gt_3", "dvars", None, 3.0),
    ("dvarsz_gt_4", "dvars", None, 4.0),
    ("dvarsz_gt_5", "dvars", None, 5.0),
    ("fd0p2_or_dvarsz3", "or", 0.2, 3.0),
    ("fd0p3_or_dvarsz3", "or", 0.3, 3.0),
    ("fd0p3_or_dvarsz4", "or", 0.3, 4.0),
    ("fd0p5_or_dvarsz5", "or", 0.5, 5.0),
]


DVARS_CHUNK = 4096  # frames of a run that one task handles at a time


def dvars(df: DataFrame, run: str, frame: str, voxel: str, value: str) -> DataFrame:
    """Root mean squared change per frame over the voxels finite in every frame of the run.

    One shuffle by run and chunk of frames, however many voxels or runs there are and however long a run is: the last
    frame of a chunk is copied to the next one. A frame without the one before it changes by nothing.
    """
    flawed = durable(df.where(~finite(value)).select(F.col(run).alias("_run"), F.col(voxel).alias("_voxel")).distinct())
    if not flawed.isEmpty():
        df = df.join(flawed, F.col(run).eqNullSafe(F.col("_run")) & F.col(voxel).eqNullSafe(F.col("_voxel")), "left_anti")
    rows = df.select(run, voxel, frame, value)
    own = F.floor(F.col(frame) / DVARS_CHUNK)
    border = rows.where(F.pmod(F.col(frame) + 1, F.lit(DVARS_CHUNK)) == 0)
    sent = rows.withColumns({"_chunk": own, "_own": F.lit(True)}).unionByName(border.withColumns({"_chunk": own + 1, "_own": F.lit(False)}))
    order = Window.partitionBy(run, "_chunk", voxel).orderBy(frame)
    before = F.when(F.lag(frame).over(order) == F.col(frame) - 1, F.lag(value).over(order))
    change = sent.repartition(run, "_chunk").select(run, "_chunk", frame, "_own", F.coalesce(F.col(value) - before, F.lit(0.0)).alias("_d")).where("_own")
    mean = change.groupBy(run, "_chunk", frame).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("dvars"))
    return mean.drop("_chunk")


def rule_condition(kind: str, fd_limit, z_limit, fd: str, z: str) -> Column:
    over_fd = F.col(fd) > F.lit(fd_limit) if fd_limit is not None else F.lit(False)
    over_z = F.col(z) > F.lit(z_limit) if z_limit is not None else F.lit(False)
    return {"fd": over_fd, "dvars": over_z, "or": over_fd | over_z}[kind]


def apply_rules(df: DataFrame, rules, fd: str, z: str) -> DataFrame:
    """Each frame once per rule with its verdict; no join, the rules are literals."""
    verdicts = F.array(*[
        F.struct(F.lit(name).alias("rule"), rule_condition(kind, a, b, fd, z).alias("bad")) for name, kind, a, b in rules
    ])
    return df.withColumn("_r", F.explode(verdicts)).withColumns({"rule": F.col("_r.rule"), "bad": F.col("_r.bad")}).drop("_r")


def extra_thresholds(df: DataFrame, run: str, fd: str, thresholds: list[float]) -> DataFrame:
    """Frames above further displacement limits; limits are made unique and sorted."""
    limits = F.array(*[F.lit(t) for t in sorted(set(thresholds))])
    bad = F.count_if(F.col(fd) > F.col("threshold"))
    return (
        df.withColumn("threshold", F.explode(limits)).groupBy("threshold", run)
        .agg(bad.alias("n_bad"), (bad / F.count(F.lit(1)) * 100).alias("percent"))
    )


def bad_frame_reason(fd: str, z: str, incomplete: str, fd_limit: float, z_limit: float) -> Column:
    over_fd, over_z = F.col(fd) > fd_limit, F.col(z) > z_limit
    return (
        F.when(F.col(incomplete), "incomplete_last_frame").when(over_fd & over_z, "fd_and_dvars")
        .when(over_fd, "fd").when(over_z, "dvars")
    )


def coverage_preflight(runs: DataFrame, edges_ok: str, last_edge: str, before_last: str, samples: str, lengths_ok: str, identity_ok: str) -> DataFrame:
    """Margin, method and status per run; every run is reported, none is dropped."""
    margin = F.col(samples) - (F.col(last_edge) - 1)
    final_only = (margin < 0) & (F.col(before_last) <= F.col(samples) + 1)
    status = (
        F.when(~F.col(identity_ok), "identity mismatch").when(~F.col(lengths_ok), "length mismatch")
        .when((margin < 0) & ~final_only, "incomplete coverage").otherwise("ok")
    )
    return runs.withColumns({
        "coverage_margin": margin, "final_replacement": final_only,
        "alignment": F.when(F.col(edges_ok), "individual edges").otherwise("onset and nominal period"), "status": status,
    })


def task_locking(df: DataFrame, keys: list[str], columns: list[str], events: list[str]) -> DataFrame:
    """(keys, c, ev, r): correlation of each column with each event indicator, in one pass."""
    cells = [(c, e) for c in columns for e in events]
    wide = df.groupBy(*keys).agg(*[pearson(c, e).alias(f"{c}|{e}") for c, e in cells])
    packed = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(e).alias("ev"), F.col(f"`{c}|{e}`").alias("r")) for c, e in cells])
    return wide.select(*keys, F.explode(packed).alias("_x")).select(*keys, "_x.c", "_x.ev", "_x.r")


def degenerate_columns(df: DataFrame, keys: list[str], columns: list[str], tiny: float = 1e-12) -> DataFrame:
    """(keys, a, b, problem): constant columns and pairs with |r| above 1 - 1e-10."""
    sds = [F.stddev_samp(c).alias(f"s|{c}") for c in columns]
    pairs = [(a, b) for n, a in enumerate(columns) for b in columns[n + 1:]]
    rs = [pearson(a, b).alias(f"{a}|{b}") for a, b in pairs]
    wide = df.groupBy(*keys).agg(*sds, *rs)
    flat = [F.struct(F.lit(c).alias("a"), F.lit(None).cast("string").alias("b"), F.when(F.col(f"`s|{c}`") <= tiny, "constant").alias("problem")) for c in columns]
    near = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.abs(F.col(f"`{a}|{b}`")) > 1 - 1e-10, "collinear").alias("problem")) for a, b in pairs]
    return wide.select(*keys, F.explode(F.array(*flat, *near)).alias("_x")).select(*keys, "_x.a", "_x.b", "_x.problem").where("problem IS NOT NULL")


def gram(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key with the packed upper triangle of the sums of products, and the row count."""
    sums = [F.sum(col(a) * col(b)) for n, a in enumerate(columns) for b in columns[n:]]
    return df.groupBy(*keys).agg(F.array(*sums).alias("gram"), F.count(F.lit(1)).alias("n"))


def unpack_symmetric(values, k: int):
    """Packed upper triangle to a dense matrix; inside tasks only."""
    import numpy as np

    m = np.zeros((k, k))
    m[np.triu_indices(k)] = values
    return m + np.triu(m, 1).T


def design_diagnostics(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, rank, condition) of the design, from its Gram matrix."""
    import pandas as pd

    k = len(columns)
    packed = gram(df, keys, columns)

    def solve(batches):
        import numpy as np

        for batch in batches:
            rows = []
            for values in batch["gram"]:
                g = unpack_symmetric(np.asarray(values, dtype=float), k)
                d = np.sqrt(np.diag(g))
                d[d == 0] = 1.0
                ev = np.linalg.eigvalsh(g / np.outer(d, d))[::-1]
                rank = int((ev > ev[0] * 1e-10).sum())
                low = ev[rank - 1] if rank else float("nan")
                rows.append((rank, float(np.sqrt(ev[0] / low)) if rank == k else float("inf")))
            yield pd.concat([batch[[*keys, "n"]].reset_index(drop=True), pd.DataFrame(rows, columns=["rank", "condition"])], axis=1)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema if f.name != "gram")
    return packed.mapInPandas(solve, f"{schema}, rank int, condition double")


def drift_flags(df: DataFrame, keys: list[str], t: str, value: str, limit: float = 0.8) -> DataFrame:
    """Correlation with time, flag above the limit, and range over interquartile range."""
    from .ordered import percentiles

    base = df.groupBy(*keys).agg(pearson(value, t).alias("r_time"), (F.max(value) - F.min(value)).alias("_range"))
    q = percentiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75})
    return base.join(q, keys).select(
        *keys, "r_time", (F.abs("r_time") > limit).alias("drift"),
        (F.col("_range") / F.nullif(F.col("_q3") - F.col("_q1"), F.lit(0.0))).alias("range_over_iqr"),
    )


def golden_reconcile(new: DataFrame, saved: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """One row: keys on one side only, largest difference, and the verdict."""
    a = new.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(1).alias("_a"))
    b = saved.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(1).alias("_b"))
    gaps = [F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}")) for v in values]
    gap = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    out = a.join(b, keys, "full_outer").agg(
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_one_sided"), F.max(gap).alias("max_difference")
    )
    return out.withColumn("within", (F.col("n_one_sided") == 0) & (F.col("max_difference") <= tolerance))
