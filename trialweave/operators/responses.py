"""Response tables: contrasts, designs, least squares per feature, epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import col
from .matching import epochs
from .quality import unpack_symmetric


def metric_change(before: DataFrame, after: DataFrame, keys: list[str], metric: str) -> DataFrame:
    a = before.select(*keys, F.col(metric).alias("_before"))
    return after.join(a, keys).withColumn(f"{metric}_change", F.col(metric) - F.col("_before")).drop("_before")


def class_contrasts(df: DataFrame, label: str, keys: list[str], value: str, classes: list[int]) -> DataFrame:
    """Each class mean minus the mean of the other class means; weights sum to zero."""
    means = df.groupBy(label, *keys).agg(F.avg(value).alias("_m"))
    rest = -1.0 / (len(classes) - 1)
    sent = means.withColumn("target", F.explode(F.array(*[F.lit(c) for c in classes])))
    return sent.groupBy("target", *keys).agg(
        F.sum(F.col("_m") * F.when(F.col(label) == F.col("target"), 1.0).otherwise(rest)).alias("contrast")
    )


def event_design(df: DataFrame, keys: list[str], onset: str, period: float) -> DataFrame:
    """Sparse design: one row per key and frame that holds an onset, frames counted from one."""
    frame = F.ceil(F.col(onset) / F.lit(period)).alias("frame")
    return df.where(F.col(onset) > 0).groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("n_events"))


def weights_by_run(df: DataFrame, keys: list[str], run: str, label: str, weight: Column) -> DataFrame:
    """Class weight shared equally by the runs that have a column for the class."""
    columns = df.select(*keys, run, label).distinct()
    counts = columns.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_k"))
    return columns.join(counts, [*keys, label]).withColumn("weight", weight / F.col("_k")).drop("_k")


def mass_univariate_ols(df: DataFrame, keys: list[str], value: str, design: list[Column], contrast: list[float]) -> DataFrame:
    """(keys, estimate, t, dof): least squares of every feature on one short design.

    The sums of products of design and value are aggregated by Spark; tasks only solve
    one small system per feature.
    """
    import pandas as pd

    k = len(design)
    names = [f"_d{n}" for n in range(k)]
    data = df.select(*keys, col(value).alias("_y"), *[d.alias(n) for d, n in zip(design, names)])
    products = [F.sum(F.col(a) * F.col(b)) for n, a in enumerate(names) for b in names[n:]]
    sums = data.groupBy(*keys).agg(
        F.array(*products).alias("xx"), F.array(*[F.sum(F.col(a) * F.col("_y")) for a in names]).alias("xy"),
        F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.count("_y").alias("n"),
    )

    def solve(batches):
        import numpy as np

        c = np.asarray(contrast)
        for batch in batches:
            rows = []
            for xx, xy, yy, n in zip(batch["xx"], batch["xy"], batch["yy"], batch["n"]):
                g, h = unpack_symmetric(np.asarray(xx, dtype=float), k), np.asarray(xy, dtype=float)
                inverse = np.linalg.pinv(g)
                b = inverse @ h
                rank = int(np.linalg.matrix_rank(g))
                dof = int(n) - rank
                sigma2 = max(yy - b @ h, 0.0) / dof if dof > 0 else float("nan")
                se = float(np.sqrt(sigma2 * (c @ inverse @ c)))
                rows.append((float(c @ b), float(c @ b) / se if se > 0 else None, dof))
            out = pd.DataFrame(rows, columns=["estimate", "t", "dof"])
            yield pd.concat([batch[keys].reset_index(drop=True), out], axis=1)

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in keys)
    return sums.mapInPandas(solve, f"{head}, estimate double, t double, dof int")


def epoch_average(onsets: DataFrame, series: DataFrame, run: str, frame: str, label: str, value: str) -> DataFrame:
    """(label, rel, n, mean): percent of the run mean, each epoch minus its mean over frames -3..-1."""
    mean = series.groupBy(run).agg(F.avg(value).alias("_mu"))
    pct = series.join(mean, run).select(run, frame, (F.lit(100) * F.col(value) / F.col("_mu")).alias("_v"))
    e = epochs(onsets, pct, run, frame).join(onsets.select(run, F.col(frame).alias("onset"), label), [run, "onset"])
    base = e.where("rel BETWEEN -3 AND -1").groupBy(run, "onset").agg(F.avg("_v").alias("_b"))
    return e.join(base, [run, "onset"]).groupBy(label, "rel").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_v") - F.col("_b")).alias("mean"))
