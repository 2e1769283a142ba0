"""Aggregations. Every one is a partial aggregate with a join back, never a window over a raw key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clamp, col, pearson
from ..session import durable, packed
from .ordered import join_few, percentiles


def centre_within(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Value minus the mean of its key."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return df.join(means, keys).withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def zscore_within(df: DataFrame, keys: list[str], value: str, out: str, tiny: float = 1e-12) -> DataFrame:
    """Sample-sd z score inside each key; NULL where the key has no spread."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.when(F.col("_s") > tiny, (F.col(value) - F.col("_m")) / F.col("_s"))
    return join_few(df, stats, keys).withColumn(out, z).drop("_m", "_s")


def zscore_from_train(df: DataFrame, keys: list[str], is_train: Column, value: str, out: str, tiny: float = 1e-12) -> DataFrame:
    """z score with mean and sd of the training rows only."""
    stats = df.where(is_train).groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.when(F.col("_s") > tiny, (F.col(value) - F.col("_m")) / F.col("_s"))
    return join_few(df, stats, keys).withColumn(out, z).drop("_m", "_s")


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, valid, missing, mean, sd and exact median per key."""
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"), F.count(value).alias("n_valid"),
        (F.count(F.lit(1)) - F.count(value)).alias("n_missing"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
    )
    return base.join(percentiles(df, keys, value, {"median": 0.5}), keys, "left")


def equal_weight_mean(df: DataFrame, levels: list[list[str]], value: str, out: str) -> DataFrame:
    """Means of means: each level averages the level before it with equal weights."""
    for keys in levels:
        df = df.groupBy(*keys).agg(F.avg(value).alias(value)) if keys else df.agg(F.avg(value).alias(value))
    return df.withColumnRenamed(value, out)


def robust_z(df: DataFrame, run: str, frame: str, value: str, out: str) -> DataFrame:
    """(x - median) / (1.4826 MAD) per run from frame 2 on; frame 1 is zero; a run without spread is an error."""
    df = packed(df)  # read four times below
    later = df.where(F.col(frame) > 1)
    med = durable(percentiles(later, [run], value, {"_med": 0.5}))
    dev = join_few(later, med, [run]).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = percentiles(dev, [run], "_dev", {"_mad": 0.5})
    scaled = join_few(df, med.join(mad, run), [run], "left")
    scale = F.col("_mad") * 1.4826
    flat = F.raise_error(F.lit(f"{value} has no spread in a run")).cast("double")
    z = F.when(F.col(frame) == 1, F.lit(0.0)).when(scale > 0, (F.col(value) - F.col("_med")) / scale).otherwise(flat)
    return scaled.withColumn(out, z).drop("_med", "_mad")


def confusion(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """Full grid of true x predicted counts with row fractions; the classes are all that occur on either side."""
    counts = df.groupBy(*keys, truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy(*keys, truth).agg(F.sum("n").alias("_row"))
    seen = counts.select(F.explode(F.array(truth, predicted)).alias("_c")).where("_c IS NOT NULL").distinct()
    classes = seen.agg(F.collect_list("_c").alias("_classes"))  # one row; classes are counted in tens
    grid = rows.join(classes, F.lit(True)).withColumn(predicted, F.explode("_classes")).drop("_classes")
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, [*keys, truth, predicted], "left").select(
        *keys, truth, predicted, n.alias("n"), (n / F.col("_row")).alias("fraction")
    )


def accuracy(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """Accuracy and mean class recall."""
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    per_class = df.groupBy(*keys, truth).agg(F.sum(F.coalesce(hit, F.lit(0.0))).alias("_hits"), F.count(F.lit(1)).alias("_n"))
    out = [
        F.sum("_n").alias("n_units"), (F.sum("_hits") / F.sum("_n")).alias("accuracy"),
        F.avg(F.col("_hits") / F.col("_n")).alias("balanced_accuracy"),
    ]
    return per_class.groupBy(*keys).agg(*out)


def evidence(df: DataFrame, keys: list[str], truth: str, candidate: str, score: str) -> DataFrame:
    """Score of the true class minus the mean of the other classes, per unit."""
    own = F.sum(F.when(F.col(candidate) == F.col(truth), F.col(score)))
    return df.groupBy(*keys, truth).agg(
        (own - (F.sum(score) - own) / (F.count(score) - 1)).alias("evidence")
    )


def fisher_mean(r, bound: float = 1 - 1e-12) -> Column:
    return F.tanh(F.avg(F.atanh(clamp(r, bound))))


def diagonal_contrast(df: DataFrame, keys: list[str], a: str, b: str, z: str) -> DataFrame:
    """Mean of the diagonal cells minus mean of the others."""
    same = F.col(a) == F.col(b)
    return df.groupBy(*keys).agg(
        F.avg(F.when(same, F.col(z))).alias("mean_diagonal"), F.avg(F.when(~same, F.col(z))).alias("mean_off_diagonal"),
    ).withColumn("delta", F.col("mean_diagonal") - F.col("mean_off_diagonal"))


def class_contrast(df: DataFrame, keys: list[str], a: str, b: str, z: str) -> DataFrame:
    """Per class: its diagonal cell minus the mean of the cells it shares with other classes.

    Each off-diagonal cell counts for both of its classes.
    """
    both = df.withColumn("class", F.explode(F.array_distinct(F.array(a, b))))
    same = F.col(a) == F.col(b)
    return both.groupBy(*keys, "class").agg(
        (F.avg(F.when(same, F.col(z))) - F.avg(F.when(~same, F.col(z)))).alias("delta")
    )


def censor_summary(df: DataFrame, run: str, rule: str, bad: str, subject: list[str] | None = None) -> DataFrame:
    """Per rule: totals, largest run percentage, and runs above 5, 10 and 20 percent."""
    keys = [*(subject or []), rule]
    per_run = df.groupBy(*keys, run).agg(F.count_if(bad).alias("_bad"), F.count(F.lit(1)).alias("_n"))
    pct = F.col("_bad") / F.col("_n") * 100
    return per_run.groupBy(*keys).agg(
        F.sum("_bad").alias("n_censored"), (F.sum("_bad") / F.sum("_n") * 100).alias("percent_censored"),
        F.max(pct).alias("max_run_percent"), F.count_if(pct > 5).alias("runs_over_5pct"),
        F.count_if(pct > 10).alias("runs_over_10pct"), F.count_if(pct > 20).alias("runs_over_20pct"),
    )


def overlap_counts(df: DataFrame, at: list[str], significant: str) -> DataFrame:
    """Per cell: how many maps cover it, how many are significant there, and the fraction."""
    return df.groupBy(*at).agg(
        F.count_if(significant).alias("n_significant"), F.count(significant).alias("coverage"),
        (F.count_if(significant) / F.count(significant)).alias("fraction"),
    )


def tsnr(df: DataFrame, voxel: str, run: str, value: str) -> DataFrame:
    """(run, tsnr): mean over sd per voxel and run; voxels flat in any run are left out of all runs."""
    per = df.groupBy(voxel, run).agg((F.avg(value) / F.nullif(F.stddev_samp(value), F.lit(0.0))).alias("_t"))
    good = per.groupBy(voxel).agg(F.bool_and(F.col("_t").isNotNull()).alias("_ok")).where("_ok").select(voxel)
    return per.join(good, voxel, "left_semi").groupBy(run).agg(F.avg("_t").alias("tsnr"), F.count(F.lit(1)).alias("n_voxels"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def correlations(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, a, b, r) for every pair of a short list of columns, in one pass."""
    named = [(a, b) for n, a in enumerate(columns) for b in columns[n:]]
    wide = df.groupBy(*keys).agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in named])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in named])
    return wide.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.a", "_c.b", "_c.r")
