"""Cross-half similarity of context templates over repeated run splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.stats import fisher_z
from . import patterns
from .patterns import Places


def half_templates(units: DataFrame, splits: DataFrame, keys: list[str], vec: str, width: int | None = None) -> DataFrame:
    """(keys, split, in_a, context, template): equal mean over items of the within-item means.

    Units are read once, into run-centred sums per (run, context, item); splits only
    meet those sums.
    """
    sums, _ = patterns.cube(units, keys, "run", ["context", "item"], vec, width)
    halves = sums.join(splits, "run")
    cells = vectors.add_sums(halves, [*keys, "split", "in_a", "context", "item"], "s", "n", "s", "n", width)
    means = cells.withColumn("s", vectors.divide("s", "n"))
    t = vectors.sum_vectors(means, [*keys, "split", "in_a", "context"], "s", "s", "k", width)
    return t.select(*keys, "split", "in_a", "context", vectors.divide("s", "k").alias("template"))


def cross_similarity(templates: DataFrame, keys: list[str], clamp: float = 1e-12) -> DataFrame:
    """(keys, split, a, b, r, z): context a in half A against context b in half B."""
    t = vectors.unit_length(templates, "template", "template")
    a = t.where("in_a").select(*keys, "split", F.col("context").alias("a"), F.col("template").alias("ta"))
    b = t.where("NOT in_a").select(*keys, "split", F.col("context").alias("b"), F.col("template").alias("tb"))
    r = a.join(b, [*keys, "split"]).withColumn("r", vectors.dot("ta", "tb")).drop("ta", "tb")
    return r.withColumn("z", fisher_z("r", clamp))


def deltas(similarity: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, split, context, delta): overall (context NULL) and per context, diagonal minus off-diagonal.

    A context's own contrast uses the cells it shares with any other context, so each
    off-diagonal cell is sent to both of its contexts; the overall contrast uses each once.
    """
    same = F.col("a") == F.col("b")
    sent = similarity.withColumn("context", F.explode(F.array_distinct(F.array(F.col("a"), F.col("b"), F.lit(None).cast("int")))))
    return sent.groupBy(*keys, "split", "context").agg(
        (F.avg(F.when(same, F.col("z"))) - F.avg(F.when(~same, F.col("z")))).alias("delta")
    )


def over_splits(delta: DataFrame, keys: list[str]) -> DataFrame:
    return delta.groupBy(*keys, "context").agg(
        F.avg("delta").alias("mean_delta"), F.max("delta").alias("max_delta"), F.stddev_samp("delta").alias("sd_delta"),
        F.count("delta").alias("n_splits"),
    )


def split_half(
    units: DataFrame, splits: DataFrame, keys: list[str], vec: str, places: Places | None = None, width: int | None = None
) -> DataFrame:
    """Whole-width templates once; each region or neighbourhood reads only its own features of them."""
    t = half_templates(units, splits, keys, vec, width)
    if places is not None:
        t, keys = places.cut(t, "template"), [*keys, places.key]
    return over_splits(deltas(cross_similarity(t, keys), keys), keys)
