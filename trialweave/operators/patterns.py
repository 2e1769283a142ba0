"""Pattern classification with held-out blocks, on array columns.

A unit is one row with one vector. One pass over the units builds a *cube*: vector sums
per (block, class). Block means, centring, held-out templates (total minus own block)
and every permutation are algebra on that small cube. A second pass scores the units:
each row meets the few templates of its fold, and the dot product turns a pair of
vectors into one number inside the join, before anything is shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import durable

DIGITS = 12  # similarities are rounded before ranking, so the last bits decide no tie


@dataclass(frozen=True)
class Places:
    """How a whole-width vector is cut into regions or neighbourhoods.

    ``cut(df, vec)`` adds the key column ``key`` and restricts ``vec`` to the place.
    """

    key: str
    cut: Callable[[DataFrame, str], DataFrame]


def slices(count: int, width: int, key: str = "region") -> Places:
    """Consecutive equal slices of the vector."""

    def cut(df: DataFrame, vec: str) -> DataFrame:
        df = df.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        return df.withColumn(vec, F.slice(vec, F.col(key) * width + 1, width))

    return Places(key, cut)


def neighbourhoods(membership: DataFrame, key: str = "centre") -> Places:
    """Overlapping places given as (key, dim) rows; a place is as wide as its neighbourhood."""

    def cut(df: DataFrame, vec: str) -> DataFrame:
        rest = [c for c in df.columns if c != vec]
        near = vectors.to_long(df, vec, "_d", "_v").join(membership.select(key, F.col("dim").alias("_d")), "_d")
        return vectors.to_vector(near, [*rest, key], "_d", "_v", vec)

    return Places(key, cut)


def cube(
    units: DataFrame, keys: list[str], block: str, cells: list[str], vec: str, width: int | None = None, centre: bool = True
) -> tuple[DataFrame, DataFrame]:
    """((keys, block, cells, n, s), (keys, block, mean)): sums per cell and the block means.

    With ``centre`` the sums are those of vectors minus their block mean. The cube is
    written once: it is read several times and is far smaller than the units.
    """
    raw = durable(vectors.sum_vectors(units, [*keys, block, *cells], vec, "s", "n", width))
    means = vectors.add_sums(raw, [*keys, block], "s", "n", "_s", "_n", width).select(
        *keys, block, vectors.divide("_s", "_n").alias("block_mean")
    )
    if not centre:
        return raw, means
    n = F.col("n")
    moved = F.zip_with("s", "block_mean", lambda s, m: s - n * m)
    return raw.join(means, [*keys, block]).withColumn("s", moved).drop("block_mean"), means


def centre_blocks(units: DataFrame, means: DataFrame, on: list[str], vec: str) -> DataFrame:
    """Vectors minus the mean vector of their block (all units of the block, tested ones too)."""
    return units.join(means, on).withColumn(vec, vectors.subtract(vec, "block_mean")).drop("block_mean")


def leave_out(sums: DataFrame, keys: list[str], block: str, label: str, width: int | None = None) -> DataFrame:
    """(keys, block, label, n, template): class means over all blocks but ``block``."""
    total = vectors.add_sums(sums, [*keys, label], "s", "n", "tot", "tot_n", width)
    blocks = sums.select(*keys, block).distinct()
    grid = blocks.join(total, keys) if keys else blocks.join(total, F.lit(True))  # folds x classes
    own = sums.select(*keys, block, label, F.col("s").alias("own"), F.col("n").alias("own_n"))
    left = grid.join(own, [*keys, block, label], "left")
    n = F.col("tot_n") - F.coalesce("own_n", F.lit(0))
    rest = F.when(F.col("own").isNull(), F.col("tot")).otherwise(vectors.subtract("tot", "own"))
    return (
        left.withColumns({"n": n, "_rest": rest}).where("n > 0")
        .select(*keys, block, label, "n", vectors.divide("_rest", "n").alias("template"))
    )


def held_out_templates(
    units: DataFrame, keys: list[str], block: str, label: str, vec: str, width: int | None = None, centre: bool = False
) -> DataFrame:
    return leave_out(cube(units, keys, block, [label], vec, width, centre)[0], keys, block, label, width)


def similarities(tests: DataFrame, templates: DataFrame, on: list[str], vec: str, candidate: str) -> DataFrame:
    """Pearson correlation of each test vector with each template sharing ``on``."""
    rest = [c for c in templates.columns if c not in (candidate, "template", "n")]
    t = vectors.unit_length(templates.select(*rest, F.col(candidate).alias("candidate"), "template"), "template", "template")
    x = vectors.unit_length(tests, vec, vec)
    return x.join(t, on).withColumn("similarity", vectors.dot(vec, "template")).drop(vec, "template")


def decide(sims: DataFrame, unit: list[str], truth: str) -> DataFrame:
    """Prediction and evidence per unit in one aggregate; a tie goes to the smallest class."""
    s = F.round("similarity", DIGITS)
    own = F.sum(F.when(F.col("candidate") == F.col(truth), F.col("similarity")))
    rest = (F.sum("similarity") - own) / F.nullif(F.count("similarity") - 1, F.lit(0))
    return sims.groupBy(*unit, truth).agg(
        F.max_by("candidate", F.when(s.isNotNull(), F.struct(s.alias("s"), (-F.col("candidate")).alias("c")))).alias("predicted"),
        F.when(F.count("similarity") == F.count(F.lit(1)), own - rest).alias("evidence"),
    )


def train_scaling(units: DataFrame, means: DataFrame, block: str, vec: str, width: int | None) -> DataFrame:
    """(block, mu, sd) over all other blocks of the centred vectors; sd NULL where a feature is flat.

    The sums of squares about the block mean come from raw sums, so units are read once.
    """
    sq = units.select(block, F.transform(vec, lambda v: v * v).alias("_xx"))
    raw = vectors.sum_vectors(sq, [block], "_xx", "_q", "n", width).join(means, block)
    n = F.col("n")
    ss = raw.select(block, "n", F.zip_with("_q", "block_mean", lambda q, m: q - n * m * m).alias("s"), F.lit(0).alias("_one"))
    left = leave_out(ss, [], block, "_one", width)
    count = F.col("n")
    # Centred blocks sum to zero, so the training mean is zero and only the spread is needed.
    var = F.transform("template", lambda q: q * count / (count - 1))
    return left.withColumn("_v", var).select(block, F.transform("_v", lambda v: F.when(v > 1e-24, F.sqrt(v))).alias("sd"))


def decode(
    units: DataFrame, unit: str, block: str, label: str, vec: str, places: Places, width: int | None = None,
    labels: DataFrame | None = None, demean: bool = False, scale: bool = False, min_features: int = 1,
) -> DataFrame:
    """(perm, place, block, unit, label, predicted, evidence) of leave-one-block-out template decoding.

    ``labels`` (perm, unit, permuted) replaces the true labels once per permutation.
    Only the cube is built per permutation; unit vectors are cut and normalised once.
    """
    perm = ["perm"] if labels is not None else []
    named = units.select(unit, block, label, vec)
    if labels is not None:
        named = named.drop(label).join(labels.select("perm", unit, F.col("permuted").alias(label)), unit)
    sums, means = cube(named, perm, block, [label], vec, width)
    templates = leave_out(sums, perm, block, label, width)
    tests = units.select(unit, block, *([] if perm else [label]), vec)
    means = means.where("perm = 0").drop("perm") if perm else means  # the same in every permutation
    tests = centre_blocks(tests, means, [block], vec)
    if scale:
        sd = train_scaling(units, means, block, vec, width)
        divide = lambda v: F.zip_with(v, "sd", lambda x, s: x / s)
        templates = templates.join(sd, block).withColumn("template", divide("template")).drop("sd")
        tests = tests.join(sd, block).withColumn(vec, divide(vec)).drop("sd")
    templates, tests = places.cut(templates, "template"), places.cut(tests, vec)
    if scale:
        templates = templates.withColumn("template", F.filter("template", lambda v: v.isNotNull()))
        tests = tests.withColumn(vec, F.filter(vec, lambda v: v.isNotNull()))
    tests = tests.where(F.size(vec) >= min_features)
    # ``demean`` needs no step of its own: the correlation removes each vector's mean anyway.
    sims = similarities(tests, templates, [places.key, block], vec, label)
    if perm:
        sims = sims.join(labels.select("perm", unit, F.col("permuted").alias(label)), ["perm", unit])
    return decide(sims, [*perm, places.key, block, unit], label)


def decode_one_out(units: DataFrame, keys: list[str], unit: str, label: str, vec: str, scale: bool = False, width: int | None = None) -> DataFrame:
    """Leave-one-unit-out decoding in closed form: only the own class template changes."""
    sums = durable(vectors.sum_vectors(units, [*keys, label], vec, "s", "n", width))
    classes = sums.select(*keys, F.col(label).alias("candidate"), "s", "n")
    x = units.select(*keys, unit, label, vec)
    own = F.col("candidate") == F.col(label)
    pairs = x.join(classes, keys) if keys else x.join(classes, F.lit(True))  # units x classes
    count = F.when(own, F.col("n") - 1).otherwise(F.col("n"))
    pairs = pairs.withColumns({
        "_count": count, "_sum": F.when(own, vectors.subtract("s", vec)).otherwise(F.col("s"))
    }).where("_count > 0")
    pairs = pairs.withColumn("template", vectors.divide("_sum", "_count")).drop("s", "n", "_sum", "_count")
    if scale:
        sq = units.select(*keys, F.transform(vec, lambda v: v * v).alias("_xx"))
        a = vectors.add_sums(sums, keys, "s", "n", "_s1", "_n", width)
        b = vectors.sum_vectors(sq, keys, "_xx", "_s2", "_n2", width)
        stats = a.join(b, keys) if keys else a.join(b, F.lit(True))
        pairs = pairs.join(stats, keys) if keys else pairs.join(stats, F.lit(True))
        m = F.col("_n") - 1
        pairs = pairs.withColumn("mu", F.zip_with("_s1", vec, lambda s, v: (s - v) / m))
        pairs = pairs.withColumn("_q", F.zip_with("_s2", vec, lambda s, v: (s - v * v) / m))
        var = F.zip_with("mu", "_q", lambda a_, b_: b_ - a_ * a_)
        pairs = pairs.withColumn("sd", F.transform(var, lambda v: F.when(v > 1e-24, F.sqrt(v * m / (m - 1)))))
        pairs = pairs.withColumns({"template": standardise("template"), vec: standardise(vec)})
        pairs = pairs.drop("mu", "sd", "_q", "_s1", "_s2", "_n", "_n2")
    pairs = vectors.unit_length(vectors.unit_length(pairs, "template", "template"), vec, vec)
    sims = pairs.withColumn("similarity", vectors.dot(vec, "template")).drop(vec, "template")
    return decide(sims, [*keys, unit], label)


def standardise(vec: str) -> Column:
    """(x - mu) / sd with flat features left out."""
    moved = F.zip_with(F.zip_with(vec, "mu", lambda x, m: x - m), "sd", lambda x, s: x / s)
    return F.filter(moved, lambda v: v.isNotNull())


def permuted_units(units: DataFrame, labels: DataFrame, unit: str, label: str) -> DataFrame:
    """Units once per permutation with the permuted label in place of the true one."""
    return units.drop(label).join(labels.select("perm", unit, F.col("permuted").alias(label)), unit)
