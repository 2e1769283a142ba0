"""Joins: reconciliation, nearest events, intervals, epochs, condition pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import last_known, next_known, running_sum, scan


def intersect_masks(base: DataFrame, keys: list[str], *masks: DataFrame) -> DataFrame:
    """Rows of ``base`` whose key is in every mask."""
    for m in masks:
        base = base.join(m.select(*keys), keys, "left_semi")
    return base


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(status, n): keys on one side only, equal and different values, NULL-safe."""
    l = left.select(*keys, *[F.col(v).alias(f"_l_{v}") for v in values], F.lit(True).alias("_inl"))
    r = right.select(*keys, *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(True).alias("_inr"))
    equal = F.lit(True)
    for v in values:
        equal = equal & F.col(f"_l_{v}").eqNullSafe(F.col(f"_r_{v}"))
    status = (
        F.when(F.col("_inl").isNull(), "right_only").when(F.col("_inr").isNull(), "left_only")
        .when(equal, "equal").otherwise("different")
    )
    return l.join(r, keys, "full_outer").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def lookup(df: DataFrame, stem: Column, manifest: DataFrame, name: Column, fields: list[str]) -> DataFrame:
    """Left lookup by case-insensitive name with the number of manifest matches.

    The manifest is first reduced to one row per name, so a repeated name cannot
    multiply rows; ``n_matches`` above one is the error the caller must report.
    """
    names = manifest.select(F.lower(name).alias("_name"), *fields)
    one = names.groupBy("_name").agg(
        F.count(F.lit(1)).alias("n_matches"), F.min(F.struct(*fields)).alias("_fields")
    ).select("_name", "n_matches", *[F.col(f"_fields.{f}").alias(f) for f in fields])
    out = df.withColumn("_name", F.lower(stem)).join(one, "_name", "left").drop("_name")
    return out.withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def nearest_event(
    targets: DataFrame, candidates: DataFrame, key: str, t: str, ident: str, chunk: Column
) -> DataFrame:
    """Each target with the candidate nearest in time in its key; the earlier one on a tie.

    Both streams are ordered together and the last and next candidate are carried.
    """
    c = candidates.groupBy(key, t).agg(F.min(ident).alias("_cand"))
    both = (
        targets.select(key, t, F.col(ident).alias("_id"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_cand"))
        .unionByName(c.select(key, t, F.col("_cand").alias("_id"), F.lit(0).alias("_kind"), "_cand"))
        .withColumn("_hit", F.when(F.col("_kind") == 0, F.struct(F.col(t).alias("at"), F.col("_cand").alias("id"))))
    )
    seen = scan(both, [key], chunk, [t, "_kind", "_id"], _back=last_known("_hit"), _fwd=next_known("_hit"))
    seen = seen.where(F.col("_kind") == 1)
    back, fwd = F.col(t) - F.col("_back.at"), F.col("_fwd.at") - F.col(t)
    use_back = F.col("_fwd").isNull() | (back <= fwd)
    pick = F.when(F.col("_back").isNotNull() & use_back, F.col("_back")).otherwise(F.col("_fwd"))
    return seen.select(
        key, F.col("_id").alias(ident), F.col(t), pick["id"].alias("matched"), F.abs(pick["at"] - F.col(t)).alias("gap")
    )


def interval_means(samples: DataFrame, edges: DataFrame, key: str, t: str, ident: str, value: str, chunk: Column) -> DataFrame:
    """(key, frame, n, mean): samples in [edge_i, edge_i+1); samples before the first edge are left out."""
    both = samples.select(key, t, ident, F.col(value).alias("_v"), F.lit(0).alias("_edge")).unionByName(
        edges.select(key, t, ident, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_edge"))
    )
    both = both.withColumn("_late", 1 - F.col("_edge"))
    placed = scan(both, [key], chunk, [t, "_late", ident], frame=running_sum("_edge"))
    return (
        placed.where((F.col("_edge") == 0) & (F.col("frame") > 0))
        .groupBy(key, "frame").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))
    )


def epochs(onsets: DataFrame, series: DataFrame, run: str, frame: str, first: int = -5, last: int = 15) -> DataFrame:
    """Samples around each onset: an equi-join on (run, frame), so hot runs spread."""
    steps = F.explode(F.sequence(F.lit(first), F.lit(last)))
    want = onsets.select(run, F.col(frame).alias("onset"), steps.alias("rel")).withColumn(frame, F.col("onset") + F.col("rel"))
    return want.join(series, [run, frame])


def upper_pairs(conditions: DataFrame, keys: list[str], index: str, values: list[str]) -> DataFrame:
    """All pairs i < j of *conditions* (tens per key by design, never raw rows)."""
    a = conditions.select(*keys, F.col(index).alias("i"), *[F.col(v).alias(f"{v}_i") for v in values])
    b = conditions.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col(index).alias("j"), *[F.col(v).alias(f"{v}_j") for v in values])
    on = F.col("i") < F.col("j")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_b_{k}"))
    return a.join(b, on).drop(*[f"_b_{k}" for k in keys])


def same_item_pairs(conditions: DataFrame, keys: list[str], item: str, context: str, values: list[str]) -> DataFrame:
    """Pairs of contexts of one item, named ``a_vs_b``."""
    pairs = upper_pairs(conditions, [*keys, item], context, values)
    return pairs.withColumn("context_pair", F.concat_ws("_vs_", "i", "j")).drop("i", "j")


def from_baseline(df: DataFrame, keys: list[str], is_base: Column, value: str, out: str) -> DataFrame:
    """Absolute distance of each row to its key's mean over the baseline rows."""
    base = df.where(is_base).groupBy(*keys).agg(F.avg(value).alias("_base"))
    return df.where(~is_base).join(base, keys).withColumn(out, F.abs(F.col(value) - F.col("_base"))).drop("_base")


def permuted_pairs(pairs: DataFrame, mapping: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value of the pair (map(i), map(j)) for every permutation, from an i < j table."""
    m1 = mapping.select(*keys, "perm", F.col("index").alias("i"), F.col("mapped").alias("_mi"))
    m2 = mapping.select(*keys, "perm", F.col("index").alias("j"), F.col("mapped").alias("_mj"))
    moved = pairs.select(*keys, "i", "j").join(m1, [*keys, "i"]).join(m2, [*keys, "perm", "j"])
    moved = moved.withColumns({"_lo": F.least("_mi", "_mj"), "_hi": F.greatest("_mi", "_mj")})
    source = pairs.select(*keys, F.col("i").alias("_lo"), F.col("j").alias("_hi"), F.col(value))
    return moved.join(source, [*keys, "_lo", "_hi"]).select(*keys, "perm", "i", "j", value)


def one_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present on one side only."""
    l, r = left.select(*keys).distinct(), right.select(*keys).distinct()
    return (
        l.join(r, keys, "left_anti").withColumn("side", F.lit("left"))
        .unionByName(r.join(l, keys, "left_anti").withColumn("side", F.lit("right")))
    )


def full_grid_status(grid: DataFrame, results: DataFrame, keys: list[str], analysis: str, expected: dict[str, int]) -> DataFrame:
    """Every key and analysis once: result where there is one, with ok / partial / missing."""
    kinds = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in expected.items()])
    full = grid.withColumn("_k", F.explode(kinds)).select(*keys, F.col("_k.a").alias(analysis), F.col("_k.n").alias("_expected"))
    status = F.when(F.col("n_valid").isNull(), "missing").when(F.col("n_valid") < F.col("_expected"), "partial").otherwise("ok")
    return full.join(results, [*keys, analysis], "left").withColumn("status", status).select(
        *keys, analysis, F.coalesce("n_valid", F.lit(0)).alias("n_valid"), "value", "status"
    )
