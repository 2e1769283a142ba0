"""Label coding, filters, deterministic subsets and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import col, finite
from .ordered import number_rows


def encode_labels(df: DataFrame, label: str, order: list[str], out: str = "code") -> DataFrame:
    """Text labels to their 1-based place in ``order``; unknown labels get NULL."""
    clean = F.upper(F.trim(F.col(label)))
    return df.withColumn(out, F.nullif(F.array_position(F.array(*[F.lit(o.upper()) for o in order]), clean), F.lit(0)))


def unknown_labels(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    return encode_labels(df, label, order, "_code").where("_code IS NULL").select(label).distinct()


def encode_numbers(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Numeric labels to their sorted rank among the distinct values."""
    from .ordered import distribution

    values = df.select(label).distinct()
    codes = distribution(values, [], label).select(label, F.col("_cum").alias(out))
    return df.join(codes, label)


def condition_code(context: str, item: str, n_items: int) -> Column:
    """Context-major condition index, 1-based, from 1-based codes."""
    return (F.col(context) - 1) * n_items + F.col(item)


def drop_control(df: DataFrame, context: str, control) -> DataFrame:
    return df.where(F.col(context) != F.lit(control))


def complete_features(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of features that are finite in every unit."""
    good = df.groupBy(*keys).agg(F.bool_and(finite(value)).alias("_ok")).where("_ok").select(*keys)
    return df.join(good, keys, "left_semi")


def guard_min_features(df: DataFrame, keys: list[str], minimum: int = 10) -> DataFrame:
    """One status row per region; small regions stay in the table."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_features"))
        .withColumn("status", F.when(F.col("n_features") < minimum, "insufficient_features").otherwise("ok"))
    )


def evenly_spaced(df: DataFrame, chunk, order: list[str], count: int) -> DataFrame:
    """``count`` rows at evenly spaced places along ``order``, first and last included."""
    numbered = number_rows(df, [], chunk, order, "_rn")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    step = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    places = (
        n.select("_n", step.alias("_s"))
        .select(F.floor(1 + (F.col("_n") - 1) * F.col("_s") / F.lit(count - 1.0) + 0.5).alias("_rn"))
        .distinct()
    )
    return numbered.join(places, "_rn", "left_semi").drop("_rn")


def apply_sign_map(df: DataFrame, signs: DataFrame, keys: list[str], value: str, sign: str = "sign") -> DataFrame:
    """Multiply by the sign listed for the key; unlisted keys keep their value."""
    return (
        df.join(signs, keys, "left")
        .withColumn(value, F.coalesce(F.col(sign), F.lit(1)) * F.col(value))
        .drop(sign)
    )


def recentre(value, centre: float = 756.0) -> Column:
    """Screen position relative to the fixed screen centre."""
    return col(value) - F.lit(centre)


class InvariantError(ValueError):
    pass


def violation_counts(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(check, n_rows, n_violations): a row violates a check where its condition is not true."""
    parts = [
        df.agg(
            F.lit(name).alias("check_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_violations"),
        )
        for name, (df, ok) in checks.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def assert_invariants(checks: dict[str, tuple[DataFrame, Column]]) -> None:
    """Raise with every violated check; the collected table has one row per check."""
    bad = violation_counts(checks).where("n_violations > 0").collect()
    if bad:
        raise InvariantError("; ".join(f"{r.check_name}: {r.n_violations} of {r.n_rows}" for r in bad))
