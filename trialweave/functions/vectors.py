"""Array columns as vectors, and sums of vectors over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def total(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v)


def mean(a) -> Column:
    return total(a) / F.size(col(a))


def subtract(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def divide(a, n) -> Column:
    n = col(n)
    return F.transform(col(a), lambda x: x / n)


def scale(a, n) -> Column:
    n = col(n)
    return F.transform(col(a), lambda x: x * n)


def centred(df: DataFrame, vec: str, out: str) -> DataFrame:
    """Each vector minus its own mean; the mean is a column so it is computed once."""
    return (
        df.withColumn("_mean", mean(vec))
        .withColumn(out, F.transform(F.col(vec), lambda x: x - F.col("_mean")))
        .drop("_mean")
    )


def unit_length(df: DataFrame, vec: str, out: str, tiny: float = 2.220446049250313e-16) -> DataFrame:
    """Centred vector scaled to length one; NULL where it has no variance."""
    df = centred(df, vec, out).withColumn("_norm", F.sqrt(dot(out, out)))
    scaled = F.transform(F.col(out), lambda x: x / F.col("_norm"))
    return df.withColumn(out, F.when(F.col("_norm") > F.lit(tiny), scaled)).drop("_norm")


def to_long(df: DataFrame, vec: str, dim: str = "dim", value: str = "value") -> DataFrame:
    """One row per vector element."""
    rest = [c for c in df.columns if c != vec]
    return df.select(*rest, F.posexplode(vec).alias(dim, value))


def to_vector(df: DataFrame, keys: list[str], dim: str, value: str, out: str, **extra: Column) -> DataFrame:
    """Rows back to one array per key; a group is as wide as the vector, no more."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(dim), F.col(value))))
    return (
        df.groupBy(*keys)
        .agg(packed.alias("_packed"), *[c.alias(n) for n, c in extra.items()])
        .withColumn(out, F.transform("_packed", lambda s: s.getField(value)))
        .drop("_packed")
    )


NARROW = 128  # up to this width a vector sum is one aggregate column per element


def _element_sums(vec: str, width: int) -> Column:
    """Sum of each of the ``width`` elements over a group; fails on another width or a missing element."""
    wrong = F.raise_error(F.lit(f"a vector of {vec} is not of width {width} or misses an element")).cast("double")
    sums = []
    for i in range(width):
        x = F.get(F.col(vec), F.lit(i))
        whole = F.count(x) == F.count(vec)
        if i == 0:
            whole = whole & (F.coalesce(F.max(F.size(vec)), F.lit(width)) <= width)
        sums.append(F.when(whole, F.sum(x)).otherwise(wrong))
    return F.array(*sums)


def _whole(n: Column, present: Column) -> Column:
    """The count, where no element of that place is missing."""
    return F.when(n == present, n).otherwise(F.raise_error(F.lit("a vector misses an element")).cast("bigint"))


def sum_vectors(df: DataFrame, keys: list[str], vec: str, out: str = "total", count: str = "n", width: int | None = None) -> DataFrame:
    """Element-wise sum and row count per key, combined on the map side; a NULL vector is no row.

    With a known narrow width the elements are summed as plain columns: one shuffle of
    one row per key and task. Otherwise elements are exploded first, so the shuffle
    carries (keys x width) rows per task however many vectors a hot key holds.
    """
    if width and width <= NARROW:
        return df.groupBy(*keys).agg(_element_sums(vec, width).alias(out), F.count(vec).alias(count))
    long = df.select(*keys, F.posexplode(vec).alias("_dim", "_v"))
    sums = long.groupBy(*keys, "_dim").agg(F.sum("_v").alias("_s"), _whole(F.count(F.lit(1)), F.count("_v")).alias("_n"))
    return to_vector(sums, keys, "_dim", "_s", out, **{count: F.max("_n")})


def add_sums(df: DataFrame, keys: list[str], vec: str, n: str, out: str, out_n: str, width: int | None = None) -> DataFrame:
    """Sum of partial sums: vectors added, their counts added."""
    if width and width <= NARROW:
        return df.groupBy(*keys).agg(_element_sums(vec, width).alias(out), F.sum(n).alias(out_n))
    long = df.select(*keys, F.col(n).alias("_n"), F.posexplode(vec).alias("_dim", "_v"))
    sums = long.groupBy(*keys, "_dim").agg(F.sum("_v").alias("_s"), F.sum("_n").alias("_c"))
    return to_vector(sums, keys, "_dim", "_s", out, **{out_n: F.max("_c")})
