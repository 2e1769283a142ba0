"""Permutation p values, multiple testing, maximum statistics and sign flips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import normal_cdf, normal_quantile
from ..functions.stats import finite, only_finite
from ..session import durable
from .ordered import CHUNK_ROWS, distribution, min_from_here, running_sum, scan, value_at


def bh_fdr(df: DataFrame, family: list[str], p: str, out: str = "q") -> DataFrame:
    """Step-up false discovery rate inside each declared family; a missing p stays missing.

    Equal p values share one row of the distribution: permutation p values take few
    distinct values however many tests there are. q is the smallest p*m/rank from
    there on, which needs only a suffix minimum over chunks of p.
    """
    df = durable(df)  # q is joined back on the exact p, which a recomputed sum might not repeat
    dist = distribution(df, family, p).withColumn("_raw", F.col(p) * F.col("_total") / F.col("_cum"))
    # Halves of the unit interval by magnitude keep the chunks in order and the small p values apart.
    chunk = F.floor(F.log2(F.greatest(F.col(p), F.lit(1e-300))) * 8)
    adj = scan(dist, family, chunk, [p], _min=min_from_here("_raw"))
    adj = adj.select(*family, p, F.least("_min", F.lit(1.0)).alias(out))
    return df.join(adj, [*family, p], "left")


def bh_fdr_with_placeholders(df: DataFrame, family: list[str], p: str, failed: str, out: str = "q") -> DataFrame:
    """Failed tests count as p = 1 during the adjustment only."""
    held = df.withColumn(p, F.when(F.col(failed), F.lit(1.0)).otherwise(F.col(p)))
    return bh_fdr(held, family, p, out).where(~F.col(failed))


def fwe_threshold(maxima: DataFrame, keys: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """The ceil((1-alpha)(n+1))-th smallest of the null maxima."""
    rank = F.ceil(F.lit(1 - alpha) * (F.col("_total") + 1))
    return distribution(maxima, keys, value).groupBy(*keys).agg(value_at(rank, value).alias("threshold"))


def _against_null(observed: DataFrame, null: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Observed and null values of a test side by side; null values that are no numbers are NULL and count nowhere."""
    o = observed.select(*keys, F.col(value).alias("_obs"))
    n = null.select(*keys, only_finite(value).alias("_null"))
    return o.join(n, keys, "left") if keys else o.join(n, F.lit(True), "left")  # without keys: one observed row


def _null_moments() -> list:
    return [F.count("_null").alias("n_perm"), F.avg("_null").alias("null_mean"), F.stddev_samp("_null").alias("null_sd")]


def _tail(reached) -> Column:
    """Share of the null that reaches the observed value, which is counted in itself."""
    return (F.count_if(reached) + 1) / (F.count("_null") + 1)


def p_upper(observed: DataFrame, null: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n_perm, null_mean, null_sd, p): one-sided with the observed value counted in.

    p is missing where the observed value is no finite number; null values that are none are not counted.
    """
    p = F.when(F.first(only_finite("_obs")).isNotNull(), _tail(F.col("_null") >= F.col("_obs")))
    joined = _against_null(observed, null, keys, value)
    return joined.groupBy(*keys, "_obs").agg(*_null_moments(), p.alias("p")).withColumnRenamed("_obs", value)


def p_two_sided(observed: DataFrame, null: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Twice the smaller tail, each with the observed value counted in, at most one; missing as in ``p_upper``."""
    tails = F.least(_tail(F.col("_null") >= F.col("_obs")), _tail(F.col("_null") <= F.col("_obs")))
    p = F.when(F.first(only_finite("_obs")).isNotNull(), F.least(F.lit(1.0), tails * 2))
    joined = _against_null(observed, null, keys, value)
    return joined.groupBy(*keys, "_obs").agg(*_null_moments(), p.alias("p")).withColumnRenamed("_obs", value)


def count_at_least(observed: DataFrame, pool: DataFrame, keys: list[str], value: str, pool_value: str) -> DataFrame:
    """(keys, value, _ge, _n): how many pool values of the key reach each observed value.

    Both are merged along one order and counted with a running sum; observations are
    never paired with the pool, so neither side is multiplied by the other. Values that
    are no finite numbers take no part on either side.
    """
    observed, pool = observed.where(finite(value)), pool.where(finite(pool_value))
    seen = observed.select(*keys, F.col(value).alias("_v")).distinct().withColumn("_w", F.lit(0).cast("bigint"))
    held = pool.groupBy(*keys, F.col(pool_value).alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
    merged = durable(seen.unionByName(held).groupBy(*keys, "_v").agg(F.sum("_w").alias("_w")))
    place = distribution(merged, keys, "_v").select(*keys, "_v", F.floor(F.col("_cum") / CHUNK_ROWS).alias("_place"))
    through = scan(merged.join(place, [*keys, "_v"]), keys, "_place", ["_v"], _through=running_sum("_w"))
    size = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else pool.agg(F.count(F.lit(1)).alias("_n"))
    out = through.join(size, keys) if keys else through.join(size, F.lit(True))  # without keys: one row
    return out.select(*keys, F.col("_v").alias(value), (F.col("_n") - F.col("_through") + F.col("_w")).alias("_ge"), "_n")


def p_pooled(observed: DataFrame, null: DataFrame, value: str) -> DataFrame:
    """Share of one pooled null at or above each observed value, nothing added; missing for a missing value."""
    observed = durable(observed)
    p = count_at_least(observed, null, [], value, value)
    return observed.join(p.select(value, (F.col("_ge") / F.col("_n")).alias("p")), value, "left")


def max_per_permutation(null: DataFrame, family: list[str], value: str, out: str = "max_value") -> DataFrame:
    """Largest finite value of each permutation."""
    return null.groupBy(*family, "perm").agg(F.max(only_finite(value)).alias(out))


def maxstat_fwe(observed: DataFrame, null: DataFrame, keys: list[str], family: list[str], value: str, add_one: bool = True) -> DataFrame:
    """p of each observed value among the maxima of its family per permutation; a missing value keeps its row, without p."""
    observed = durable(observed)
    maxima = durable(max_per_permutation(null, family, value, "_max"))  # one row per family and permutation
    counts = count_at_least(observed, maxima, family, value, "_max")
    extra = 1 if add_one else 0
    p = counts.select(*family, value, ((F.col("_ge") + extra) / (F.col("_n") + extra)).alias("p_fwe"))
    return observed.join(p, [*family, value], "left").select(*dict.fromkeys([*family, *keys, value]), "p_fwe")


def studentise(observed: DataFrame, null: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Observed and null values standardised by mean and sd of both pooled, per test; finite numbers only."""
    number = only_finite(value).alias(value)
    pool = observed.select(*keys, F.lit(0).alias("perm"), number).unionByName(null.select(*keys, "perm", number))
    stats = pool.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = (only_finite(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    o = observed.join(stats, keys).withColumn("z", z).withColumnsRenamed({"_m": "null_mean", "_s": "null_sd"})
    n = null.join(stats, keys).withColumn("z", z).drop("_m", "_s")
    return o, n


def maxstat_studentised(observed: DataFrame, null: DataFrame, keys: list[str], family: list[str], value: str) -> DataFrame:
    """Adds null mean, sd, z, uncorrected p and family-wise p over all tests of the family."""
    o, n = studentise(observed, null, keys, value)
    o = durable(o)
    plain = p_upper(observed, null, keys, value).select(*keys, F.col("p").alias("p_uncorrected"), "n_perm")
    fwe = maxstat_fwe(o.select(*dict.fromkeys([*family, *keys]), "z"), n, keys, family, "z").select(*keys, "p_fwe")
    return o.select(*dict.fromkeys([*family, *keys]), value, "null_mean", "null_sd", "z").join(plain, keys).join(fwe, keys)


def sign_flip_exact(effects: DataFrame, family: list[str], test: list[str], subject: str, value: str) -> DataFrame:
    """Exact one-sided p over all sign patterns of the subjects, maximum-statistic p, and q.

    A subject's bit is its place among the subjects, whatever its id; there are a few tens at most, since 2^n
    patterns are a plain row generator that meets the effects inside an explode. Each subject gives one value to a
    test, else the query fails; a value that is no finite number counts as missing.
    """
    subjects = effects.where(F.col(subject).isNotNull()).agg(F.array_sort(F.collect_set(subject)).alias("_subjects"))
    cells = effects.groupBy(*family, *test, subject).agg(F.count(F.lit(1)).alias("_rows"), F.first(only_finite(value)).alias(value))
    once = F.when(F.col("_rows") > 1, F.raise_error(F.lit("a subject has several values in one test"))).otherwise(F.col(value))
    effects = durable(cells.join(subjects, F.lit(True)).select(*family, *test, once.alias(value), F.expr(f"int(array_position(_subjects, {subject})) - 1").alias("_bit"), F.size("_subjects").alias("_n")))
    wide = effects.withColumn("pattern", F.explode(F.expr("sequence(0L, shiftleft(1L, _n) - 1)")))
    bit = F.expr("shiftright(pattern, _bit) & 1")
    signed = F.when(bit == 1, F.col(value)).otherwise(-F.col(value))
    null = durable(wide.groupBy(*family, *test, "pattern").agg(F.round(F.avg(signed), 12).alias("_null")))
    obs = durable(effects.groupBy(*family, *test).agg(F.round(F.avg(value), 12).alias("observed")))
    joined = null.join(obs, [*family, *test])
    plain = joined.groupBy(*family, *test, "observed").agg(
        (F.count_if(F.col("_null") >= F.col("observed")) / F.count(F.lit(1))).alias("p")
    )
    by_pattern = null.select(*family, F.col("pattern").alias("perm"), F.col("_null").alias("observed"))
    fwe = maxstat_fwe(obs, by_pattern, test, family, "observed", add_one=False).select(*family, *test, "p_fwe")
    return bh_fdr(plain.join(fwe, [*family, *test]), family, "p")


def null_centre(observed: DataFrame, null: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Observed value minus the mean of its own permutations, finite numbers only; missing where it is none."""
    m = null.groupBy(*keys).agg(F.avg(only_finite(value)).alias("null_mean"))
    return observed.join(m, keys).withColumn("centred", only_finite(value) - F.col("null_mean"))


def stouffer(df: DataFrame, keys: list[str], p: str, n: int, floor: float = 1e-15) -> DataFrame:
    """Combined one-sided p over tests present in all ``n`` subjects, with q over them."""
    z = df.where(F.col(p).isNotNull()).withColumn("_z", -normal_quantile(F.least(F.greatest(F.col(p), F.lit(floor)), F.lit(1 - floor))))
    out = z.groupBy(*keys).agg((F.sum("_z") / F.sqrt(F.count("_z"))).alias("z"), F.count("_z").alias("_n")).where(F.col("_n") == n).drop("_n")
    return bh_fdr(out.withColumn("p", normal_cdf(-F.col("z"))), [], "p")


def group_null_mean(null: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Permutation k of every subject averaged with equal weights."""
    return null.groupBy(*keys, "perm").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n_subjects"))
