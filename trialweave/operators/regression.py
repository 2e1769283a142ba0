"""Small regressions for many groups: Spark aggregates sums of products, tasks solve k x k systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.stats import finite
from .ordered import tied_ranks
from .quality import gram, unpack_symmetric
from .summaries import zscore_within


def ranked(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns replaced by their tied ranks inside each key."""
    for c in columns:
        df = tied_ranks(df, keys, c, "_rank").drop(c).withColumnRenamed("_rank", c)
    return df


def ols(df: DataFrame, keys: list[str], y: str, xs: list[str], factors: list[str] | None = None, standardise: bool = True, parts: bool = True) -> DataFrame:
    """One row per key: beta (array), intercept, r2, adjusted_r2, delta_r2, partial_r2, n_valid, n_dropped, status.

    ``xs`` and ``y`` are standardised (sample sd), ``factors`` are 0/1 columns used as they
    are. Rows with a missing value are dropped and counted.
    """
    import pandas as pd

    factors = factors or []
    columns = ["_one", *xs, *factors, y]
    ok = finite(y)
    for c in [*xs, *factors]:
        ok = ok & finite(c)
    marked = df.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_one", F.lit(1.0))
    inside = lambda c: F.when(F.col("_ok"), F.col(c))
    stats = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("_ok").alias("n_valid"), *[F.avg(inside(c)).alias(f"_m_{c}") for c in [*xs, *factors, y]]
    )
    # Sums are taken around the key's means: no cancellation in the small system.
    moved = marked.join(stats, keys).select(
        *keys, "n_total", "n_valid", F.when(F.col("_ok"), F.lit(1.0)).alias("_one"),
        *[(inside(c) - F.col(f"_m_{c}")).alias(c) for c in [*xs, *factors, y]],
    )
    sums = gram(moved, [*keys, "n_total", "n_valid"], columns).drop("n")
    k = len(xs) + len(factors)
    nx = len(xs)

    def solve(batches):
        import numpy as np

        blank = (None, None, None, None, None)
        for batch in batches:
            rows = []
            for values, n in zip(batch["gram"], batch["n_valid"]):
                if n <= k + 1:
                    rows.append((*blank, "too_few_valid_rows"))
                    continue
                g = unpack_symmetric(np.asarray(values, dtype=float), k + 2)[1:, 1:]
                sd = np.sqrt(np.maximum(np.diag(g), 0) / (n - 1))
                if sd[-1] <= 1e-12:
                    rows.append((*blank, "constant_outcome"))
                    continue
                flat = [x for x, s in zip(xs, sd) if s <= 1e-12]
                if flat:
                    rows.append((*blank, "constant_predictor:" + "|".join(flat)))
                    continue
                scale = np.ones(k + 1)
                if standardise:
                    scale[:nx], scale[-1] = sd[:nx], sd[-1]
                g = g / np.outer(scale, scale)
                xx, xy, yy = g[:k, :k], g[:k, -1], g[-1, -1]
                d = np.sqrt(np.maximum(np.diag(xx), 1e-300))
                if np.linalg.matrix_rank(xx / np.outer(d, d), tol=1e-9) < k:
                    rows.append((*blank, "rank_deficient_design"))
                    continue
                b = np.linalg.solve(xx, xy)
                sse = max(yy - b @ xy, 0.0)
                r2 = 1 - sse / yy
                delta, partial = [], []
                for p in range(nx if parts else 0):
                    keep = [q for q in range(k) if q != p]
                    less = yy - (np.linalg.solve(xx[np.ix_(keep, keep)], xy[keep]) @ xy[keep] if keep else 0.0)
                    delta.append(max(0.0, r2 - (1 - less / yy)))
                    partial.append(max(0.0, (less - sse) / less) if less > 0 else None)
                rows.append((b.tolist(), r2, 1 - (1 - r2) * (n - 1) / (n - k - 1), delta, partial, "ok"))
            out = pd.DataFrame(rows, columns=["beta", "r2", "adjusted_r2", "delta_r2", "partial_r2", "status"])
            head = batch[[*keys, "n_valid"]].reset_index(drop=True)
            head["n_dropped"] = (batch["n_total"] - batch["n_valid"]).to_numpy()
            yield pd.concat([head, out], axis=1)

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in keys)
    return sums.mapInPandas(
        solve,
        f"{head}, n_valid bigint, n_dropped bigint, beta array<double>, r2 double, adjusted_r2 double, delta_r2 array<double>, partial_r2 array<double>, status string",
    )


def treatment_columns(df: DataFrame, column: str, levels: list, prefix: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns of all levels but the first."""
    names = [f"{prefix}_{level}" for level in levels[1:]]
    return df.withColumns({n: (F.col(column) == F.lit(level)).cast("double") for n, level in zip(names, levels[1:])}), names


def fit_weights(design: DataFrame, keys: list[str], pair: list[str], columns: list[str]) -> DataFrame:
    """(keys, pair, a): the row of (X'X)^-1 X' of every pair, intercept first.

    A coefficient of any outcome on this design is then sum(a * y): the design is
    factored once and serves every region and permutation.
    """
    import pandas as pd

    names = ["_one", *columns]
    k = len(names)
    d = design.withColumn("_one", F.lit(1.0))
    sums = gram(d, keys, names)

    def solve(batches):
        import numpy as np

        for batch in batches:
            inverse = [np.linalg.inv(unpack_symmetric(np.asarray(v, dtype=float), k)).tolist() for v in batch["gram"]]
            out = batch[keys].reset_index(drop=True)
            out["_inverse"] = inverse
            yield out

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in keys)
    inverse = sums.mapInPandas(solve, f"{head}, _inverse array<array<double>>")
    x = d.select(*keys, *pair, F.array(*[F.col(n) for n in names]).alias("_x"))
    return x.join(inverse, keys).select(*keys, *pair, F.transform("_inverse", lambda row: vectors.dot(row, F.col("_x"))).alias("a"))


def coefficients(outcomes: DataFrame, weights: DataFrame, on: list[str], group: list[str], y: str, predictors: list[str]) -> DataFrame:
    """(group, predictor, beta) of the standardised outcome, for every group at once."""
    joined = outcomes.join(weights, on)
    betas = [F.sum(F.get(F.col("a"), F.lit(n + 1)) * F.col(y)) for n in range(len(predictors))]
    wide = joined.groupBy(*group).agg(F.stddev_samp(y).alias("_sd"), *[b.alias(p) for b, p in zip(betas, predictors)])
    cells = F.array(*[F.struct(F.lit(p).alias("predictor"), (F.col(p) / F.col("_sd")).alias("beta")) for p in predictors])
    return wide.select(*group, F.explode(cells).alias("_c")).select(*group, "_c.predictor", "_c.beta")


def rsa(
    neural: DataFrame, design: DataFrame, mapping: DataFrame, subject: list[str], region: list[str], predictors: list[str], nuisance: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Observed and permuted coefficients of neural distances on the design.

    ``neural`` (subject, region, i, j, d) holds every pair; ``design`` (subject, i, j, columns)
    may hold a subset, to which the fit is restricted. Permutations move the index of
    the conditions, never the data.
    """
    z = design
    for p in predictors:
        z = zscore_within(z, subject, p, p)
    w = fit_weights(z, subject, ["i", "j"], [*predictors, *nuisance])
    observed = coefficients(neural, w, [*subject, "i", "j"], [*subject, *region], "d", predictors)
    wanted = design.select(*subject, "i", "j")
    m1 = mapping.select(*subject, "perm", F.col("index").alias("i"), F.col("mapped").alias("_mi"))
    m2 = mapping.select(*subject, "perm", F.col("index").alias("j"), F.col("mapped").alias("_mj"))
    moved = wanted.join(m1, [*subject, "i"]).join(m2, [*subject, "perm", "j"])
    moved = moved.withColumns({"_lo": F.least("_mi", "_mj"), "_hi": F.greatest("_mi", "_mj")})
    source = neural.select(*subject, *region, F.col("i").alias("_lo"), F.col("j").alias("_hi"), "d")
    permuted = moved.join(source, [*subject, "_lo", "_hi"])
    null = coefficients(permuted, w, [*subject, "i", "j"], [*subject, *region, "perm"], "d", predictors)
    return observed, null
