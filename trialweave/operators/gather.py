"""Fits of pair distances under permuted conditions, by gathering.

A subject's distances are one packed square and its design one packed table of pairs. A permutation moves the index
of the conditions: the outcome of pair (i, j) becomes the distance of (m[i], m[j]). A task holds one (subject, region,
block of permutations): it factors the design once and gathers, for each permutation, one vector of outcomes from the
square. Nothing of the size permutations x pairs is ever a table; what is shuffled is squares x blocks.

The number of conditions bounds a square; more than MOST is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions.stats import seeded_key

MOST = 2_000  # conditions of one subject
BLOCK = 250  # permutations gathered by one task at a time
FIT = "perm int, beta array<double>, r2 double, adjusted_r2 double, n bigint, status string"


def mappings(conditions: DataFrame, keys: list[str], index: str, perms: int, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """(keys, conditions, block, maps): one bijection of places for each permutation; permutation 0 moves nothing.

    Place r of the sorted conditions goes to the rank of its seeded digest. One row holds ``block`` permutations.
    """
    most = F.raise_error(F.lit(f"more than {MOST} conditions")).cast("boolean")
    listed = conditions.groupBy(*keys).agg(F.array_sort(F.collect_set(index)).alias("conditions"))
    listed = listed.where(F.when(F.size("conditions") > MOST, most).otherwise(True))
    blocks = listed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(perms), F.lit(block))))

    def drawn(perm):
        key = F.transform("conditions", lambda c, r: F.struct(seeded_key(seed, *keys, perm, c).alias("k"), r.alias("r")))
        order = F.transform(F.array_sort(key), lambda s: s.r)
        places = F.transform("conditions", lambda c, r: r)
        return F.when(perm == 0, places).otherwise(F.transform(F.array_sort(F.transform(order, lambda o, rank: F.struct(o, rank.alias("rank")))), lambda s: s["rank"]))

    last = F.least(F.col("block") + block - 1, F.lit(perms))
    return blocks.withColumn("maps", F.transform(F.sequence("block", last), drawn))


def fits(neural: DataFrame, design: DataFrame, subject: list[str], region: list[str], predictors: list[str], nuisance: list[str],
         perms: int, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """(subject, region, perm, beta, r2, adjusted_r2, n, status) of every permutation; 0 is the observed order.

    ``neural`` (subject, region, i, j, d) holds each pair of conditions once; ``design`` (subject, i, j, columns) may
    hold some of the pairs, and the fit is restricted to them. Outcome and predictors are standardised, nuisance columns
    are used as they are; ``beta`` is in the order predictors, nuisance. A region with a missing or non-finite distance
    among the pairs that a permutation can reach, a flat outcome, or a design of less than full rank keeps its rows,
    without coefficients, and ``status`` says why. A design pair that no region measured is an error.
    """
    import numpy as np
    import pandas as pd

    columns = [*predictors, *nuisance]
    ends = neural.select(*subject, F.col("i").alias("index")).union(neural.select(*subject, F.col("j").alias("index"))).distinct()
    drawn = mappings(ends, subject, "index", perms, seed, block)
    square = neural.groupBy(*subject, *region).agg(F.collect_list(F.struct("i", "j", F.col("d").cast("double").alias("d"))).alias("pairs"))
    table = design.select(*subject, F.struct("i", "j", F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).alias("row"))
    table = table.groupBy(*subject).agg(F.array_sort(F.collect_list("row")).alias("design"))
    rows = square.join(table, subject).join(drawn, subject)
    keys = [*subject, *region]
    schema = StructType([*[StructField(k, neural.schema[k].dataType) for k in keys], *_parse_datatype_string(FIT).fields])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[0]
        place = {c: k for k, c in enumerate(one["conditions"])}
        d = np.full((len(place), len(place)), np.nan)
        for p in one["pairs"]:
            a, b = place[p["i"]], place[p["j"]]
            d[a, b] = d[b, a] = np.nan if p["d"] is None else p["d"]
        i = np.array([place[p["i"]] for p in one["design"]])
        j = np.array([place[p["j"]] for p in one["design"]])
        x = np.array([p["x"] for p in one["design"]], float)
        maps = np.stack([np.asarray(m) for m in one["maps"]])
        y = d[maps[:, i], maps[:, j]]
        beta, r2, status = solve(x, len(predictors), y)
        n, k = len(i), len(columns)
        out = pd.DataFrame({"perm": np.arange(len(maps), dtype=np.int32) + int(one["block"])})
        for c in reversed(keys):
            out.insert(0, c, [one[c]] * len(out))
        good = status == "ok"
        out["beta"] = [b.tolist() if g else None for b, g in zip(beta, good)]
        out["r2"] = np.where(good, r2, np.nan)
        out["adjusted_r2"] = np.where(good, 1 - (1 - r2) * (n - 1) / max(1, n - k - 1), np.nan)
        out["n"], out["status"] = n, status
        return out

    done = rows.groupBy(*keys, "block").applyInPandas(run, schema)  # a group is one row
    return done.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in ("r2", "adjusted_r2")})


def solve(x, predictors: int, y):
    """(beta, r2, status) of each row of ``y`` on the standardised design, whose factor serves all of them."""
    import numpy as np

    n, k = x.shape
    status = np.full(len(y), "ok", object)
    beta, r2 = np.zeros((len(y), k)), np.zeros(len(y))
    z = x - x.mean(0)
    spread = x.std(0, ddof=1) if n > 1 else np.zeros(k)
    if n <= k + 1 or not np.isfinite(x).all() or (spread <= 1e-12).any() or np.linalg.matrix_rank(z / spread) < k:
        status[:] = "unusable_design"
        return beta, r2, status
    z[:, :predictors] /= spread[:predictors]
    factor = np.linalg.solve(z.T @ z, z.T)  # the intercept goes with the means
    sd = y.std(1, ddof=1)
    status[~(sd > 1e-12)] = "constant_outcome"
    status[~np.isfinite(y).all(1)] = "missing_distance"
    good = status == "ok"
    w = (y[good] - y[good].mean(1, keepdims=True)) / sd[good, None]
    beta[good] = w @ factor.T
    r2[good] = 1 - ((w - beta[good] @ z.T) ** 2).sum(1) / (w**2).sum(1)
    return beta, r2, status


def coefficients(done: DataFrame, keys: list[str], names: list[str], first: int = 0) -> DataFrame:
    """(keys, perm, predictor, beta): the coefficients ``first``, ... of the fits, one row each."""
    cells = F.array(*[F.struct(F.lit(p).alias("predictor"), F.get("beta", F.lit(first + k)).alias("beta")) for k, p in enumerate(names)])
    return done.select(*keys, "perm", F.explode(cells).alias("_c")).select(*keys, "perm", "_c.predictor", "_c.beta")
