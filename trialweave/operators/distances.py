"""Representational distances between conditions.

Conditions are the small side of everything here: units are reduced to one vector per
condition (or per run and condition) before any pair is formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import durable
from . import patterns
from .matching import upper_pairs
from .quality import unpack_symmetric


def condition_patterns(units: DataFrame, keys: list[str], block: str, condition: str, vec: str, width: int | None = None) -> DataFrame:
    """(keys, condition, n, pattern): mean of run-centred vectors per condition."""
    sums, _ = patterns.cube(units, keys, block, [condition], vec, width)
    c = vectors.add_sums(sums, [*keys, condition], "s", "n", "s", "n", width)
    return c.select(*keys, condition, "n", vectors.divide("s", "n").alias("pattern"))


def rdm_correlation(means: DataFrame, keys: list[str], condition: str, vec: str = "pattern") -> DataFrame:
    """(keys, i, j, d): one minus the correlation of two condition patterns, kept in 0..2."""
    unit = vectors.unit_length(means, vec, vec)
    pairs = upper_pairs(unit, keys, condition, [vec])
    d = F.least(F.greatest(1 - vectors.dot(f"{vec}_i", f"{vec}_j"), F.lit(0.0)), F.lit(2.0))
    return pairs.select(*keys, "i", "j", d.alias("d"))


def rdm_absolute(values: DataFrame, keys: list[str], condition: str, columns: list[str]) -> DataFrame:
    """(keys, i, j, columns): absolute differences of condition means."""
    pairs = upper_pairs(values, keys, condition, columns)
    return pairs.select(*keys, "i", "j", *[F.abs(F.col(f"{c}_i") - F.col(f"{c}_j")).alias(c) for c in columns])


def same_identity(i: str, j: str, n_items: int):
    """(same item, same context) of two 0-based context-major condition codes, as 0/1."""
    item = (F.col(i) % n_items == F.col(j) % n_items).cast("double")
    context = (F.floor(F.col(i) / n_items) == F.floor(F.col(j) / n_items)).cast("double")
    return item, context


def split_patterns(sums: DataFrame, splits: DataFrame, keys: list[str], condition: str, width: int | None = None) -> DataFrame:
    """(keys, split, condition, a, b): mean patterns of both halves from sums per run and condition."""
    halves = vectors.add_sums(sums.join(splits, "run"), [*keys, "split", "in_a", condition], "s", "n", "s", "n", width)
    p = halves.select(*keys, "split", "in_a", condition, vectors.divide("s", "n").alias("p"))
    a = p.where("in_a").select(*keys, "split", condition, F.col("p").alias("a"))
    b = p.where("NOT in_a").select(*keys, "split", condition, F.col("p").alias("b"))
    return a.join(b, [*keys, "split", condition])


def crossnobis(halves: DataFrame, keys: list[str], condition: str) -> DataFrame:
    """(keys, i, j, d, sd, n_splits): cross-half product of condition differences per feature.

    Negative values are kept: they say that the halves disagree.
    """
    pairs = upper_pairs(halves, [*keys, "split"], condition, ["a", "b"])
    d = vectors.dot(vectors.subtract("a_i", "a_j"), vectors.subtract("b_i", "b_j")) / F.size("a_i")
    per_split = pairs.select(*keys, "split", "i", "j", d.alias("d"))
    return per_split.groupBy(*keys, "i", "j").agg(
        F.avg("d").alias("d"), F.stddev_samp("d").alias("sd"), F.count(F.lit(1)).alias("n_splits")
    )


def run_condition_residuals(units: DataFrame, run: str, condition: str, vec: str, width: int | None = None) -> DataFrame:
    """(unit columns, residual, dof): vectors minus the least-squares run and condition effects.

    The normal equations need only counts and sums per run and condition; one small
    system is solved and its effects are joined back to the units.
    """
    import pandas as pd

    cells = durable(vectors.sum_vectors(units, [run, condition], vec, "s", "n", width))

    def solve(pdf: "pd.DataFrame") -> "pd.DataFrame":
        import numpy as np

        runs, conds = sorted(pdf[run].unique()), sorted(pdf[condition].unique())
        at_r = {v: n for n, v in enumerate(runs)}
        at_c = {v: n + len(runs) for n, v in enumerate(conds)}
        k = len(runs) + len(conds)
        s = np.stack(pdf["s"].to_numpy())
        g, h = np.zeros((k, k)), np.zeros((k, s.shape[1]))
        for r, c, n, row in zip(pdf[run].map(at_r), pdf[condition].map(at_c), pdf["n"], s):
            g[r, r] += n
            g[c, c] += n
            g[r, c] += n
            g[c, r] += n
            h[r] += row
            h[c] += row
        effect = np.linalg.pinv(g) @ h
        rank = int(np.linalg.matrix_rank(g))
        dof = int(pdf["n"].sum()) - rank
        rows = [(int(v), "run", effect[n].tolist(), dof) for v, n in at_r.items()]
        rows += [(int(v), "condition", effect[n].tolist(), dof) for v, n in at_c.items()]
        return pd.DataFrame(rows, columns=["level", "kind", "effect", "dof"])

    # One group of (runs x conditions) sums: a table of design cells, not of units.
    effects = durable(cells.groupBy(F.lit(1).alias("_all")).applyInPandas(solve, "level bigint, kind string, effect array<double>, dof bigint"))
    by_run = effects.where("kind = 'run'").select(F.col("level").alias(run), F.col("effect").alias("_er"), "dof")
    by_cond = effects.where("kind = 'condition'").select(F.col("level").alias(condition), F.col("effect").alias("_ec"))
    out = units.join(by_run, run).join(by_cond, condition)
    fitted = F.zip_with("_er", "_ec", lambda a, b: a + b)
    return out.withColumn("residual", vectors.subtract(vec, fitted)).drop("_er", "_ec")


def product_sums(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, n, xx, xxxx): packed sums of x_i x_j and of their squares.

    Tasks add with numpy and emit one row per key; Spark adds the rows.
    """
    import pandas as pd

    slim = df.select(*keys, vec)

    def partial(batches):
        import numpy as np

        held: dict = {}
        for batch in batches:
            for key, part in batch.groupby(keys, sort=False):
                key = key if isinstance(key, tuple) else (key,)
                x = np.stack(part[vec].to_numpy())
                at = np.triu_indices(x.shape[1])
                new = (len(x), (x.T @ x)[at], ((x * x).T @ (x * x))[at])
                old = held.get(key)
                held[key] = new if old is None else tuple(a + b for a, b in zip(old, new))
        rows = [(*k, n, a.tolist(), b.tolist()) for k, (n, a, b) in held.items()]
        yield pd.DataFrame(rows, columns=[*keys, "n", "xx", "xxxx"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name in keys)
    parts = slim.mapInPandas(partial, f"{head}, n bigint, xx array<double>, xxxx array<double>")
    a = vectors.add_sums(parts, keys, "xx", "n", "xx", "n")
    b = vectors.add_sums(parts, keys, "xxxx", "n", "xxxx", "_n").drop("_n")
    return a.join(b, keys)


def shrink_covariance(sums: DataFrame, keys: list[str], dof: str) -> DataFrame:
    """(keys, shrinkage, covariance, whitener): analytic off-diagonal shrinkage and its inverse square root.

    ``covariance`` is packed (upper triangle), ``whitener`` is an array of rows.
    """
    import pandas as pd

    def solve(batches):
        import numpy as np

        for batch in batches:
            rows = []
            for xx, xxxx, n in zip(batch["xx"], batch["xxxx"], batch[dof]):
                d = int((np.sqrt(8 * len(xx) + 1) - 1) / 2)
                cov = unpack_symmetric(np.asarray(xx, dtype=float), d) / n
                var = np.diag(cov).copy()
                scale = np.sqrt(np.outer(var, var))
                r = cov / scale
                np.fill_diagonal(r, 1.0)
                squares = unpack_symmetric(np.asarray(xxxx, dtype=float), d) / scale**2
                spread = np.maximum(squares - n * r**2, 0) / (n * max(n - 1, 1))
                up = np.triu_indices(d, 1)
                low = float((r[up] ** 2).sum())
                lam = 1.0 if low <= np.finfo(float).eps else min(1.0, max(0.0, float(spread[up].sum()) / low))
                shrunk = (1 - lam) * r
                np.fill_diagonal(shrunk, 1.0)
                shrunk = shrunk * scale
                values, vecs = np.linalg.eigh((shrunk + shrunk.T) / 2)
                white = (vecs / np.sqrt(values)) @ vecs.T
                rows.append((lam, shrunk[np.triu_indices(d)].tolist(), white.tolist()))
            out = pd.DataFrame(rows, columns=["shrinkage", "covariance", "whitener"])
            yield pd.concat([batch[keys].reset_index(drop=True), out], axis=1)

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in keys)
    return sums.mapInPandas(solve, f"{head}, shrinkage double, covariance array<double>, whitener array<array<double>>")


def whiten(df: DataFrame, whiteners: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Vectors times the symmetric whitener of their key."""
    out = df.join(whiteners.select(*keys, "whitener"), keys)
    return out.withColumn(vec, F.transform("whitener", lambda row: vectors.dot(row, F.col(vec)))).drop("whitener")
