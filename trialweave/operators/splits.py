"""Search for balanced halves of runs, each partition a bit mask.

A candidate is one row: the mask of its half A over the sorted runs, in 64-bit words. Tasks draw candidates from their
numbers and get the cell counts of half A for a batch of them as one product of masks and counts; nothing of the size
candidates x runs is a table. Equal masks are one partition. Only the table of units per (run, cell) is known to every
task; it has a line for each run and a column for each cell, and more than MOST numbers are an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

MOST = 1 << 22  # numbers of the table (run, cell)
CANDIDATES, KEPT = 100_000, 200  # of the original work
BATCH = 2_000  # candidates of a task


def seeded(seed: int, *parts) -> str:
    """The text that ``functions.stats.seeded_key`` gives."""
    return hashlib.md5("|".join(map(str, (seed, *parts))).encode(), usedforsecurity=False).hexdigest()


def plan(units: DataFrame, run: str, stratum: str, cell: list[str]) -> tuple[list, list, object]:
    """(runs, the stratum of each, units of each run and cell)."""
    import numpy as np

    counts = durable(units.groupBy(run, stratum, *cell).agg(F.count(F.lit(1)).alias("_c")))
    size = counts.agg(F.count_distinct(run).alias("r"), F.count_distinct(F.struct(*cell)).alias("c")).first()
    if size["r"] * size["c"] > MOST:
        raise ValueError(f"{size['r']} runs x {size['c']} cells are more than {MOST}")
    rows = counts.select(run, stratum, F.struct(*cell).alias("_cell"), "_c").collect()
    where: dict = {}
    for r in rows:
        if where.setdefault(r[run], r[stratum]) != r[stratum]:
            raise ValueError(f"run {r[run]} lies in several strata")
    runs = sorted(where)
    place = {r: k for k, r in enumerate(runs)}
    cells = {c: k for k, c in enumerate(sorted({tuple(r["_cell"]) for r in rows}, key=str))}
    table = np.zeros((len(runs), len(cells)), np.int64)
    for r in rows:
        table[place[r[run]], cells[tuple(r["_cell"])]] += r["_c"]
    return runs, [where[r] for r in runs], table


def drawn(attempt: int, runs: list, strata: list, seed: int):
    """Half A of one candidate: half of the runs of each stratum, odd strata sharing the extras; A holds the first run."""
    import numpy as np

    groups: dict = {}
    for k, s in enumerate(strata):
        groups.setdefault(s, []).append(k)
    extra = len(runs) // 2 - sum(len(g) // 2 for g in groups.values())
    odd = sorted((s for s in groups if len(groups[s]) % 2), key=lambda s: (seeded(seed, attempt, s), s))
    mask = np.zeros(len(runs), bool)
    for s, g in groups.items():
        take = len(g) // 2 + (s in odd[:extra])
        mask[sorted(g, key=lambda k: (seeded(seed, attempt, s, runs[k]), runs[k]))[:take]] = True
    return mask if not len(mask) or mask[0] else ~mask


def candidates(units: DataFrame, run: str, stratum: str, cell: list[str], attempts: int = CANDIDATES, seed: int = 1) -> tuple[DataFrame, list]:
    """((attempt, mask, max_deviation, sum_squared), runs): distinct partitions with every cell in both halves.

    Deviations are those of half A from half of all units of a cell. Of equal partitions the first attempt counts.
    """
    import numpy as np
    import pandas as pd

    runs, strata, table = plan(units, run, stratum, cell)
    total = table.sum(0)

    def search(batches):
        for batch in batches:
            masks = np.array([drawn(a, runs, strata, seed) for a in batch["attempt"]], bool).reshape(len(batch), len(runs))
            a = masks.astype(np.int64) @ table
            covered = ((a > 0) & (a < total)).all(1) & (len(total) > 0)
            off = np.abs(a - total / 2.0)
            words = np.zeros((len(masks), -(-max(1, len(runs)) // 64) * 64), bool)
            words[:, : len(runs)] = masks
            packed = np.packbits(words.reshape(len(masks), -1, 64), axis=2, bitorder="little").view(np.int64)[:, :, 0]
            out = pd.DataFrame({"attempt": batch["attempt"], "mask": list(packed), "max_deviation": off.max(1, initial=0), "sum_squared": (off**2).sum(1)})
            yield out[covered]

    numbers = units.sparkSession.range(1, attempts + 1, 1, max(1, -(-attempts // BATCH))).withColumnRenamed("id", "attempt")
    found = numbers.mapInPandas(search, "attempt bigint, mask array<bigint>, max_deviation double, sum_squared double")
    return found.groupBy("mask").agg(F.min("attempt").alias("attempt"), F.first("max_deviation").alias("max_deviation"), F.first("sum_squared").alias("sum_squared")), runs


def best(found: DataFrame, keep: int = KEPT) -> DataFrame:
    """The ``keep`` partitions of least largest, then summed squared, deviation; a bounded top-k."""
    return found.orderBy("max_deviation", "sum_squared", "attempt").limit(keep)


def members(chosen: DataFrame, runs: list, run: str) -> DataFrame:
    """(split, run, in_a, deviations): the runs of each chosen partition; splits count from the most balanced."""
    order = Window.orderBy("max_deviation", "sum_squared", "attempt")  # as long as the number kept
    numbered = chosen.withColumn("split", F.row_number().over(order))
    named = numbered.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(len(runs) - 1))))
    word = F.get(F.col("mask"), F.floor(F.col("_r") / 64).cast("int"))
    bit = F.expr("shiftright(_w, _r % 64) & 1") == 1
    return named.withColumn("_w", word).select("split", F.get(F.lit(runs), F.col("_r")).alias(run), bit.alias("in_a"), "max_deviation", "sum_squared")
