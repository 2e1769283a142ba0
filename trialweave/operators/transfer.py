"""Templates of one class of units tested on another: across contexts and across items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import blocked, patterns
from .patterns import Places


def context_transfer(
    units: DataFrame, control: int, vec: str, places: Places, width: int | None = None, keys: list[str] | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """(perm, keys, place, source, target, unit, item, predicted, evidence).

    Item templates of each source context, from all runs but the tested one, meet the
    units of each target context. Semantic sources are tested on semantic targets, the
    control source on all. ``labels`` replaces the items once per permutation.
    """
    keys = keys or []
    perm = ["perm"] if labels is not None else []
    named = units
    if labels is not None:
        named = patterns.permuted_units(units, labels, "unit", "item")
    sums, means = patterns.cube(named, [*perm, *keys], "run", ["context", "item"], vec, width)
    t = patterns.leave_out(sums, [*perm, *keys, "context"], "run", "item", width).withColumnRenamed("context", "source")
    tests = units.select(*keys, "run", F.col("context").alias("target"), "unit", *([] if perm else ["item"]), vec)
    means = means.where("perm = 0").drop("perm") if perm else means
    tests = patterns.centre_blocks(tests, means, [*keys, "run"], vec)
    sims = patterns.similarities(places.cut(tests, vec), places.cut(t, "template"), [*keys, places.key, "run"], vec, "item")
    sims = sims.where((F.col("source") == control) | (F.col("target") != control))
    if perm:
        sims = sims.join(labels.select("perm", "unit", F.col("permuted").alias("item")), ["perm", "unit"])
    return patterns.decide(sims, [*perm, *keys, places.key, "source", "target", "unit"], "item")


def permuted_cells(
    units: DataFrame, control: int, vec: str, places: DataFrame, key: str, width: int, keys: list[str], labels: DataFrame
) -> DataFrame:
    """(perm, keys, place, source, target, n, accuracy, evidence) of ``context_transfer`` for all permutations of the items.

    ``places`` are (key, dims) rows; permutations go through the tasks in blocks.
    """
    cells = blocked.permuted_scores(units, "unit", "run", "item", vec, places, key, labels, width, keys=keys, source="context")
    cells = cells.where((F.col("source") == control) | (F.col("target") != control))
    return cells.select("perm", *keys, key, "source", "target", "n", "accuracy", "evidence")


def transfer_cells(decoded: DataFrame, keys: list[str]) -> DataFrame:
    hit = (F.col("predicted") == F.col("item")).cast("double")
    return decoded.groupBy(*keys, "source", "target").agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg("evidence").alias("evidence")
    )


def transfer_summary(cells: DataFrame, keys: list[str], control: int) -> DataFrame:
    """Within, cross and effect over semantic cells with equal weights; control source apart."""
    semantic = (F.col("source") != control) & (F.col("target") != control)
    same = F.col("source") == F.col("target")
    from_control = (F.col("source") == control) & (F.col("target") != control)
    out = []
    for m in ("evidence", "accuracy"):
        within, cross = F.avg(F.when(semantic & same, F.col(m))), F.avg(F.when(semantic & ~same, F.col(m)))
        out += [
            within.alias(f"within_{m}"), cross.alias(f"cross_{m}"), (within - cross).alias(f"{m}_effect"),
            F.avg(F.when(from_control, F.col(m))).alias(f"control_{m}"),
        ]
    return cells.groupBy(*keys).agg(*out)


def leave_two_out(sums: DataFrame, a: str, b: str, label: str, width: int | None = None) -> DataFrame:
    """Class means without one ``a`` and without one ``b``: total - a - b + both, per tested (a, b)."""
    def roll(by):
        return vectors.add_sums(sums, [*by, label], "s", "n", "s", "n", width)

    cells = sums.select(a, b).distinct()
    total = roll([]).withColumnsRenamed({"s": "t_s", "n": "t_n"})
    by_a = roll([a]).withColumnsRenamed({"s": "a_s", "n": "a_n"})
    by_b = roll([b]).withColumnsRenamed({"s": "b_s", "n": "b_n"})
    both = sums.withColumnsRenamed({"s": "o_s", "n": "o_n"})
    g = cells.join(total, F.lit(True))  # tested cells x classes
    g = g.join(by_a, [a, label], "left").join(by_b, [b, label], "left").join(both, [a, b, label], "left")

    def less(x, y):
        return F.when(F.col(y).isNull(), F.col(x)).otherwise(vectors.subtract(x, y))

    g = g.withColumn("_r", less("t_s", "a_s"))
    g = g.withColumn("_r", less("_r", "b_s"))
    g = g.withColumn("_r", F.when(F.col("o_s").isNull(), F.col("_r")).otherwise(F.zip_with("_r", "o_s", lambda p, q: p + q)))
    zero = F.lit(0)
    n = F.col("t_n") - F.coalesce("a_n", zero) - F.coalesce("b_n", zero) + F.coalesce("o_n", zero)
    return g.withColumn("n", n).where("n > 0").select(a, b, label, "n", vectors.divide("_r", "n").alias("template"))


def cross_item_transfer(units: DataFrame, vec: str, places: Places, width: int | None = None) -> DataFrame:
    """(place, item, unit, context, predicted, evidence): context decoded without the tested item and run."""
    sums, means = patterns.cube(units, [], "run", ["item", "context"], vec, width)
    t = leave_two_out(sums, "item", "run", "context", width)
    tests = patterns.centre_blocks(units.select("item", "run", "unit", "context", vec), means, ["run"], vec)
    sims = patterns.similarities(places.cut(tests, vec), places.cut(t, "template"), [places.key, "item", "run"], vec, "context")
    return patterns.decide(sims, [places.key, "item", "unit"], "context")


def cross_item_summary(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Item x context cells, equal means to items, equal mean over items."""
    hit = (F.col("predicted") == F.col("context")).cast("double")
    cells = decoded.groupBy(*keys, "item", "context").agg(F.avg(hit).alias("accuracy"), F.avg("evidence").alias("evidence"))
    items = cells.groupBy(*keys, "item").agg(F.avg("accuracy").alias("accuracy"), F.avg("evidence").alias("evidence"))
    return items.groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"), F.avg("evidence").alias("evidence"), F.count(F.lit(1)).alias("n_items"))
