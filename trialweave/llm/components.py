"""Connected components of a written edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of the edges (a, b), for every node with an edge.

    Every round takes the smallest label among a node's neighbours, hangs the root of its old label below it and
    then follows labels one step (label of label), so chains halve. Only minima and joins meet a hub; the tables
    are as long as the nodes and edges. Runs until nothing moves; no edge: no row.
    """
    edges = edges.where("a <> b").select("a", "b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = 2 * edges.count()
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels", rows)
    rows = labels.count()  # no later table is longer
    while True:
        known = small(labels, rows)
        heard = both.join(known, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        best = heard.join(known, "node").select("node", "label", F.least("label", "near").alias("best"))
        hooked = small(best.groupBy(F.col("label").alias("root")).agg(F.min("best").alias("lower")), rows)
        step = best.join(hooked, F.col("best") == F.col("root"), "left").select("node", "label", F.least("best", F.coalesce("lower", "best")).alias("next"))
        moved = written(step, "moved", rows)
        if moved.where("next <> label").isEmpty():
            return labels
        labels = moved.select("node", F.col("next").alias("label"))


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after the new ``links`` (a, b) between labels: a node without a row is its own label so far.

    Only the new links are contracted; earlier labels follow by a join.
    """
    fresh = components(links)
    if labels is None:
        return fresh
    moved = fresh.select(F.col("node").alias("label"), F.col("label").alias("lower"))
    old = labels.join(small(moved, moved.count()), "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    rows = labels.count()
    first = fresh.join(small(labels.select("node"), rows), "node", "left_anti")
    return written(old.unionByName(first), "labels", rows + moved.count())
