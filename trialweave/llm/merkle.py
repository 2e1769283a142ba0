"""Content-addressed manifest of a dataset, and the proofs that its rows belong to it.

Every row is a leaf digest. The leaves of one group (a tree) stand in order; runs of ARITY consecutive nodes become
the digest of their children until one node remains, the group's subroot; the subroots become the root by the same
rule. The manifest stores records *digest -> children*: one record spans up to SEGMENT_LEVELS levels, so that its
children are at most ARITY ** SEGMENT_LEVELS digests and the levels between are computed from them.

A request for a leaf descends from the root. At each record the next digits of the leaf's rank select a child, the
unselected children of its run are collected as one step of the path, and the reversed path is the proof. Requests
that share the beginning of their ranks share the descent: a record is met once for each place of it that is asked.

Ranks come from one range partitioning (no window over a group), segments are grouped by (tree, block) and hold at
most ARITY ** SEGMENT_LEVELS digests whatever the size of a group, and every layer is written. The driver sees the
size of the largest tree, nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY = 2  # children of a node
SEGMENT_LEVELS = 10  # levels that one stored record spans
DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]  # fields of a leaf, in this order


def encoded(value: Column) -> Column:
    """A field of a leaf: ``-`` where null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def over(value: Column, size: int) -> Column:
    """Integer quotient of a value that is not negative."""
    return ((value - value % size) / size).cast("bigint")


def joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def parents(nodes: Column, arity: int) -> Column:
    """The next level of an array of digests: one digest for each run of ``arity`` of them."""
    runs = F.sequence(F.lit(0), over(F.size(nodes) - 1, arity).cast("int"))
    return F.transform(runs, lambda k: F.sha2(joined(F.slice(nodes, k * arity + 1, F.lit(arity))), 256))


def layers(children: Column, levels: Column, arity: int) -> Column:
    """All levels of a record, its children first and its own digest (an array of one) last."""
    return F.aggregate(F.array_repeat(F.lit(0), levels), F.array(children), lambda rows, _: F.concat(rows, F.array(parents(F.element_at(rows, -1), arity))))


def steps(rows: Column, levels: Column, digit: Column, arity: int, most: int) -> Column:
    """Unselected siblings on the way from a record to its child ``digit``, from the top: (before, after) at each level."""

    def step(level: Column) -> Column:
        own = F.floor(digit / F.element_at(F.array(*[F.lit(arity**k) for k in range(most)]), level + 1)).cast("int")
        nodes = F.element_at(rows, level + 1)
        before = F.slice(nodes, own - own % arity + 1, own % arity)
        after = F.slice(nodes, own + 2, arity - 1 - own % arity)
        return F.struct(joined(before).alias("before"), joined(after).alias("after"))

    down = F.array(*[F.lit(k) for k in reversed(range(most))])
    return F.transform(F.slice(down, F.lit(most + 1) - levels, levels), step)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df``, written, with ``rank`` from 0 along ``order`` inside ``keys`` (nulls first, strings bytewise)."""
    by = [F.asc_nulls_first(c) for c in [*keys, *order]]
    placed = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col("_at"), 33)  # the id counts rows within a partition below bit 33
    sizes = placed.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(k).alias(f"_k{k}") for k in keys], "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    on = part == F.col("_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k{k}"))
    return placed.join(sizes, on).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"))


@dataclass
class Store:
    """Records by layer (``digest, levels, children``) and the top of each tree (``tree, layer, digest``)."""

    layers: list[DataFrame]
    tops: DataFrame


@dataclass
class Manifest:
    """``leaves``: (tree, rank, leaf, further columns); ``trees``: the records of the groups; ``root``: of the subroots."""

    leaves: DataFrame
    trees: Store
    root: Store
    arity: int
    most: int


def build(nodes: DataFrame, arity: int, most: int) -> Store:
    """Records over ``nodes`` (tree, n nodes in the tree, rank, digest), layer by layer up to one node for each tree."""
    size, stored, tops = arity**most, [], None
    largest = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        grouped = nodes.groupBy("tree", "n", over(F.col("rank"), size).alias("rank")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("own"))
        children = F.transform("own", lambda c: c.digest)
        count = F.size("own")
        top = F.size(F.filter(F.array(*[F.lit(arity**k) for k in range(most)]), lambda p: p < count))
        segments = grouped.select("tree", "n", "rank", children.alias("children"), F.when(F.col("n") <= size, top).otherwise(most).alias("levels"))
        digest = F.element_at(F.element_at(layers(F.col("children"), F.col("levels"), arity), -1), 1)
        segments = written(segments.withColumn("digest", digest), "segments")
        stored.append(segments.select("digest", "levels", "children").dropDuplicates(["digest"]))
        done = segments.where(F.col("n") <= size).select("tree", F.lit(len(stored)).alias("layer"), "digest")
        tops = done if tops is None else tops.unionByName(done)
        if largest <= size:
            return Store(stored, tops)
        largest = -(-largest // size)
        nodes = segments.where(F.col("n") > size).select("tree", over(F.col("n") + (size - 1), size).alias("n"), "rank", "digest")


def manifest(docs: DataFrame, leaf: Column, group: str, order: str, carry: dict[str, Column], arity: int = ARITY, most: int = SEGMENT_LEVELS) -> Manifest:
    """The manifest of ``docs``: one tree for each value of ``group``, leaves by ``order``, then by digest.

    Null is a value of ``group`` and of ``order``, and comes first. Repeated rows are leaves of their own, next to
    each other. An empty table has no tree and no root. ``carry`` names what the leaves keep for later use.
    """
    inner = docs.select(F.col(group).alias("_group"), F.col(order).alias("_order"), leaf.alias("leaf"), *[c.alias(n) for n, c in carry.items()])
    rows = written(inner.withColumn("_row", F.monotonically_increasing_id()), "leaves")  # keeps many equal rows apart
    placed = ranked(rows, ["_group"], ["_order", "leaf", "_row"], "ranked")
    groups = ranked(placed.groupBy("_group").agg(F.count(F.lit(1)).alias("n")), [], ["_group"], "groups")
    groups = groups.select(F.col("_group").alias("_named"), "n", F.col("rank").alias("tree"))
    leaves = placed.join(groups, F.col("_group").eqNullSafe(F.col("_named")))
    trees = build(leaves.select("tree", "n", "rank", F.col("leaf").alias("digest")), arity, most)
    count = groups.agg(F.count(F.lit(1)).alias("n"))
    subroots = trees.tops.crossJoin(count)  # one row of one number
    root = build(subroots.select(F.lit(0).cast("bigint").alias("tree"), "n", F.col("tree").alias("rank"), "digest"), arity, most)
    return Manifest(leaves.select("tree", "rank", "leaf", *carry), trees, root, arity, most)


def descend(store: Store, tops: DataFrame, requests: DataFrame, arity: int, most: int) -> DataFrame:
    """``tops`` (tree, layer, digest, path, further columns) followed down to ``requests`` (tree, rank, asked).

    Returns the further columns, the request's ``asked``, the ``digest`` found at its rank, and the ``path`` to it.
    """
    size = arity**most
    further = [c for c in tops.columns if c not in ("tree", "layer", "digest", "path")]
    wanted, keep = [], [F.col("asked")]
    for _ in store.layers:
        digit = (F.col("rank") % size).cast("int").alias("digit")
        requests = requests.groupBy("tree", over(F.col("rank"), size).alias("rank")).agg(F.collect_list(F.struct(digit, *keep)).alias("wanted"))
        wanted.append(requests)
        requests, keep = requests.select("tree", "rank"), []
    frontier = None
    for layer in reversed(range(len(wanted))):
        enter = tops.where(F.col("layer") == layer + 1).drop("layer").withColumn("rank", F.lit(0).cast("bigint"))
        frontier = enter if frontier is None else frontier.unionByName(enter)
        met = frontier.join(wanted[layer], ["tree", "rank"]).join(store.layers[layer], "digest")

        def below(rows: Column, w: Column, last: bool = layer == 0) -> Column:
            found = F.get(F.col("children"), w.digit).alias("digest")
            path = F.concat(F.col("path"), steps(rows, F.col("levels"), w.digit, arity, most)).alias("path")
            place = w.asked.alias("asked") if last else (F.col("rank") * size + w.digit).alias("below")
            return F.struct(place, found, path)

        rows = layers(F.col("children"), F.col("levels"), arity)  # bound once for each record, then read by its requests
        each = F.flatten(F.transform(F.array(rows), lambda r: F.transform("wanted", lambda w: below(r, w))))
        frontier = met.select("tree", *further, F.inline(each))
        frontier = frontier.withColumnRenamed("below", "rank") if layer else frontier.drop("tree")
    return frontier


def proofs(made: Manifest, requests: DataFrame) -> DataFrame:
    """The proof of each of ``requests`` (rows of ``made.leaves``, or some of them; their further columns are kept).

    ``leaf``, ``subroot`` and ``root`` as descended from the root, ``proof`` the siblings from the leaf upwards:
    (before, after) at each level, each the digests left and right of the own node, end to end, or empty.
    """
    carry = [c for c in requests.columns if c not in ("tree", "rank", "leaf")]
    empty = F.array().cast("array<struct<before:string,after:string>>").alias("path")
    top = made.root.tops.select("tree", "layer", "digest", empty, F.col("digest").alias("root"))
    trees = requests.select("tree").distinct()
    asked = trees.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.struct("tree").alias("asked"))
    entered = descend(made.root, top, asked, made.arity, made.most)
    entered = entered.select(F.col("asked.tree").alias("tree"), "root", F.col("digest").alias("subroot"), "path").join(made.trees.tops, "tree")
    own = requests.select("tree", "rank", F.struct(*carry).alias("asked"))
    found = descend(made.trees, entered, own, made.arity, made.most)
    return found.select("asked.*", F.col("digest").alias("leaf"), "subroot", "root", F.reverse("path").alias("proof"))


def proof_text(proof: Column) -> Column:
    """All sibling digests of a proof, from the leaf upwards, left to right."""
    return joined(F.transform(proof, lambda s: F.concat(s.before, s.after)))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and its siblings amount to."""
    return F.aggregate(proof, leaf, lambda own, s: F.sha2(F.concat(s.before, own, s.after), 256))
