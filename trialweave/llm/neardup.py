"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges.

* Words are runs of bytes other than white space after folding A-Z; a document's set holds its distinct
  five-word shingles (shorter texts: the whole sequence), as 64-bit hashes. No word: empty set, no link.
* Equal sets are one *node* (128-bit digest of the set), so exact copies never meet pairwise.
* One permutation: a shingle's leading bits name its bin and the smallest shingle of each bin is kept. An empty
  bin copies the first filled bin of its own fixed random order (optimal densification), so short sets work too.
* BANDS x ROWS bins form bucket keys. A bucket is never expanded into pairs: its most central member (the one
  whose buckets hold most members) is the hub of a star. Confirmed links join components; members of a bucket
  that are still in different components get further stars around other hubs, four times as many each round,
  until the bucket lies in one component or each of its members was a hub. After the first round two upper
  bounds on an overlap rule out nearly all pairs inside a large group of loose copies: the number of shingles that
  any other open set holds too, and the summed minima of shingle counts by classes of low bits. No cap: two sets that share a
  bucket are compared, unless a bound or their sizes rule a link out or they are already connected.
* A link is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hasher, bounded, byte_set, mix, packed, per_text, slices, small, spans, trim, written
from .components import merged

SHINGLE = 5
PERCENT = 75
BINS, BANDS, ROWS = 128, 32, 4
CELLS, LEVELS = 256, 3  # classes of shingles by their low bits; class sizes told apart
WIDE_ROWS = 50_000  # the same bound for members with their class maps (some 200 bytes each)

NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def shingle_sets(column: pa.Array, hasher: Hasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, first = packed(column)
    start, end = spans(data, NOT_SPACE)
    bound, h = per_text(start, first), hasher.load(data)(start, end)
    step = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(SHINGLE)]
    whole = np.zeros(0, np.uint64)
    if len(h) >= SHINGLE:
        whole = h[: len(h) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            whole += h[k : len(h) - SHINGLE + 1 + k] * step[k]
        whole = mix(whole)
    out = []
    for low, high in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if high - low >= SHINGLE:
            out.append(np.unique(whole[low : high - SHINGLE + 1]))
        elif high > low:
            short = sum((h[low + k : low + k + 1] * step[k] for k in range(high - low)), np.full(1, 0x5851F42D4C957F2D * (high - low) % (1 << 64), np.uint64))
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(one: np.ndarray) -> bytes | None:
    """128 bits that name a set whatever its order."""
    if not len(one):
        return None
    again = mix(one ^ np.uint64(0xA24BAED4963EE407))
    return np.array([again.sum(), np.bitwise_xor.reduce(mix(again))], np.uint64).tobytes()


class Sketch:
    """Bucket keys of a set by one-permutation hashing with optimal densification."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.order = np.array([rng.permutation(BINS) for _ in range(BINS)])
        self.weight = rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)

    def keys(self, one: np.ndarray) -> np.ndarray:
        bins = (one >> np.uint64(64 - 7)).astype(np.int64)
        lead = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        least, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
        least[bins[lead]], filled[bins[lead]] = one[lead], True
        if len(lead) < BINS:
            empty = np.flatnonzero(~filled)
            donor = self.order[empty, filled[self.order[empty]].argmax(axis=1)]
            least[empty] = least[donor]
        return mix((least.reshape(BANDS, ROWS) * self.weight).sum(axis=1) + self.band).view(np.int64)


def named_texts(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc_id, at, text): ``at``, a hash of the text, tells rows of one id, or without an id, apart."""
    whole = F.col(text).cast("string")
    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("at"), whole.alias("text"))


def sketches(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc_id, at, n_shingles, node, keys) per row; a text without words has no node and no keys."""
    bounded(docs.sparkSession)
    rows = named_texts(docs, ident, text)

    def run(batches):
        hasher, sketch = Hasher(), Sketch()
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), hasher)
            yield pa.record_batch({
                "doc_id": part.column("doc_id"),
                "at": part.column("at"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([set_digest(s) for s in sets], pa.binary()),
                "keys": pa.array([sketch.keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            })
        hasher = sketch = None
        trim()

    return rows.mapInArrow(run, "doc_id bigint, at bigint, n_shingles bigint, node binary, keys array<bigint>")


def levels(one: np.ndarray) -> np.ndarray:
    """Bit maps of the classes that hold at least 1, 2, ... LEVELS shingles, and how many shingles are beyond."""
    count = np.bincount((one & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    maps = [np.packbits(count >= k).view(np.int64) for k in range(1, LEVELS + 1)]
    return np.append(np.concatenate(maps), np.maximum(count - LEVELS, 0).sum())


def overlap_bound(x: str, y: str) -> Column:
    """No two sets share more than the summed minima of their class sizes (beyond LEVELS: of the totals)."""
    words = LEVELS * CELLS // 64
    bits = [F.bit_count(F.col(x)[i].bitwiseAND(F.col(y)[i])) for i in range(words)]
    return sum(bits[1:], bits[0]) + F.least(F.col(x)[words], F.col(y)[words])


def full_sets(docs: DataFrame, ident: str, text: str, wanted: DataFrame) -> DataFrame:
    """(node, items, cells) of the wanted nodes, read again from the texts of their first rows.

    ``items`` are the shingle hashes; ``cells`` says how they spread over their low bits, see ``levels``.

    ``wanted`` (node, row: the id and the text's hash) names a row that has the set; other rows of that id, or rows
    without an id, are not met. Should two texts share both, only the one whose set is the wanted one counts.
    """
    named = wanted.select(F.col("row.doc_id").alias("_id"), F.col("row.at").alias("_at"), "node")
    same = (F.col("at") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    rows = named_texts(docs, ident, text).join(small(named, wanted.count()), same).select("node", "text")

    def run(batches):
        hasher = Hasher()
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), hasher)
            node = part.column("node").to_pylist()
            keep = [i for i, s in enumerate(sets) if set_digest(s) == node[i]]
            yield pa.record_batch({
                "node": pa.array([node[i] for i in keep], pa.binary()),
                "items": pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64())),
                "cells": pa.array([levels(sets[i]) for i in keep], pa.list_(pa.int64())),
            })
        hasher = None
        trim()

    sets = rows.mapInArrow(run, "node binary, items array<bigint>, cells array<bigint>")
    return sets.groupBy("node").agg(F.first("items").alias("items"), F.first("cells").alias("cells"))


def confirm(edges: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``edges`` whose full sets, of a and b, overlap in at least ``percent`` of their union."""
    both = small(edges, edges.count()).join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("bigint")
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select(*edges.columns)


def shareable(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, m, cells): m shingles of a node occur in another of these nodes too, which bounds any overlap."""
    items = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("items").alias("item"))
    own = items.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    own = own.groupBy("node").agg(F.count(F.lit(1)).alias("e"))
    nodes = nodes.join(sets.select("node", "cells"), "node").join(own, "node", "left")
    return nodes.select("node", (F.col("n") - F.coalesce("e", F.lit(0))).alias("m"), "cells")


def enough(most: Column, percent: int) -> Column:
    """Whether sets of n and an shingles could be linked if they shared ``most`` of them."""
    return 100 * most >= percent * (F.col("n") + F.col("an") - most)


def grouped(docs: DataFrame, ident: str, text: str, percent: int) -> DataFrame:
    """(doc_id, at, n_shingles, label, component_id) for every row: ``label`` names its component, null without words."""
    rows = written(sketches(docs, ident, text), "sketches")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "at")).alias("row"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    nodes = written(nodes, "nodes")
    exploded = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(exploded.join(shared, "key"), "members")
    central = members.groupBy("node").agg(F.sum("size").alias("rank"))
    left = written(members.join(central, "node").select("key", "node", "n", "rank", F.col("n").alias("m"), F.lit(None).cast("array<bigint>").alias("cells")), "central")
    n_left = left.count()
    wanted = written(nodes.select("node", "row").join(left.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = written(full_sets(docs, ident, text, wanted), "sets")
    labels = tested = None
    hubs = 1
    while True:
        # stars for the buckets that still span components; later rounds take about four times as many hubs each
        left = left.withColumn("label", F.col("node")) if labels is None else (
            left.join(small(labels, labels.count()), "node", "left").withColumn("label", F.coalesce("label", "node")))
        open_ = left.groupBy("key").agg(F.max(F.struct("rank", "node")).alias("top"), F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
        stars = written(open_.where("low <> high").select("key", "top", "size"), "stars", n_left)
        buckets = stars.count()
        if not buckets:
            break
        drawn = F.pmod(F.xxhash64("node", F.lit(hubs)), F.col("size")) < (hubs if hubs > 1 else 0)
        pending = left.join(small(stars, buckets), "key").withColumn("hub", (F.col("node") == F.col("top.node")) | drawn)
        pending = written(pending.select("key", "node", "n", "rank", "m", "cells", "label", "hub"), "pending", n_left)
        n_left = pending.count()
        if hubs == 4:
            pending = written(pending.drop("m", "cells").join(shareable(pending.select("node", "n").distinct(), sets), "node"), "pending", n_left)
        centre = pending.where("hub").select("key", F.col("node").alias("a"), F.col("n").alias("an"), F.col("m").alias("am"), F.col("cells").alias("ac"), F.col("label").alias("al"))
        centre = F.broadcast(centre) if centre.count() <= WIDE_ROWS else centre
        once = ~F.col("hub") | (F.col("a") < F.col("node"))
        fits = (F.col("label") != F.col("al")) & enough(F.least("m", "am"), percent)
        if hubs > 1:
            fits = fits & enough(overlap_bound("cells", "ac"), percent)
        edges = pending.join(centre, "key").where(once & fits)
        edges = edges.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), F.least("al", "label").alias("la"), F.greatest("al", "label").alias("lb")).distinct()
        if tested is not None:
            edges = edges.join(tested, ["a", "b"], "left_anti")
        edges = written(edges, "edges")
        fresh = written(confirm(edges, sets, percent), "links")
        edges = edges.select("a", "b")
        tested = edges if tested is None else tested.unionByName(edges)
        if not fresh.isEmpty():
            labels = merged(labels, fresh.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        left = pending.where("NOT hub").select("key", "node", "n", "rank", "m", "cells")
        hubs *= 4
    named = nodes.select("node", "doc_id")
    if labels is not None:
        named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        ids = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = named.join(ids, "label").select("node", "label", "component_id")
    else:
        named = named.select("node", F.col("node").alias("label"), F.col("doc_id").alias("component_id"))
    return rows.select("doc_id", "at", "n_shingles", "node").join(named, "node", "left").drop("node")


def near_components(docs: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    ``component_id`` is the smallest id that links reach. Ties cannot arise; repeated rows share a set and so a
    component. Rows without an id take part under their text; a component that has no id at all is named null and
    its rows are kept. Null and blank texts have an empty set and stand alone. Other columns are not read.
    """
    reached = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = grouped(docs, ident, text, percent).select("doc_id", "n_shingles", reached.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, rows without an id last, then the text's hash.

    Rows that share id and text, or have no id, are copies like any others: one of them stays. Texts without words
    belong to no component and stay.
    """
    rows = written(grouped(docs, ident, text, percent).where("label IS NOT NULL").select("label", "doc_id", "at"), "grouped")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    member = rows.join(first.where("n > 1").select("label", "first"), "label")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))
    fate = written(member.groupBy(F.col("doc_id").alias("_id"), F.col("at").alias("_at")).agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n")), "fate")
    name, whole = F.col(ident).cast("bigint"), F.xxhash64(F.col(text).cast("string"))
    same = whole.eqNullSafe(F.col("_at")) & name.eqNullSafe(F.col("_id"))
    lost = written(fate.where("NOT stays").select("_id", "_at"), "lost")
    left = docs.join(small(lost, lost.count()), same, "left_anti")
    again = written(fate.where("stays AND n > 1").select("_id", "_at"), "again")
    repeated = again.count()
    if not repeated:
        return left
    again = small(again, repeated)
    return left.join(again, same, "left_anti").unionByName(left.join(again, same).dropDuplicates(["_id", "_at"]).select(*docs.columns))
