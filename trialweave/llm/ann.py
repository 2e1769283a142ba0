"""Nearest neighbours by largest inner product, with multiprobe p-stable hashing.

* TABLES tables of FUNCTIONS functions floor((a.x + b) / w) with Gaussian a. Vectors get one more coordinate that
  lifts them to the largest norm, and queries are scaled to it, so the largest inner product is the smallest
  Euclidean distance.
* A query visits its own bucket and then perturbed ones in order of estimated success: the sets of moves across
  the nearest boundaries, ordered by the expected squared distances. Bucket keys are linear in the cell numbers,
  so all probes of a batch are one integer product.
* Buckets are dealt into groups; a group is cut into chunks of points and of queries whose sizes are bounded,
  whatever a bucket holds, and each pair of chunks meets in one task. Candidates of all tables are merged and
  ranked by the inner product of the original vectors in double precision.
* The number of probes is fitted: the least that finds AIM of the true neighbours within a sample of at most
  SAMPLE vectors and SAMPLE_QUERIES queries. Neighbours in the whole table are nearer, so its recall is higher.
  Where all MOST_PROBES sets of moves fall short of AIM, every query visits all buckets.
* Queries that found fewer than they should are asked again with all sets of moves, and then in all buckets.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, written

TABLES, FUNCTIONS, WIDTH = 4, 8, 2.0  # WIDTH: of a cell, in largest norms
NEAREST = 20
SAMPLE, SAMPLE_QUERIES, AIM = 8_192, 128, 0.95
MOST_PROBES = 3**FUNCTIONS  # all sets of moves
VISIT_KEYS = 1 << 20  # probe keys made at once
BLOCK = 1 << 20  # products held at once by queries that visit all buckets
POINTS, QUERIES = 10_000, 2_000  # rows of a chunk
SLACK = 1e-9  # rounding of the block products, in squared largest norms
KEEP_PAIRS = 500_000  # pairs held before all but the best are let go
EXACT = 20_000  # pairs whose products are summed at once


def probe_order(functions: int, most: int) -> np.ndarray:
    """Sets of moves, best first, over a query's 2 x functions boundaries sorted by distance; [probe, boundary]."""
    j, k = np.arange(1, 2 * functions + 1), functions
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    back = 2 * k + 1 - j
    far = 1 - back / (k + 1) + back * (back + 1) / (4 * (k + 1) * (k + 2))
    cost = np.where(j <= k, near, far)
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < most:
        value, own = heapq.heappop(heap)
        if len({min(b, 2 * k - 1 - b) for b in own}) == len(own):  # not both sides of one function
            found.append(own)
        last = own[-1] + 1
        if last < 2 * k:
            heapq.heappush(heap, (value + cost[last], (*own, last)))
            heapq.heappush(heap, (value + cost[last] - cost[last - 1], (*own[:-1], last)))
    out = np.zeros((len(found), 2 * k), np.int64)
    for i, own in enumerate(found):
        out[i, list(own)] = 1
    return out


@dataclass
class Tables:
    direction: np.ndarray  # [table, function, dimension + 1]
    offset: np.ndarray  # [table, function]
    factor: np.ndarray  # [table, function], odd 64-bit
    norm: float
    order: np.ndarray

    @staticmethod
    def drawn(dimension: int, norm: float, probes: int, seed: int = 17) -> Tables:
        rng = np.random.default_rng(seed)
        shape = (TABLES, FUNCTIONS)
        factor = rng.integers(0, 1 << 62, shape) * 2 + 1
        return Tables(rng.normal(size=(*shape, dimension + 1)), rng.uniform(0, 1, shape), factor, norm, probe_order(FUNCTIONS, probes))

    def cells(self, x: np.ndarray, table: int, query: bool) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        lifted = np.hstack([x * (self.norm / size), np.zeros_like(size)]) if query else np.hstack([x, np.sqrt(np.maximum(self.norm**2 - size**2, 0))])
        return lifted @ self.direction[table].T / (WIDTH * self.norm) + self.offset[table]

    def keys(self, x: np.ndarray, table: int) -> np.ndarray:
        return (np.floor(self.cells(x, table, False)).astype(np.int64) * self.factor[table]).sum(axis=1)

    def probes(self, x: np.ndarray, table: int) -> np.ndarray:
        """Bucket keys [query, probe], best first."""
        at = self.cells(x, table, True)
        cell = np.floor(at)
        gap = np.hstack([at - cell, 1 - (at - cell)])
        order = np.argsort(gap, axis=1, kind="stable")
        move = np.where(order < FUNCTIONS, -1, 1) * self.factor[table][order % FUNCTIONS]
        return (cell.astype(np.int64) * self.factor[table]).sum(axis=1)[:, None] + move @ self.order.T


def usable(vector: str) -> Column:
    """Neither null nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fitted_probes(sample: np.ndarray, norm: float) -> int | None:
    """The least number of probes, by doubling, that finds AIM of the sample's true neighbours; None if none does."""
    queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    tables = Tables.drawn(sample.shape[1], norm, MOST_PROBES)
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))[: len(queries)]] = -np.inf
    count = min(NEAREST, len(sample) - 1)
    if count < 1:
        return 1
    best = np.argpartition(-scores, count - 1, axis=1)[:, :count]
    first = np.full(best.shape, MOST_PROBES)  # the probe that finds each neighbour
    for table in range(TABLES):
        key, probe = tables.keys(sample, table), tables.probes(queries, table)
        for q in range(len(queries)):
            hit = key[best[q]][:, None] == probe[q][None, :]
            first[q] = np.minimum(first[q], np.where(hit.any(axis=1), hit.argmax(axis=1), MOST_PROBES))
    probes = 1
    while (first < probes).mean() < AIM:
        if probes == MOST_PROBES:
            return None
        probes = min(2 * probes, MOST_PROBES)
    return probes


def best_pairs(query: np.ndarray, place: np.ndarray, score: np.ndarray, ident: np.ndarray, count: int) -> np.ndarray:
    """Positions of each query's ``count`` best pairs, one for an id, ties to the smaller id."""
    order = np.lexsort((-score, ident[place], query))
    own, other = query[order], ident[place[order]]
    order = order[np.concatenate(([True], (own[1:] != own[:-1]) | (other[1:] != other[:-1])))[: len(order)]]  # an id's best row
    order = order[np.lexsort((ident[place[order]], -score[order], query[order]))]
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[rank < count]


def meet(points: pa.Table, queries: pa.Table, count: int, slack: float) -> pa.Table:
    """The best candidates of each query among the points in its probed buckets, or in all where it lists none."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if points.num_rows and queries.num_rows:
        x, ident, key = matrix(points["vector"].combine_chunks()), points["vec_id"].to_numpy(), points["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        x, ident, key = x[order], ident[order], key[order]
        bucket, low = np.unique(key, return_index=True)
        high = np.append(low[1:], len(key))
        y, asker = matrix(queries["vector"].combine_chunks()), queries["query_id"].to_numpy()
        probes = queries["keys"].combine_chunks()
        listed = np.diff(probes.offsets.to_numpy())
        owner, everywhere = np.repeat(np.arange(len(y)), listed), np.flatnonzero(listed == 0)
        wanted = probes.flatten().to_numpy()
        at = np.minimum(np.searchsorted(bucket, wanted), len(bucket) - 1)
        real = bucket[at] == wanted
        at, owner = at[real], owner[real]
        turn = np.argsort(at, kind="stable")
        at, owner = at[turn], owner[turn]
        floor = np.full(len(y), -np.inf)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def settle() -> None:
            nonlocal held, size
            q, p, s = (np.concatenate([h[k] for h in held]) for k in range(3))
            best = best_pairs(q, p, s, ident, count)
            full = np.bincount(q[best], minlength=len(y)) >= count
            least = np.full(len(y), np.inf)
            np.minimum.at(least, q[best], s[best])
            floor[full] = least[full] - slack
            near = s >= floor[q]
            q, p = q[near], p[near]
            exact = np.concatenate([np.zeros(0), *[np.cumsum(y[q[k : k + EXACT]] * x[p[k : k + EXACT]], axis=1)[:, -1] for k in range(0, len(q), EXACT)]])
            best = best_pairs(q, p, exact, ident, count)
            held, size = [(q[best], p[best], exact[best])], len(best)

        edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
        blocks = [(owner[first:last], low[at[first]], high[at[first]]) for first, last in zip(edges.tolist(), [*edges[1:].tolist(), len(at)])]
        step = max(1, BLOCK // max(1, len(everywhere)))
        blocks += [(everywhere, k, min(k + step, len(x))) for k in range(0, len(x) if len(everywhere) else 0, step)]
        for own, begin, end in blocks:
            scores = y[own] @ x[begin:end].T
            i, j = np.nonzero((scores >= floor[own][:, None]) & (asker[own][:, None] != ident[begin:end][None, :]))
            held.append((own[i], begin + j, scores[i, j]))
            size += len(i)
            if size > KEEP_PAIRS + count * len(y):
                settle()
        if held:
            settle()
            q, p, s = held[0]
            out = {"query_id": asker[q], "vec_id": ident[p], "score": s}
    return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})


def nearest(vectors: DataFrame, queries: DataFrame, ident: str = "vec_id", vector: str = "embedding", count: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``count`` best candidates found, ties to the smaller id.

    Null or zero vectors, and those with a null or non-finite component, take no part, nor do rows without id or with
    another number of components than most. Rows that repeat an id are one candidate, by their best score, and no
    candidate of their own query. Fewer candidates than ``count`` give fewer rows; an empty table gives none.
    """
    def ready(df: DataFrame) -> DataFrame:
        return df.where(F.col(ident).isNotNull() & usable(vector)).select(F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    points = ready(vectors)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, v: total + v * v))
    sizes = points.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"))
    main = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if main is None:
        return points.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    dimension, rows, longest = main["d"], main["n"], main["norm"]
    points, asked = (df.where(F.size("vector") == dimension).dropDuplicates(["id", "vector"]) for df in (points, ready(queries)))
    drawn = points.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).toArrow()
    _, once = np.unique(drawn["id"].to_numpy(), return_index=True)  # neighbours are ids, not rows
    probes = fitted_probes(matrix(drawn["vector"].combine_chunks())[np.sort(once)], longest)
    # with one more id than ``count`` every query has enough candidates
    enough = len(once) > count or points.select("id").distinct().limit(count + 1).count() > count
    rounds = ([probes] if probes == MOST_PROBES else [probes, MOST_PROBES]) + [None] if enough and probes else [None]
    tables = Tables.drawn(dimension, longest, 1)
    groups = max(4, -(-rows // POINTS))

    def group_of(key: np.ndarray) -> np.ndarray:
        return (mix(key.view(np.uint64)) % np.uint64(groups)).astype(np.int64)

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                for table in range(TABLES):
                    key = tables.keys(x, table)
                    yield pa.RecordBatch.from_arrays([pa.array(group_of(key) * TABLES + table), pa.array(key), batch.column(0), batch.column(1)], names=["g", "key", "vec_id", "vector"])

    def visits_of(asked: DataFrame, probes: int | None) -> DataFrame:
        """A row for each query and group, with its keys there; without probes, each group of one table and no keys."""
        here = None if probes is None else Tables.drawn(dimension, longest, probes)

        def everywhere(batches):
            for batch in batches:
                for g in range(groups if batch.num_rows else 0):
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(batch.num_rows + 1), pa.int32()), pa.array([], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, g * TABLES)), batch.column(0), none, batch.column(1)], names=["g", "query_id", "keys", "vector"])

        def visit(batches):
            size = max(1, min(512, VISIT_KEYS // probes))
            for whole in batches:
                for low in range(0, whole.num_rows, size):
                    batch = whole.slice(low, size)
                    x = matrix(batch.column(1))
                    for table in range(TABLES):
                        key = here.probes(x, table)
                        group = group_of(key.ravel()).reshape(key.shape)
                        order = np.lexsort((group.ravel(), np.repeat(np.arange(len(x)), key.shape[1])))
                        owner, group, key = order // key.shape[1], group.ravel()[order], key.ravel()[order]
                        opens = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (group[1:] != group[:-1]))))
                        take = pa.array(owner[opens])
                        keys = pa.ListArray.from_arrays(pa.array(np.append(opens, len(key)), pa.int32()), pa.array(key))
                        yield pa.RecordBatch.from_arrays([pa.array(group[opens] * TABLES + table), batch.column(0).take(take), keys, batch.column(1).take(take)], names=["g", "query_id", "keys", "vector"])

        return written(asked.mapInArrow(everywhere if probes is None else visit, "g bigint, query_id bigint, keys array<bigint>, vector array<double>"), "visits")

    indexed = written(points.mapInArrow(index, "g bigint, key bigint, vec_id bigint, vector array<double>"), "index")
    keys = ["g", "pc", "qc"]
    slack = SLACK * longest * longest

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        return meet(p, q, count, slack)

    def ranked(asked: DataFrame, probes: int | None) -> DataFrame:
        visits = visits_of(asked, probes)
        cuts = indexed.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / POINTS).alias("np")).join(visits.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("nq")), "g")
        cuts = written(cuts, "cuts")  # one row for each group of POINTS points
        left = indexed.join(cuts, "g").withColumn("pc", F.pmod(F.xxhash64("vec_id"), "np")).withColumn("qc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nq") - 1)))
        right = visits.join(cuts, "g").withColumn("qc", F.pmod(F.xxhash64("query_id"), "nq")).withColumn("pc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("np") - 1)))
        found = left.select(*keys, "key", "vec_id", "vector").groupBy(*keys).cogroup(right.select(*keys, "keys", "query_id", "vector").groupBy(*keys)).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
        merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return merged.withColumn("rank", rank).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")

    done = []
    for probes in rounds:
        top = ranked(asked, probes)
        if probes is None:
            done.append(top)
            break
        top = written(top, "ranked")
        whole = top.where(F.col("rank") == count).select(F.col("query_id").alias("id"))
        short = written(asked.join(whole, "id", "left_anti"), "short")
        done.append(top.join(whole, F.col("query_id") == F.col("id"), "left_semi"))
        if short.isEmpty():
            break
        asked = short
    return reduce(DataFrame.unionByName, done)
