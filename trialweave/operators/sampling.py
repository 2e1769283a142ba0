"""Seeded draws: permutations, folds, splits and samples that depend on no partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import md5_heads, md5_order
from ..functions.stats import seeded_chunk, seeded_key
from ..session import durable
from .ordered import number_rows


def per_permutation(df: DataFrame, count: int, out: str = "perm", first: int = 1) -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))))


def seeded_rank(df: DataFrame, keys: list[str], seed: int, parts: list[str], ids: list[str], out: str) -> DataFrame:
    """Random rank inside each key; hot keys are split by leading digits of the random key."""
    keyed = df.withColumn("_key", seeded_key(seed, *parts))
    return number_rows(keyed, keys, seeded_chunk("_key"), ["_key", *ids], out).drop("_key")


BLOCK = 1 << 18  # units of a block that one task shuffles, at most
DRAWN = 1 << 21  # labels that a task draws at a time


def permute_within(
    df: DataFrame, blocks: list[str], unit: str, label: str, count: int, seed: int = 1, out: str = "permuted",
    chunk_width: int = 65536,
) -> DataFrame:
    """(perm, blocks, unit, permuted): labels shuffled inside each block, counts kept.

    The unit at place r of its block takes the label of the unit at random place r. Where no block holds more than
    BLOCK units, a task orders the units of one block for some permutations, so that units are sent once for these and
    never once for each permutation. Larger blocks are ranked by chunks; their drawn rows are merged, never broadcast.
    """
    base = df.select(*blocks, unit, label)
    most = base.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most <= BLOCK:
        return _permuted_blocks(base, blocks, unit, label, count, seed, out, max(1, min(64, DRAWN // max(1, most))))
    placed = number_rows(base.select(*blocks, unit), blocks, F.expr(f"{unit} div {chunk_width}"), [unit], "_place")
    drawn = seeded_rank(per_permutation(base, count), [*blocks, "perm"], seed, ["perm", unit], [unit], "_place")
    drawn = drawn.select("perm", *blocks, "_place", F.col(label).alias(out))
    return placed.join(drawn.hint("merge"), [*blocks, "_place"]).select("perm", *blocks, unit, out)


def _permuted_blocks(base: DataFrame, blocks: list[str], unit: str, label: str, count: int, seed: int, out: str, draws: int) -> DataFrame:
    """``permute_within``: ``draws`` permutations of a block in one group of rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in blocks:
        base = base.where(F.col(b).isNotNull())
    schema = base.select(F.lit(1).alias("perm"), *blocks, unit, F.col(label).alias(out)).schema
    sent = base.select(
        *blocks, unit, F.col(label).alias("_label"), F.coalesce(F.concat(F.lit("|"), F.col(unit).cast("string")), F.lit("")).alias("_tail"),
        F.explode(F.sequence(F.lit(1), F.lit(count), F.lit(draws))).alias("_first"))
    sent = sent.repartition(4 * base.sparkSession.sparkContext.defaultParallelism, *blocks, "_first")  # few bytes make many rows

    def shuffle(table: pa.Table) -> pa.Table:
        first = table["_first"][0].as_py()
        table = table.take(pc.sort_indices(table, sort_keys=[(unit, "ascending")], null_placement="at_start"))
        perms = np.arange(first, min(first + draws, count + 1), dtype=np.int32)
        order = md5_order([f"{seed}|{p}".encode() for p in perms], *_bytes_of(table["_tail"]))
        own = table.select([*blocks, unit]).take(pa.array(np.tile(np.arange(table.num_rows), len(perms))))
        own = own.add_column(0, "perm", pa.array(np.repeat(perms, table.num_rows)))
        return own.append_column(out, table["_label"].take(pa.array(order.ravel())))

    return sent.groupBy(*blocks, "_first").applyInArrow(shuffle, schema)


def _bytes_of(texts) -> tuple:
    """(data, starts, sizes) of an Arrow column of texts without missing ones."""
    import numpy as np
    import pyarrow as pa

    whole = pa.concat_arrays([c.cast(pa.large_binary()) for c in texts.chunks])
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends)


def permute_until_valid(
    df: DataFrame, blocks: list[str], unit: str, label: str, count: int, valid: Callable[[DataFrame], DataFrame], seed: int = 1,
    most: int = 200, chunk_width: int = 65536,
) -> DataFrame:
    """(perm, attempt, unit, permuted): labels shuffled inside each block, redrawn until ``valid`` accepts them.

    ``valid`` maps drawn rows (perm, attempt, unit, permuted) to the accepted ``perm`` values. Only permutations that
    still fail are drawn again, with the attempt's number in the seed, so a permutation's labels do not depend on how
    many others there are. Each round is written. A permutation that fails ``most`` times is an error.
    """
    base = df.select(*blocks, unit, label)
    placed = durable(number_rows(base.select(*blocks, unit), blocks, F.expr(f"{unit} div {chunk_width}"), [unit], "_place"))
    pending = df.sparkSession.range(1, count + 1).select(F.col("id").cast("int").alias("perm"))
    kept = None
    for attempt in range(1, most + 1):
        tries = base.join(pending, F.lit(True)).withColumn("attempt", F.lit(attempt))  # labels x open permutations: the rows to draw
        drawn = seeded_rank(tries, [*blocks, "perm"], seed, ["perm", "attempt", unit], [unit], "_place")
        drawn = drawn.select("perm", "attempt", *blocks, "_place", F.col(label).alias("permuted"))
        drawn = durable(placed.join(drawn, [*blocks, "_place"]).select("perm", "attempt", unit, "permuted"))
        good = durable(valid(drawn).select("perm").distinct())
        fine = drawn.join(good, "perm", "left_semi")
        kept = fine if kept is None else kept.unionByName(fine)
        pending = durable(pending.join(good, "perm", "left_anti"))
        if pending.isEmpty():
            return kept
    raise ValueError(f"{pending.count()} of {count} permutations found no valid labels in {most} attempts")


def covering(drawn: DataFrame, units: DataFrame, unit: str, cell: list[str], keys: list[str] | None = None) -> DataFrame:
    """(perm) of the draws in which every combination of ``cell`` values and labels occurs, within each of ``keys``.

    Values and labels are those of the data: the required cells are products of distinct counts, not a number given.
    """
    keys = keys or []
    found = drawn.join(units.select(unit, *keys, *cell), unit).groupBy("perm", *keys, *cell, "permuted").agg(F.count(F.lit(1)).alias("_n"))
    sizes = [units.agg(F.count_distinct(*keys)).first()[0]] if keys else []
    sizes += [units.agg(F.count_distinct(c)).first()[0] for c in cell] + [drawn.agg(F.count_distinct("permuted")).first()[0]]
    return found.groupBy("perm").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == math.prod(sizes)).select("perm")


def permute_conditions(conditions: DataFrame, keys: list[str], index: str, count: int, seed: int = 1) -> DataFrame:
    """(perm, keys, index, mapped): one bijection of the conditions per key and permutation."""
    drawn = per_permutation(conditions.select(*keys, index), count)
    return seeded_rank(drawn, [*keys, "perm"], seed, [*keys, "perm", index], [index], "mapped")


SPREAD = 16  # draws from which on the rows are dealt evenly to all tasks before they are keyed
CHUNK = 1 << 17  # rows whose draws a task decides together, at most
CHUNK_BYTES = 1 << 25
FOUND = 1 << 18  # rows found before they leave the task


def first_by_key(df: DataFrame, cell: list[str], seed: int, parts: list[str], order: list[str], draws: int) -> DataFrame:
    """(draw, cell, first): the least (_key, *order) of each cell and draw, ``_key`` being the seeded key of ``parts``.

    Tasks read the rows once: the leading 32 bits of all their keys are computed in numpy, and of a chunk of rows only
    those that hold the least bits of a cell and draw leave it. Whole keys are computed and compared for these alone.
    """
    slim = df.select(*dict.fromkeys([*cell, *parts, *order]))
    if draws >= SPREAD:  # the keys cost far more than one shuffle of the rows, which may lie in a single file
        slim = slim.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    tail = F.concat(F.lit(""), *[F.coalesce(F.concat(F.lit("|"), F.col(p).cast("string")), F.lit("")) for p in parts])
    slim = slim.select(*dict.fromkeys([*cell, *order]), tail.alias("_tail"))
    prefixes = [f"{seed}|{draw}".encode() for draw in range(1, draws + 1)]

    def least(batches):
        import pyarrow as pa

        held, rows, size = [], 0, 0
        for batch in batches:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
            if rows >= CHUNK or size >= CHUNK_BYTES:
                yield from _least_heads(pa.Table.from_batches(held), cell, prefixes)
                held, rows, size = [], 0, 0
        if rows:
            yield from _least_heads(pa.Table.from_batches(held), cell, prefixes)

    near = slim.mapInArrow(least, slim.select(F.lit(1).alias("draw"), "*").schema)
    near = near.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}|"), F.col("draw").cast("string"), "_tail")))
    return near.groupBy("draw", *cell).agg(F.min(F.struct("_key", *order)).alias("first"))


def _least_heads(table, cell: list[str], prefixes: list[bytes]):
    """Rows of ``table`` with the numbers of the draws in which no row of their cell has a lesser head, and a few more."""
    import numpy as np
    import pyarrow as pa

    table = table.combine_chunks()
    codes = np.zeros(table.num_rows, np.int64)
    for c in cell:
        own = pa.concat_arrays(table[c].chunks).dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        codes = np.unique(codes * (int(own.max()) + 1) + own, return_inverse=True)[1]
    by = np.argsort(codes, kind="stable")
    codes = codes[by]
    data, starts, sizes = _bytes_of(table["_tail"])

    def found(hits):
        draw, cells, heads, rows = (np.concatenate(x) for x in zip(*hits))
        at = draw * (int(codes[-1]) + 1) + cells
        place = np.lexsort((heads, at))
        first = np.flatnonzero(np.r_[True, np.diff(at[place]) > 0])
        best = np.repeat(heads[place][first], np.diff(np.r_[first, len(place)]))
        kept = place[heads[place] == best]
        for part in range(0, len(kept), CHUNK):
            own = kept[part : part + CHUNK]
            out = table.take(pa.array(by[rows[own]]))
            yield from out.add_column(0, "draw", pa.array((draw[own] + 1).astype(np.int32))).combine_chunks().to_batches()

    hits, count = [], 0
    for draw, rows, heads in md5_heads(prefixes, data, starts[by], sizes[by]):
        cells = codes[rows]
        edges = np.flatnonzero(np.r_[True, np.diff(cells) > 0])
        best = np.repeat(np.minimum.reduceat(heads, edges), np.diff(np.r_[edges, len(rows)]))
        hit = np.flatnonzero(heads == best)
        hits.append((np.full(len(hit), draw), cells[hit], heads[hit], rows[hit]))
        count += len(hit)
        if count >= FOUND:
            yield from found(hits)
            hits, count = [], 0
    if hits:
        yield from found(hits)


def sample_one(df: DataFrame, cell: list[str], seed: int, parts: list[str], value: str, draws: int) -> DataFrame:
    """One seeded row per cell and draw; an aggregate, so no cell is ever gathered."""
    first = first_by_key(df, cell, seed, parts, [*dict.fromkeys([*parts, value])], draws)
    return first.select("draw", *cell, F.col(f"first.{value}").alias(value))


def sample_rows(df: DataFrame, keys: list[str], seed: int, parts: list[str], ids: list[str], count: int) -> DataFrame:
    """``count`` seeded rows per key."""
    return seeded_rank(df, keys, seed, parts, ids, "_rank").where(F.col("_rank") <= count).drop("_rank")


def fold_by_block(df: DataFrame, block: str, k: int, seed: int = 1, keys: list[str] | None = None) -> DataFrame:
    """(keys, block, fold): whole blocks dealt into k folds in seeded order."""
    keys = keys or []
    blocks = df.select(*keys, block).distinct()
    ranked = seeded_rank(blocks, keys, seed, [*keys, block], [block], "_rank")
    return ranked.select(*keys, block, ((F.col("_rank") - 1) % k + 1).cast("int").alias("fold"))


def missing_classes(df: DataFrame, fold: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, fold, label, in_test, in_train) for every fold and class of the key."""
    keys = keys or []
    cells = df.groupBy(*keys, fold, label).agg(F.count(F.lit(1)).alias("_n"))
    folds = cells.select(*keys, fold).distinct()
    totals = cells.groupBy(*keys, label).agg(F.sum("_n").alias("_total"))
    # Folds and classes are counted in tens: the grid is as small as the confusion table.
    grid = folds.join(totals, keys) if keys else folds.join(totals, F.lit(True))
    grid = grid.join(cells, [*keys, fold, label], "left")
    in_test = F.coalesce(F.col("_n"), F.lit(0))
    return grid.select(*keys, fold, label, in_test.alias("in_test"), (F.col("_total") - in_test).alias("in_train"))


def folds_all_classes(df: DataFrame, block: str, label: str, k: int, attempts: int, seed: int = 1) -> DataFrame:
    """(attempt, block, fold) of the first draw whose folds have every class on both sides.

    Attempts are drawn as one table; nothing loops on the driver. No valid attempt is an error.
    """
    counts = df.groupBy(block, label).agg(F.count(F.lit(1)).alias("_c"))
    blocks = per_permutation(counts.select(block).distinct(), attempts, "attempt")
    drawn = seeded_rank(blocks, ["attempt"], seed, ["attempt", block], [block], "_rank")
    drawn = drawn.select("attempt", block, ((F.col("_rank") - 1) % k + 1).cast("int").alias("fold"))
    spread = counts.join(drawn, block).groupBy("attempt", "fold", label).agg(F.sum("_c").alias("_test"))
    totals = counts.groupBy(label).agg(F.sum("_c").alias("_total"))
    classes = totals.agg(F.count(F.lit(1)).alias("_k"))
    covered = (
        spread.join(totals, label)
        .where(F.col("_total") > F.col("_test"))
        .groupBy("attempt")
        .agg(F.count(F.lit(1)).alias("_cells"))
        .join(classes, F.col("_cells") == F.col("_k") * k)
    )
    first = covered.agg(F.min("attempt").alias("attempt"))
    none = F.raise_error(F.lit(f"none of {attempts} draws has every class on both sides of each fold")).cast("int")
    first = first.select(F.coalesce("attempt", none).alias("attempt"))
    return drawn.join(first, "attempt")


def first_valid(proposals: DataFrame, valid: DataFrame, keys: list[str], attempt: str = "attempt") -> DataFrame:
    """Proposals of the smallest valid attempt per key; a key none of whose attempts is valid is an error."""
    best = valid.groupBy(*keys).agg(F.min(attempt).alias("_best"))
    none = F.raise_error(F.lit(f"a key of {', '.join(keys)} has no valid attempt")).cast("bigint")
    wanted = proposals.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("_best", none).alias(attempt))
    return proposals.join(wanted, [*keys, attempt], "left_semi")


def propose_halves(runs: DataFrame, run: str, stratum: str, count: int, seed: int = 1) -> DataFrame:
    """(attempt, run, stratum, in_a): half of the runs of each stratum; odd strata share the extras.

    The half holding the smallest run is called A, so swapped halves are one partition.
    """
    runs = runs.select(run, stratum).distinct()
    sizes = runs.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    plan = sizes.agg(
        F.sum("_size").alias("_runs"), F.sum(F.floor(F.col("_size") / 2)).alias("_base"), F.min(stratum).alias("_any")
    ).select((F.floor(F.col("_runs") / 2) - F.col("_base")).alias("_extra"))
    tries = per_permutation(sizes, count, "attempt")
    odd = seeded_rank(
        tries.withColumn("_odd", F.col("_size") % 2 == 1), ["attempt", "_odd"], seed, ["attempt", stratum], [stratum], "_odd_rank"
    )
    take = odd.join(plan, F.lit(True)).select(
        "attempt", stratum,
        (F.floor(F.col("_size") / 2) + F.when(F.col("_odd") & (F.col("_odd_rank") <= F.col("_extra")), 1).otherwise(0)).alias("_take"),
    )
    drawn = seeded_rank(per_permutation(runs, count, "attempt"), ["attempt", stratum], seed, ["attempt", stratum, run], [run], "_rank")
    halves = drawn.join(take, ["attempt", stratum]).withColumn("_a", F.col("_rank") <= F.col("_take"))
    lead = halves.groupBy("attempt").agg(F.min_by("_a", run).alias("_lead"))
    return halves.join(lead, "attempt").select("attempt", run, stratum, (F.col("_a") == F.col("_lead")).alias("in_a"))


def signature(halves: DataFrame, run: str) -> DataFrame:
    """(attempt, members): the runs of half A as one text, the name of the partition."""
    runs = F.sort_array(F.collect_list(F.when(F.col("in_a"), F.col(run))))
    return halves.groupBy("attempt").agg(F.concat_ws(",", F.transform(runs, lambda r: r.cast("string"))).alias("members"))


def distinct_halves(halves: DataFrame, run: str) -> DataFrame:
    """(attempt, members): the first attempt of every distinct partition."""
    return signature(halves, run).groupBy("members").agg(F.min("attempt").alias("attempt")).select("attempt", "members")


def half_counts(units: DataFrame, halves: DataFrame, run: str, cell: list[str]) -> DataFrame:
    """(attempt, cell, n_a, n_b): units of each cell in both halves, from counts per run."""
    per_run = units.groupBy(run, *cell).agg(F.count(F.lit(1)).alias("_c"))
    return per_run.join(halves, run).groupBy("attempt", *cell).agg(
        F.sum(F.when(F.col("in_a"), F.col("_c")).otherwise(0)).alias("n_a"),
        F.sum(F.when(F.col("in_a"), 0).otherwise(F.col("_c"))).alias("n_b"),
    )


def covered_attempts(counts: DataFrame) -> DataFrame:
    """Attempts with every cell in both halves."""
    return counts.groupBy("attempt").agg(F.min(F.least("n_a", "n_b")).alias("_least")).where("_least > 0").select("attempt")


def split_halves(units: DataFrame, run: str, stratum: str, cell: list[str], count: int | None, attempts: int, seed: int = 1) -> DataFrame:
    """(split, run, in_a): the first ``count`` distinct, covered partitions; None: all among the attempts.

    Fewer than ``count`` among the attempts is an error.
    """
    halves = durable(propose_halves(units, run, stratum, attempts, seed))  # attempts x runs rows, read three times
    valid = distinct_halves(halves, run).join(covered_attempts(half_counts(units, halves, run, cell)), "attempt")
    # One row per attempt, whose number the caller bounds: a single small window.
    ranked = valid.withColumn("split", F.row_number().over(Window.orderBy("attempt")))
    if count is not None:
        ranked = durable(ranked.where(F.col("split") <= count))
        if (found := ranked.count()) < count:
            raise ValueError(f"{found} of {count} distinct, covered partitions in {attempts} attempts")
    return halves.join(ranked.select("attempt", "split"), "attempt").select("split", run, "in_a")


def rank_splits(counts: DataFrame, keep: int) -> DataFrame:
    """Covered partitions by largest, then summed squared, deviation of half A from half of all."""
    off = F.abs(F.col("n_a") - (F.col("n_a") + F.col("n_b")) / 2.0)
    return (
        counts.groupBy("attempt")
        .agg(F.max(off).alias("max_deviation"), F.sum(off * off).alias("sum_squared"), F.min(F.least("n_a", "n_b")).alias("_least"))
        .where("_least > 0")
        .drop("_least")
        .orderBy("max_deviation", "sum_squared", "attempt")
        .limit(keep)
    )


def sample_rank(df: DataFrame, keys: list[str], seed: int, parts: list[str], ids: list[str], count: int) -> DataFrame:
    """``count`` seeded rows per key with their place in the draw."""
    return seeded_rank(df, keys, seed, parts, ids, "rank").where(F.col("rank") <= count)
