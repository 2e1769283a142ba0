"""Labels redrawn until valid, and the search for balanced halves."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from trialweave.operators import sampling, splits

RUNS = [(r, r // 9) for r in range(72)]  # sessions of nine runs: all odd, more runs than one word of bits holds


def rare(spark, copies=1):
    """Every context once or twice with every item: a shuffle often leaves a half without some cell."""
    rng = random.Random(1)
    rows = [(i * 4 + c + 100 * k, r, i, c) for k, (r, i) in enumerate(itertools.product(range(4), range(2))) for c in range(2) for _ in range(copies)]
    rng.shuffle(rows)
    return spark.createDataFrame([(u * 1000 + n, r, i, c) for n, (u, r, i, c) in enumerate(rows)], "unit bigint, run int, item int, context int").withColumn("half", F.col("run") % 2)


def test_redraws_until_every_half_holds_every_cell(spark):
    units = rare(spark)
    valid = lambda d: sampling.covering(d, units, "unit", ["half", "item"])
    got = sampling.permute_until_valid(units, ["run"], "unit", "context", 30, valid)
    rows = got.join(units, "unit").toPandas()
    assert sorted(rows.perm.unique()) == list(range(1, 31)) and (rows.groupby("perm").unit.nunique() == units.count()).all()
    assert rows.groupby("perm").attempt.nunique().max() == 1 and rows.attempt.max() > 1
    for _, one in rows.groupby("perm"):
        assert one.groupby(["half", "item", "permuted"]).ngroups == 8
        for _, run in one.groupby("run"):
            assert sorted(run.permuted) == sorted(run.context)
    fewer = sampling.permute_until_valid(units, ["run"], "unit", "context", 7, valid).toPandas()
    same = rows[rows.perm <= 7].set_index(["perm", "unit"]).permuted
    assert (fewer.set_index(["perm", "unit"]).permuted.sort_index() == same.sort_index()).all()


def test_first_attempts_only_where_all_are_valid(spark):
    units = rare(spark)
    got = sampling.permute_until_valid(units, ["run"], "unit", "context", 5, lambda d: d.select("perm"))
    assert {r["attempt"] for r in got.collect()} == {1}


def test_labels_that_can_never_cover_are_an_error(spark):
    units = rare(spark).withColumn("context", F.when((F.col("item") == 0) & (F.col("run") == 0), 9).otherwise(F.col("context")))
    with pytest.raises(ValueError, match="no valid labels in 3 attempts"):
        sampling.permute_until_valid(units, ["run"], "unit", "context", 4, lambda d: sampling.covering(d, units, "unit", ["half", "item"]), most=3)


def trials(spark, runs=RUNS):
    rng = random.Random(5)
    return spark.createDataFrame([(r, s, i, c) for r, s in runs for i in range(3) for c in range(2) for _ in range(rng.randrange(4))], "run int, session int, item int, context int")


def test_masks_equal_the_table_of_attempts(spark):
    """The same draws, canonical halves, coverage and deviations as the plain path over (attempt, run) rows."""
    units = trials(spark)
    found, runs = splits.candidates(units, "run", "session", ["item", "context"], 60)
    best = splits.best(found, 25)
    halves = sampling.propose_halves(units, "run", "session", 60)
    fresh = halves.join(sampling.distinct_halves(halves, "run"), "attempt", "left_semi")
    plain = sampling.rank_splits(sampling.half_counts(units, fresh, "run", ["item", "context"]), 25)
    assert [tuple(r) for r in best.select("attempt", "max_deviation", "sum_squared").collect()] == [tuple(r) for r in plain.select("attempt", "max_deviation", "sum_squared").collect()]
    named = splits.members(best, runs, "run").toPandas()
    want = halves.toPandas().set_index(["attempt", "run"]).in_a
    order = [r["attempt"] for r in plain.collect()]
    assert len(named) == 25 * 72 and all(r.in_a == want[order[r.split - 1], r.run] for r in named.itertuples())


def test_few_runs_have_few_partitions(spark):
    units = trials(spark, [(r, 0) for r in range(4)])
    full = units.select("run", "session").distinct().join(units.select("item", "context").distinct(), F.lit(True))
    found, runs = splits.candidates(full, "run", "session", ["item", "context"], 500)
    assert runs == [0, 1, 2, 3] and sorted(tuple(r["mask"]) for r in found.collect()) == [(3,), (5,), (9,)]
    assert all(r["max_deviation"] == 0 for r in found.collect())
    alone = full.where("run > 0 OR item = 0")
    assert splits.candidates(alone.where("run < 2"), "run", "session", ["item", "context"], 50)[0].count() == 0
    assert splits.candidates(full.limit(0), "run", "session", ["item"], 5)[0].count() == 0
    with pytest.raises(ValueError, match="several strata"):
        splits.candidates(full.withColumn("session", F.col("item")), "run", "session", ["item"], 5)


def test_tables_beyond_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(splits, "MOST", 10)
    with pytest.raises(ValueError, match="are more than 10"):
        splits.candidates(trials(spark), "run", "session", ["item", "context"], 5)
