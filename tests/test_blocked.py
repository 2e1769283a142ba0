"""Blocked permutations against the plain path and against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from trialweave.operators import blocked, patterns, sampling, transfer


def trials(spark, width, units=60, runs=5, signal=1.0):
    rng = np.random.default_rng(width)
    shape = rng.normal(size=(3, width))
    rows = []
    for u in range(units):
        item = int(rng.integers(3))
        rows.append((u * 3, u % runs, item, (signal * shape[item] + rng.normal(size=width)).tolist()))
    return spark.createDataFrame(rows, "unit bigint, run int, item int, x array<double>")


def labelled(units, perms):
    drawn = sampling.permute_within(units, ["run"], "unit", "item", perms).select("perm", "unit", "permuted")
    return drawn.unionByName(units.select(F.lit(0).alias("perm"), "unit", F.col("item").alias("permuted"))).persist()


def plain(units, labels, places, key, width):
    d = patterns.decode(units, "unit", "run", "item", "x", places, width, labels)
    hit = (F.col("predicted") == F.col("item")).cast("double")
    return {(r[key], r["perm"]): (r["a"], r["e"]) for r in d.groupBy("perm", key).agg(F.avg(hit).alias("a"), F.avg("evidence").alias("e")).collect()}


def assert_same(got, want, key):
    have = {(r[key], r["perm"]): (r["accuracy"], r["evidence"]) for r in got.collect()}
    assert set(have) == set(want)
    for k, (a, e) in want.items():
        assert have[k][0] == pytest.approx(a, abs=1e-12) and have[k][1] == pytest.approx(e, abs=1e-9)


@pytest.mark.parametrize("chunk,perms,tile,part", [(1_024, 128, 128, 1 << 20), (4, 3, 5, 6)])
def test_regions_equal_the_plain_path(spark, monkeypatch, chunk, perms, tile, part):
    for name, value in {"UNITS": chunk, "PERMS": perms, "TILE": tile, "PART": part}.items():
        monkeypatch.setattr(blocked, name, value)
    units = trials(spark, 12)
    labels = labelled(units, 7)
    got = blocked.permuted_scores(units, "unit", "run", "item", "x", blocked.even_places(3, 4, spark), "region", labels, 12)
    assert_same(got, plain(units, labels, patterns.slices(3, 4), "region", 12), "region")


def test_neighbourhoods_equal_the_plain_path(spark):
    units = trials(spark, 10)
    labels = labelled(units, 4)
    near = spark.createDataFrame([(c, d) for c in range(10) for d in range(max(0, c - 2), min(10, c + 3))], "centre int, dim int")
    got = blocked.permuted_scores(units, "unit", "run", "item", "x", blocked.near_places(near), "centre", labels, 10)
    assert_same(got, plain(units, labels, patterns.neighbourhoods(near), "centre", 10), "centre")


def test_a_class_may_miss_its_training_rows(spark):
    units = trials(spark, 6, 24, 3).withColumn("item", F.when(F.col("unit") == 9, 7).otherwise(F.col("item")))
    labels = labelled(units, 3)
    got = blocked.permuted_scores(units, "unit", "run", "item", "x", blocked.even_places(1, 6, spark), "region", labels, 6)
    assert_same(got, plain(units, labels, patterns.slices(1, 6), "region", 6), "region")


def test_wide_vectors_recover_a_planted_signal(spark):
    width = 50_277
    units = trials(spark, width, 24, 4, 0.3)
    labels = labelled(units, 9)
    places = spark.createDataFrame([(0, list(range(width))), (1, list(range(0, width, 7))), (2, [5, 9])], "region int, dims array<int>")
    got = blocked.permuted_scores(units, "unit", "run", "item", "x", places, "region", labels, width, min_features=10).collect()
    assert len(got) == 30 and all(r["status"] == "insufficient_features" and r["accuracy"] is None for r in got if r["region"] == 2)
    own = {(r["region"], r["perm"]): r for r in got if r["status"] == "ok"}
    assert own[0, 0]["accuracy"] == 1 and own[1, 0]["accuracy"] == 1 and own[0, 0]["n"] == 24
    assert max(own[0, p]["evidence"] for p in range(1, 10)) < own[0, 0]["evidence"]


def test_bad_vectors_are_refused_and_nothing_gives_nothing(spark):
    units = trials(spark, 6, 24, 3)
    labels, places = labelled(units, 2), blocked.even_places(1, 6, spark)
    with pytest.raises(Exception, match="width 6|misses an element"):
        blocked.permuted_scores(units.withColumn("x", F.slice("x", 1, 5)), "unit", "run", "item", "x", places, "region", labels, 6).count()
    assert blocked.permuted_scores(units.limit(0), "unit", "run", "item", "x", places, "region", labels.limit(0), 6).count() == 0


@pytest.mark.parametrize("chunk,perms,context", [(1_024, 128, "unit div 6 % 4 + 2"), (5, 2, "unit div 3 % 4 + 2")])  # the second: two contexts a subject
def test_sources_and_subjects_equal_the_plain_transfer(spark, monkeypatch, chunk, perms, context):
    monkeypatch.setattr(blocked, "UNITS", chunk)
    monkeypatch.setattr(blocked, "PERMS", perms)
    units = trials(spark, 8, 90, 3).withColumns({"subject": (F.col("unit") % 2).cast("int"), "context": F.expr(f"cast({context} as int)")})
    drawn = sampling.permute_within(units, ["subject", "context", "run"], "unit", "item", 4).select("perm", "unit", "permuted")
    labels = drawn.unionByName(units.select(F.lit(0).alias("perm"), "unit", F.col("item").alias("permuted"))).persist()
    keys = ["perm", "subject", "region"]
    decoded = transfer.context_transfer(units, 5, "x", patterns.slices(2, 4), 8, ["subject"], labels)
    want = {tuple(r[c] for c in (*keys, "source", "target")): r for r in transfer.transfer_cells(decoded, keys).collect()}
    got = transfer.permuted_cells(units, 5, "x", blocked.even_places(2, 4, spark), "region", 8, ["subject"], labels).collect()
    assert {tuple(r[c] for c in (*keys, "source", "target")) for r in got} == set(want) and len(got) == len(want) == 5 * 2 * (2 * 13 if perms > 2 else 4 + 3)
    for r in got:
        other = want[tuple(r[c] for c in (*keys, "source", "target"))]
        assert r["n"] == other["n"] and r["accuracy"] == pytest.approx(other["accuracy"], abs=1e-12) and r["evidence"] == pytest.approx(other["evidence"], abs=1e-9, nan_ok=True)
    empty = transfer.permuted_cells(units, 5, "x", blocked.even_places(2, 4, spark), "region", 8, ["subject"], labels.limit(0))
    assert empty.count() == 0 and empty.columns == [*keys, "source", "target", "n", "accuracy", "evidence"]
