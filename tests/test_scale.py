"""Plans whose memory, shuffles and time must grow no faster than the rows."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from trialweave.functions import digests, stats
from trialweave.operators import blocked, learners, ordered, quality, sampling, summaries, timeseries
from trialweave.plans import rows as plans_rows
from trialweave.plans import series
from trialweave.plans.registry import SQL
from trialweave.session import compiled
from trialweave.sources import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def frames(spark):
    rows = spark.range(0, 60).select(F.floor(F.col("id") / 20).alias("run"), (F.col("id") % 20 + 1).alias("frame"), (F.col("id") * 7 % 13 / 4.0).alias("v"))
    return rows.withColumn("w", F.col("v") * 2)


def test_a_scan_sorts_its_rows_once_and_never_sends_them_to_the_join(frames):
    text = plan(timeseries.differences(frames, ["run"], "frame", ["v", "w"], F.expr("frame div 6")))
    assert "SortAggregate" not in text and "isnull(" not in text.split("SortMergeJoin")[-1].split("\n")[0]
    got = {(r.run, r.frame): (r.d_v, r.d_w) for r in timeseries.differences(frames, ["run"], "frame", ["v", "w"], F.expr("frame div 6")).collect()}
    v = {(r.run, r.frame): r.v for r in frames.collect()}
    assert got == {(a, b): (x - v.get((a, b - 1), x), 2 * (x - v.get((a, b - 1), x))) for (a, b), x in v.items()}


def test_missing_keys_and_chunks_are_one_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (1, None)], "k int, t int")
    got = ordered.number_rows(df, ["k"], F.expr("t div 2"), ["t"], "n").collect()
    assert {(r.k, r.t): r.n for r in got} == {(None, 1): 1, (None, 2): 2, (1, None): 1, (1, 3): 2}


def test_dvars_cuts_a_run_and_equals_the_plain_difference(spark, monkeypatch, frames):
    monkeypatch.setattr(quality, "DVARS_CHUNK", 4, raising=False)
    cells = frames.select("run", "frame", F.explode(F.array(*[F.struct(F.lit(n).alias("voxel"), F.col(c).alias("val")) for n, c in enumerate("vw")])).alias("c"))
    cells = cells.select("run", "frame", "c.*").where("NOT (run = 1 AND frame = 9)")
    cells = cells.unionByName(frames.select("run", "frame", F.lit(2).alias("voxel"), F.when(F.col("frame") != 5, F.col("v")).alias("val")).where("run = 2"))
    out = quality.dvars(cells, "run", "frame", "voxel", "val")
    assert "_chunk" in plan(out)  # a run longer than a chunk is no single group
    got = {(r.run, r.frame): r.dvars for r in out.collect()}
    v = {(r.run, r.frame): r.v for r in frames.collect() if (r.run, r.frame) != (1, 9)}
    assert set(got) == set(v)
    for (a, b), x in v.items():
        d = x - v.get((a, b - 1), x)
        assert math.isclose(got[a, b], math.sqrt((d * d + 4 * d * d) / 2), abs_tol=1e-12)  # the voxel with a gap counts nowhere


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_percentiles_read_only_the_places_of_their_ranks(spark, monkeypatch, most):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", most)
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in ((1, 200), (2, 2), (3, 57)) for v in rng.integers(0, 40, n)] + [(1, None), (4, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: (r.a, r.b) for r in ordered.percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    for k in (1, 2, 3):
        assert np.allclose(got[k], np.quantile([v for j, v in rows if j == k and v is not None], [0.5, 0.95]))
    assert set(got) == {1, 2, 3}
    assert "Exchange" not in plan(ordered.percentiles(df, ["k"], "v", {"a": 0.5})).split("Window")[0] or most < 1000


def test_statistics_of_few_keys_go_to_the_rows(spark, frames):
    for z in (summaries.zscore_within(frames, ["run"], "v", "z"), summaries.zscore_from_train(frames, ["run"], F.col("frame") > 3, "v", "z")):
        assert "BroadcastHashJoin" in plan(z) and "SortMergeJoin" not in plan(z)
    tests = spark.createDataFrame([(1, 1, 0, [1.0, 2.0])], "region int, unit int, truth int, x array<double>")
    weights = spark.createDataFrame([(1, 0.5, 0, [1.0, 0.0], 0.0), (1, 0.5, 1, [0.0, 1.0], 0.0)], "region int, gamma double, candidate int, w array<double>, b double")
    out = learners.linear_predict(tests, weights, ["region"], ["gamma"], "unit", "truth", "x")
    assert "BroadcastHashJoin" in plan(out) and out.first().predicted == 1


def test_draws_add_up_rows_without_sorting_them(spark):
    df = spark.createDataFrame([(n % 3 or None, n, float(n % 5)) for n in range(60)], "cell int, trial int, v double")
    got = sampling.first_by_key(df, ["cell"], 7, ["trial"], ["trial", "v"], 4)
    want = sampling.per_permutation(df, 4, "draw").withColumn("_key", sampling.seeded_key(7, "draw", "trial"))
    want = want.groupBy("draw", "cell").agg(F.min_by("v", F.struct("_key", "trial", "v")).alias("v"))
    assert sorted(map(str, got.select("draw", "cell", "first.v").collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, sampling.sample_one(df, ["cell"], 7, ["trial"], "v", 4).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("chunk", [7, 1 << 17])
def test_many_draws_read_the_rows_once(spark, monkeypatch, chunk):
    monkeypatch.setattr(sampling, "CHUNK", chunk, raising=False)
    rows = [(n % 3 or None, "ab"[n % 2], n % 50 if n % 9 else None, float(n % 5) if n % 7 else None) for n in range(300)]
    df = spark.createDataFrame(rows, "cell int, side string, trial int, v double").withColumn("text", F.format_string("%.1f", "v"))
    df = df.withColumn("text", F.when(F.col("trial") % 4 > 0, F.concat("text", F.repeat(F.lit("-"), 60))).otherwise(F.col("text")))
    got = sampling.first_by_key(df, ["cell", "side"], 5, ["trial", "text"], ["trial", "v"], 20)
    assert "Generate" not in plan(got) and plan(got).count("Scan") == 1  # no row for each draw
    want = sampling.per_permutation(df, 20, "draw").withColumn("_key", sampling.seeded_key(5, "draw", "trial", "text"))
    want = want.groupBy("draw", "cell", "side").agg(F.min(F.struct("_key", "trial", "v")).alias("first"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 120
    assert sampling.first_by_key(df.limit(0), ["cell"], 5, ["trial"], ["trial"], 20).count() == 0


def test_heads_are_those_of_the_library():
    texts = [bytes((n * k) % 251 for k in range(n)) for n in [*range(140), 3, 3, 900]]
    prefixes = [b"5|1", b"5|10", b"5|100", b"", b"x" * 71]
    sizes = np.array([len(t) for t in texts])
    found = digests.md5_heads(prefixes, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
    got = {(p, int(r)): int(h) for p, rows, heads in found for r, h in zip(rows, heads)}
    assert got == {(p, r): int(hashlib.md5(a + t).hexdigest()[:8], 16) for p, a in enumerate(prefixes) for r, t in enumerate(texts)}


def test_permuted_labels_are_never_broadcast(spark, monkeypatch):
    rows = [(n % 3 or None, n // 2 if n % 5 else None, n * 7 % 11) for n in range(60)] + [(1, 400 + n, n % 4) for n in range(70)]
    df = spark.createDataFrame(rows, "run int, unit long, item int").where("unit IS NULL OR unit % 2 = 1 OR unit > 399").dropDuplicates(["run", "unit"])
    inside = sampling.permute_within(df, ["run"], "unit", "item", 70)
    assert "Join" not in plan(inside)  # the units of a block meet their labels in one task
    monkeypatch.setattr(sampling, "BLOCK", 0)
    merged = sampling.permute_within(df, ["run"], "unit", "item", 70)
    assert plan(merged).split("Join")[0].endswith("SortMerge")
    assert sorted(map(str, inside.collect())) == sorted(map(str, merged.collect())) and inside.columns == merged.columns


def test_labels_travel_as_few_bytes(spark):
    """Labels of any spread come back as they went, in the order of permutation and unit."""
    for spread in (1, 300, 70_000, 1 << 40):
        labels = spark.createDataFrame([(p, u, (u * p % 5 - 2) * spread) for p in range(3) for u in range(7)], "perm int, u long, c long").withColumn("k", F.lit(0))
        row = labels.groupBy("k").applyInArrow(blocked._packed_labels(["k"], "u"), "k int, labels struct<perm: array<int>, times: array<int>, least: bigint, form: string, c: binary>").first()["labels"]
        assert row["perm"] == [0, 1, 2] and row["times"] == [7, 7, 7]
        assert (np.frombuffer(row["c"], row["form"]).astype(np.int64) + row["least"]).tolist() == [(u * p % 5 - 2) * spread for p in range(3) for u in range(7)]


def test_one_value_of_each_cell_in_a_hundred_profiles(spark, tmp_path):
    rows = [(n, n % 40, n % 15, "NA"[n % 2], "F", n % 11 / 100.0, 1.0) for n in range(400)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_discount double, l_quantity double")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = plans_rows.sample_one_per_cell(spark, str(tmp_path))
    per = got.groupBy("subject", "item", "context").agg(F.count("*").alias("n"), F.count_distinct("draw").alias("d")).collect()
    assert len(per) == df.select(F.col("l_suppkey") % 5, F.col("l_partkey") % 5, "l_returnflag").distinct().count()
    assert {(r.n, r.d) for r in per} == {(100, 100)} and "range(1, 101)" in SQL["sample_one_per_cell"]


@pytest.mark.parametrize("few", [0, 400_000])
def test_nuisance_table_numbers_frames_once_and_sends_no_wide_table(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW_ROWS", few)
    rows = [(n * 7 % 400, n % 31, n % 4, n % 7, float(n * n % 50), 5e6 if n % 90 == 7 else float(n * 37 % 9000), n % 11 / 100.0, n % 9 / 100.0) for n in range(400)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    df.withColumns({"l_shipdate": F.lit("x"), "l_returnflag": F.lit("N"), "l_linestatus": F.lit("F")}).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = series.nuisance_table(spark, str(tmp_path))
    text = plan(got)
    assert "lineitem" not in text  # read from the written frames, not numbered a second time
    assert not [line for line in text.split("\n") if "Exchange" in line and "sq_" in line]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = con.execute(SQL["nuisance_table"]).df()
    assert compare(got.toPandas(), want) is None and want.spike.notna().any()


def test_changes_of_the_numbering_pass_equal_differences(spark, tmp_path, monkeypatch):
    """Over chunks of few orders, with missing values, missing runs, and rows that come twice."""
    monkeypatch.setattr(views, "ORDER_CHUNK", 16)
    rows = [(n * 7 % 90 if n % 17 else None, n % 31, n % 4 or None, n % 3, float(n * n % 50) if n % 6 else None, float(n * 37 % 9000), n % 11 / 100.0, n % 9 / 100.0) for n in range(200)]
    df = spark.createDataFrame([*rows, *rows[:40]], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    df.withColumns({"l_shipdate": F.lit("x"), "l_returnflag": F.lit("N"), "l_linestatus": F.lit("F")}).write.parquet(str(tmp_path / "lineitem.parquet"))
    want = timeseries.differences(views.frames(spark, str(tmp_path)), ["run"], "frame", views.MOTION, views.frame_chunk())
    got = views.frames(spark, str(tmp_path), changes=True)
    assert got.columns == want.columns and got.count() == 240
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_changes_that_are_there_are_kept(frames):
    once = timeseries.differences(frames, ["run"], "frame", ["v"], F.expr("frame div 6"))
    again = timeseries.differences(once, ["run"], "frame", ["v"], F.expr("frame div 6"))
    assert again.columns == once.columns == ["run", "frame", "v", "w", "d_v"]
    assert "d_w" in timeseries.differences(once, ["run"], "frame", ["v", "w"], F.expr("frame div 6")).columns


def test_rounding_equals_decimal_rounding(spark):
    rng = np.random.default_rng(2)
    values = [0.0, -0.0, 0.5e-6, -0.5e-6, 1.5e-6, 2.0000005, -2.0000005, 1e11 + 0.3, 3.7e15, 1e300, float("inf"), float("nan"), None, *map(float, rng.normal(0, 100, 500))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    old = F.round(F.col("v") + F.lit(1e-10), 6) + F.lit(0.0)
    assert df.where(~stats.r6("v").eqNullSafe(old)).count() == 0


def test_generated_methods_stay_compilable(spark):
    assert compiled(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_templates_of_permutations_are_never_broadcast(spark):
    units = spark.createDataFrame([(n, n % 3, n % 2, [float(n * k % 7) for k in range(4)]) for n in range(24)], "unit int, run int, item int, x array<double>")
    labels = units.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("perm"), "unit", F.col("item").alias("permuted"))
    out = blocked.permuted_scores(units, "unit", "run", "item", "x", blocked.even_places(2, 2, spark), "region", labels, 4)
    assert "SortMergeJoin" in plan(out) and out.count() == 4
