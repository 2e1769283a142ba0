"""Row rules, sinks and must-fail cases."""

import pytest
from pyspark.sql import functions as F

from trialweave.functions.stats import pearson
from trialweave.operators import matching, selection, timeseries
from trialweave.session import scratch_path
from trialweave.sources import sinks


def test_unknown_label_is_reported(spark):
    df = spark.createDataFrame([(" person ",), ("FOOD",), ("SEA",)], "c string")
    assert [r.c for r in selection.unknown_labels(df, "c", ["PERSON", "FOOD"]).collect()] == ["SEA"]


def test_invariant_violation_stops(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    with pytest.raises(selection.InvariantError, match="finite: 1 of 2"):
        selection.assert_invariants({"finite": (df, selection.finite("v"))})


def test_no_overwrite_and_no_invalid_write(spark):
    df, path = spark.range(3), scratch_path(spark, "t")
    sinks.write_validated(df, path, {"ok": (df, F.col("id") >= 0)})
    with pytest.raises(sinks.AlreadyWritten):
        sinks.write_table(df, path)
    other = scratch_path(spark, "u")
    with pytest.raises(selection.InvariantError):
        sinks.write_validated(df, other, {"ok": (df, F.col("id") > 0)})
    with pytest.raises(Exception):
        spark.read.parquet(other)


def test_resume_runs_only_missing_and_checks_signature(spark):
    path, asked = scratch_path(spark, "p"), []

    def compute(ids):
        asked.append(list(ids))
        return spark.createDataFrame([(i, float(i)) for i in ids], "perm int, v double")

    sinks.resume_permutations(spark, path, [1, 2], "a", compute)
    out = sinks.resume_permutations(spark, path, [1, 2, 3], "a", compute)
    assert asked == [[1, 2], [3]] and out.count() == 3
    with pytest.raises(ValueError):
        sinks.resume_permutations(spark, path, [1], "b", compute)


def test_nearest_event_tie_takes_the_earlier(spark):
    t = spark.createDataFrame([(1, 10, 100)], "key int, t bigint, id bigint")
    c = spark.createDataFrame([(1, 5, 1), (1, 15, 2), (1, 5, 9)], "key int, t bigint, id bigint")
    r = matching.nearest_event(t, c, "key", "t", "id", F.expr("t div 4")).first()
    assert (r.matched, r.gap) == (1, 5)


def test_frame_edges_rules(spark):
    runs = spark.createDataFrame([(1, 3, 100), (2, 3, 100), (3, 3, 100)], "run int, n_frames int, onset bigint")
    e = [(1, 100 + 760 * i) for i in range(4)] + [(2, 101 + 760 * i) for i in range(3)] + [(3, 100), (3, 2000)]
    out = timeseries.frame_edges(spark.createDataFrame(e, "run int, t bigint"), runs, ["run"], "t", 760, 2, F.expr("t div 1000")).toPandas()
    assert dict(out.groupby("run")["method"].first()) == {1: "all_edges", 2: "last_extrapolated", 3: "nominal"}
    assert out.groupby("run").size().tolist() == [3, 3, 3]
    assert out[out.run == 2].sort_values("frame")["next"].iloc[-1] == 101 + 3 * 760


def test_pearson_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(pearson("a", "b").alias("r")).first().r is None


def test_lowpass_keeps_constants(spark):
    df = spark.createDataFrame([(1, i, 3.0) for i in range(30)], "run int, frame int, v double")
    out = timeseries.lowpass_fir(df, ["run"], "frame", "v", timeseries.fir_weights(11, 0.1, 1.0), "s").toPandas()
    assert ((out.s - 3.0).abs() < 1e-12).all()
