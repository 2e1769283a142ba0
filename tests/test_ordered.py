"""Chunked scans equal plain windows, whatever the chunk width, the skew and the partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialweave.operators import inference, ordered


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(600) < 0.6, 1, rng.integers(2, 9, 600))  # key 1 holds most rows
    v = rng.integers(0, 40, 600).astype(float)
    pdf = pd.DataFrame({"key": key, "t": rng.permutation(600), "v": np.where(rng.random(600) < 0.2, np.nan, v)})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df.cache()


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_scan_equals_window(series, width):
    w = Window.partitionBy("key").orderBy("t")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = series.withColumns({
        "rn": F.row_number().over(w), "run": F.coalesce(F.sum("v").over(up), F.lit(0.0)), "prev": F.lag("v").over(w), "next": F.lead("v").over(w),
        "last": F.last("v", True).over(up), "first": F.first("v", True).over(down), "low": F.min("v").over(down),
    })
    got = ordered.scan(
        series, ["key"], F.expr(f"t div {width}"), ["t"], rn=ordered.row_number(), run=ordered.running_sum("v"), prev=ordered.previous("v"),
        next=ordered.following("v"), last=ordered.last_known("v"), first=ordered.next_known("v"), low=ordered.min_from_here("v"),
    )
    a, b = (d.toPandas().sort_values("t").reset_index(drop=True)[list(want.columns)] for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@pytest.fixture(params=[1, 5, 100_000])
def chunk_rows(request, monkeypatch):
    """Distinct values per chunk: many chunks, some, one."""
    monkeypatch.setattr(ordered, "CHUNK_ROWS", request.param)


def test_percentiles_match_numpy(series, chunk_rows):
    got = ordered.percentiles(series, ["key"], "v", {"a": 0.1, "b": 0.5, "c": 0.95}).toPandas().set_index("key")
    raw = series.toPandas().dropna()
    for key, part in raw.groupby("key"):
        np.testing.assert_allclose(got.loc[key, ["a", "b", "c"]].to_numpy(dtype=float), np.quantile(part["v"], [0.1, 0.5, 0.95]))


def test_tied_ranks_match_pandas(series, chunk_rows):
    got = ordered.tied_ranks(series, ["key"], "v", "r").toPandas().dropna().sort_values("t")
    want = got.groupby("key")["v"].rank()
    np.testing.assert_allclose(got["r"], want)


def test_many_chunks_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 3)
    v = np.random.default_rng(1).exponential(size=3000) ** 3
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    got = ordered.tied_ranks(df, [], "v", "r").toPandas()
    np.testing.assert_allclose(got["r"], got["v"].rank())
    assert ordered.chunk_edges(df.groupBy("v").count().withColumnRenamed("count", "_n"), [], "v").select(F.size("_edges").alias("k")).first()["k"] > 200


def test_result_does_not_depend_on_partitions(spark, series):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return ordered.percentiles(series.repartition(n), [], "v", {"a": 0.3}).first()["a"]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert run(1) == run(50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("p,q", [
    ([0.01, 0.04, 0.03, 0.2], [0.04, 0.16 / 3, 0.16 / 3, 0.2]), ([0.0, 1.0], [0.0, 1.0]), ([0.01, 0.04, 0.03], [0.03, 0.04, 0.04]),
])
def test_bh_closed_form(spark, p, q):
    df = spark.createDataFrame(list(enumerate(p)), "id int, p double")
    got = [r["q"] for r in inference.bh_fdr(df, [], "p").orderBy("id").collect()]
    np.testing.assert_allclose(got, q, atol=1e-12)


def test_bh_missing_stays_missing(spark):
    df = spark.createDataFrame([(0, 0.01), (1, None), (2, 0.04)], "id int, p double")
    got = {r["id"]: r["q"] for r in inference.bh_fdr(df, [], "p").collect()}
    assert got[1] is None and got[0] == pytest.approx(0.02) and got[2] == pytest.approx(0.04)
