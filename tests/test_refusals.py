"""What would lose data silently is refused."""

import pytest
from pyspark.sql import functions as F

from trialweave.functions import vectors
from trialweave.operators import sampling, summaries
from trialweave.sources import sinks


@pytest.mark.parametrize("width", [3, None])
def test_vector_sums_refuse_missing_elements(spark, width):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, [1.0, None, 3.0])], "k int, x array<double>")
    with pytest.raises(Exception, match="misses an element"):
        vectors.sum_vectors(df, ["k"], "x", width=width).collect()
    assert vectors.sum_vectors(df.limit(1), ["k"], "x", width=width).first()["total"] == [1.0, 2.0, 3.0]


def test_vector_sums_refuse_another_width(spark):
    df = spark.createDataFrame([(1, [1.0] * 100)], "k int, x array<double>")
    for width in (64, 101):
        with pytest.raises(Exception, match="not of width"):
            vectors.sum_vectors(df, ["k"], "x", width=width).collect()


def test_too_few_partitions_are_an_error(spark):
    units = spark.createDataFrame([(r, r % 2, c) for r in range(4) for c in range(2)], "run int, stratum int, cell int")
    with pytest.raises(ValueError, match="of 50 distinct"):
        sampling.split_halves(units, "run", "stratum", ["cell"], 50, 60)
    assert sampling.split_halves(units, "run", "stratum", ["cell"], None, 60).select("split").distinct().count() == 2


def test_draws_without_a_valid_attempt_are_an_error(spark):
    one = spark.createDataFrame([(b, "x" if b else "y") for b in range(4)], "block int, label string")
    with pytest.raises(Exception, match="none of 5 draws"):
        sampling.folds_all_classes(one, "block", "label", 2, 5).collect()
    drawn = spark.createDataFrame([(1, 1), (2, 1)], "draw int, attempt int")
    with pytest.raises(Exception, match="no valid attempt"):
        sampling.first_valid(drawn, drawn.where("draw = 1"), ["draw"]).collect()


def test_runs_without_spread_are_an_error(spark):
    flat = spark.range(10).select(F.lit(1).alias("run"), F.col("id").cast("int").alias("frame"), F.lit(2.0).alias("v"))
    with pytest.raises(Exception, match="no spread"):
        summaries.robust_z(flat, "run", "frame", "v", "z").collect()


def test_digests_tell_repeats_and_separators_apart(spark):
    def digest(rows):
        return sinks.content_digest(spark.createDataFrame(rows, "a string, b string"), "t").first()["digest"]

    x, y, z = ("x", "1"), ("y", "1"), ("z", "1")
    assert digest([x, x, z]) != digest([y, y, z]) and digest([x, y]) == digest([y, x])
    assert digest([("a,1:b", None)]) != digest([("a", "b")]) and digest([(None, "-")]) != digest([("-", None)])
