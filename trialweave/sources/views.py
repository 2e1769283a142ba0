"""Analysis views over the warehouse tables, with the same views as SQL text.

Names: *unit* (one trial), *item*, *context* (3 = control), *run* (recording block),
*session*, *dim* (feature), *region* (set of features), *subject*.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import to_long
from ..operators.ordered import number_rows, previous, row_number, scan
from ..session import compiled, durable

WIDTH = 64          # embedding width
REGION_WIDTH = 16   # features per region
CONTROL = 3         # context code of the control class
CONTROL_TEXT = "AO"  # control context among the ratings
ORDER_CHUNK = 1 << 18  # order keys per chunk of an ordered scan; about a million lines at most
CHUNK_US = 60_000_000  # one minute of event time per chunk

FRAME_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return compiled(spark).read.parquet(f"{sf}/{name}.parquet")


def micros(c: str) -> Column:
    """Zone-free timestamp to microseconds since 1970, whatever the session time zone."""
    gap = f"CAST(CAST({c} - TIMESTAMP_NTZ '1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20,6))"
    return F.expr(f"CAST({gap} * 1000000 AS BIGINT)")


def units(spark, sf) -> DataFrame:
    run = (F.col("vec_id") % 10).cast("int")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("unit"),
        F.col("label").alias("item"),
        F.expr("CAST((vec_id div 10) % 4 AS INT)").alias("context"),
        run.alias("run"),
        F.expr("CAST((vec_id % 10) div 5 AS INT)").alias("session"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


UNITS = """units AS (SELECT vec_id AS unit, label AS item, CAST((vec_id // 10) % 4 AS INT) AS context,
  CAST(vec_id % 10 AS INT) AS run, CAST((vec_id % 10) // 5 AS INT) AS session, embedding AS x FROM embeddings)"""


def features(spark, sf) -> DataFrame:
    """Units in long form."""
    long = to_long(units(spark, sf), "x", "dim", "v")
    return long.withColumn("region", F.expr(f"CAST(dim div {REGION_WIDTH} AS INT)"))


FEATURES = UNITS + """,
feats AS (SELECT unit, item, context, run, session, CAST(d AS INT) AS dim, CAST(d // 16 AS INT) AS region,
  CAST(x[d + 1] AS DOUBLE) AS v FROM units, range(64) t(d))"""


def region_units(spark, sf) -> DataFrame:
    """One vector per unit and region."""
    u = units(spark, sf)
    regions = F.explode(F.sequence(F.lit(0), F.lit(WIDTH // REGION_WIDTH - 1)))
    return (
        u.select("*", regions.alias("region"))
        .withColumn("x", F.slice("x", F.col("region") * REGION_WIDTH + 1, REGION_WIDTH))
    )


def ratings(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.expr("CAST(l_suppkey % 5 AS INT)").alias("subject"),
        F.expr("CAST(l_partkey % 5 AS INT)").alias("item"),
        F.concat("l_returnflag", "l_linestatus").alias("context"),
        F.expr("nullif(l_quantity, 50.0D)").alias("m1"),
        (F.col("l_discount") * 100).alias("m2"),
        F.col("l_orderkey").alias("trial"),
    )


RATINGS = """ratings AS (SELECT CAST(l_suppkey % 5 AS INT) AS subject, CAST(l_partkey % 5 AS INT) AS item,
  l_returnflag || l_linestatus AS context, nullif(l_quantity, 50.0) AS m1, l_discount * 100 AS m2,
  l_orderkey AS trial FROM lineitem)"""

MOTION = ["p1", "p2", "p3", "p4", "p5", "p6"]


def frames(spark, sf, stored: bool = False, changes: bool = False) -> DataFrame:
    """Six motion parameters per run and frame; frames are numbered along the order keys.

    ``stored`` writes the numbered table once for pipelines that read it many times. ``changes`` adds the differences
    from the frame before (zero in the first), found in the pass that numbers the frames.
    """
    li = table(spark, sf, "lineitem").drop("l_shipdate", "l_returnflag", "l_linestatus")
    chunk = F.expr(f"l_orderkey div {ORDER_CHUNK}")
    measured = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    if changes:  # rows that tie in the order keys must lie alike in a chunk and in its summary
        before = {f"_before_{c}": previous(c) for c in measured}
        numbered = scan(li, ["l_suppkey"], chunk, [*FRAME_ORDER, *measured[2:]], frame=row_number(), **before)
    else:
        numbered = number_rows(li, ["l_suppkey"], chunk, FRAME_ORDER, "frame")
    now = _motion(*(F.col(c) for c in measured))
    delta = [F.coalesce(p - was, F.lit(0.0)) for p, was in zip(now, _motion(*(F.col(f"_before_{c}") for c in measured)))] if changes else []
    table_ = numbered.select(
        F.col("l_suppkey").alias("run"), "frame", *[p.alias(c) for c, p in zip(MOTION, now)], F.col("l_quantity").alias("signal"),
        *[d.alias(f"d_{c}") for c, d in zip(MOTION, delta)],
    )
    return durable(table_) if stored else table_


def _motion(q: Column, e: Column, d: Column, t: Column) -> list[Column]:
    return [q / 100, e / 100000, d, t / 100, (d + t) / 100, (q / 100 + d) / 100]


FRAMES = """frames AS (SELECT l_suppkey AS run,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice) AS frame,
  l_quantity / 100 AS p1, l_extendedprice / 100000 AS p2, l_discount AS p3, l_tax / 100 AS p4,
  (l_discount + l_tax) / 100 AS p5, (l_quantity / 100 + l_discount) / 100 AS p6, l_quantity AS signal
  FROM lineitem)"""

FRAME_CHUNK = 65536  # frames per chunk of a scan inside a run


def frame_chunk(frame: str = "frame") -> Column:
    return F.expr(f"{frame} div {FRAME_CHUNK}")


def signal(spark, sf) -> DataFrame:
    t = micros("ts")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("key"), t.alias("t"), "event_id", "event_type", "value"
    )


SIGNAL = """signal AS (SELECT user_id AS key, epoch_us(ts) AS t, event_id, event_type, value FROM events)"""


def time_chunk(t: str = "t") -> Column:
    return F.expr(f"{t} div {CHUNK_US}")


def grid(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.expr("CAST(p_partkey % 10 AS INT)").alias("i"),
        F.expr("CAST((p_partkey div 10) % 10 AS INT)").alias("j"),
        F.expr("CAST(p_partkey div 100 AS INT)").alias("k"),
        F.col("p_size").cast("double").alias("value"),
        F.col("p_retailprice").alias("price"),
        F.col("p_brand").alias("label"),
        F.col("p_type").alias("kind"),
    )


GRID = """grid AS (SELECT CAST(p_partkey % 10 AS INT) AS i, CAST((p_partkey // 10) % 10 AS INT) AS j,
  CAST(p_partkey // 100 AS INT) AS k, CAST(p_size AS DOUBLE) AS value, p_retailprice AS price,
  p_brand AS label, p_type AS kind FROM part),
mask AS (SELECT i, j, k, value, price, label, kind FROM grid WHERE value > 25)"""


def mask(spark, sf) -> DataFrame:
    return grid(spark, sf).where(F.col("value") > 25)


def pvalues(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("test"),
        ((F.col("c_custkey") * 7919 % 1009 + 0.5) / 1009).alias("p"),
        F.col("c_mktsegment").alias("family"),
    )


PVALUES = """pv AS (SELECT c_custkey AS test, (c_custkey * 7919 % 1009 + 0.5) / CAST(1009 AS DOUBLE) AS p,
  c_mktsegment AS family FROM customer)"""
