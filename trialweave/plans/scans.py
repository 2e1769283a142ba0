"""Source and sink queries. Files are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..functions.vectors import to_long
from ..operators import sampling, spatial
from ..session import scratch_path
from ..sources import readers, sinks
from ..sources import views as V
from . import sqlparts as S
from .registry import query, rnd


@query(
    "scan_run_files",
    """WITH im AS (SELECT s_suppkey // 10 + 1 AS session, s_suppkey % 10 + 1 AS run FROM supplier WHERE s_suppkey % 17 <> 5 UNION ALL SELECT s_suppkey // 10 + 1, s_suppkey % 10 + 1 FROM supplier WHERE s_suppkey % 29 = 3),
mo AS (SELECT DISTINCT l_suppkey // 10 + 1 AS session, l_suppkey % 10 + 1 AS run FROM lineitem WHERE l_suppkey % 17 <> 5 AND l_suppkey % 23 <> 7),
i AS (SELECT session, run, count(*) AS ni FROM im GROUP BY ALL), b AS (SELECT coalesce(i.session, m.session) AS session, coalesce(i.run, m.run) AS run, ni, m.session AS ms FROM i FULL JOIN mo m ON i.session = m.session AND i.run = m.run)
SELECT CAST(session AS INT) AS session, CAST(run AS INT) AS run, CAST(session * 1000 + run AS INT) AS key, row_number() OVER (ORDER BY session, run) AS ordinal,
CASE WHEN ni IS NULL THEN 'missing_image' WHEN ms IS NULL THEN 'missing_motion' WHEN ni > 1 THEN 'duplicate' ELSE 'paired' END AS status, coalesce(run - lag(run) OVER (PARTITION BY session ORDER BY run) > 1, false) AS gap FROM b""",
)
def scan_run_files(spark, sf):
    name = lambda c: F.format_string("session%02d_run%02d", F.expr(f"{c} div 10") + 1, F.col(c) % 10 + 1)
    s = V.table(spark, sf, "supplier")
    images = s.where("s_suppkey % 17 <> 5").union(s.where("s_suppkey % 29 = 3")).select(F.concat(F.lit("func/"), name("s_suppkey"), F.lit(".nii")).alias("path"))
    motions = V.table(spark, sf, "lineitem").select("l_suppkey").distinct().where("l_suppkey % 17 <> 5 AND l_suppkey % 23 <> 7")
    motions = motions.select(F.concat(F.lit("rp_"), name("l_suppkey"), F.lit(".txt")).alias("path"))
    return readers.pair_run_files(images, motions)


@query(
    "scan_trial_metadata",
    """WITH t AS (SELECT o_orderkey, CAST(o_custkey % 5 AS INT) AS subject, CAST(year(o_orderdate) AS INT) AS session, CAST(month(o_orderdate) AS INT) AS run FROM orders)
SELECT o_orderkey, subject, session, run, dense_rank() OVER (PARTITION BY subject ORDER BY session, run) AS run_id, dense_rank() OVER (PARTITION BY subject, session ORDER BY run) AS run_in_session,
row_number() OVER (PARTITION BY subject, session, run ORDER BY o_orderkey) AS trial_in_run, row_number() OVER (PARTITION BY subject ORDER BY session, run, o_orderkey) AS trial_index FROM t""",
)
def scan_trial_metadata(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("int").alias("subject"), F.year("o_orderdate").alias("session"), F.month("o_orderdate").alias("run"))
    return readers.trial_ordinals(o, "subject", "session", "run", "o_orderkey", F.expr(f"o_orderkey div {V.ORDER_CHUNK}"))


@query(
    "scan_two_layout_ratings",
    f"SELECT l_orderkey AS trial, l_suppkey AS run, {rnd('nullif(l_quantity, 50.0)', 'm1')}, {rnd('CASE WHEN l_linenumber % 2 = 1 THEN l_discount * 100 ELSE l_tax * 100 END', 'm2')} FROM lineitem",
)
def scan_two_layout_ratings(spark, sf):
    base = [F.col("l_orderkey").alias("trial"), F.col("l_suppkey").alias("run")]
    rating = F.when(F.col("l_quantity") == 50, F.lit(float("nan"))).otherwise(F.col("l_quantity"))  # files mark missing as NaN
    li = V.table(spark, sf, "lineitem")
    labelled = li.where("l_linenumber % 2 = 1").select(*base, F.col("l_returnflag").alias("label"), rating.alias("f2"), (F.col("l_discount") * 100).alias("f3"))
    plain = li.where("l_linenumber % 2 = 0").select(*base, rating.alias("f4"), (F.col("l_tax") * 100).alias("f5"))
    return readers.two_layout_ratings(labelled, plain).select("trial", "run", r6("m1").alias("m1"), r6("m2").alias("m2"))


@query(
    "scan_response_matrix",
    f"WITH {V.FEATURES} SELECT unit, dim, {rnd('v', 'value')} FROM feats WHERE dim IN (SELECT p_partkey % 64 FROM part WHERE p_size > 3)",
)
def scan_response_matrix(spark, sf):
    mask = V.table(spark, sf, "part").where("p_size > 3").select((F.col("p_partkey") % 64).cast("int").alias("dim")).distinct()
    long = to_long(V.units(spark, sf).select("unit", "x"), "x", "dim", "value")
    return long.join(mask, "dim", "left_semi").select("unit", "dim", r6("value").alias("value"))


@query(
    "scan_mask_as_table",
    f"""WITH {V.GRID}, dims AS (SELECT kind, max(i) + 1 AS ni, max(j) + 1 AS nj, max(k) + 1 AS nk, min(price) / 1e7 AS shift FROM grid GROUP BY kind), r AS (SELECT max(i) + 1 AS ni, max(j) + 1 AS nj, max(k) + 1 AS nk, min(price) / 1e7 AS shift FROM grid)
SELECT m.kind, CAST(m.i + 10 * (m.j + 10 * m.k) + 1 AS BIGINT) AS linear, m.value, d.ni = r.ni AND d.nj = r.nj AND d.nk = r.nk AND abs(d.shift - r.shift) < 1e-4 AS matches FROM mask m JOIN dims d ON d.kind = m.kind, r""",
)
def scan_mask_as_table(spark, sf):
    g = V.grid(spark, sf)
    shape = [(F.max(c) + 1).alias(f"n{c}") for c in "ijk"] + [(F.min("price") / 1e7).alias("shift")]
    ok = readers.same_geometry(g.groupBy("kind").agg(*shape), g.agg(*shape), "kind", ["ni", "nj", "nk"], ["shift"])
    m = V.mask(spark, sf).select("kind", spatial.linear_index("i", "j", "k", 10, 10).alias("linear"), "value")
    return m.join(ok, "kind")


@query(
    "scan_atlas_labels",
    "SELECT n_nationkey AS id, n_name AS name, n_nationkey * 7 % 256 AS r, n_nationkey * 13 % 256 AS g, n_regionkey * 50 AS b, CAST(n_nationkey - 12.5 AS DOUBLE) AS x, CAST(n_regionkey * 2 AS DOUBLE) AS y FROM nation",
)
def scan_atlas_labels(spark, sf):
    n = V.table(spark, sf, "nation")
    lut, xml = scratch_path(spark, "lut"), scratch_path(spark, "xml")
    key = F.col("n_nationkey")
    n.select(key, F.replace("n_name", F.lit(" "), F.lit("_")), key * 7 % 256, key * 13 % 256, F.col("n_regionkey") * 50, F.lit(0)).write.csv(lut, sep=" ")
    labels = n.select(key.alias("index"), F.col("n_name").alias("name"), (key - 12.5).alias("x"), (F.col("n_regionkey") * 2.0).alias("y"), F.lit(0.0).alias("z"))
    labels.write.format("xml").option("rowTag", "label").option("rootTag", "atlas").save(xml)
    both = readers.atlas_lut(spark, lut).join(readers.atlas_xml(spark, xml).select(F.col("index").alias("id"), "x", "y", F.col("name").alias("full")), "id")
    return both.select("id", F.col("full").alias("name"), "r", "g", "b", "x", "y")


@query(
    "scan_text_motion",
    f"WITH {V.FRAMES} SELECT run, count(*) AS n_frames, count(*) = max(frame) AS complete, true AS finite, {rnd('sum(p2)', 'sum_p2')}, {rnd('sum(p5)', 'sum_p5')} FROM frames GROUP BY run",
)
def scan_text_motion(spark, sf):
    path = scratch_path(spark, "motion")
    V.frames(spark, sf).select(F.concat_ws(" ", "run", "frame", *V.MOTION)).write.text(path)
    m = readers.motion_text(spark, path)
    return m.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_frames"), (F.count(F.lit(1)) == F.max("frame")).alias("complete"), F.bool_and("ok").alias("finite"),
        r6(F.sum("p2")).alias("sum_p2"), r6(F.sum("p5")).alias("sum_p5"),
    )


@query(
    "scan_signal_chunks",
    """WITH s AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id), o AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 37 = 0 THEN 'keep' ELSE 'drop' END AS action FROM customer WHERE c_custkey % 37 = 0 OR c_custkey % 41 = 1)
SELECT key, n, CASE WHEN action = 'keep' THEN true WHEN action = 'drop' THEN false ELSE n BETWEEN 60 AND 75 END AS kept, CASE WHEN action IS NOT NULL THEN 'forced_' || action WHEN n BETWEEN 60 AND 75 THEN 'length_ok' ELSE 'length' END AS reason FROM s LEFT JOIN o USING (key)""",
)
def scan_signal_chunks(spark, sf):
    c = V.table(spark, sf, "customer").where("c_custkey % 37 = 0 OR c_custkey % 41 = 1")
    overrides = c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 37 == 0, "keep").otherwise("drop").alias("action"))
    return readers.select_chunks(V.signal(spark, sf), "key", 60, 75, overrides)


@query(
    "scan_roi_manifest",
    "WITH s AS (SELECT lower(replace(p_name, ' ', '_') || '_' || substr(p_brand, 7)) AS stem, count(*) AS n_rows FROM part GROUP BY 1) SELECT row_number() OVER (ORDER BY stem) AS ordinal, stem, n_rows, n_rows > 1 AS duplicate FROM s",
)
def scan_roi_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.substring("p_brand", 7, 9))
    name = F.concat(F.when(F.col("p_size") % 2 == 0, F.upper(stem)).otherwise(stem), F.when(F.col("p_size") % 3 == 0, ".nii.gz").otherwise(".nii"))
    V.table(spark, sf, "part").select(F.col("p_type").alias("source"), name.alias("output_file")).write.csv(path, sep="\t", header=True)
    return readers.region_manifest(spark, path)


@query(
    "sink_tables",
    f"WITH {V.RATINGS} SELECT 'parquet' AS form, subject, context, count(*) AS n, {rnd('avg(m2)', 'mean')} FROM ratings GROUP BY ALL UNION ALL SELECT 'tsv', subject, context, count(*), {rnd('avg(m2)', 'mean')} FROM ratings GROUP BY ALL",
)
def sink_tables(spark, sf):
    t = V.ratings(spark, sf).groupBy("subject", "context").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("m2")).alias("mean"))
    a, b = scratch_path(spark, "table"), scratch_path(spark, "tsv")
    sinks.write_table(t, a)
    sinks.write_table(t, b, "tsv")
    back = spark.read.csv(b, sep="\t", header=True, schema=t.schema)
    return spark.read.parquet(a).withColumn("form", F.lit("parquet")).unionByName(back.withColumn("form", F.lit("tsv")))


@query("sink_sparse_map", f"WITH {V.GRID} SELECT g.i, g.j, g.k, m.value, CASE WHEN m.i IS NULL THEN 0 ELSE 1 END AS inside FROM grid g LEFT JOIN mask m ON g.i = m.i AND g.j = m.j AND g.k = m.k")
def sink_sparse_map(spark, sf):
    m = V.mask(spark, sf).withColumn("inside", F.lit(1))
    at, path = ["i", "j", "k"], scratch_path(spark, "map")
    full = sinks.dense_map(V.grid(spark, sf), m, at, "value", None).join(sinks.dense_map(V.grid(spark, sf), m, at, "inside", 0), at)
    sinks.write_table(full, path)
    return spark.read.parquet(path)


@query(
    "sink_no_overwrite",
    "SELECT 'first' AS attempt, 'written' AS outcome, count(*) AS n_rows FROM orders UNION ALL SELECT 'second', 'refused', count(*) FROM orders UNION ALL SELECT 'invalid', 'rejected', 0",
)
def sink_no_overwrite(spark, sf):
    from ..operators.selection import InvariantError

    o = V.table(spark, sf, "orders")
    path, other = scratch_path(spark, "orders"), scratch_path(spark, "never")
    checks = {"positive": (o, F.col("o_totalprice") > 0)}
    outcomes = {}
    for attempt, target, rules in (("first", path, checks), ("second", path, checks), ("invalid", other, {"negative": (o, F.col("o_totalprice") < 0)})):
        try:
            sinks.write_validated(o, target, rules)
            outcomes[attempt] = "written"
        except sinks.AlreadyWritten:
            outcomes[attempt] = "refused"
        except InvariantError:
            outcomes[attempt] = "rejected"
    rows = F.array(*[F.struct(F.lit(a).alias("attempt"), F.lit(v).alias("outcome")) for a, v in outcomes.items()])
    n = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.explode(rows).alias("_r"), "n")
    return n.select("_r.attempt", "_r.outcome", F.when(F.col("_r.outcome") == "rejected", 0).otherwise(F.col("n")).alias("n_rows"))


def _digest_sql(name: str, columns: list[str]) -> str:
    text = "concat_ws(',', " + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"
    return f"SELECT '{name}' AS source, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(sha256({text}), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM {name}"


@query(
    "sink_provenance",
    "WITH d AS (" + " UNION ALL ".join([
        _digest_sql("nation", ["n_nationkey", "n_name", "n_regionkey"]), _digest_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
        _digest_sql("conversations", ["conv_id", "turn", "role", "text"]),
    ]) + """) SELECT source, n_rows, digest, to_json({'source': source, 'n_rows': n_rows, 'digest': digest, 'parameters': {'seed': 1, 'selection': 'SELKEY'}}) AS manifest FROM d""".replace("SELKEY", sinks.selection_key(["nation", "documents", "conversations"])),
)
def sink_provenance(spark, sf):
    inputs = {n: V.table(spark, sf, n) for n in ("nation", "documents", "conversations")}
    return sinks.provenance(inputs, {"seed": 1, "selection": sinks.selection_key(list(inputs))})


@query(
    "sink_nested_json",
    "SELECT r_name, to_json(list({'index': n_nationkey, 'name': n_name} ORDER BY n_nationkey)) AS doc FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name",
)
def sink_nested_json(spark, sf):
    both = V.table(spark, sf, "nation").join(V.table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return sinks.nested_json(both, "r_name", "n_nationkey", "n_name")


@query(
    "resume_permutations",
    f"WITH {V.UNITS}, {S.permuted('units', ['run'], 'unit', 'item', 6)} SELECT perm, permuted AS item, count(*) AS n, CAST(sum(unit) AS BIGINT) AS sum_unit FROM perms GROUP BY ALL",
)
def resume_permutations(spark, sf):
    u = V.units(spark, sf).drop("x")

    def compute(ids):
        drawn = sampling.permute_within(u, ["run"], "unit", "item", max(ids)).where(F.col("perm").isin(ids))
        return drawn.groupBy("perm", F.col("permuted").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.sum("unit").alias("sum_unit"))

    path = scratch_path(spark, "permutations")
    sinks.resume_permutations(spark, path, [1, 2, 3], "seed=1", compute)  # an earlier, interrupted job
    out = sinks.resume_permutations(spark, path, [1, 2, 3, 4, 5, 6], "seed=1", compute)
    return out.select("perm", "item", "n", "sum_unit")
