"""Row-level queries: coding, filters, subsets, sets, scalar functions, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import cdf_sql, normal_cdf, normal_quantile, quantile_sql
from ..functions.stats import r6
from ..operators import sampling, selection, splits
from ..sources import views as V
from .registry import query, rnd

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "encode_labels",
    "SELECT o_orderkey, CAST(nullif(list_position(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'],"
    " upper(trim(o_orderpriority))), 0) AS BIGINT) AS code,"
    " CAST((SELECT count(DISTINCT c_nationkey) FROM customer c2 WHERE c2.c_nationkey <= c.c_nationkey) AS BIGINT) AS number_code"
    " FROM orders JOIN customer c ON c_custkey = o_custkey",
)
def encode_labels(spark, sf):
    coded = selection.encode_labels(V.table(spark, sf, "orders"), "o_orderpriority", PRIORITIES)
    coded = coded.select("o_orderkey", "o_custkey", F.col("code").cast("bigint").alias("code"))
    numbers = selection.encode_numbers(V.table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "number_code")
    return coded.join(numbers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "code", "number_code")


@query(
    "condition_code",
    f"""WITH {V.RATINGS}, codes AS (SELECT context, dense_rank() OVER (ORDER BY context) AS c FROM (SELECT DISTINCT context FROM ratings))
SELECT subject, CAST((c - 1) * 5 + item + 1 AS BIGINT) AS condition, count(*) AS n FROM ratings JOIN codes USING (context) GROUP BY 1, 2""",
)
def condition_code(spark, sf):
    names = ["AF", "AO", "NF", "NO", "RF", "RO"]
    coded = selection.encode_labels(V.ratings(spark, sf), "context", names, "c").withColumn("_item", F.col("item") + 1)
    coded = coded.withColumn("condition", selection.condition_code("c", "_item", 5).cast("bigint"))
    return coded.groupBy("subject", "condition").agg(F.count(F.lit(1)).alias("n"))


@query("filter_semantic_subset", f"WITH {V.UNITS} SELECT unit, item, context, run FROM units WHERE context <> 3")
def filter_semantic_subset(spark, sf):
    return selection.drop_control(V.units(spark, sf), "context", V.CONTROL).select("unit", "item", "context", "run")


@query(
    "filter_complete_features",
    f"""WITH {V.FEATURES}, holes AS (SELECT unit, dim, CASE WHEN unit % 97 = 0 AND dim % 7 = 0 THEN NULL ELSE v END AS v FROM feats)
SELECT dim, count(*) AS n, {rnd('avg(v)', 'mean')} FROM holes
WHERE dim IN (SELECT dim FROM holes GROUP BY dim HAVING bool_and(v IS NOT NULL)) GROUP BY dim""",
)
def filter_complete_features(spark, sf):
    holes = V.features(spark, sf).withColumn("v", F.when(~((F.col("unit") % 97 == 0) & (F.col("dim") % 7 == 0)), F.col("v")))
    kept = selection.complete_features(holes.select("unit", "dim", "v"), ["dim"], "v")
    return kept.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v")).alias("mean"))


@query("filter_threshold_mask", f"WITH {V.GRID} SELECT i, j, k, value FROM grid WHERE value > 25")
def filter_threshold_mask(spark, sf):
    return V.mask(spark, sf).select("i", "j", "k", "value")


@query(
    "guard_min_features",
    f"""WITH {V.GRID} SELECT label, k, count(*) AS n_features,
CASE WHEN count(*) < 3 THEN 'insufficient_features' ELSE 'ok' END AS status FROM mask GROUP BY label, k""",
)
def guard_min_features(spark, sf):
    return selection.guard_min_features(V.mask(spark, sf), ["label", "k"], 3)


@query(
    "subset_deterministic",
    f"""WITH {V.GRID}, numbered AS (SELECT i, j, k, row_number() OVER (ORDER BY k, j, i) AS rn, count(*) OVER () AS n FROM mask)
SELECT i, j, k FROM numbered WHERE rn IN (SELECT CAST(floor(1 + ((SELECT count(*) FROM mask) - 1) * s / 49.0 + 0.5) AS BIGINT) FROM range(50) t(s))""",
)
def subset_deterministic(spark, sf):
    return selection.evenly_spaced(V.mask(spark, sf).select("i", "j", "k"), "k", ["k", "j", "i"], 50)


@query(
    "apply_sign_map",
    f"""WITH {V.SIGNAL}, signs AS (SELECT s_suppkey AS key, CASE WHEN s_nationkey % 2 = 0 THEN -1 ELSE 1 END AS sign FROM supplier)
SELECT event_id, {rnd('coalesce(sign, 1) * value', 'value')} FROM signal LEFT JOIN signs USING (key)""",
)
def apply_sign_map(spark, sf):
    signs = V.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.when(F.col("s_nationkey") % 2 == 0, -1).otherwise(1).alias("sign")
    )
    out = selection.apply_sign_map(V.signal(spark, sf), signs, ["key"], "value")
    return out.select("event_id", r6("value").alias("value"))


@query("recentre_constant", f"SELECT event_id, {rnd('value - 756', 'centred')} FROM events")
def recentre_constant(spark, sf):
    return V.table(spark, sf, "events").select("event_id", r6(selection.recentre("value")).alias("centred"))


@query(
    "assert_invariants",
    """SELECT 'finite_price' AS check_name, count(*) AS n_rows, count(*) FILTER (WHERE NOT isfinite(l_extendedprice)) AS n_violations FROM lineitem
UNION ALL SELECT 'known_priority', count(*), count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW')) FROM orders
UNION ALL SELECT 'one_row_per_order', count(*), count(*) FILTER (WHERE c <> 1) FROM (SELECT count(*) c FROM orders GROUP BY o_orderkey)
UNION ALL SELECT 'one_row_per_line', count(*), count(*) FILTER (WHERE c <> 1) FROM (SELECT count(*) c FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL SELECT 'pattern_width', count(*), count(*) FILTER (WHERE len(embedding) <> 64) FROM embeddings
UNION ALL SELECT 'cell_coverage', count(*), count(*) FILTER (WHERE c < 2) FROM (SELECT count(*) c FROM embeddings GROUP BY label, (vec_id // 10) % 4)""",
)
def assert_invariants(spark, sf):
    li, orders, emb = (V.table(spark, sf, t) for t in ("lineitem", "orders", "embeddings"))
    c = F.count(F.lit(1)).alias("c")
    return selection.violation_counts(
        {
            "finite_price": (li, selection.finite("l_extendedprice")),
            "known_priority": (orders, F.col("o_orderpriority").isin(PRIORITIES)),
            "one_row_per_order": (orders.groupBy("o_orderkey").agg(c), F.col("c") == 1),
            "one_row_per_line": (li.groupBy("l_orderkey", "l_linenumber").agg(c), F.col("c") == 1),
            "pattern_width": (emb, F.size("embedding") == V.WIDTH),
            "cell_coverage": (V.units(spark, sf).groupBy("item", "context").agg(c), F.col("c") >= 2),
        }
    )


# Sets of grid cells.


@query(
    "set_union_masks",
    f"""WITH {V.GRID} SELECT DISTINCT i, j, k FROM (SELECT i, j, k FROM grid WHERE label = 'Brand#1'
UNION ALL SELECT i, j, k FROM grid WHERE label = 'Brand#2' UNION ALL SELECT i, j, k FROM mask WHERE kind = 'ECONOMY')""",
)
def set_union_masks(spark, sf):
    g, at = V.grid(spark, sf), ["i", "j", "k"]
    a, b = (g.where(F.col("label") == name).select(at) for name in ("Brand#1", "Brand#2"))
    return a.union(b).union(V.mask(spark, sf).where("kind = 'ECONOMY'").select(at)).distinct()


@query("set_intersect", f"WITH {V.GRID} SELECT i, j, k FROM mask INTERSECT SELECT i, j, k FROM grid WHERE price > 950")
def set_intersect(spark, sf):
    at = ["i", "j", "k"]
    return V.mask(spark, sf).select(at).intersect(V.grid(spark, sf).where("price > 950").select(at))


@query("set_except", f"WITH {V.GRID} SELECT i, j, k FROM mask WHERE kind <> 'ECONOMY' EXCEPT SELECT i, j, k FROM grid WHERE price > 950")
def set_except(spark, sf):
    at = ["i", "j", "k"]
    keep = V.mask(spark, sf).where("kind <> 'ECONOMY'").select(at)
    return keep.join(V.grid(spark, sf).where("price > 950").select(at), at, "left_anti")


@query(
    "append_tables",
    "SELECT 'customer' AS source, c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer"
    " UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, NULL FROM supplier",
)
def append_tables(spark, sf):
    a = V.table(spark, sf, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    b = V.table(spark, sf, "supplier").select(
        F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")
    )
    return a.unionByName(b, allowMissingColumns=True)


# Scalar functions.


@query(
    "fn_string",
    r"""SELECT c_custkey, upper(trim(c_mktsegment)) AS up, lower(c_name) AS low, replace(c_name, 'Customer', '') AS erased,
regexp_replace(c_name, '0+', 'z') AS replaced, regexp_extract(c_name, '#0*([0-9]+)$', 1) AS digits,
split_part(c_mktsegment || '_vs_' || c_name, '_vs_', 2) AS after_vs, starts_with(c_mktsegment, 'B') AS starts,
ends_with(c_mktsegment, 'Y') AS ends, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS padded,
printf('session%02d_run%02d', c_nationkey, CAST(c_custkey % 10 AS INT)) AS tag FROM customer""",
)
def fn_string(spark, sf):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return V.table(spark, sf, "customer").select(
        "c_custkey",
        F.upper(F.trim(seg)).alias("up"),
        F.lower(name).alias("low"),
        F.replace(name, F.lit("Customer"), F.lit("")).alias("erased"),
        F.expr("regexp_replace(c_name, '^(.*?)0+', '$1z')").alias("replaced"),
        F.regexp_extract(name, "#0*([0-9]+)$", 1).alias("digits"),
        F.split_part(F.concat(seg, F.lit("_vs_"), name), F.lit("_vs_"), F.lit(2)).alias("after_vs"),
        seg.startswith("B").alias("starts"),
        seg.endswith("Y").alias("ends"),
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("padded"),
        F.format_string("session%02d_run%02d", "c_nationkey", (F.col("c_custkey") % 10).cast("int")).alias("tag"),
    )


@query(
    "fn_math",
    f"""SELECT l_orderkey, l_linenumber, l_quantity, {rnd('atanh(greatest(least(l_discount, 0.05), -0.05))', 'fz')}, {rnd('tanh(l_tax)', 'th')},
{rnd('sqrt(l_extendedprice)', 'root')}, {rnd('abs(l_quantity - 25)', 'gap')}, CAST(ceil(l_quantity / 3) AS BIGINT) AS up, CAST(floor(l_quantity / 3) AS BIGINT) AS down,
{rnd('round(l_quantity / 4)', 'near')}, CAST(l_orderkey % 7 AS BIGINT) AS rest FROM lineitem""",
)
def fn_math(spark, sf):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        r6(F.atanh(F.greatest(F.least(d, F.lit(0.05)), F.lit(-0.05)))).alias("fz"),
        r6(F.tanh("l_tax")).alias("th"),
        r6(F.sqrt("l_extendedprice")).alias("root"),
        r6(F.abs(q - 25)).alias("gap"),
        F.ceil(q / 3).alias("up"),
        F.floor(q / 3).alias("down"),
        r6(F.round(q / 4)).alias("near"),
        (F.col("l_orderkey") % 7).alias("rest"),
    )


@query(
    "fn_normal",
    f"WITH {V.PVALUES}, z AS (SELECT test, p, {quantile_sql('p')} AS z FROM pv) SELECT test, {rnd('p', 'p')}, {rnd('z', 'z')}, {rnd(cdf_sql('z'), 'back')} FROM z",
)
def fn_normal(spark, sf):
    p = V.pvalues(spark, sf).withColumn("z", normal_quantile("p"))
    return p.select("test", r6("p").alias("p"), r6("z").alias("z"), r6(normal_cdf("z")).alias("back"))


@query(
    "fn_index",
    f"""WITH {V.GRID} SELECT i, j, k, CAST(i + 10 * (j + 10 * k) + 1 AS BIGINT) AS linear,
CAST((i + 10 * (j + 10 * k)) % 10 AS INT) AS back_i, CAST(((i + 10 * (j + 10 * k)) // 10) % 10 AS INT) AS back_j,
CASE WHEN i < j THEN CAST(j * (j - 1) // 2 + i + 1 AS BIGINT) END AS upper_index FROM grid""",
)
def fn_index(spark, sf):
    from ..operators.spatial import linear_index, upper_index

    g = V.grid(spark, sf).select("i", "j", "k", linear_index("i", "j", "k", 10, 10).alias("linear"))
    at = F.col("linear") - 1
    return g.select(
        "i", "j", "k", "linear", (at % 10).cast("int").alias("back_i"),
        (F.floor(at / 10) % 10).cast("int").alias("back_j"),
        F.when(F.col("i") < F.col("j"), upper_index("i", "j")).alias("upper_index"),
    )


@query(
    "fn_array",
    f"""WITH {V.UNITS}, d AS (SELECT unit, list_transform(x, lambda e: CAST(e AS DOUBLE)) AS x FROM units)
SELECT unit, len(x) AS width, {rnd('sqrt(list_sum(list_transform(x, lambda e: e * e)))', 'norm')},
{rnd('list_sum(list_transform(list_zip(x, list_reverse(x)), lambda p: p[1] * p[2]))', 'dot_reversed')},
list_sum(range(1, CAST(unit % 5 + 2 AS BIGINT)))::BIGINT AS steps, {rnd('2.5 * (unit % 3)', 'repeated')} FROM d""",
)
def fn_array(spark, sf):
    from ..functions import vectors

    steps = F.aggregate(F.sequence(F.lit(1), (F.col("unit") % 5 + 1).cast("int")), F.lit(0), lambda s, v: s + v)
    repeated = vectors.total(F.array_repeat(F.lit(2.5), (F.col("unit") % 3).cast("int")))
    return V.units(spark, sf).select(
        "unit", F.size("x").cast("bigint").alias("width"), r6(F.sqrt(vectors.dot("x", "x"))).alias("norm"),
        r6(vectors.dot("x", F.reverse("x"))).alias("dot_reversed"), steps.cast("bigint").alias("steps"),
        r6(repeated).alias("repeated"),
    )


@query(
    "fn_json_time",
    """SELECT event_id, to_json({'user': user_id, 'kind': event_type, 'nested': {'id': event_id}}) AS doc,
strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events""",
)
def fn_json_time(spark, sf):
    nested = F.struct(F.col("event_id").alias("id"))
    return V.table(spark, sf, "events").select(
        "event_id",
        F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind"), nested.alias("nested"))).alias("doc"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"),
    )


@query("fn_bits", "SELECT o_orderkey, CAST((o_orderkey >> 1) & 1 AS BIGINT) AS bit1, CAST((o_orderkey >> 5) & 1 AS BIGINT) AS bit5 FROM orders")
def fn_bits(spark, sf):
    key = F.col("o_orderkey")
    return V.table(spark, sf, "orders").select(
        "o_orderkey", F.shiftright(key, 1).bitwiseAND(1).alias("bit1"), F.shiftright(key, 5).bitwiseAND(1).alias("bit5")
    )


# Limits and samples.


@query(
    "rank_splits",
    """WITH runs AS (SELECT DISTINCT vec_id % 10 AS run, (vec_id % 10) // 5 AS session FROM embeddings),
sizes AS (SELECT session, count(*) AS sz FROM runs GROUP BY session),
plan AS (SELECT sum(sz) // 2 - sum(sz // 2) AS extra FROM sizes),
att AS (SELECT range AS attempt FROM range(1, 100001)),
odd AS (SELECT attempt, session, sz, row_number() OVER (PARTITION BY attempt, sz % 2 ORDER BY md5(concat_ws('|', '1', attempt, session)), session) AS r FROM sizes, att),
take AS (SELECT attempt, session, sz // 2 + CASE WHEN sz % 2 = 1 AND r <= extra THEN 1 ELSE 0 END AS t FROM odd, plan),
dr AS (SELECT attempt, run, session, row_number() OVER (PARTITION BY attempt, session ORDER BY md5(concat_ws('|', '1', attempt, session, run)), run) AS r FROM runs, att),
half AS (SELECT attempt, run, r <= t AS a FROM dr JOIN take USING (attempt, session)),
can AS (SELECT attempt, run, a = first_value(a) OVER (PARTITION BY attempt ORDER BY run) AS in_a FROM half),
sig AS (SELECT attempt, string_agg(CASE WHEN in_a THEN CAST(run AS VARCHAR) END, ',' ORDER BY run) AS members FROM can GROUP BY attempt),
uniq AS (SELECT min(attempt) AS attempt FROM sig GROUP BY members),
cell AS (SELECT vec_id % 10 AS run, label, (vec_id // 10) % 4 AS ctx, count(*) AS c FROM embeddings WHERE (vec_id // 10) % 4 <> 3 GROUP BY 1, 2, 3),
cnt AS (SELECT attempt, label, ctx, sum(CASE WHEN in_a THEN c ELSE 0 END) AS na, sum(CASE WHEN in_a THEN 0 ELSE c END) AS nb FROM cell JOIN can USING (run) JOIN uniq USING (attempt) GROUP BY 1, 2, 3)
SELECT CAST(attempt AS BIGINT) AS attempt, CAST(max(abs(na - (na + nb) / 2.0)) AS DOUBLE) AS max_deviation, CAST(sum(pow(na - (na + nb) / 2.0, 2)) AS DOUBLE) AS sum_squared
FROM cnt GROUP BY attempt HAVING min(least(na, nb)) > 0 ORDER BY 2, 3, 1 LIMIT 200""",
)
def rank_splits(spark, sf):
    units = selection.drop_control(V.units(spark, sf).drop("x"), "context", V.CONTROL)
    found, _ = splits.candidates(units, "run", "session", ["item", "context"])
    return splits.best(found).select("attempt", "max_deviation", "sum_squared")


@query(
    "distinct_canonical",
    """WITH m AS (SELECT l_suppkey AS run, l_orderkey % 64 AS attempt, count(*) % 2 = 1 AS a FROM lineitem GROUP BY 1, 2),
g AS (SELECT attempt, run % 8 AS member, count(*) FILTER (WHERE a) % 2 = 1 AS a FROM m GROUP BY 1, 2),
c AS (SELECT attempt, member, a = first_value(a) OVER (PARTITION BY attempt ORDER BY member) AS in_a FROM g),
s AS (SELECT attempt, string_agg(CASE WHEN in_a THEN '1' ELSE '0' END, '' ORDER BY member) AS bits FROM c GROUP BY attempt)
SELECT bits, CAST(min(attempt) AS BIGINT) AS attempt FROM s GROUP BY bits""",
)
def distinct_canonical(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run"), (F.col("l_orderkey") % 64).alias("attempt"))
    m = li.groupBy("run", "attempt").agg((F.count(F.lit(1)) % 2 == 1).alias("a"))
    g = m.groupBy("attempt", (F.col("run") % 8).alias("member")).agg((F.count_if("a") % 2 == 1).alias("a"))
    lead = g.groupBy("attempt").agg(F.min_by("a", "member").alias("lead"))
    bit = F.when(F.col("a") == F.col("lead"), "1").otherwise("0")
    packed = F.sort_array(F.collect_list(F.struct("member", bit.alias("bit"))))  # eight members at most
    bits = g.join(lead, "attempt").groupBy("attempt").agg(F.concat_ws("", F.transform(packed, lambda s: s["bit"])).alias("bits"))
    return bits.groupBy("bits").agg(F.min("attempt").alias("attempt"))


PROFILES = 100  # of the original work


@query(
    "sample_one_per_cell",
    f"""WITH {V.RATINGS}, d AS (SELECT subject, item, context, m2, range AS draw, md5(concat_ws('|', '7', 'draw', subject, trial)) AS k0, trial,
 md5(concat_ws('|', '7', range, trial, printf('%.1f', m2))) AS key FROM ratings, range(1, {PROFILES + 1}))
SELECT CAST(draw AS INT) AS draw, subject, item, context, {rnd('m2', 'value')} FROM d
QUALIFY row_number() OVER (PARTITION BY draw, subject, item, context ORDER BY key, trial, m2) = 1""",
)
def sample_one_per_cell(spark, sf, draws=PROFILES):
    rated = V.ratings(spark, sf).withColumn("text", F.format_string("%.1f", "m2"))
    first = sampling.first_by_key(rated, ["subject", "item", "context"], 7, ["trial", "text"], ["trial", "m2"], draws)
    return first.select("draw", "subject", "item", "context", r6("first.m2").alias("value"))


@query(
    "sample_centres",
    f"""WITH {V.GRID}, d AS (SELECT CAST(range AS INT) AS perm, i, j, k, md5(concat_ws('|', '3', range, i, j, k)) AS key FROM mask, range(1, 4))
SELECT perm, i, j, k FROM d QUALIFY row_number() OVER (PARTITION BY perm ORDER BY key, k, j, i) <= 100""",
)
def sample_centres(spark, sf):
    m = sampling.per_permutation(V.mask(spark, sf).select("i", "j", "k"), 3)
    return sampling.sample_rows(m, ["perm"], 3, ["perm", "i", "j", "k"], ["k", "j", "i"], 100)
