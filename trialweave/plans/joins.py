"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import matching, sampling, selection, spatial
from ..sources import views as V
from .registry import query, rnd

AT = ["i", "j", "k"]
MM2 = [[2.0, 0, 0, 0], [0, 2.0, 0, 0], [0, 0, 2.0, 0]]
SHRINK = [[0.8, 0, 0, 0.3], [0, 0.8, 0, -0.4], [0, 0, 0.8, 0.2]]
SHIFT = [[1.0, 0, 0, 0.25], [0, 1.0, 0, 0.5], [0, 0, 1.0, -0.25]]


@query(
    "join_mask_intersection",
    f"""WITH {V.GRID} SELECT g.label, count(*) AS n, {rnd('avg(g.value)', 'mean_value')} FROM grid g
SEMI JOIN mask m ON g.i = m.i AND g.j = m.j AND g.k = m.k WHERE price > 920 AND kind <> 'ECONOMY' GROUP BY g.label""",
)
def join_mask_intersection(spark, sf):
    g = V.grid(spark, sf)
    both = matching.intersect_masks(g, AT, V.mask(spark, sf), g.where("price > 920"), g.where("kind <> 'ECONOMY'"))
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_value"))


@query(
    "join_exact_reconcile",
    """WITH l AS (SELECT o_orderkey AS key, o_orderkey % 7 AS v FROM orders),
r AS (SELECT l_orderkey AS key, count(*) AS v FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN l.key IS NULL THEN 'right_only' WHEN r.key IS NULL THEN 'left_only' WHEN l.v = r.v THEN 'equal' ELSE 'different' END AS status,
count(*) AS n FROM l FULL JOIN r ON l.key = r.key GROUP BY 1""",
)
def join_exact_reconcile(spark, sf):
    left = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 7).alias("v"))
    right = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("v"))
    return matching.reconcile(left, right, ["key"], ["v"])


@query(
    "join_manifest_lookup",
    """WITH m AS (SELECT lower(n_name) AS name, n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 3 > 0)
SELECT s_suppkey, coalesce(c, 0) AS n_matches, n_regionkey FROM (SELECT s_suppkey, lower(upper(n_name)) AS stem FROM supplier JOIN nation ON s_nationkey = n_nationkey) s
LEFT JOIN (SELECT name, count(*) AS c, min(n_regionkey) AS n_regionkey FROM m GROUP BY name) u ON u.name = s.stem""",
)
def join_manifest_lookup(spark, sf):
    nation = V.table(spark, sf, "nation")
    stems = V.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    stems = stems.select("s_suppkey", F.upper("n_name").alias("stem"))
    manifest = nation.where("n_nationkey % 3 > 0")
    return matching.lookup(stems, F.col("stem"), manifest, F.col("n_name"), ["n_regionkey"]).select("s_suppkey", "n_matches", "n_regionkey")


@query(
    "join_nearest_event",
    f"""WITH {V.SIGNAL}, c AS (SELECT key, t, min(event_id) AS id FROM signal WHERE event_type = 'view' GROUP BY key, t)
SELECT s.key, s.event_id, c.id AS matched, abs(c.t - s.t) AS gap FROM signal s LEFT JOIN c ON c.key = s.key WHERE s.event_type = 'purchase'
QUALIFY row_number() OVER (PARTITION BY s.event_id ORDER BY abs(c.t - s.t), c.t) = 1""",
)
def join_nearest_event(spark, sf):
    s = V.signal(spark, sf)
    targets, candidates = s.where("event_type = 'purchase'"), s.where("event_type = 'view'")
    return matching.nearest_event(targets, candidates, "key", "t", "event_id", V.time_chunk()).select("key", "event_id", "matched", "gap")


@query(
    "join_interval_frames",
    f"""WITH {V.SIGNAL}, f AS (SELECT key, event_type, value, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)
OVER (PARTITION BY key ORDER BY t, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id) AS frame FROM signal)
SELECT key, CAST(frame AS BIGINT) AS frame, count(*) AS n, {rnd('avg(value)', 'mean')} FROM f WHERE event_type <> 'view' AND frame > 0 GROUP BY 1, 2""",
)
def join_interval_frames(spark, sf):
    s = V.signal(spark, sf)
    means = matching.interval_means(
        s.where("event_type <> 'view'"), s.where("event_type = 'view'"), "key", "t", "event_id", "value", V.time_chunk()
    )
    return means.select("key", "frame", "n", r6("mean").alias("mean"))


@query(
    "join_radius_mm",
    f"""WITH {V.GRID} SELECT a.i, a.j, a.k, count(*) AS n_members, {rnd('avg(b.value)', 'mean_value')} FROM mask a JOIN mask b
ON 4 * (pow(a.i - b.i, 2) + pow(a.j - b.j, 2) + pow(a.k - b.k, 2)) <= 16 GROUP BY 1, 2, 3 HAVING count(*) >= 10""",
)
def join_radius_mm(spark, sf):
    m = V.mask(spark, sf)
    near = spatial.neighbours(m, m, spatial.offsets_mm(MM2, 4.0), 10)
    return _describe_members(near, m)


def _describe_members(near, m):
    value = m.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("k").alias("nk"), "value")
    return near.join(value, ["ni", "nj", "nk"]).groupBy(*AT).agg(
        F.count(F.lit(1)).alias("n_members"), r6(F.avg("value")).alias("mean_value")
    )


@query(
    "join_radius_voxel",
    f"""WITH {V.GRID}, c AS (SELECT * FROM mask WHERE kind = 'ECONOMY') SELECT a.i, a.j, a.k, count(*) AS n_members, {rnd('avg(b.value)', 'mean_value')} FROM c a JOIN mask b
ON pow(a.i - b.i, 2) + pow(a.j - b.j, 2) + pow(a.k - b.k, 2) <= 9 GROUP BY 1, 2, 3""",
)
def join_radius_voxel(spark, sf):
    m = V.mask(spark, sf)
    near = spatial.neighbours(m.where("kind = 'ECONOMY'"), m, spatial.offsets_voxel(3.0))
    return _describe_members(near, m)


@query(
    "join_event_epochs",
    f"""WITH {V.FRAMES}, o AS (SELECT run, frame AS onset FROM frames WHERE signal = 50)
SELECT o.run, CAST(f.frame - onset AS INT) AS rel, count(*) AS n, {rnd('avg(f.p2)', 'mean')} FROM o JOIN frames f ON o.run = f.run AND f.frame BETWEEN onset - 5 AND onset + 15 GROUP BY 1, 2""",
)
def join_event_epochs(spark, sf):
    f = V.frames(spark, sf)
    e = matching.epochs(f.where("signal = 50").select("run", "frame"), f.select("run", "frame", "p2"), "run", "frame")
    return e.groupBy("run", "rel").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p2")).alias("mean"))


CELLS = f"""{V.RATINGS}, cells AS (SELECT subject, item, context, avg(m1) AS m1, avg(m2) AS m2 FROM ratings WHERE context <> 'AO' GROUP BY 1, 2, 3),
codes AS (SELECT context, dense_rank() OVER (ORDER BY context) - 1 AS c FROM (SELECT DISTINCT context FROM cells)),
conds AS (SELECT subject, item, context, CAST(c * 5 + item + 1 AS INT) AS condition, m1, m2 FROM cells JOIN codes USING (context))"""
CONTEXTS = ["AF", "NF", "NO", "RF", "RO"]


def conditions(spark, sf):
    """Mean ratings per subject and condition, control left out; 25 conditions."""
    r = selection.drop_control(V.ratings(spark, sf), "context", V.CONTROL_TEXT)
    cells = r.groupBy("subject", "item", "context").agg(F.avg("m1").alias("m1"), F.avg("m2").alias("m2"))
    cells = selection.encode_labels(cells, "context", CONTEXTS, "_c").withColumn("_i", F.col("item") + 1)
    return cells.withColumn("condition", selection.condition_code("_c", "_i", 5).cast("int")).drop("_c", "_i")


@query(
    "join_pairs_upper",
    f"""WITH {CELLS} SELECT a.subject, a.condition AS i, b.condition AS j, {rnd('abs(a.m1 - b.m1)', 'gap')} FROM conds a JOIN conds b
ON a.subject = b.subject AND a.condition < b.condition""",
)
def join_pairs_upper(spark, sf):
    pairs = matching.upper_pairs(conditions(spark, sf), ["subject"], "condition", ["m1"])
    return pairs.select("subject", "i", "j", r6(F.abs(F.col("m1_i") - F.col("m1_j"))).alias("gap"))


@query(
    "join_same_item_pairs",
    f"""WITH {CELLS} SELECT a.subject, a.item, a.context || '_vs_' || b.context AS context_pair, {rnd('abs(a.m1 - b.m1)', 'gap1')}, {rnd('abs(a.m2 - b.m2)', 'gap2')}
FROM conds a JOIN conds b ON a.subject = b.subject AND a.item = b.item AND a.context < b.context""",
)
def join_same_item_pairs(spark, sf):
    pairs = matching.same_item_pairs(conditions(spark, sf), ["subject"], "item", "context", ["m1", "m2"])
    return pairs.select(
        "subject", "item", "context_pair", r6(F.abs(F.col("m1_i") - F.col("m1_j"))).alias("gap1"),
        r6(F.abs(F.col("m2_i") - F.col("m2_j"))).alias("gap2"),
    )


@query(
    "join_baseline",
    f"""WITH {V.RATINGS}, b AS (SELECT subject, item, avg(m1) AS base FROM ratings WHERE context = 'AO' GROUP BY 1, 2)
SELECT subject, item, context, count(d) AS n, {rnd('avg(d)', 'displacement')} FROM (SELECT subject, item, context, abs(m1 - base) AS d FROM ratings JOIN b USING (subject, item) WHERE context <> 'AO')
GROUP BY 1, 2, 3""",
)
def join_baseline(spark, sf):
    r = V.ratings(spark, sf)
    moved = matching.from_baseline(r, ["subject", "item"], F.col("context") == V.CONTROL_TEXT, "m1", "d")
    return moved.groupBy("subject", "item", "context").agg(F.count("d").alias("n"), r6(F.avg("d")).alias("displacement"))


@query(
    "join_permutation_index",
    f"""WITH {CELLS}, pairs AS (SELECT a.subject, a.condition AS i, b.condition AS j, abs(a.m1 - b.m1) AS d FROM conds a JOIN conds b ON a.subject = b.subject AND a.condition < b.condition),
map AS (SELECT subject, CAST(p AS INT) AS perm, condition AS idx, row_number() OVER (PARTITION BY subject, p ORDER BY md5(concat_ws('|', '1', subject, p, condition)), condition) AS mapped FROM conds, range(1, 6) t(p))
SELECT pr.subject, mi.perm, pr.i, pr.j, {rnd('q.d', 'd')} FROM pairs pr JOIN map mi ON mi.subject = pr.subject AND mi.idx = pr.i
JOIN map mj ON mj.subject = pr.subject AND mj.perm = mi.perm AND mj.idx = pr.j
JOIN pairs q ON q.subject = pr.subject AND q.i = least(mi.mapped, mj.mapped) AND q.j = greatest(mi.mapped, mj.mapped)""",
)
def join_permutation_index(spark, sf):
    c = conditions(spark, sf).withColumn("index", F.col("condition"))
    pairs = matching.upper_pairs(c, ["subject"], "condition", ["m1"]).withColumn("d", F.abs(F.col("m1_i") - F.col("m1_j")))
    mapping = sampling.permute_conditions(c, ["subject"], "index", 5)
    moved = matching.permuted_pairs(pairs, mapping, ["subject"], "d")
    return moved.select("subject", "perm", "i", "j", r6("d").alias("d"))


@query(
    "resample_nearest",
    f"""WITH {V.GRID}, aim AS (SELECT i, j, k, CAST(floor(i * 0.8 + 0.3 + 0.5) AS INT) AS si, CAST(floor(j * 0.8 - 0.4 + 0.5) AS INT) AS sj, CAST(floor(k * 0.8 + 0.2 + 0.5) AS INT) AS sk FROM grid)
SELECT a.i, a.j, a.k, coalesce(m.value, 0) AS value FROM aim a LEFT JOIN mask m ON m.i = si AND m.j = sj AND m.k = sk""",
)
def resample_nearest(spark, sf):
    return spatial.resample_nearest(V.grid(spark, sf), V.mask(spark, sf), SHRINK, "value", 0.0)


@query(
    "resample_trilinear_cut",
    f"""WITH {V.GRID}, o AS (SELECT a, b, c, (CASE WHEN a = 1 THEN 0.25 ELSE 0.75 END) * 0.5 * (CASE WHEN c = 1 THEN 0.75 ELSE 0.25 END) AS w FROM range(2) x(a), range(2) y(b), range(2) z(c))
SELECT g.i, g.j, g.k, {rnd('sum(w * CASE WHEN m.i IS NULL THEN 0 ELSE 1 END)', 'coverage')} FROM grid g CROSS JOIN o LEFT JOIN mask m
ON m.i = g.i + a AND m.j = g.j + b AND m.k = g.k - 1 + c GROUP BY 1, 2, 3 HAVING sum(w * CASE WHEN m.i IS NULL THEN 0 ELSE 1 END) >= 0.2""",
)
def resample_trilinear_cut(spark, sf):
    binary = V.mask(spark, sf).select("i", "j", "k", F.lit(1.0).alias("coverage"))
    out = spatial.resample_trilinear(V.grid(spark, sf), binary, SHIFT, "coverage")
    return out.where("coverage >= 0.2").select("i", "j", "k", r6("coverage").alias("coverage"))


@query(
    "join_missing_pairs",
    """SELECT key, side FROM (SELECT DISTINCT o_custkey AS key, 'left' AS side FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)
UNION ALL SELECT DISTINCT user_id, 'right' FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders))""",
)
def join_missing_pairs(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    return matching.one_sided(orders, V.signal(spark, sf), ["key"])


@query(
    "split_hemisphere",
    f"""WITH {V.GRID} SELECT i, j, k, CASE WHEN 2.0 * i - 9 < 0 THEN 'L' WHEN 2.0 * i - 9 > 0 THEN 'R' ELSE 'mid' END AS side FROM mask""",
)
def split_hemisphere(spark, sf):
    x = spatial.world([[2.0, 0, 0, -9.0], [0, 2.0, 0, 0], [0, 0, 2.0, 0]])[0]
    side = F.when(x < 0, "L").when(x > 0, "R").otherwise("mid")
    return V.mask(spark, sf).select("i", "j", "k", side.alias("side"))


@query(
    "connected_components",
    f"""WITH RECURSIVE {V.GRID}, c AS (SELECT i, j, k, CAST(k AS BIGINT) * 1099511627776 + CAST(j AS BIGINT) * 1048576 + i AS cell FROM mask WHERE value > 30),
e AS (SELECT a.cell AS x, b.cell AS y FROM c a JOIN c b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1),
r(cell, label) AS (SELECT cell, cell FROM c UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.cell WHERE r.label < e.y),
l AS (SELECT cell, min(label) AS label FROM r GROUP BY cell)
SELECT label, count(*) AS n_cells, rank() OVER (ORDER BY count(*) DESC, label) = 1 AS largest FROM l GROUP BY label""",
)
def connected_components(spark, sf):
    labelled = spatial.connected_components(V.mask(spark, sf).where("value > 30"))
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n_cells"))
    best = sizes.agg(F.max_by("label", F.struct("n_cells", -F.col("label"))).alias("_best"))
    return sizes.join(best, F.lit(True)).select("label", "n_cells", (F.col("label") == F.col("_best")).alias("largest"))


@query(
    "interior_by_distance",
    f"""WITH {V.GRID}, thick AS (SELECT i, j, k FROM grid WHERE value > 5) SELECT a.i, a.j, a.k FROM thick a JOIN thick b
ON 4 * (pow(a.i - b.i, 2) + pow(a.j - b.j, 2) + pow(a.k - b.k, 2)) < 9 GROUP BY 1, 2, 3 HAVING count(*) = 19""",
)
def interior_by_distance(spark, sf):
    thick = V.grid(spark, sf).where("value > 5").select(AT)
    return spatial.interior(thick, spatial.offsets_mm(MM2, 3.0, strict=True))
