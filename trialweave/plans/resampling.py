"""Permutation, split and inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import cdf_sql, quantile_sql
from ..functions.stats import fisher_z, only_finite, pearson, r6
from ..operators import inference, ordered, sampling, selection, splits
from ..session import durable
from ..sources import views as V
from . import sqlparts as S
from .decoding import SPLITS, ATTEMPTS, run_splits
from .registry import query, rnd


@query("permute_within_block", f"WITH {V.UNITS}, {S.permuted('units', ['run'], 'unit', 'item', 5)} SELECT perm, unit, permuted FROM perms")
def permute_within_block(spark, sf):
    return sampling.permute_within(V.units(spark, sf).drop("x"), ["run"], "unit", "item", 5).select("perm", "unit", "permuted")


@query("permute_within_two_keys", f"WITH {V.UNITS}, {S.permuted('units', ['context', 'run'], 'unit', 'item', 5)} SELECT perm, unit, permuted FROM perms")
def permute_within_two_keys(spark, sf):
    return sampling.permute_within(V.units(spark, sf).drop("x"), ["context", "run"], "unit", "item", 5).select("perm", "unit", "permuted")


REDRAWN = S.permuted_until("sem", ["run"], "unit", "context", 20, 40, "JOIN sem USING (unit)", ["run % 2 AS half", "item"], "SELECT count(DISTINCT run % 2) * count(DISTINCT item) * count(DISTINCT context) FROM sem")


@query("permute_until_valid", f"WITH {V.UNITS}, sem AS (SELECT unit, item, context, run FROM units WHERE context <> 3), {REDRAWN} SELECT perm, attempt, unit, permuted FROM perms")
def permute_until_valid(spark, sf, perms=20):
    """Contexts shuffled within runs until every item has every context in odd and in even runs."""
    sem = selection.drop_control(V.units(spark, sf).drop("x"), "context", V.CONTROL).withColumn("half", F.col("run") % 2)
    valid = lambda drawn: sampling.covering(drawn, sem, "unit", ["half", "item"])
    return sampling.permute_until_valid(sem, ["run"], "unit", "context", perms, valid).select("perm", "attempt", "unit", "permuted")


@query(
    "permute_conditions",
    """WITH c AS (SELECT DISTINCT CAST(s_suppkey % 5 AS INT) AS subject, CAST(s_nationkey AS INT) AS idx FROM supplier)
SELECT CAST(range AS INT) AS perm, subject, idx AS index, row_number() OVER (PARTITION BY subject, range ORDER BY md5(concat_ws('|', '1', subject, range, idx)), idx) AS mapped FROM c, range(1, 11)""",
)
def permute_conditions(spark, sf):
    c = V.table(spark, sf, "supplier").select((F.col("s_suppkey") % 5).cast("int").alias("subject"), F.col("s_nationkey").alias("index")).distinct()
    return sampling.permute_conditions(c, ["subject"], "index", 10).select("perm", "subject", "index", F.col("mapped").cast("bigint").alias("mapped"))


@query("split_half_stratified", f"WITH {V.UNITS}, {S.splits(SPLITS, ATTEMPTS)} SELECT split, run, in_a FROM splits")
def split_half_stratified(spark, sf):
    return run_splits(spark, sf)


@query(
    "split_half_balanced",
    f"""WITH {V.UNITS}, {S.splits(100_000, 100_000)}, c AS (SELECT run, item, context, count(*) AS c FROM units WHERE context <> 3 GROUP BY ALL),
n AS (SELECT split, item, context, sum(CASE WHEN in_a THEN c ELSE 0 END) AS a, sum(CASE WHEN in_a THEN 0 ELSE c END) AS b FROM c JOIN splits USING (run) GROUP BY ALL),
r AS (SELECT split, max(abs(a - (a + b) / 2.0)) AS md, sum(pow(a - (a + b) / 2.0, 2)) AS ss FROM n GROUP BY split ORDER BY md, ss, split LIMIT 200),
k AS (SELECT *, row_number() OVER (ORDER BY md, ss, split) AS place FROM r)
SELECT CAST(place AS INT) AS split, run, in_a, CAST(md AS DOUBLE) AS max_deviation, CAST(ss AS DOUBLE) AS sum_squared FROM splits JOIN k USING (split)""",
)
def split_half_balanced(spark, sf):
    """The 200 most balanced of 100,000 candidate partitions (all, if fewer are distinct)."""
    u = selection.drop_control(V.units(spark, sf).drop("x"), "context", V.CONTROL)
    found, runs = splits.candidates(u, "run", "session", ["item", "context"])
    return splits.members(splits.best(found), runs, "run")


# The fixture holds tests whose observed value is missing or no number, and null values that are neither.
NULLS = f"""{V.RATINGS}, plain AS (SELECT subject, item, trial % 50 AS perm, round(avg(m2 + item * 0.1), 12) AS v FROM ratings GROUP BY ALL),
nulls AS (SELECT subject, item, perm, CASE WHEN perm IN (0, 7) AND (subject + item) % 7 = 1 THEN NULL WHEN perm IN (0, 8) AND (subject + item) % 7 = 2 THEN CAST('NaN' AS DOUBLE) ELSE v END AS v FROM plain),
o AS (SELECT subject, item, CASE WHEN isfinite(v) THEN v END AS v FROM nulls WHERE perm = 0), n AS (SELECT subject, item, perm, v FROM nulls WHERE perm > 0 AND isfinite(v))"""


def nulls(spark, sf):
    """Observed values (trial group 0) and 49 null values per subject and item."""
    r = V.ratings(spark, sf)
    v = r.groupBy("subject", "item", (F.col("trial") % 50).alias("perm")).agg(F.round(F.avg(F.col("m2") + F.col("item") * 0.1), 12).alias("v"))
    odd = (F.col("subject") + F.col("item")) % 7
    hole = F.when(F.col("perm").isin(0, 7) & (odd == 1), F.lit(None)).when(F.col("perm").isin(0, 8) & (odd == 2), F.lit(float("nan"))).otherwise(F.col("v"))
    v = v.withColumn("v", hole)
    return v.where("perm = 0").drop("perm"), v.where("perm > 0")


@query(
    "p_upper",
    f"WITH {NULLS} SELECT subject, item, {rnd('o.v', 'v')}, count(*) AS n_perm, CASE WHEN o.v IS NOT NULL THEN {rnd('(1.0 + count(*) FILTER (WHERE n.v >= o.v)) / (1 + count(*))')} END AS p FROM o JOIN n USING (subject, item) GROUP BY subject, item, o.v",
)
def p_upper(spark, sf):
    out = inference.p_upper(*nulls(spark, sf), ["subject", "item"], "v")
    return out.select("subject", "item", r6(only_finite("v")).alias("v"), "n_perm", r6("p").alias("p"))


@query(
    "p_two_sided",
    f"""WITH {NULLS} SELECT subject, item, {rnd('avg(n.v)', 'null_mean')}, {rnd('stddev_samp(n.v)', 'null_sd')},
CASE WHEN o.v IS NOT NULL THEN {rnd('least(1, 2 * least((1.0 + count(*) FILTER (WHERE n.v >= o.v)) / (1 + count(*)), (1.0 + count(*) FILTER (WHERE n.v <= o.v)) / (1 + count(*))))')} END AS p FROM o JOIN n USING (subject, item) GROUP BY subject, item, o.v""",
)
def p_two_sided(spark, sf):
    out = inference.p_two_sided(*nulls(spark, sf), ["subject", "item"], "v")
    return out.select("subject", "item", *[r6(c).alias(c) for c in ("null_mean", "null_sd", "p")])


@query(
    "p_pooled_null",
    f"WITH {NULLS} SELECT o.subject, o.item, CASE WHEN o.v IS NOT NULL THEN {rnd('avg(CASE WHEN n.v >= o.v THEN 1.0 ELSE 0.0 END)')} END AS p FROM o, n GROUP BY o.subject, o.item, o.v",
)
def p_pooled_null(spark, sf):
    o, n = nulls(spark, sf)
    return inference.p_pooled(o, n, "v").select("subject", "item", r6("p").alias("p"))


@query(
    "maxstat_fwe",
    f"""WITH {NULLS}, mu AS (SELECT subject, item, avg(v) AS mu FROM n GROUP BY ALL), oc AS (SELECT subject, item, round(v - mu, 12) AS v FROM o JOIN mu USING (subject, item)), nc AS (SELECT subject, item, perm, round(v - mu, 12) AS v FROM n JOIN mu USING (subject, item)),
mx AS (SELECT subject, perm, max(v) AS m FROM nc GROUP BY ALL) SELECT oc.subject, oc.item, CASE WHEN oc.v IS NOT NULL THEN {rnd('(1.0 + count(*) FILTER (WHERE m >= oc.v)) / (1 + count(*))')} END AS p_fwe FROM oc JOIN mx USING (subject) GROUP BY oc.subject, oc.item, oc.v""",
)
def maxstat_fwe(spark, sf):
    o, n = nulls(spark, sf)
    mu = n.groupBy("subject", "item").agg(F.avg(only_finite("v")).alias("mu"))
    centre = lambda d: d.join(mu, ["subject", "item"]).withColumn("v", F.round(F.col("v") - F.col("mu"), 12)).drop("mu")
    out = inference.maxstat_fwe(centre(o), centre(n), ["subject", "item"], ["subject"], "v")
    return out.select("subject", "item", r6("p_fwe").alias("p_fwe"))


@query(
    "maxstat_studentised",
    f"""WITH {NULLS}, st AS (SELECT subject, item, avg(v) AS m, stddev_samp(v) AS s FROM nulls WHERE isfinite(v) GROUP BY ALL), z AS (SELECT subject, item, perm, CASE WHEN isfinite(v) THEN round((v - m) / s, 10) END AS z, m, s FROM nulls JOIN st USING (subject, item)),
mx AS (SELECT perm, max(z) AS mz FROM z WHERE perm > 0 GROUP BY perm), pu AS (SELECT subject, item, CASE WHEN o.v IS NOT NULL THEN (1.0 + count(*) FILTER (WHERE n.v >= o.v)) / (1 + count(*)) END AS p FROM o JOIN n USING (subject, item) GROUP BY subject, item, o.v)
SELECT z.subject, z.item, {rnd('m', 'null_mean')}, {rnd('s', 'null_sd')}, {rnd('z', 'z')}, {rnd('pu.p', 'p_uncorrected')}, CASE WHEN z.z IS NOT NULL THEN {rnd('(1.0 + (SELECT count(*) FROM mx WHERE mz >= z.z)) / (1 + (SELECT count(*) FROM mx))')} END AS p_fwe FROM z JOIN pu USING (subject, item) WHERE perm = 0""",
)
def maxstat_studentised(spark, sf):
    out = inference.maxstat_studentised(*nulls(spark, sf), ["subject", "item"], [], "v")
    return out.select("subject", "item", *[r6(c).alias(c) for c in ("null_mean", "null_sd", "z", "p_uncorrected", "p_fwe")])


@query(
    "null_centre",
    f"WITH {NULLS} SELECT subject, item, {rnd('avg(n.v)', 'null_mean')}, {rnd('o.v - avg(n.v)', 'centred')} FROM o JOIN n USING (subject, item) GROUP BY subject, item, o.v",
)
def null_centre(spark, sf):
    out = inference.null_centre(*nulls(spark, sf), ["subject", "item"], "v")
    return out.select("subject", "item", r6("null_mean").alias("null_mean"), r6("centred").alias("centred"))


@query(
    "sign_flip_exact",
    f"""WITH {NULLS}, mu AS (SELECT subject, item, avg(v) AS mu FROM n GROUP BY ALL), e AS (SELECT subject, item, v - mu AS v, CAST(dense_rank() OVER (ORDER BY subject) - 1 AS INT) AS place FROM o JOIN mu USING (subject, item)),
fl AS (SELECT item, range AS pat, round(avg(CASE WHEN (range >> place) & 1 = 1 THEN v ELSE -v END), 12) AS x FROM e, range(32) GROUP BY ALL), ob AS (SELECT item, round(avg(v), 12) AS observed FROM e GROUP BY item), mx AS (SELECT pat, max(x) AS m FROM fl GROUP BY pat),
pl AS (SELECT item, observed, avg(CASE WHEN x >= observed THEN 1.0 ELSE 0.0 END) AS p FROM fl JOIN ob USING (item) GROUP BY ALL), fw AS (SELECT item, avg(CASE WHEN m >= observed THEN 1.0 ELSE 0.0 END) AS p_fwe FROM ob, mx GROUP BY item), {S.bh('pl', [])}
SELECT item, {rnd('observed', 'observed')}, {rnd('p', 'p')}, {rnd('p_fwe', 'p_fwe')}, {rnd('q', 'q')} FROM adj JOIN fw USING (item)""",
)
def sign_flip_exact(spark, sf):
    e = inference.null_centre(*nulls(spark, sf), ["subject", "item"], "v")
    out = inference.sign_flip_exact(e.withColumn("subject", 2 * F.col("subject") + 3), [], ["item"], "subject", "centred")
    return out.select("item", *[r6(c).alias(c) for c in ("observed", "p", "p_fwe", "q")])


@query(
    "stouffer",
    f"""WITH {NULLS}, pu AS (SELECT subject, item, (1.0 + count(*) FILTER (WHERE n.v >= o.v)) / (1 + count(*)) AS p FROM o JOIN n USING (subject, item) WHERE o.v IS NOT NULL GROUP BY subject, item, o.v),
zs AS (SELECT item, -({quantile_sql('c')}) AS z FROM (SELECT item, CAST(least(greatest(p, 1e-15), 1 - 1e-15) AS DOUBLE) AS c FROM pu)),
g AS (SELECT item, sum(z) / sqrt(count(*)) AS z, -sum(z) / sqrt(count(*)) AS m FROM zs GROUP BY item HAVING count(*) = 5), pl AS (SELECT item, z, {cdf_sql('m')} AS p FROM g), {S.bh('pl', [])}
SELECT item, {rnd('z', 'z')}, {rnd('p', 'p')}, {rnd('q', 'q')} FROM adj""",
)
def stouffer(spark, sf):
    p = inference.p_upper(*nulls(spark, sf), ["subject", "item"], "v")
    return inference.stouffer(p, ["item"], "p", 5).select("item", *[r6(c).alias(c) for c in ("z", "p", "q")])


DRAWS = 100


@query(
    "resample_consistency",
    f"""WITH {V.RATINGS}, d AS (SELECT range AS draw, item * 5 + subject AS cell, context, trial, m2, md5(concat_ws('|', '5', range, trial, printf('%.1f', m2))) AS key FROM ratings, range(1, {DRAWS + 1}) WHERE context <> 'AO'),
p AS (SELECT draw, cell, context, m2 AS v FROM d QUALIFY row_number() OVER (PARTITION BY draw, cell, context ORDER BY key, trial, m2) = 1),
mx AS (SELECT draw, cell, 'mixed' AS context, m2 AS v FROM d QUALIFY row_number() OVER (PARTITION BY draw, cell ORDER BY key, trial, m2) = 1),
c AS (SELECT a.context AS box, a.draw AS i, b.draw AS j, corr(a.v, b.v) AS r FROM p a JOIN p b ON a.context = b.context AND a.cell = b.cell AND a.draw < b.draw GROUP BY ALL
 UNION ALL SELECT 'cross', a.draw, b.draw, corr(a.v, b.v) FROM p a JOIN p b ON a.context < b.context AND a.cell = b.cell AND a.draw < b.draw GROUP BY a.context, b.context, a.draw, b.draw
 UNION ALL SELECT 'mixed', a.draw, b.draw, corr(a.v, b.v) FROM mx a JOIN mx b ON a.cell = b.cell AND a.draw < b.draw GROUP BY ALL),
z AS (SELECT box, atanh(least(greatest(r, -1 + 1e-12), 1 - 1e-12)) AS z FROM c) SELECT box, count(*) AS n, {rnd('avg(z)', 'mean_z')}, {rnd('stddev_samp(z)', 'sd_z')}, {rnd('median(z)', 'median_z')}, {rnd('quantile_cont(z, 0.25)', 'q25_z')}, {rnd('quantile_cont(z, 0.75)', 'q75_z')} FROM z GROUP BY box""",
)
def resample_consistency(spark, sf, draws=DRAWS):
    r = selection.drop_control(V.ratings(spark, sf), "context", V.CONTROL_TEXT)
    r = r.withColumns({"cell": F.col("item") * 5 + F.col("subject"), "text": F.format_string("%.1f", "m2")})
    # A profile has one value per cell; there are (draws x contexts) profiles however many ratings. The first of a cell
    # in all contexts is the least of its firsts in each.
    p = durable(sampling.first_by_key(r, ["cell", "context"], 5, ["trial", "text"], ["trial", "m2"], draws).withColumn("v", F.col("first.m2")))
    mixed = durable(p.groupBy("draw", "cell").agg(F.min("first").alias("first")).select("draw", "cell", F.lit("mixed").alias("context"), F.col("first.m2").alias("v")))

    def pairs(left, right, on, box):
        a = left.select("cell", F.col("draw").alias("i"), F.col("context").alias("ca"), F.col("v").alias("va"))
        b = right.select("cell", F.col("draw").alias("j"), F.col("context").alias("cb"), F.col("v").alias("vb"))
        j = a.join(b, "cell").where((F.col("i") < F.col("j")) & on)
        return j.groupBy(box.alias("box"), "ca", "cb", "i", "j").agg(pearson("va", "vb").alias("r"))

    same, ordered_ = F.col("ca") == F.col("cb"), F.col("ca") < F.col("cb")
    r = pairs(p, p, same, F.col("ca")).unionByName(pairs(p, p, ordered_, F.lit("cross"))).unionByName(pairs(mixed, mixed, same, F.lit("mixed")))
    z = durable(r.select("box", fisher_z("r").alias("z")))
    out = z.groupBy("box").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("z")).alias("mean_z"), r6(F.stddev_samp("z")).alias("sd_z"))
    at = {"median_z": 0.5, "q25_z": 0.25, "q75_z": 0.75}
    return out.join(ordered.percentiles(z, ["box"], "z", at).select("box", *[r6(c).alias(c) for c in at]), "box")


REPEATS, SUBSET = 100, 100
CLAMPED = "least(greatest(r, -1 + 1e-12), 1 - 1e-12)"


@query(
    "subset_reliability",
    f"""WITH {V.FEATURES}, u AS (SELECT unit, CAST(context AS INT) AS box FROM units UNION ALL SELECT unit, -1 FROM units),
dr AS (SELECT range AS rep, unit, box, row_number() OVER (PARTITION BY range, box ORDER BY md5(concat_ws('|', '11', range, box, unit)), unit) AS ra, row_number() OVER (PARTITION BY range, box ORDER BY md5(concat_ws('|', '12', range, box, unit)), unit) AS rb FROM u, range(1, {REPEATS + 1})),
pr AS (SELECT a.rep, a.box, a.unit AS ua, b.unit AS ub FROM (SELECT * FROM dr WHERE ra <= {SUBSET}) a JOIN (SELECT * FROM dr WHERE rb <= {SUBSET}) b ON a.rep = b.rep AND a.box = b.box AND a.ra = b.rb),
r AS (SELECT rep, box, fa.dim, corr(fa.v, fb.v) AS r FROM pr JOIN feats fa ON fa.unit = ua JOIN feats fb ON fb.unit = ub AND fb.dim = fa.dim GROUP BY ALL),
m AS (SELECT box, dim, avg(atanh({CLAMPED})) AS z FROM r GROUP BY ALL), b AS (SELECT dim, z FROM m WHERE box = -1),
t AS (SELECT list_sort(list(z))[CAST(floor(count(*) * 0.95) AS INT)] AS threshold FROM b)
SELECT m.box AS context, m.dim, {rnd('m.z', 'mean_z')}, {rnd('b.z', 'baseline_z')}, {rnd('m.z - b.z', 'difference')}, {rnd('threshold', 'threshold')}, m.z > threshold AS reliable FROM m JOIN b USING (dim), t WHERE m.box >= 0""",
)
def subset_reliability(spark, sf, repeats=REPEATS, count=SUBSET):
    """Agreement of two random subsets of a context's units, against subsets of all units and their 95th percentile."""
    x = V.units(spark, sf)
    u = x.select("unit", F.explode(F.array(F.col("context").cast("int"), F.lit(-1))).alias("box"))  # -1: all units
    reps = sampling.per_permutation(u, repeats, "rep")
    a, b = (sampling.sample_rank(reps, ["rep", "box"], seed, ["rep", "box", "unit"], ["unit"], count) for seed in (11, 12))
    pairs = durable(a.withColumnRenamed("unit", "ua").join(b.withColumnRenamed("unit", "ub"), ["rep", "box", "rank"]))
    both = pairs.join(x.select(F.col("unit").alias("ua"), F.col("x").alias("xa")), "ua").join(x.select(F.col("unit").alias("ub"), F.col("x").alias("xb")), "ub")
    long = both.select("rep", "box", F.posexplode(F.arrays_zip("xa", "xb")).alias("dim", "_v"))
    r = long.groupBy("rep", "box", "dim").agg(pearson("_v.xa", "_v.xb").alias("r"))
    m = durable(r.groupBy("box", "dim").agg(F.avg(fisher_z("r")).alias("z")))
    base = m.where("box = -1").select("dim", F.col("z").alias("base"))
    # One number for each feature of a vector, so the list is as long as a row of the input is wide.
    ranked = base.agg(F.array_sort(F.collect_list("base")).alias("_b"))
    limit = ranked.select(F.get("_b", F.floor(F.size("_b") * 0.95).cast("int") - 1).alias("threshold"))
    out = m.where("box >= 0").join(base, "dim").join(limit, F.lit(True))  # one row
    return out.select(
        F.col("box").alias("context"), "dim", r6("z").alias("mean_z"), r6("base").alias("baseline_z"), r6(F.col("z") - F.col("base")).alias("difference"),
        r6("threshold").alias("threshold"), (F.col("z") > F.col("threshold")).alias("reliable"),
    )
