"""Representational distance and regression queries.

Two subjects (run parity) and four regions; 40 conditions (4 contexts x 10 items).
Ratings of the same conditions come from line items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.stats import pearson, r6
from ..operators import distances, gather, inference, matching, patterns, regression, summaries
from ..session import durable
from ..sources import views as V
from . import sqlparts as S
from .decoding import REGIONS, centred_regions, run_splits
from .registry import query, rnd

ITEMS = 10

CPAT = f"""{V.FEATURES}, ctr AS (SELECT CAST(run % 2 AS INT) AS subject, region, context * 10 + item AS condition, dim, v - avg(v) OVER (PARTITION BY run, dim) AS v FROM feats),
cpat AS (SELECT subject, region, condition, dim, avg(v) AS v FROM ctr GROUP BY ALL)"""
RDM = f"""{CPAT}, rdm AS (SELECT a.subject, a.region, a.condition AS i, b.condition AS j, least(greatest(1 - corr(a.v, b.v), 0), 2) AS d FROM cpat a JOIN cpat b ON a.subject = b.subject AND a.region = b.region AND a.dim = b.dim AND a.condition < b.condition GROUP BY ALL)"""
BEH = """rt AS (SELECT CAST(l_orderkey % 2 AS INT) AS subject, CAST((l_suppkey % 4) * 10 + l_partkey % 10 AS INT) AS condition, nullif(l_quantity, 50.0) AS m1, l_discount * 100 AS m2 FROM lineitem),
zs AS (SELECT subject, avg(m1) AS a1, stddev_samp(m1) AS s1, avg(m2) AS a2, stddev_samp(m2) AS s2 FROM rt GROUP BY subject),
bm AS (SELECT subject, condition, avg((m1 - a1) / s1) AS m1, avg((m2 - a2) / s2) AS m2 FROM rt JOIN zs USING (subject) GROUP BY ALL),
beh AS (SELECT a.subject, a.condition AS i, b.condition AS j, abs(a.m1 - b.m1) AS m1, abs(a.m2 - b.m2) AS m2 FROM bm a JOIN bm b ON a.subject = b.subject AND a.condition < b.condition)"""
BLOCKS = f"""{RDM}, {BEH}, blk AS (SELECT subject, region, CAST(i // 10 AS INT) AS context, i % 10 AS ii, j % 10 AS jj, d, m1, m2 FROM rdm JOIN beh USING (subject, i, j) WHERE i // 10 = j // 10)"""


def subject_units(spark, sf):
    u = V.units(spark, sf)
    return u.select((F.col("run") % 2).cast("int").alias("subject"), "unit", "run", "session", (F.col("context") * ITEMS + F.col("item")).alias("condition"), "x")


def rdm(spark, sf):
    means = distances.condition_patterns(subject_units(spark, sf), ["subject"], "run", "condition", "x", V.WIDTH)
    return distances.rdm_correlation(REGIONS.cut(means, "pattern"), ["subject", "region"], "condition")


def behaviour(spark, sf):
    """Absolute differences of mean standardised ratings per subject and condition pair."""
    rated = V.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 2).cast("int").alias("subject"), ((F.col("l_suppkey") % 4) * 10 + F.col("l_partkey") % 10).cast("int").alias("condition"),
        F.expr("nullif(l_quantity, 50.0D)").alias("m1"), (F.col("l_discount") * 100).alias("m2"),
    )
    stats = rated.groupBy("subject").agg(*[f(c).alias(f"_{n}_{c}") for c in ("m1", "m2") for n, f in (("a", F.avg), ("s", F.stddev_samp))])
    # The z score is linear, so condition means are standardised after the aggregate.
    means = rated.groupBy("subject", "condition").agg(F.avg("m1").alias("m1"), F.avg("m2").alias("m2")).join(stats, "subject")
    z = means.withColumns({c: (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_s_{c}") for c in ("m1", "m2")})
    return distances.rdm_absolute(z, ["subject"], "condition", ["m1", "m2"])


def blocks(spark, sf):
    """Pairs of items inside one context: neural distance and rating differences."""
    both = rdm(spark, sf).join(behaviour(spark, sf), ["subject", "i", "j"]).where(F.expr("i div 10 = j div 10"))
    return durable(both).select(
        "subject", "region", F.expr("CAST(i div 10 AS INT)").alias("context"), (F.col("i") % 10).alias("ii"), (F.col("j") % 10).alias("jj"), "d", "m1", "m2"
    )


@query("rdm_correlation", f"WITH {RDM} SELECT subject, region, i, j, {rnd('d', 'd')} FROM rdm")
def rdm_correlation(spark, sf):
    return rdm(spark, sf).withColumn("d", r6("d"))


@query("rdm_rating", f"WITH {BEH} SELECT subject, i, j, {rnd('m1', 'm1')}, {rnd('m2', 'm2')} FROM beh")
def rdm_rating(spark, sf):
    return behaviour(spark, sf).withColumns({"m1": r6("m1"), "m2": r6("m2")})


@query(
    "rdm_categorical",
    f"WITH {BEH} SELECT subject, i, j, CAST(i % 10 = j % 10 AS DOUBLE) AS same_item, CAST(i // 10 = j // 10 AS DOUBLE) AS same_context FROM beh",
)
def rdm_categorical(spark, sf):
    item, context = distances.same_identity("i", "j", ITEMS)
    return behaviour(spark, sf).select("subject", "i", "j", item.alias("same_item"), context.alias("same_context"))


def whitening(spark, sf):
    """Residuals, their shrunk covariance per region, and run x condition sums."""
    u = V.units(spark, sf).select("unit", "run", (F.col("context") * ITEMS + F.col("item")).alias("condition"), "x")
    res = distances.run_condition_residuals(u, "run", "condition", "x", V.WIDTH)
    sums = distances.product_sums(REGIONS.cut(res.select("residual", "dof"), "residual"), ["region", "dof"], "residual")
    return u, sums, distances.shrink_covariance(sums.select("region", "dof", "xx", "xxxx"), ["region"], "dof")


@query("residual_covariance")
def residual_covariance(spark, sf):
    _, sums, _ = whitening(spark, sf)
    return sums.select("region", "dof", F.posexplode("xx").alias("entry", "value")).select(
        "region", "dof", "entry", r6(F.col("value") / F.col("dof")).alias("covariance")
    )


@query(
    "shrink_covariance",
    f"""WITH {S.CENTRED}, n AS (SELECT count(DISTINCT unit) AS n FROM cent), va AS (SELECT dim, sum(v * v) / any_value(n) AS var FROM cent, n GROUP BY dim),
p AS (SELECT a.region, a.dim AS i, b.dim AS j, any_value(n) AS n, sum(a.v * b.v) / any_value(n) AS cov, sum(a.v * a.v * b.v * b.v) AS sq FROM cent a JOIN cent b ON a.unit = b.unit AND a.region = b.region AND a.dim <= b.dim, n GROUP BY ALL),
r AS (SELECT p.*, vi.var AS vi, vj.var AS vj, cov / sqrt(vi.var * vj.var) AS r FROM p JOIN va vi ON vi.dim = i JOIN va vj ON vj.dim = j),
l AS (SELECT region, least(1, greatest(0, sum(greatest(sq / (vi * vj) - n * r * r, 0) / (n * (n - 1))) / sum(r * r))) AS lam FROM r WHERE i < j GROUP BY region)
SELECT region, i % 16 AS i, j % 16 AS j, {rnd('lam', 'shrinkage')}, {rnd('CASE WHEN i = j THEN cov ELSE (1 - lam) * cov END', 'covariance')} FROM r JOIN l USING (region)""",
)
def shrink_covariance(spark, sf):
    sums = distances.product_sums(centred_regions(spark, sf).select("region", "x"), ["region"], "x")
    w = distances.shrink_covariance(sums, ["region"], "n")
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(V.REGION_WIDTH) for j in range(i, V.REGION_WIDTH)])
    cells = w.select("region", r6("shrinkage").alias("shrinkage"), F.explode(F.arrays_zip("covariance", at.alias("at"))).alias("_c"))
    return cells.select("region", "_c.at.i", "_c.at.j", "shrinkage", r6("_c.covariance").alias("covariance"))


@query("whiten_features")
def whiten_features(spark, sf):
    u, _, w = whitening(spark, sf)
    x = distances.whiten(REGIONS.cut(u, "x"), w, ["region"], "x")
    return x.select("unit", "region", F.posexplode("x").alias("dim", "v")).select("unit", "region", "dim", r6("v").alias("v"))


@query("crossnobis")
def crossnobis(spark, sf):
    return whitened_crossnobis(spark, sf).select("region", "i", "j", r6("d").alias("d"), r6("sd").alias("sd"), "n_splits")


def whitened_crossnobis(spark, sf):
    u, _, w = whitening(spark, sf)
    u = u.where(f"condition < {V.CONTROL * ITEMS}")
    sums, _ = patterns.cube(u, [], "run", ["condition"], "x", V.WIDTH)
    halves = distances.split_patterns(sums, run_splits(spark, sf), [], "condition", V.WIDTH)
    # Whitening is linear, so only the few half patterns are whitened, not the units.
    a = distances.whiten(REGIONS.cut(halves.select("split", "condition", "a"), "a"), w, ["region"], "a")
    b = distances.whiten(REGIONS.cut(halves.select("split", "condition", "b"), "b"), w, ["region"], "b")
    return distances.crossnobis(a.join(b, ["region", "split", "condition"]), ["region"], "condition")


TWO = """{p}r2 AS (SELECT {k}, count(*) AS n, corr(d, m1) AS r1, corr(d, m2) AS r2, corr(m1, m2) AS r12 FROM {src} GROUP BY {k}),
{p}fit AS (SELECT {k}, n, (r1 - r12 * r2) / (1 - r12 * r12) AS b1, (r2 - r12 * r1) / (1 - r12 * r12) AS b2, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) AS rsq, r1, r2 FROM {p}r2)"""


def two(k, src, p=""):
    return TWO.format(k=k, src=src, p=p)


FIT = f"n AS n_valid, {rnd('b1', 'beta_1')}, {rnd('b2', 'beta_2')}, {rnd('rsq', 'r2')}, {rnd('1 - (1 - rsq) * (n - 1) / (n - 3)', 'adjusted_r2')}, {rnd('greatest(0, rsq - r2 * r2)', 'delta_1')}, {rnd('greatest(0, rsq - r1 * r1)', 'delta_2')}, {rnd('greatest(0, rsq - r2 * r2) / (1 - r2 * r2)', 'partial_1')}, {rnd('greatest(0, rsq - r1 * r1) / (1 - r1 * r1)', 'partial_2')}, 'ok' AS status"


def _fit(df, keys):
    fit = regression.ols(df, keys, "d", ["m1", "m2"])
    get = lambda c, n: r6(F.get(F.col(c), F.lit(n)))
    return fit.select(
        *keys, "n_valid", get("beta", 0).alias("beta_1"), get("beta", 1).alias("beta_2"), r6("r2").alias("r2"), r6("adjusted_r2").alias("adjusted_r2"),
        get("delta_r2", 0).alias("delta_1"), get("delta_r2", 1).alias("delta_2"),
        get("partial_r2", 0).alias("partial_1"), get("partial_r2", 1).alias("partial_2"), "status",
    )


@query("ols_standardised", f"WITH {RDM}, {BEH}, both_ AS (SELECT * FROM rdm JOIN beh USING (subject, i, j)), {two(k='subject, region', src='both_')} SELECT subject, region, {FIT} FROM fit")
def ols_standardised(spark, sf):
    return _fit(durable(rdm(spark, sf).join(behaviour(spark, sf), ["subject", "i", "j"])), ["subject", "region"])


def _rank_sql(c):
    return f"rank() OVER (PARTITION BY subject, region ORDER BY round({c}, 10)) + (count(*) OVER (PARTITION BY subject, region, round({c}, 10)) - 1) / 2.0 AS {c}"


@query(
    "ols_ranked",
    f"WITH {RDM}, {BEH}, both_ AS (SELECT subject, region, {', '.join(map(_rank_sql, ('d', 'm1', 'm2')))} FROM rdm JOIN beh USING (subject, i, j) WHERE d IS NOT NULL AND m1 IS NOT NULL AND m2 IS NOT NULL), {two(k='subject, region', src='both_')} SELECT subject, region, {FIT} FROM fit",
)
def ols_ranked(spark, sf):
    """The fit on tied ranks, taken inside each key among the rows without a missing value."""
    both = rdm(spark, sf).join(behaviour(spark, sf), ["subject", "i", "j"])
    both = durable(both.select("subject", "region", *[F.round(c, 10).alias(c) for c in ("d", "m1", "m2")]).dropna())
    return _fit(durable(regression.ranked(both, ["subject", "region"], ["d", "m1", "m2"])), ["subject", "region"])


@query("context_regression", f"WITH {BLOCKS}, {two(k='subject, region, context', src='blk')} SELECT subject, region, context, {FIT} FROM fit")
def context_regression(spark, sf):
    return _fit(blocks(spark, sf), ["subject", "region", "context"])


WP = "wp AS (SELECT a.subject, a.region, a.context AS c1, b.context AS c2, a.d - b.d AS d, a.m1 - b.m1 AS m1, a.m2 - b.m2 AS m2 FROM blk a JOIN blk b ON a.subject = b.subject AND a.region = b.region AND a.ii = b.ii AND a.jj = b.jj AND a.context < b.context)"
WARP = f"{BLOCKS}, {WP}"


def block_pairs(spark, sf):
    b = blocks(spark, sf)
    pairs = matching.upper_pairs(b, ["subject", "region", "ii", "jj"], "context", ["d", "m1", "m2"])
    return pairs.withColumnsRenamed({"i": "c1", "j": "c2"})


@query(
    "geometry_warping",
    f"WITH {WARP}, {two(k='subject, region, c1, c2', src='wp')} SELECT subject, region, {rnd('avg(b1)', 'mean_beta_1')}, {rnd('median(b1)', 'median_beta_1')}, {rnd('avg(b2)', 'mean_beta_2')}, {rnd('median(b2)', 'median_beta_2')}, {rnd('avg(rsq)', 'mean_r2')}, count(*) AS n_context_pairs FROM fit GROUP BY 1, 2",
)
def geometry_warping(spark, sf):
    flat = warping_fits(spark, sf)
    # Six context pairs per group: the built-in median holds a handful of values.
    return flat.groupBy("subject", "region").agg(
        r6(F.avg("b1")).alias("mean_beta_1"), r6(F.median("b1")).alias("median_beta_1"), r6(F.avg("b2")).alias("mean_beta_2"),
        r6(F.median("b2")).alias("median_beta_2"), r6(F.avg("r2")).alias("mean_r2"), F.count(F.lit(1)).alias("n_context_pairs"),
    )


def warping_fits(spark, sf):
    """Change of distances between two contexts on the change of ratings, per pair of contexts."""
    p = block_pairs(spark, sf)
    moved = p.select("subject", "region", "c1", "c2", *[(F.col(f"{c}_i") - F.col(f"{c}_j")).alias(c) for c in ("d", "m1", "m2")])
    fit = regression.ols(moved, ["subject", "region", "c1", "c2"], "d", ["m1", "m2"], parts=False)
    return fit.select("subject", "region", "status", F.get("beta", F.lit(0)).alias("b1"), F.get("beta", F.lit(1)).alias("b2"), "r2")


GEO = f"""{BLOCKS}, rk AS (SELECT *, rank() OVER (PARTITION BY subject, region, context ORDER BY round(d, 12)) + (count(*) OVER (PARTITION BY subject, region, context, round(d, 12)) - 1) / 2.0 AS rd FROM blk),
geo AS (SELECT a.subject, a.region, a.context AS c1, b.context AS c2, count(*) AS n, corr(a.d, b.d) AS pr, corr(a.rd, b.rd) AS sr FROM rk a JOIN rk b ON a.subject = b.subject AND a.region = b.region AND a.ii = b.ii AND a.jj = b.jj AND a.context < b.context GROUP BY ALL)"""


def geometry_table(spark, sf):
    b = blocks(spark, sf).withColumn("rd", F.round("d", 12))
    b = durable(regression.ranked(b, ["subject", "region", "context"], ["rd"]))
    pairs = matching.upper_pairs(b, ["subject", "region", "ii", "jj"], "context", ["d", "rd"])
    return pairs.groupBy("subject", "region", F.col("i").alias("c1"), F.col("j").alias("c2")).agg(
        F.count(F.lit(1)).alias("n"), pearson("d_i", "d_j").alias("pr"), pearson("rd_i", "rd_j").alias("sr")
    )


@query("context_geometry", f"WITH {GEO} SELECT subject, region, c1, c2, n, {rnd('pr', 'pearson_r')}, {rnd('sr', 'spearman_r')} FROM geo")
def context_geometry(spark, sf):
    return geometry_table(spark, sf).select("subject", "region", "c1", "c2", "n", r6("pr").alias("pearson_r"), r6("sr").alias("spearman_r"))


@query(
    "geometry_matrices",
    f"""WITH {GEO}, m AS (SELECT subject, region, c1 AS a, c2 AS b, pr AS r FROM geo UNION ALL SELECT subject, region, c2, c1, pr FROM geo UNION ALL SELECT DISTINCT subject, region, c, c, 1.0 FROM geo, (VALUES (0), (1), (2), (3)) x(c))
SELECT subject, region, a, b, {rnd('r', 'r')} FROM m UNION ALL SELECT NULL, region, a, b, {rnd('tanh(avg(atanh(least(greatest(r, -1 + 1e-12), 1 - 1e-12))))', 'r')} FROM m GROUP BY region, a, b""",
)
def geometry_matrices(spark, sf):
    g = durable(geometry_table(spark, sf))
    up = g.select("subject", "region", F.col("c1").alias("a"), F.col("c2").alias("b"), F.col("pr").alias("r"))
    down = up.select("subject", "region", F.col("b").alias("a"), F.col("a").alias("b"), "r")
    diagonal = g.select("subject", "region").distinct().withColumn("a", F.explode(F.array(*[F.lit(c) for c in range(4)])))
    m = up.unionByName(down).unionByName(diagonal.select("subject", "region", "a", F.col("a").alias("b"), F.lit(1.0).alias("r")))
    group = m.groupBy("region", "a", "b").agg(summaries.fisher_mean("r").alias("r")).withColumn("subject", F.lit(None).cast("int"))
    return m.unionByName(group.select("subject", "region", "a", "b", "r")).withColumn("r", r6("r"))


DISP = f"{RDM}, {BEH}, dp AS (SELECT subject, region, CAST(i % 10 AS INT) AS item, (i // 10) || '_vs_' || (j // 10) AS pair, i, j, d, m1, m2 FROM rdm JOIN beh USING (subject, i, j) WHERE i % 10 = j % 10)"


def displacement(spark, sf):
    both = rdm(spark, sf).join(behaviour(spark, sf), ["subject", "i", "j"]).where("i % 10 = j % 10")
    pair = F.concat_ws("_vs_", F.expr("i div 10"), F.expr("j div 10"))
    return both.select("subject", "region", (F.col("i") % 10).cast("int").alias("item"), pair.alias("pair"), "i", "j", "d", "m1", "m2")


@query(
    "pair_slopes",
    f"""WITH {DISP}, l AS (SELECT region, pair, 'm1' AS rating, m1 AS x, d FROM dp UNION ALL SELECT region, pair, 'm2', m2, d FROM dp)
SELECT region, pair, rating, count(*) AS n_valid, {rnd('regr_intercept(d, x)', 'intercept')}, {rnd('regr_slope(d, x)', 'slope')}, {rnd('regr_slope(d, x) * stddev_samp(x) / stddev_samp(d)', 'beta')} FROM l GROUP BY ALL""",
)
def pair_slopes(spark, sf):
    long = displacement(spark, sf).select("region", "pair", "d", F.explode(F.create_map(F.lit("m1"), F.col("m1"), F.lit("m2"), F.col("m2"))).alias("rating", "x"))
    slope = F.regr_slope("d", "x")
    return long.groupBy("region", "pair", "rating").agg(
        F.count(F.lit(1)).alias("n_valid"), r6(F.regr_intercept("d", "x")).alias("intercept"), r6(slope).alias("slope"),
        r6(slope * F.stddev_samp("x") / F.nullif(F.stddev_samp("d"), F.lit(0.0))).alias("beta"),
    )


PAIR_LEVELS = [f"{a}_vs_{b}" for a in range(4) for b in range(a + 1, 4)]


def factor_columns(df):
    df, pair_names = regression.treatment_columns(df, "pair", PAIR_LEVELS, "pair")
    df, item_names = regression.treatment_columns(df, "item", list(range(ITEMS)), "item")
    return df, pair_names, item_names


@query("ols_factor")
def ols_factor(spark, sf):
    df, pair_names, item_names = factor_columns(durable(displacement(spark, sf)))
    fit = regression.ols(df, ["subject", "region"], "d", ["m1", "m2"], [*pair_names, *item_names], parts=False)
    return fit.select(
        "subject", "region", "n_valid", r6(F.get("beta", F.lit(0))).alias("beta_1"), r6(F.get("beta", F.lit(1))).alias("beta_2"),
        r6("r2").alias("r2"), r6("adjusted_r2").alias("adjusted_r2"), "status",
    )


RSA_PERMS = 5_000  # of the original work


def omnibus_fits(spark, sf, perms):
    """Fits of all pairs on identity and rating differences."""
    neural = durable(rdm(spark, sf))
    item, context = distances.same_identity("i", "j", ITEMS)
    design = durable(behaviour(spark, sf).withColumns({"same_item": item, "same_context": context}))
    return durable(gather.fits(neural, design, ["subject"], ["region"], PRED, [], perms))


def statistics(done, names):
    """Subject and group rows of the coefficients: two-sided p, q within a subject or the group, and the null."""
    keys = ["subject", "region", "predictor"]
    beta = durable(gather.coefficients(done, ["subject", "region"], names))
    observed, null = beta.where("perm = 0").drop("perm"), beta.where("perm > 0")
    subject = inference.bh_fdr(inference.p_two_sided(observed, null, keys, "beta"), ["subject"], "p")
    top = observed.groupBy("region", "predictor").agg(F.avg("beta").alias("beta"))
    pooled = inference.group_null_mean(null, ["region", "predictor"], "beta").withColumnRenamed("mean", "beta")
    group = inference.bh_fdr(inference.p_two_sided(top, pooled, ["region", "predictor"], "beta"), [], "p")
    shown = [*[r6(c).alias(c) for c in ("beta", "p", "q", "null_mean", "null_sd")], "n_perm"]
    rows = subject.select(F.lit("subject").alias("level"), *keys, *shown)
    return rows.unionByName(group.select(F.lit("group").alias("level"), F.lit(None).cast("int").alias("subject"), "region", "predictor", *shown))


@query("omnibus_rsa")
def omnibus_rsa(spark, sf, perms=RSA_PERMS):
    done = statistics(omnibus_fits(spark, sf, perms), PRED)
    return done.where("level = 'subject'").drop("level")


def displacement_fits(spark, sf, perms):
    """{model: fits} of same-item pairs on the rating differences, with two sets of nuisance columns."""
    neural = durable(rdm(spark, sf))
    design = behaviour(spark, sf).where("i % 10 = j % 10")
    design = design.withColumns({"item": (F.col("i") % 10).cast("int"), "pair": F.concat_ws("_vs_", F.expr("i div 10"), F.expr("j div 10"))})
    design, pair_names, item_names = factor_columns(durable(design))
    models = {"pair_and_item": [*pair_names, *item_names], "pair": pair_names}
    return {m: (durable(gather.fits(neural, design, ["subject"], ["region"], ["m1", "m2"], extra, perms)), extra) for m, extra in models.items()}


@query("displacement_rsa")
def displacement_rsa(spark, sf, perms=RSA_PERMS):
    out = None
    for model, (done, _) in displacement_fits(spark, sf, perms).items():
        rows = statistics(done, ["m1", "m2"]).withColumn("model", F.lit(model))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("rsa_statistics")
def rsa_statistics(spark, sf, perms=RSA_PERMS):
    """Subject and group coefficients with their nulls; nuisance coefficients and fits of the observed order as rows of their own."""
    models = {"omnibus": (omnibus_fits(spark, sf, perms), [], PRED)}
    models |= {m: (done, extra, ["m1", "m2"]) for m, (done, extra) in displacement_fits(spark, sf, perms).items()}
    none, out = F.lit(None).cast("double"), None
    for model, (done, extra, names) in models.items():
        rows = statistics(done, names)
        observed = done.where("perm = 0")
        side = gather.coefficients(observed, ["subject", "region"], extra, len(names)).withColumn("level", F.lit("nuisance")) if extra else None
        fit = observed.select("subject", "region", F.explode(F.create_map(F.lit("r2"), F.col("r2"), F.lit("adjusted_r2"), F.col("adjusted_r2"))).alias("predictor", "beta"))
        for part in (side, fit.withColumn("level", F.lit("fit"))):
            if part is not None:
                rows = rows.unionByName(part.select("level", "subject", "region", "predictor", r6("beta").alias("beta"), *[none.alias(c) for c in ("p", "q", "null_mean", "null_sd")], F.lit(None).cast("bigint").alias("n_perm")))
        rows = rows.withColumn("model", F.lit(model))
        out = rows if out is None else out.unionByName(rows)
    return out


PRED = ["same_item", "same_context", "m1", "m2"]


@query(
    "predictor_correlations",
    f"WITH {BEH}, x AS (SELECT subject, CAST(i % 10 = j % 10 AS DOUBLE) AS same_item, CAST(i // 10 = j // 10 AS DOUBLE) AS same_context, m1, m2 FROM beh) "
    + " UNION ALL ".join(f"SELECT subject, '{a}' AS a, '{b}' AS b, {rnd(f'corr({a}, {b})', 'r')} FROM x GROUP BY subject" for n, a in enumerate(PRED) for b in PRED[n:]),
)
def predictor_correlations(spark, sf):
    item, context = distances.same_identity("i", "j", ITEMS)
    x = behaviour(spark, sf).withColumns({"same_item": item, "same_context": context})
    return summaries.correlations(x, ["subject"], PRED).withColumn("r", r6("r"))


@query(
    "metric_concordance",
    f"""WITH {V.FEATURES}, ctr AS (SELECT region, session, context * 10 + item AS condition, dim, v - avg(v) OVER (PARTITION BY run, dim) AS v FROM feats),
al AS (SELECT region, condition, dim, avg(v) AS v FROM ctr GROUP BY ALL), hf AS (SELECT region, condition, dim, avg(v) FILTER (WHERE session = 0) AS a, avg(v) FILTER (WHERE session = 1) AS b FROM ctr GROUP BY ALL),
s AS (SELECT x.region, x.condition AS i, y.condition AS j, 1 - corr(x.v, y.v) AS d FROM al x JOIN al y ON x.region = y.region AND x.dim = y.dim AND x.condition < y.condition GROUP BY ALL),
c AS (SELECT x.region, x.condition AS i, y.condition AS j, avg((x.a - y.a) * (x.b - y.b)) AS c FROM hf x JOIN hf y ON x.region = y.region AND x.dim = y.dim AND x.condition < y.condition GROUP BY ALL)
SELECT region, count(*) AS n, {rnd('corr(d, c)', 'r')}, {rnd('avg(CASE WHEN c < 0 THEN 1.0 ELSE 0.0 END)', 'share_negative')}, {rnd('avg(c)', 'mean_cross')}, {rnd('median(c)', 'median_cross')}, {rnd('avg(d)', 'mean_simple')}, {rnd('median(d)', 'median_simple')} FROM s JOIN c USING (region, i, j) WHERE c IS NOT NULL GROUP BY region""",
)
def metric_concordance(spark, sf):
    u = V.units(spark, sf).withColumn("condition", F.col("context") * ITEMS + F.col("item"))
    sums, _ = patterns.cube(u, [], "run", ["condition"], "x", V.WIDTH)
    whole = vectors.add_sums(sums, ["condition"], "s", "n", "s", "n", V.WIDTH).select("condition", vectors.divide("s", "n").alias("pattern"))
    simple = distances.rdm_correlation(REGIONS.cut(whole, "pattern"), ["region"], "condition")
    sessions = u.select("run", F.lit(1).alias("split"), (F.col("session") == 0).alias("in_a")).distinct()
    halves = distances.split_patterns(sums, sessions, [], "condition", V.WIDTH)
    a = REGIONS.cut(halves.select("split", "condition", "a"), "a")
    b = REGIONS.cut(halves.select("split", "condition", "b"), "b")
    cross = distances.crossnobis(a.join(b, ["region", "split", "condition"]), ["region"], "condition")
    both = simple.join(cross.select("region", "i", "j", F.col("d").alias("c")), ["region", "i", "j"])
    # At most 780 condition pairs per region: the built-in median is safe here.
    return both.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), r6(pearson("d", "c")).alias("r"), r6(F.avg((F.col("c") < 0).cast("double"))).alias("share_negative"),
        r6(F.avg("c")).alias("mean_cross"), r6(F.median("c")).alias("median_cross"), r6(F.avg("d")).alias("mean_simple"), r6(F.median("d")).alias("median_simple"),
    )


@query(
    "master_summary",
    f"""WITH {GEO}, {two(k='subject, region, context', src='blk')}, {WP}, {two(k='subject, region, c1, c2', src='wp', p='w')},
res AS (SELECT subject, region, 'context_geometry' AS analysis, avg(pr) AS value, count(*) AS n_valid FROM geo GROUP BY ALL UNION ALL SELECT subject, region, 'context_regression', avg(rsq), count(*) FROM fit GROUP BY ALL
 UNION ALL SELECT subject, region, 'warping', avg(rsq), count(*) FROM wfit GROUP BY ALL),
grid_ AS (SELECT DISTINCT subject, region, a AS analysis, e AS expected FROM rdm, (VALUES ('context_geometry', 6), ('context_regression', 4), ('warping', 6)) x(a, e))
SELECT subject, region, analysis, coalesce(n_valid, 0) AS n_valid, {rnd('value', 'value')}, CASE WHEN n_valid IS NULL THEN 'missing' WHEN n_valid < expected THEN 'partial' ELSE 'ok' END AS status FROM grid_ LEFT JOIN res USING (subject, region, analysis)""",
)
def master_summary(spark, sf):
    def summed(rows, value, analysis):
        out = rows.groupBy("subject", "region").agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n_valid"))
        return out.withColumn("analysis", F.lit(analysis))

    fits = regression.ols(blocks(spark, sf), ["subject", "region", "context"], "d", ["m1", "m2"], parts=False)
    results = summed(geometry_table(spark, sf), "pr", "context_geometry")
    results = results.unionByName(summed(fits.where("status = 'ok'"), "r2", "context_regression"))
    results = results.unionByName(summed(warping_fits(spark, sf).where("status = 'ok'"), "r2", "warping"))
    grid = V.units(spark, sf).select((F.col("run") % 2).cast("int").alias("subject")).distinct()
    grid = grid.withColumn("region", F.explode(F.sequence(F.lit(0), F.lit(3))))
    expected = {"context_geometry": 6, "context_regression": 4, "warping": 6}
    return matching.full_grid_status(grid, results, ["subject", "region"], "analysis", expected).withColumn("value", r6("value"))
