"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import pearson, r6
from ..session import durable
from ..operators import learners, ordered, patterns, quality, selection, spatial, summaries, timeseries
from ..sources import views as V
from .joins import AT
from .registry import query, rnd


@query(
    "centre_within_block",
    f"WITH {V.FEATURES} SELECT unit, dim, {rnd('v - avg(v) OVER (PARTITION BY run, dim)', 'centred')} FROM feats",
)
def centre_within_block(spark, sf):
    f = summaries.centre_within(V.features(spark, sf), ["run", "dim"], "v", "centred")
    return f.select("unit", "dim", r6("centred").alias("centred"))


@query(
    "demean_pattern",
    f"WITH {V.FEATURES} SELECT unit, dim, {rnd('v - avg(v) OVER (PARTITION BY unit)', 'centred')} FROM feats",
)
def demean_pattern(spark, sf):
    from ..functions import vectors

    c = vectors.centred(V.units(spark, sf).select("unit", "x"), "x", "x")
    return vectors.to_long(c, "x", "dim", "v").select("unit", "dim", r6("v").alias("centred"))


@query(
    "mean_condition_patterns",
    f"WITH {V.FEATURES} SELECT item, context, dim, count(*) AS n, {rnd('avg(v)', 'mean')} FROM feats GROUP BY 1, 2, 3",
)
def mean_condition_patterns(spark, sf):
    return V.features(spark, sf).groupBy("item", "context", "dim").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v")).alias("mean"))


@query(
    "mean_class_templates",
    f"""WITH {V.FEATURES}, folds AS (SELECT DISTINCT run AS fold FROM feats)
SELECT fold, item, dim, count(*) AS n, {rnd('avg(v)', 'mean')} FROM feats JOIN folds ON run <> fold GROUP BY 1, 2, 3""",
)
def mean_class_templates(spark, sf):
    from ..functions import vectors

    t = patterns.held_out_templates(V.units(spark, sf), [], "run", "item", "x", V.WIDTH)
    long = vectors.to_long(t.select(F.col("run").alias("fold"), "item", "n", "template"), "template", "dim", "v")
    return long.select("fold", "item", "dim", "n", r6("v").alias("mean"))


@query(
    "equal_weight_templates",
    f"""WITH {V.FEATURES}, m AS (SELECT run % 2 AS half, context, item, dim, avg(v) AS v FROM feats WHERE context <> 3 GROUP BY 1, 2, 3, 4)
SELECT CAST(half AS INT) AS half, context, dim, {rnd('avg(v)', 'mean')} FROM m GROUP BY 1, 2, 3""",
)
def equal_weight_templates(spark, sf):
    f = selection.drop_control(V.features(spark, sf), "context", V.CONTROL).withColumn("half", F.col("run") % 2)
    levels = [["half", "context", "item", "dim"], ["half", "context", "dim"]]
    return summaries.equal_weight_mean(f, levels, "v", "mean").withColumn("mean", r6("mean"))


@query(
    "describe_cells",
    f"""WITH {V.RATINGS} SELECT subject, item, context, count(*) AS n_trials, count(m1) AS n_valid, count(*) - count(m1) AS n_missing,
{rnd('avg(m1)', 'mean')}, {rnd('stddev_samp(m1)', 'sd')}, {rnd('median(m1)', 'median')} FROM ratings GROUP BY 1, 2, 3""",
)
def describe_cells(spark, sf):
    d = summaries.describe(V.ratings(spark, sf), ["subject", "item", "context"], "m1")
    return d.withColumns({c: r6(c) for c in ("mean", "sd", "median")})


@query(
    "describe_groups",
    f"""WITH {V.RATINGS}, s AS (SELECT subject, context, avg(m1) AS m FROM ratings GROUP BY 1, 2)
SELECT context, count(*) AS n_subjects, {rnd('avg(m)', 'mean')}, {rnd('stddev_samp(m)', 'sd')} FROM s GROUP BY GROUPING SETS ((context), ())""",
)
def describe_groups(spark, sf):
    s = V.ratings(spark, sf).groupBy("subject", "context").agg(F.avg("m1").alias("m"))
    out = s.groupingSets([["context"], []], "context").agg(
        F.count(F.lit(1)).alias("n_subjects"), r6(F.avg("m")).alias("mean"), r6(F.stddev_samp("m")).alias("sd")
    )
    return out.select("context", "n_subjects", "mean", "sd")


PROBS = {"p05": 0.05, "p50": 0.5, "p95": 0.95}


@query(
    "percentile_linear",
    "SELECT l_suppkey, " + ", ".join(rnd(f"quantile_cont(l_extendedprice, {p})", n) for n, p in PROBS.items()) + " FROM lineitem GROUP BY l_suppkey",
)
def percentile_linear(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    return ordered.percentiles(li, ["l_suppkey"], "l_extendedprice", PROBS).withColumns({n: r6(n) for n in PROBS})


def _midpoint_sql(name, p):
    pos = f"greatest(1.0, least(n * {p} + 0.5, n))"
    return rnd(
        f"max(CASE WHEN rn = floor({pos}) THEN v END) + max({pos} - floor({pos})) * (max(CASE WHEN rn = ceil({pos}) THEN v END) - max(CASE WHEN rn = floor({pos}) THEN v END))",
        name,
    )


@query(
    "percentile_midpoint",
    "WITH r AS (SELECT l_suppkey, CAST(l_extendedprice AS DOUBLE) AS v, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS DOUBLE) AS rn, CAST(count(*) OVER (PARTITION BY l_suppkey) AS DOUBLE) AS n FROM lineitem) SELECT l_suppkey, "
    + ", ".join(_midpoint_sql(n, p) for n, p in PROBS.items()) + " FROM r GROUP BY l_suppkey",
)
def percentile_midpoint(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    return ordered.percentiles(li, ["l_suppkey"], "l_extendedprice", PROBS, "midpoint").withColumns({n: r6(n) for n in PROBS})


ROBUST = """{base}, med AS (SELECT run, median(x) AS med FROM {src} WHERE frame > 1 GROUP BY run),
mad AS (SELECT run, median(abs(x - med)) AS mad FROM {src} JOIN med USING (run) WHERE frame > 1 GROUP BY run),
rz AS (SELECT run, frame, x, CASE WHEN frame = 1 THEN 0 WHEN mad > 0 THEN (x - med) / (1.4826 * mad) END AS z FROM {src} JOIN med USING (run) JOIN mad USING (run))"""


@query(
    "robust_z",
    f"WITH {ROBUST.format(base=V.FRAMES + ', src AS (SELECT run, frame, p2 AS x FROM frames)', src='src')} SELECT run, frame, {rnd('z', 'z')} FROM rz",
)
def robust_z(spark, sf):
    f = V.frames(spark, sf).select("run", "frame", "p2")
    return summaries.robust_z(f, "run", "frame", "p2", "z").select("run", "frame", r6("z").alias("z"))


DVARS = f"""{V.FRAMES}, vox AS (SELECT run, frame, v AS voxel, CASE v WHEN 0 THEN p1 WHEN 1 THEN p2 WHEN 2 THEN p3 ELSE p4 END * 10 AS val FROM frames, range(4) t(v)),
dd AS (SELECT run, frame, val - lag(val) OVER (PARTITION BY run, voxel ORDER BY frame) AS d FROM vox),
dv AS (SELECT run, frame, sqrt(avg(coalesce(d * d, 0))) AS x FROM dd GROUP BY run, frame)"""


def voxels(spark, sf, f=None):
    """Four measured columns of each frame as voxel rows."""
    f = V.frames(spark, sf) if f is None else f
    cells = F.array(*[F.struct(F.lit(n).alias("voxel"), (F.col(c) * 10).alias("val")) for n, c in enumerate(V.MOTION[:4])])
    return f.select("run", "frame", F.explode(cells).alias("_c")).select("run", "frame", "_c.voxel", "_c.val")


@query("dvars", f"WITH {DVARS} SELECT run, frame, {rnd('x', 'dvars')} FROM dv")
def dvars(spark, sf):
    return quality.dvars(voxels(spark, sf), "run", "frame", "voxel", "val").select("run", "frame", r6("dvars").alias("dvars"))


def _rule_sql():
    parts = []
    for rid, kind, fd, z in quality.RULES:
        cond = {"fd": f"fd > {fd}", "dvars": f"z > {z}", "or": f"(fd > {fd} OR z > {z})"}[kind]
        parts.append(f"('{rid}', {cond})")
    return parts


FD = """fdt AS (SELECT run, frame, coalesce(abs(p1 - lag(p1) OVER w) + abs(p2 - lag(p2) OVER w) + abs(p3 - lag(p3) OVER w)
 + 50 * (abs(p4 - lag(p4) OVER w) + abs(p5 - lag(p5) OVER w) + abs(p6 - lag(p6) OVER w)), 0) / 10 AS fd FROM frames WINDOW w AS (PARTITION BY run ORDER BY frame))"""
QC = ROBUST.format(base=DVARS, src="dv") + f", {FD}, qc AS (SELECT run, frame, fd, x AS dvars, z FROM rz JOIN fdt USING (run, frame))"
BAD = "bad AS (" + " UNION ALL ".join(
    f"SELECT run, frame, '{rid}' AS rule, "
    + {"fd": f"fd > {fd}", "dvars": f"z > {z}", "or": f"fd > {fd} OR z > {z}"}[kind]
    + " AS bad FROM qc"
    for rid, kind, fd, z in quality.RULES
) + ")"


def motion_qc(spark, sf, f=None):
    """(run, frame, fd, dvars, z) of every frame; displacement in tenths for this fixture. ``f``: frames written before."""
    f = V.frames(spark, sf, stored=True) if f is None else f
    fd = timeseries.framewise_displacement(f, ["run"], "frame", V.MOTION, V.frame_chunk()).withColumn("fd", F.col("fd") / 10)
    d = quality.dvars(voxels(spark, sf, f), "run", "frame", "voxel", "val")
    z = summaries.robust_z(d, "run", "frame", "dvars", "z")
    return fd.select("run", "frame", "fd").join(z.hint("merge"), ["run", "frame"])  # a row for each frame on either side


@query("candidate_rules", f"WITH {QC}, {BAD} SELECT run, rule, count(*) AS n_frames, count(*) FILTER (WHERE bad) AS n_bad FROM bad GROUP BY 1, 2")
def candidate_rules(spark, sf):
    flagged = quality.apply_rules(motion_qc(spark, sf), quality.RULES, "fd", "z")
    return flagged.groupBy("run", "rule").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if("bad").alias("n_bad"))


@query(
    "censor_summary",
    f"""WITH {QC}, {BAD}, r AS (SELECT rule, run, count(*) FILTER (WHERE bad) AS b, count(*) AS n FROM bad GROUP BY 1, 2)
SELECT rule, CAST(sum(b) AS BIGINT) AS n_censored, {rnd('100.0 * sum(b) / sum(n)', 'percent_censored')}, {rnd('max(100.0 * b / n)', 'max_run_percent')},
count(*) FILTER (WHERE 100.0 * b / n > 5) AS runs_over_5pct, count(*) FILTER (WHERE 100.0 * b / n > 10) AS runs_over_10pct, count(*) FILTER (WHERE 100.0 * b / n > 20) AS runs_over_20pct FROM r GROUP BY rule""",
)
def censor_summary(spark, sf):
    flagged = quality.apply_rules(motion_qc(spark, sf), quality.RULES, "fd", "z")
    out = summaries.censor_summary(flagged, "run", "rule", "bad")
    return out.withColumns({c: r6(c) for c in ("percent_censored", "max_run_percent")})


@query(
    "extra_thresholds",
    f"""WITH {V.FRAMES}, {FD} SELECT CAST(th AS DOUBLE) AS threshold, run, count(*) FILTER (WHERE fd > th) AS n_bad, {rnd('100.0 * count(*) FILTER (WHERE fd > th) / count(*)', 'percent')}
FROM fdt, (VALUES (0.4), (0.45)) t(th) GROUP BY 1, 2""",
)
def extra_thresholds(spark, sf):
    f = timeseries.framewise_displacement(V.frames(spark, sf), ["run"], "frame", V.MOTION, V.frame_chunk())
    return quality.extra_thresholds(f.withColumn("fd", F.col("fd") / 10), "run", "fd", [0.45, 0.4, 0.45]).withColumn("percent", r6("percent"))


@query(
    "bad_frame_reason",
    f"""WITH {QC}, l AS (SELECT run, max(frame) AS last FROM qc GROUP BY run)
SELECT run, frame, CASE WHEN frame = last AND run % 3 = 0 THEN 'incomplete_last_frame' WHEN fd > 0.5 AND z > 5 THEN 'fd_and_dvars' WHEN fd > 0.5 THEN 'fd' WHEN z > 5 THEN 'dvars' END AS reason
FROM qc JOIN l USING (run) WHERE (frame = last AND run % 3 = 0) OR fd > 0.5 OR z > 5""",
)
def bad_frame_reason(spark, sf):
    q = durable(motion_qc(spark, sf).drop("dvars"))  # read twice
    last = q.groupBy("run").agg(F.max("frame").alias("last"))
    q = ordered.join_few(q, last, ["run"]).withColumn("incomplete", (F.col("frame") == F.col("last")) & (F.col("run") % 3 == 0))
    out = q.withColumn("reason", quality.bad_frame_reason("fd", "z", "incomplete", 0.5, 5.0))
    return out.where("reason IS NOT NULL").select("run", "frame", "reason")


@query(
    "pivot_wide",
    "SELECT l_suppkey, " + ", ".join(f"count(*) FILTER (WHERE l_returnflag || l_linestatus = '{c}') AS {c}" for c in ("AF", "AO", "NF", "NO", "RF", "RO"))
    + " FROM lineitem GROUP BY l_suppkey",
)
def pivot_wide(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumn("c", F.concat("l_returnflag", "l_linestatus"))
    wide = li.groupBy("l_suppkey").pivot("c", ["AF", "AO", "NF", "NO", "RF", "RO"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def _stats_sql(cols, probs):
    return ", ".join(rnd(f"quantile_cont({c}, {p})", f"{c}_{n}") for c in cols for n, p in probs.items())


QS = {"median": 0.5, "p95": 0.95}


@query(
    "run_summary",
    f"WITH {QC} SELECT run, count(*) AS n_frames, {_stats_sql(['fd', 'dvars', 'z'], QS)}, {rnd('max(fd)', 'fd_max')}, {rnd('corr(fd, dvars)', 'fd_dvars_r')} FROM qc GROUP BY run",
)
def run_summary(spark, sf):
    return _summary(motion_qc(spark, sf), ["run"], ["fd", "dvars", "z"], None)


def _summary(q, keys, columns, corr_where):
    q = durable(q)  # the table of frame metrics is read once per metric below
    pair = (F.col("fd"), F.col("dvars"))
    if corr_where is not None:
        pair = tuple(F.when(corr_where, c) for c in pair)
    out = q.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), r6(F.max("fd")).alias("fd_max"), r6(pearson(*pair)).alias("fd_dvars_r"))
    for c in columns:
        p = ordered.percentiles(q, keys, c, {f"{c}_{n}": v for n, v in QS.items()})
        p = p.withColumns({f"{c}_{n}": r6(f"{c}_{n}") for n in QS})
        out = out.join(p, keys) if keys else out.join(p, F.lit(True))
    return out


@query(
    "participant_summary",
    f"""WITH {QC} SELECT CAST(run % 5 AS INT) AS subject, count(*) AS n_frames, {_stats_sql(['fd', 'dvars', 'z'], QS)}, {rnd('max(fd)', 'fd_max')},
{rnd('corr(CASE WHEN frame > 1 THEN fd END, CASE WHEN frame > 1 THEN dvars END)', 'fd_dvars_r')} FROM qc GROUP BY 1""",
)
def participant_summary(spark, sf):
    q = motion_qc(spark, sf).withColumn("subject", (F.col("run") % 5).cast("int"))
    return _summary(q, ["subject"], ["fd", "dvars", "z"], F.col("frame") > 1)


# Decoder summaries; the decoder itself is in decoding.py, whose SQL these reuse.


@query(
    "fisher_mean",
    f"""WITH {V.RATINGS}, r AS (SELECT subject, item, context, corr(m1, m2) AS r FROM ratings GROUP BY 1, 2, 3)
SELECT subject, {rnd('tanh(avg(atanh(greatest(least(r, 0.999999), -0.999999))))', 'mean_r')} FROM r GROUP BY subject""",
)
def fisher_mean(spark, sf):
    r = V.ratings(spark, sf).groupBy("subject", "item", "context").agg(pearson("m1", "m2").alias("r"))
    return r.groupBy("subject").agg(r6(summaries.fisher_mean("r", 0.999999)).alias("mean_r"))


@query(
    "macro_average",
    f"""WITH {V.RATINGS}, c AS (SELECT item, context, avg(m1) AS m FROM ratings GROUP BY 1, 2), i AS (SELECT item, avg(m) AS m FROM c GROUP BY item)
SELECT 'overall' AS level, NULL AS context, {rnd('avg(m)', 'mean')} FROM i UNION ALL SELECT 'context', context, {rnd('avg(m)', 'mean')} FROM c GROUP BY context""",
)
def macro_average(spark, sf):
    cells = V.ratings(spark, sf).groupBy("item", "context").agg(F.avg("m1").alias("m"))
    overall = summaries.equal_weight_mean(cells, [["item"], []], "m", "mean")
    by = summaries.equal_weight_mean(cells, [["context"]], "m", "mean").select(F.lit("context").alias("level"), "context", "mean")
    return overall.select(F.lit("overall").alias("level"), F.lit(None).cast("string").alias("context"), "mean").unionByName(by).withColumn("mean", r6("mean"))


@query(
    "group_null_mean",
    f"""WITH {V.RATINGS}, n AS (SELECT subject, item, trial % 20 AS perm, avg(m2) AS v FROM ratings GROUP BY 1, 2, 3)
SELECT item, perm, {rnd('avg(v)', 'mean')}, count(*) AS n_subjects FROM n GROUP BY 1, 2""",
)
def group_null_mean(spark, sf):
    from ..operators import inference

    null = V.ratings(spark, sf).groupBy("subject", "item", (F.col("trial") % 20).alias("perm")).agg(F.avg("m2").alias("v"))
    return inference.group_null_mean(null, ["item"], "v").select("item", "perm", r6("mean").alias("mean"), "n_subjects")


@query(
    "overlap_counts",
    f"""WITH {V.GRID}, s AS (SELECT i, j, value > 25 AS sig FROM grid), c AS (SELECT i, j, count(*) FILTER (WHERE sig) AS n_significant, count(sig) AS coverage FROM s GROUP BY 1, 2)
SELECT n_significant, count(*) AS n_cells, {rnd('avg(n_significant / CAST(coverage AS DOUBLE))', 'mean_fraction')}, bool_and(n_significant <= coverage) AS valid FROM c GROUP BY 1""",
)
def overlap_counts(spark, sf):
    maps = V.grid(spark, sf).withColumn("sig", F.col("value") > 25)  # slices along k play the subjects
    cells = summaries.overlap_counts(maps, ["i", "j"], "sig")
    return cells.groupBy("n_significant").agg(
        F.count(F.lit(1)).alias("n_cells"), r6(F.avg("fraction")).alias("mean_fraction"),
        F.bool_and(F.col("n_significant") <= F.col("coverage")).alias("valid"),
    )


@query(
    "fixed_denominator_mean",
    f"WITH {V.GRID} SELECT i, j, {rnd('sum(coalesce(CASE WHEN value > 25 THEN value END, 0)) / 5', 'mean')} FROM grid GROUP BY 1, 2",
)
def fixed_denominator_mean(spark, sf):
    g = V.grid(spark, sf).withColumn("v", F.when(F.col("value") > 25, F.col("value")))
    return g.groupBy("i", "j").agg(r6(F.sum(F.coalesce("v", F.lit(0.0))) / F.lit(5)).alias("mean"))


@query(
    "tsnr",
    f"""WITH {DVARS}, p AS (SELECT voxel, run, avg(val) / nullif(stddev_samp(val), 0) AS t FROM vox GROUP BY 1, 2)
SELECT run, {rnd('avg(t)', 'tsnr')}, count(*) AS n_voxels FROM p WHERE voxel IN (SELECT voxel FROM p GROUP BY voxel HAVING bool_and(t IS NOT NULL)) GROUP BY run""",
)
def tsnr(spark, sf):
    return summaries.tsnr(voxels(spark, sf), "voxel", "run", "val").withColumn("tsnr", r6("tsnr"))


@query(
    "roi_inventory",
    f"""WITH {V.GRID}, r AS (SELECT g.label, g.kind, count(*) AS size, count(m.i) AS overlap FROM grid g LEFT JOIN mask m ON g.i = m.i AND g.j = m.j AND g.k = m.k GROUP BY 1, 2)
SELECT label, count(*) AS n_subjects, {rnd('avg(overlap)', 'mean_overlap')}, min(overlap) AS min_overlap, max(overlap) AS max_overlap, {rnd('avg(overlap / CAST(size AS DOUBLE))', 'mean_fraction')}, {rnd('8.0 * sum(overlap)', 'volume_mm3')} FROM r GROUP BY label""",
)
def roi_inventory(spark, sf):
    m = V.mask(spark, sf).select(*AT, F.lit(1).alias("hit"))
    r = V.grid(spark, sf).join(m, AT, "left").groupBy("label", "kind").agg(F.count(F.lit(1)).alias("size"), F.count("hit").alias("overlap"))
    return r.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_subjects"), r6(F.avg("overlap")).alias("mean_overlap"), F.min("overlap").alias("min_overlap"),
        F.max("overlap").alias("max_overlap"), r6(F.avg(F.col("overlap") / F.col("size"))).alias("mean_fraction"),
        r6(F.sum("overlap") * 8.0).alias("volume_mm3"),
    )


@query(
    "task_locking",
    f"""WITH {V.FRAMES}, e AS (SELECT *, CASE WHEN signal = 50 THEN 1.0 ELSE 0.0 END AS e1, CASE WHEN signal < 5 THEN 1.0 ELSE 0.0 END AS e2 FROM frames),
l AS (SELECT run, c, ev, corr(CASE c WHEN 'p2' THEN p2 WHEN 'p3' THEN p3 ELSE p4 END, CASE ev WHEN 'e1' THEN e1 ELSE e2 END) AS r FROM e, (VALUES ('p2'), ('p3'), ('p4')) a(c), (VALUES ('e1'), ('e2')) b(ev) GROUP BY 1, 2, 3)
SELECT c, ev, {rnd('avg(r)', 'mean_r')}, {rnd('max(abs(r))', 'max_abs_r')} FROM l GROUP BY 1, 2""",
)
def task_locking(spark, sf):
    e = V.frames(spark, sf).withColumns({"e1": (F.col("signal") == 50).cast("double"), "e2": (F.col("signal") < 5).cast("double")})
    r = quality.task_locking(e, ["run"], ["p2", "p3", "p4"], ["e1", "e2"])
    return r.groupBy("c", "ev").agg(r6(F.avg("r")).alias("mean_r"), r6(F.max(F.abs("r"))).alias("max_abs_r"))


@query(
    "confound_subject_summary",
    f"""WITH {QC}, r AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE fd > 0.5 OR z > 5) AS bad, corr(fd, frame) AS drift FROM qc GROUP BY run)
SELECT CAST(run % 5 AS INT) AS subject, CAST(sum(n) AS BIGINT) AS n_frames, CAST(sum(bad) AS BIGINT) AS n_bad, {rnd('100.0 * sum(bad) / sum(n)', 'percent_bad')}, min(24 + 3 + bad) AS min_columns, max(24 + 3 + bad) AS max_columns, count(*) FILTER (WHERE abs(drift) > 0.1) AS n_drift FROM r GROUP BY 1""",
)
def confound_subject_summary(spark, sf):
    r = motion_qc(spark, sf).groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("fd") > 0.5) | (F.col("z") > 5)).alias("bad"), pearson("fd", "frame").alias("drift")
    )
    width = F.col("bad") + 27
    return r.groupBy((F.col("run") % 5).cast("int").alias("subject")).agg(
        F.sum("n").alias("n_frames"), F.sum("bad").alias("n_bad"), r6(F.sum("bad") / F.sum("n") * 100).alias("percent_bad"),
        F.min(width).alias("min_columns"), F.max(width).alias("max_columns"), F.count_if(F.abs("drift") > 0.1).alias("n_drift"),
    )


@query(
    "mean_correlation_matrix",
    f"WITH {V.FRAMES}, r AS (" + " UNION ALL ".join(
        f"SELECT run, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM frames GROUP BY run" for n, a in enumerate(V.MOTION) for b in V.MOTION[n:]
    ) + f") SELECT a, b, {rnd('avg(r)', 'mean_r')} FROM r GROUP BY 1, 2",
)
def mean_correlation_matrix(spark, sf):
    r = summaries.correlations(V.frames(spark, sf), ["run"], V.MOTION)
    return r.groupBy("a", "b").agg(r6(F.avg("r")).alias("mean_r"))


@query(
    "project_reduce_axis",
    f"""WITH {V.GRID} SELECT i, j, bool_or(value > 45) AS any_high, {rnd('avg(value)', 'mean')}, {rnd('arg_max(value - 25, struct_pack(a := abs(value - 25), s := value))', 'signed_max')} FROM grid GROUP BY 1, 2""",
)
def project_reduce_axis(spark, sf):
    v = F.col("value") - 25
    return V.grid(spark, sf).groupBy("i", "j").agg(
        F.bool_or(F.col("value") > 45).alias("any_high"), r6(F.avg("value")).alias("mean"),
        r6(F.max_by(v, F.struct(F.abs(v).alias("a"), F.col("value").alias("s")))).alias("signed_max"),
    )


CENTROID = f"WITH {V.GRID} SELECT label, count(*) AS n, {rnd('avg(2.0 * i - 9)', 'x')}, {rnd('avg(2.0 * j - 10)', 'y')}, {rnd('avg(2.0 * k + 4)', 'z')} FROM mask GROUP BY label"
AFFINE = [[2.0, 0, 0, -9.0], [0, 2.0, 0, -10.0], [0, 0, 2.0, 4.0]]


def centroids(spark, sf):
    x, y, z = spatial.world(AFFINE)
    return V.mask(spark, sf).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(x)).alias("x"), r6(F.avg(y)).alias("y"), r6(F.avg(z)).alias("z")
    )


@query("roi_centroid", CENTROID)
def roi_centroid(spark, sf):
    return centroids(spark, sf)


@query("sort_roi_by_centroid", f"SELECT label, y, row_number() OVER (ORDER BY y DESC, label) AS place FROM ({CENTROID})")
def sort_roi_by_centroid(spark, sf):
    c = centroids(spark, sf).withColumn("_back", -F.col("y"))
    return ordered.number_rows(c, [], F.floor("_back"), ["_back", "label"], "place").select("label", "y", F.col("place").cast("bigint").alias("place")).orderBy("place")


@query(
    "run_context_crosstab",
    f"WITH {V.UNITS} SELECT run, " + ", ".join(f"count(*) FILTER (WHERE context = {c}) AS c{c}" for c in range(4)) + ", count(DISTINCT context) = 1 AS run_blocked FROM units GROUP BY run",
)
def run_context_crosstab(spark, sf):
    u = V.units(spark, sf)
    wide = u.groupBy("run").pivot("context", [0, 1, 2, 3]).agg(F.count(F.lit(1))).na.fill(0)
    named = wide.select("run", *[F.col(str(c)).alias(f"c{c}") for c in range(4)])
    used = sum((F.col(f"c{c}") > 0).cast("int") for c in range(4))
    return named.withColumn("run_blocked", used == 1)


@query("gmm_peak_threshold")
def gmm_peak_threshold(spark, sf):
    peaks = V.features(spark, sf).groupBy("dim", "item").agg(F.max("v").alias("peak"))
    per_dim = peaks.groupBy("dim").agg(F.avg("peak").alias("peak"))
    out = learners.mixture_threshold(per_dim, "peak")
    return out.select("dim", r6("peak").alias("peak"), "kept")


@query("pca_project")
def pca_project(spark, sf):
    means = V.units(spark, sf)
    out = learners.first_component(means, "x", ["unit", "item"])
    return out.groupBy("item").agg(r6(F.avg("score")).alias("mean_score"), F.count(F.lit(1)).alias("n"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return summaries.duplicate_keys(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
