"""Ordered-signal and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import inference, ordered, quality, summaries, timeseries
from ..session import packed
from ..sources import views as V
from .registry import query, rnd
from .trials import QC, motion_qc

W = "WINDOW w AS (PARTITION BY run ORDER BY frame)"


@query("frame_difference", f"WITH {V.FRAMES} SELECT run, frame, {rnd('coalesce(p2 - lag(p2) OVER w, 0)', 'd_p2')} FROM frames {W}")
def frame_difference(spark, sf):
    d = timeseries.differences(V.frames(spark, sf).select("run", "frame", "p2"), ["run"], "frame", ["p2"], V.frame_chunk())
    return d.select("run", "frame", r6("d_p2").alias("d_p2"))


@query(
    "framewise_displacement",
    f"WITH {V.FRAMES}, f AS (SELECT run, frame, coalesce(abs(p1 - lag(p1) OVER w) + abs(p2 - lag(p2) OVER w) + abs(p3 - lag(p3) OVER w) + 50 * (abs(p4 - lag(p4) OVER w) + abs(p5 - lag(p5) OVER w) + abs(p6 - lag(p6) OVER w)), 0) AS fd FROM frames {W}) SELECT run, frame, {rnd('fd', 'fd')} FROM f",
)
def framewise_displacement(spark, sf):
    f = timeseries.framewise_displacement(V.frames(spark, sf), ["run"], "frame", V.MOTION, V.frame_chunk())
    return f.select("run", "frame", r6("fd").alias("fd"))


def _motion24_sql():
    d = [f"coalesce({c} - lag({c}) OVER w, 0)" for c in V.MOTION]
    cols = [rnd(c, c) for c in V.MOTION] + [rnd(e, f"d_{c}") for c, e in zip(V.MOTION, d)]
    cols += [rnd(f"{c} * {c}", f"sq_{c}") for c in V.MOTION] + [rnd(f"pow({e}, 2)", f"sq_d_{c}") for c, e in zip(V.MOTION, d)]
    return f"WITH {V.FRAMES} SELECT run, frame, {', '.join(cols)} FROM frames {W}"


@query("motion24", _motion24_sql())
def motion24(spark, sf):
    m = timeseries.motion24(V.frames(spark, sf), ["run"], "frame", V.MOTION, V.frame_chunk())
    return m.select("run", "frame", *[r6(c).alias(c) for c in m.columns if c not in ("run", "frame")])


EDGES = f"""{V.SIGNAL}, lv AS (SELECT *, value > 100 AND NOT coalesce(lag(value > 100) OVER (PARTITION BY key ORDER BY t, event_id), false) AS up FROM signal),
edges AS (SELECT key, t, event_id, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS edge FROM lv WHERE up)"""


def edges(spark, sf):
    s = V.signal(spark, sf).select("key", "t", "event_id", "value")
    return timeseries.rising_edges(s, ["key"], ["t", "event_id"], "value", 100.0, V.time_chunk())


@query("rising_edges", f"WITH {EDGES} SELECT key, t, event_id, edge FROM edges")
def rising_edges(spark, sf):
    return edges(spark, sf).select("key", "t", "event_id", "edge")


@query("alternate_edges", f"WITH {EDGES} SELECT key, t, edge, CASE WHEN (edge - 2) % 2 = 1 THEN 'event' ELSE 'cue' END AS role FROM edges WHERE edge >= 2")
def alternate_edges(spark, sf):
    return timeseries.alternate_edges(edges(spark, sf), first=3).select("key", "t", "edge", "role")


@query("first_above", f"WITH {V.SIGNAL} SELECT key, min(t) AS onset FROM signal WHERE value > 100 GROUP BY key")
def first_above(spark, sf):
    return timeseries.first_above(V.signal(spark, sf), ["key"], "t", "value", 100.0)


@query(
    "pad_missing_edges",
    f"""WITH {EDGES}, z AS (SELECT key, t - (SELECT min(t) FROM signal) AS t, event_id FROM edges), g AS (SELECT key, t - lag(t) OVER (PARTITION BY key ORDER BY t, event_id) AS gap FROM z), m AS (SELECT key, median(CAST(gap AS DOUBLE)) AS gap FROM g GROUP BY key),
f AS (SELECT key, count(*) AS found, min(t) AS first FROM z GROUP BY key)
SELECT key, t, false AS added FROM z UNION ALL
SELECT key, CAST(first - round(gap * n) AS BIGINT), true FROM f JOIN m USING (key), range(1, 13) s(n) WHERE found < 12 AND gap > 0 AND n <= least(12 - found, floor(first / gap))""",
)
def pad_missing_edges(spark, sf):
    start = V.signal(spark, sf).agg(F.min("t").alias("_start"))
    e = edges(spark, sf).join(start, F.lit(True)).select("key", (F.col("t") - F.col("_start")).alias("t"), "event_id")
    return timeseries.pad_missing_edges(e, ["key"], "t", 12, V.time_chunk(), ["event_id"])


@query(
    "flag_negative_onset",
    f"""WITH {V.SIGNAL}, f AS (SELECT key, min(t) AS onset FROM signal WHERE value > 100 GROUP BY key)
SELECT event_id, CASE WHEN t - onset < 0 THEN false ELSE value > 1 END AS good FROM signal JOIN f USING (key) WHERE event_type = 'purchase'""",
)
def flag_negative_onset(spark, sf):
    s = V.signal(spark, sf)
    onset = timeseries.first_above(s, ["key"], "t", "value", 100.0)
    trials = s.where("event_type = 'purchase'").join(onset, "key")
    trials = trials.withColumns({"good": F.col("value") > 1, "rel": F.col("t") - F.col("onset")})
    return timeseries.flag_negative_onset(trials, "rel", "good").select("event_id", "good")


@query(
    "cumulative_offsets",
    f"""WITH {V.FRAMES}, r AS (SELECT CAST(run % 5 AS INT) AS subject, run, count(*) AS n FROM frames GROUP BY 1, 2)
SELECT subject, run, n, {rnd('0.76 * coalesce(sum(n) OVER (PARTITION BY subject ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)', 'offset_s')} FROM r""",
)
def cumulative_offsets(spark, sf):
    li = V.table(spark, sf, "lineitem")
    runs = li.groupBy(F.col("l_suppkey").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("subject", (F.col("run") % 5).cast("int"))
    out = timeseries.cumulative_offsets(runs, ["subject"], "run", "n", 0.76, F.expr("run div 4096"))
    return out.select("subject", "run", "n", r6("offset").alias("offset_s"))


@query(
    "trapezoid_integral",
    f"""WITH {V.SIGNAL}, p AS (SELECT key, t, event_id, coalesce((value + lag(value) OVER (PARTITION BY key ORDER BY t, event_id)) / 2, 0) AS a FROM signal)
SELECT event_id, {rnd('sum(a) OVER (PARTITION BY key ORDER BY t, event_id) / 1000.0', 'integral')} FROM p""",
)
def trapezoid_integral(spark, sf):
    s = V.signal(spark, sf).select("key", "t", "event_id", "value")
    out = timeseries.trapezoid_integral(s, ["key"], ["t", "event_id"], "value", 1000.0, V.time_chunk())
    return out.select("event_id", r6("integral").alias("integral"))


@query(
    "linear_detrend",
    f"""WITH {V.FRAMES}, l AS (SELECT run, regr_slope(p2, frame) AS b, regr_intercept(p2, frame) AS a FROM frames GROUP BY run)
SELECT run, frame, {rnd('p2 - (a + b * frame)', 'residual')} FROM frames JOIN l USING (run)""",
)
def linear_detrend(spark, sf):
    out = timeseries.linear_detrend(V.frames(spark, sf).select("run", "frame", "p2"), ["run"], "frame", "p2", "residual")
    return out.select("run", "frame", r6("residual").alias("residual"))


@query(
    "block_zscore",
    f"""WITH {V.RATINGS}, r AS (SELECT subject, trial, item, context, m1, m2 FROM ratings), s AS (SELECT subject, avg(m1) AS m, stddev_samp(m1) AS s, avg(m2) FILTER (WHERE trial % 4 > 0) AS tm, stddev_samp(m2) FILTER (WHERE trial % 4 > 0) AS ts FROM r GROUP BY subject)
SELECT subject, trial, item, context, {rnd('m1', 'm1')}, {rnd('m2', 'm2')}, {rnd('(m1 - m) / s', 'z1')}, {rnd('(m2 - tm) / ts', 'z2')} FROM r JOIN s USING (subject)""",
)
def block_zscore(spark, sf):
    z = summaries.zscore_within(V.ratings(spark, sf), ["subject"], "m1", "z1")
    z = summaries.zscore_from_train(z, ["subject"], F.col("trial") % 4 > 0, "m2", "z2")
    return z.select("subject", "trial", "item", "context", *[r6(c).alias(c) for c in ("m1", "m2", "z1", "z2")])


@query(
    "tied_rank",
    f"""WITH {V.RATINGS} SELECT subject, trial, item, context, {rnd('m2', 'm2')}, {rnd('rank() OVER (PARTITION BY subject ORDER BY m2) + (count(*) OVER (PARTITION BY subject, m2) - 1) / 2.0', 'rank_m2')} FROM ratings""",
)
def tied_rank(spark, sf):
    out = ordered.tied_ranks(V.ratings(spark, sf), ["subject"], "m2", "rank_m2")
    return out.select("subject", "trial", "item", "context", r6("m2").alias("m2"), r6("rank_m2").alias("rank_m2"))


@query(
    "joint_outliers",
    """WITH p AS (SELECT c_custkey, c_acctbal, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
r AS (SELECT c_custkey, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 + rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS s FROM p)
SELECT c_custkey, CAST(s AS DOUBLE) AS rank_sum FROM r ORDER BY s DESC, c_custkey LIMIT 12""",
)
def joint_outliers(spark, sf):
    orders = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    p = V.table(spark, sf, "customer").join(orders, "c_custkey").select("c_custkey", "c_acctbal", "n")
    return timeseries.joint_outliers(p, [], "c_acctbal", "n", ["c_custkey"]).select("c_custkey", "rank_sum")


GAPS = f"""{EDGES}, g AS (SELECT key, t - lag(t) OVER (PARTITION BY key ORDER BY t, event_id) AS gap FROM edges)"""


@query(
    "regular_intervals",
    f"WITH {GAPS} SELECT key, count(*) AS n_edges, min(gap) AS min_gap, max(gap) AS max_gap, coalesce(bool_and(abs(gap - 86400000000) <= 43200000000), false) AS regular FROM g GROUP BY key",
)
def regular_intervals(spark, sf):
    e = edges(spark, sf)
    return timeseries.regular_intervals(e, ["key"], "t", 86_400_000_000, 43_200_000_000, V.time_chunk(), ["event_id"])


# Every third recording keeps a full set of evenly timed edges, the others lose one or all but a few.
TRIGGERS = """runs AS (SELECT o_custkey AS run, count(*) + 3 AS n_frames, CAST(100 + o_custkey % 50 AS BIGINT) AS onset FROM orders GROUP BY o_custkey),
trig AS (SELECT run, onset + (s - 1) * 760 + (run * s) % 3 AS t FROM runs, range(1, 100) q(s) WHERE s <= n_frames + 1 - run % 3)"""


def triggers(spark, sf):
    runs = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg((F.count(F.lit(1)) + 3).alias("n_frames"))
    runs = runs.withColumn("onset", (F.lit(100) + F.col("run") % 50).cast("bigint"))
    step = F.explode(F.sequence(F.lit(1), (F.col("n_frames") + 1 - F.col("run") % 3).cast("int")))
    trig = runs.select("run", "onset", step.alias("s"))
    return runs, trig.select("run", (F.col("onset") + (F.col("s") - 1) * 760 + (F.col("run") * F.col("s")) % 3).alias("t"))


FRAME_EDGES = f"""{TRIGGERS}, gg AS (SELECT run, t, t - lag(t) OVER (PARTITION BY run ORDER BY t) AS gap FROM trig),
chk AS (SELECT run, count(*) AS n, coalesce(bool_and(abs(gap - 760) <= 1), false) AS ok FROM gg GROUP BY run),
plan AS (SELECT run, n_frames, onset, CASE WHEN ok AND n = n_frames + 1 THEN 'all_edges' WHEN ok AND n = n_frames THEN 'last_extrapolated' ELSE 'nominal' END AS method FROM runs JOIN chk USING (run)),
num AS (SELECT run, t, lead(t) OVER (PARTITION BY run ORDER BY t) AS nxt, row_number() OVER (PARTITION BY run ORDER BY t) AS frame FROM trig),
fe AS (SELECT run, frame, t AS first, coalesce(nxt, t + 760) AS next, method FROM num JOIN plan USING (run) WHERE method <> 'nominal' AND frame <= n_frames
UNION ALL SELECT run, s, CAST(onset + (s - 1) * 760 AS BIGINT), CAST(onset + s * 760 AS BIGINT), method FROM plan, range(1, 100) q(s) WHERE method = 'nominal' AND s <= n_frames)"""


@query("frame_edges", f"WITH {FRAME_EDGES} SELECT run, frame, first, next, method FROM fe")
def frame_edges(spark, sf):
    runs, trig = triggers(spark, sf)
    return timeseries.frame_edges(trig, runs, ["run"], "t", 760, 1, F.expr("t div 1000000"))


@query(
    "fill_last_frame",
    f"""WITH {V.FRAMES}, l AS (SELECT run, max(frame) AS last FROM frames GROUP BY run),
h AS (SELECT run, frame, last, CASE WHEN (run % 2 = 0 AND frame = last) OR (run % 10 = 1 AND frame = 7) THEN NULL ELSE p2 END AS v FROM frames JOIN l USING (run))
SELECT run, frame, {rnd('CASE WHEN v IS NULL AND frame = last THEN lag(v) OVER w ELSE v END', 'value')}, CASE WHEN v IS NOT NULL THEN 'measured' WHEN frame = last AND lag(v) OVER w IS NOT NULL THEN 'filled' ELSE 'fatal' END AS status FROM h {W}""",
)
def fill_last_frame(spark, sf):
    f = V.frames(spark, sf).select("run", "frame", "p2")
    f = f.join(f.groupBy("run").agg(F.max("frame").alias("last")), "run")
    hole = ((F.col("run") % 2 == 0) & (F.col("frame") == F.col("last"))) | ((F.col("run") % 10 == 1) & (F.col("frame") == 7))
    f = f.withColumn("value", F.when(~hole, F.col("p2"))).drop("p2")
    out = timeseries.fill_last_frame(f, ["run"], "frame", "last", "value", V.frame_chunk())
    return out.select("run", "frame", r6("value").alias("value"), "status")


TAPS = timeseries.fir_weights(5, 0.1, 1.0)


@query(
    "lowpass_fir",
    f"WITH {V.FRAMES}, taps AS (SELECT * FROM (VALUES " + ", ".join(f"({n - 2}, CAST({w!r} AS DOUBLE))" for n, w in enumerate(TAPS))
    + f") t(o, w)) SELECT f.run, f.frame, {rnd('sum(g.p2 * w) / sum(w)', 'smooth')} FROM frames f CROSS JOIN taps JOIN frames g ON g.run = f.run AND g.frame = f.frame - o GROUP BY 1, 2",
)
def lowpass_fir(spark, sf):
    out = timeseries.lowpass_fir(V.frames(spark, sf).select("run", "frame", "p2"), ["run"], "frame", "p2", TAPS, "smooth")
    return out.select("run", "frame", r6("smooth").alias("smooth"))


@query("spike_columns", f"WITH {V.FRAMES} SELECT run, frame, row_number() OVER (PARTITION BY run ORDER BY frame) AS spike FROM frames WHERE signal > 48")
def spike_columns(spark, sf):
    return timeseries.spike_columns(V.frames(spark, sf), ["run"], "frame", F.col("signal") > 48, V.frame_chunk())


BH = "least(1, min(p * m / rn) OVER ({part} ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


def bh_sql(part: str) -> str:
    by = f"PARTITION BY {part}" if part else ""
    return (
        f"r AS (SELECT *, rank() OVER ({by} ORDER BY p) + count(*) OVER ({by + (',' if by else 'PARTITION BY') } p) - 1 AS rn, count(p) OVER ({by}) AS m FROM src WHERE p IS NOT NULL),\n"
        f"adj AS (SELECT *, {BH.format(part=by)} AS q FROM r)"
    )


@query(
    "bh_fdr",
    f"WITH {V.PVALUES}, src AS (SELECT test, family, CASE WHEN test % 50 > 0 THEN p END AS p FROM pv), {bh_sql('')} SELECT test, {rnd('q', 'q')} FROM src LEFT JOIN adj USING (test)",
)
def bh_fdr(spark, sf):
    p = V.pvalues(spark, sf).withColumn("p", F.when(F.col("test") % 50 > 0, F.col("p")))
    return inference.bh_fdr(p, [], "p").select("test", r6("q").alias("q"))


@query("bh_fdr_by_family", f"WITH {V.PVALUES}, src AS (SELECT * FROM pv), {bh_sql('family')} SELECT test, family, {rnd('q', 'q')} FROM adj")
def bh_fdr_by_family(spark, sf):
    return inference.bh_fdr(V.pvalues(spark, sf), ["family"], "p").select("test", "family", r6("q").alias("q"))


@query(
    "bh_fdr_with_placeholders",
    f"WITH {V.PVALUES}, src AS (SELECT test, family, CASE WHEN test % 10 = 0 THEN 1.0 ELSE p END AS p, test % 10 = 0 AS failed FROM pv), {bh_sql('family')} SELECT test, family, {rnd('q', 'q')} FROM adj WHERE NOT failed",
)
def bh_fdr_with_placeholders(spark, sf):
    p = V.pvalues(spark, sf).withColumn("failed", F.col("test") % 10 == 0)
    return inference.bh_fdr_with_placeholders(p, ["family"], "p", "failed").select("test", "family", r6("q").alias("q"))


@query(
    "fwe_threshold",
    f"""WITH {V.RATINGS}, n AS (SELECT subject, trial % 500 AS perm, max(v) AS m FROM (SELECT subject, trial, item, m2 + item AS v FROM ratings) GROUP BY 1, 2),
x AS (SELECT subject, perm, m + perm / 1000.0 AS m FROM n), o AS (SELECT subject, m, row_number() OVER (PARTITION BY subject ORDER BY m) AS rn, count(*) OVER (PARTITION BY subject) AS n FROM x)
SELECT subject, {rnd('max(m)', 'threshold')} FROM o WHERE rn = ceil(0.95 * (n + 1)) GROUP BY subject""",
)
def fwe_threshold(spark, sf):
    r = V.ratings(spark, sf).withColumn("v", F.col("m2") + F.col("item"))
    maxima = r.groupBy("subject", (F.col("trial") % 500).alias("perm")).agg(F.max("v").alias("m"))
    maxima = maxima.withColumn("m", F.col("m") + F.col("perm") / 1000.0)
    return inference.fwe_threshold(maxima, ["subject"], "m").withColumn("threshold", r6("threshold"))


@query(
    "infer_contiguous_blocks",
    f"""WITH {V.UNITS} SELECT unit, CASE WHEN n % 10 = 0 THEN CAST(ceil(rn / (n / 10.0)) AS BIGINT) END AS block FROM (SELECT unit, row_number() OVER (ORDER BY unit) AS rn, count(*) OVER () AS n FROM units)""",
)
def infer_contiguous_blocks(spark, sf):
    u = V.units(spark, sf).select("unit")
    return timeseries.contiguous_blocks(u, [], "unit", 10, F.expr("unit div 65536"))


# Quality checks.


@query(
    "coverage_preflight",
    f"""WITH {FRAME_EDGES}, e AS (SELECT run, max(next) AS last_edge, max(first) AS before_last, any_value(method) AS method FROM fe GROUP BY run),
r AS (SELECT run, n_frames, last_edge, before_last, method, last_edge - 1 - CASE WHEN run % 5 = 0 THEN 300 WHEN run % 7 = 0 THEN 2000 ELSE -100 END AS samples FROM runs JOIN e USING (run))
SELECT run, samples - (last_edge - 1) AS coverage_margin, samples - (last_edge - 1) < 0 AND before_last <= samples + 1 AS final_replacement,
CASE WHEN method <> 'nominal' THEN 'individual edges' ELSE 'onset and nominal period' END AS alignment,
CASE WHEN run % 11 = 3 THEN 'identity mismatch' WHEN run % 13 = 4 THEN 'length mismatch' WHEN samples - (last_edge - 1) < 0 AND NOT before_last <= samples + 1 THEN 'incomplete coverage' ELSE 'ok' END AS status FROM r""",
)
def coverage_preflight(spark, sf):
    runs, trig = triggers(spark, sf)
    fe = timeseries.frame_edges(trig, runs, ["run"], "t", 760, 1, F.expr("t div 1000000"))
    e = fe.groupBy("run").agg(F.max("next").alias("last_edge"), F.max("first").alias("before_last"), F.max("method").alias("method"))
    short = F.when(F.col("run") % 5 == 0, 300).when(F.col("run") % 7 == 0, 2000).otherwise(-100)
    r = runs.join(e, "run").withColumns({
        "samples": F.col("last_edge") - 1 - short, "edges_ok": F.col("method") != "nominal",
        "lengths_ok": F.col("run") % 13 != 4, "identity_ok": F.col("run") % 11 != 3,
    })
    out = quality.coverage_preflight(r, "edges_ok", "last_edge", "before_last", "samples", "lengths_ok", "identity_ok")
    return out.select("run", "coverage_margin", "final_replacement", "alignment", "status")


@query(
    "nuisance_table",
    f"""WITH {QC}, m AS (SELECT run, frame, {', '.join(f'coalesce({c} - lag({c}) OVER w, 0) AS d_{c}' for c in V.MOTION)} FROM frames {W}),
b AS (SELECT run, frame, row_number() OVER (PARTITION BY run ORDER BY frame) AS spike FROM qc WHERE fd > 0.5 OR z > 5)
SELECT run, frame, {', '.join(rnd(c, c) for c in V.MOTION)}, {', '.join(rnd(f'd_{c}', f'd_{c}') for c in V.MOTION)}, {', '.join(rnd(f'{c} * {c}', f'sq_{c}') for c in V.MOTION)}, {', '.join(rnd(f'd_{c} * d_{c}', f'sq_d_{c}') for c in V.MOTION)}, spike
FROM frames JOIN m USING (run, frame) LEFT JOIN b USING (run, frame)""",
)
def nuisance_table(spark, sf):
    # Frames are numbered and their changes taken in one pass, and written in compressed columns; of the 24 columns the
    # squares are made last, so that no table of that width is written or sent.
    f = packed(V.frames(spark, sf, changes=True).drop("signal"))
    bad = (F.col("fd") > 0.5) | (F.col("z") > 5)
    spikes = timeseries.spike_columns(motion_qc(spark, sf, f), ["run"], "frame", bad, V.frame_chunk())
    out = timeseries.motion24(ordered.join_few(f, spikes, ["run", "frame"], "left"), ["run"], "frame", V.MOTION, V.frame_chunk(), ("spike",))
    return out.select("run", "frame", *[r6(c).alias(c) for c in out.columns if c not in ("run", "frame", "spike")], "spike")


@query("design_diagnostics")
def design_diagnostics(spark, sf):
    f = V.frames(spark, sf).withColumn("one", F.lit(1.0))
    out = quality.design_diagnostics(f, ["run"], ["one", *V.MOTION])
    return out.select("run", "n", "rank", r6("condition").alias("condition"))


@query(
    "degenerate_columns",
    f"WITH {V.FRAMES}, f AS (SELECT run, p2, p3, p3 * 2 + 1 AS p3_copy, 4.0 AS flat FROM frames), s AS (SELECT run, "
    + ", ".join(f"stddev_samp({c}) AS s_{c}" for c in ("p2", "p3", "p3_copy", "flat")) + ", corr(p2, p3) AS r1, corr(p2, p3_copy) AS r2, corr(p3, p3_copy) AS r3 FROM f GROUP BY run) "
    + " UNION ALL ".join(f"SELECT run, '{c}' AS a, NULL AS b, 'constant' AS problem FROM s WHERE s_{c} <= 1e-12" for c in ("p2", "p3", "p3_copy", "flat"))
    + "".join(f" UNION ALL SELECT run, '{a}', '{b}', 'collinear' FROM s WHERE abs({r}) > 1 - 1e-10" for a, b, r in (("p2", "p3", "r1"), ("p2", "p3_copy", "r2"), ("p3", "p3_copy", "r3"))),
)
def degenerate_columns(spark, sf):
    f = V.frames(spark, sf).withColumns({"p3_copy": F.col("p3") * 2 + 1, "flat": F.lit(4.0)})
    return quality.degenerate_columns(f, ["run"], ["p2", "p3", "p3_copy", "flat"])


@query(
    "drift_flags",
    f"""WITH {V.FRAMES} SELECT run, {rnd('corr(p2, frame)', 'r_time')}, abs(corr(p2, frame)) > 0.05 AS drift,
{rnd('(max(p2) - min(p2)) / (quantile_cont(p2, 0.75) - quantile_cont(p2, 0.25))', 'range_over_iqr')} FROM frames GROUP BY run""",
)
def drift_flags(spark, sf):
    out = quality.drift_flags(V.frames(spark, sf), ["run"], "frame", "p2", 0.05)
    return out.select("run", r6("r_time").alias("r_time"), "drift", r6("range_over_iqr").alias("range_over_iqr"))


@query(
    "golden_reconcile",
    """WITH a AS (SELECT l_orderkey AS key, sum(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey AS key, sum(l_quantity) + CASE WHEN l_orderkey % 1000 = 7 THEN 0.5 ELSE 0 END AS q, avg(l_discount) AS d FROM lineitem WHERE l_orderkey % 500 > 0 GROUP BY l_orderkey)
SELECT count(*) FILTER (WHERE a.key IS NULL OR b.key IS NULL) AS n_one_sided, round(max(greatest(abs(a.q - b.q), abs(a.d - b.d))), 6) + 0.0 AS max_difference,
count(*) FILTER (WHERE a.key IS NULL OR b.key IS NULL) = 0 AND max(greatest(abs(a.q - b.q), abs(a.d - b.d))) <= 1e-10 AS within FROM a FULL JOIN b ON a.key = b.key""",
)
def golden_reconcile(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "key")
    agg = [F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d")]
    a = li.groupBy("key").agg(*agg)
    b = li.where("key % 500 > 0").groupBy("key").agg(*agg).withColumn("q", F.col("q") + F.when(F.col("key") % 1000 == 7, 0.5).otherwise(0.0))
    out = quality.golden_reconcile(a, b, ["key"], ["q", "d"], 1e-10)
    return out.withColumn("max_difference", r6("max_difference"))
