"""Pattern classification, transfer, cross-half and neighbourhood queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.stats import r6
from ..operators import blocked, inference, learners, patterns, responses, sampling, selection, spatial, splithalf, summaries, transfer
from ..session import durable, packed
from ..sources import views as V
from . import sqlparts as S
from .registry import query, rnd

PERMS = 100  # of the cross-half nulls, as in their SQL twins
DECODE_PERMS = 1_000  # of the original work
SCAN_PERMS = 100  # the SQL twin's; a parameter of the queries


REGIONS = patterns.slices(V.WIDTH // V.REGION_WIDTH, V.REGION_WIDTH)


def semantic(spark, sf):
    return selection.drop_control(V.units(spark, sf), "context", V.CONTROL)


def centred_regions(spark, sf):
    """Run-centred units cut into regions, for the learners that need rows rather than sums."""
    u = V.units(spark, sf)
    _, means = patterns.cube(u, [], "run", [], "x", V.WIDTH)
    return REGIONS.cut(patterns.centre_blocks(u, means, ["run"], "x"), "x")


def decoded(spark, sf, label="item", **options):
    return patterns.decode(V.units(spark, sf), "unit", "run", label, "x", REGIONS, V.WIDTH, **options)


DEC = f"WITH {S.CENTRED}, {S.decode('cent', ['region'], 'item')}"


@query(
    "template_decode",
    f"{DEC}, pc AS (SELECT region, item, avg(CASE WHEN predicted = item THEN 1.0 ELSE 0.0 END) AS rec FROM dec GROUP BY 1, 2) "
    f"SELECT region, count(*) AS n_units, {rnd('avg(CASE WHEN predicted = item THEN 1.0 ELSE 0.0 END)', 'accuracy')}, any_value(b) AS balanced_accuracy FROM dec JOIN (SELECT region, {rnd('avg(rec)', 'b')} FROM pc GROUP BY region) USING (region) GROUP BY region",
)
def template_decode(spark, sf):
    acc = summaries.accuracy(decoded(spark, sf), ["region"], "item", "predicted")
    return acc.withColumns({c: r6(c) for c in ("accuracy", "balanced_accuracy")})


# Features divided by their spread over the training runs, the usual setting of the decoders.
DEC_SCALED = f"""WITH {S.CENTRED}, {S.templates('cent', ['region'], 'item')}, rq AS (SELECT run, dim, sum(v * v) AS q, count(*) AS n FROM cent GROUP BY ALL), tq AS (SELECT dim, sum(q) AS q, sum(n) AS n FROM rq GROUP BY dim),
sdv AS (SELECT rq.run, dim, sqrt((tq.q - rq.q) / (tq.n - rq.n - 1)) AS sd FROM rq JOIN tq USING (dim)),
sims AS (SELECT c.region, c.unit, c.run, c.item, t.cand, corr(c.v / sd, t.v / sd) AS s FROM cent c JOIN tmpl t ON c.region = t.region AND c.run = t.run AND c.dim = t.dim JOIN sdv ON sdv.run = c.run AND sdv.dim = c.dim GROUP BY ALL),
{S.decide('sims', ['region', 'unit', 'run'], 'item', 'dec')}"""


@query("template_decode_scaled", f"{DEC_SCALED} SELECT region, unit, item, predicted, {rnd('evidence', 'evidence')} FROM dec")
def template_decode_scaled(spark, sf):
    return decoded(spark, sf, scale=True).select("region", "unit", "item", "predicted", r6("evidence").alias("evidence"))


@query("argmax_class", f"{DEC} SELECT region, unit, item, predicted FROM dec")
def argmax_class(spark, sf):
    return decoded(spark, sf).select("region", "unit", "item", "predicted")


@query("evidence_score", f"{DEC} SELECT region, unit, {rnd('evidence', 'evidence')} FROM dec")
def evidence_score(spark, sf):
    return decoded(spark, sf).select("region", "unit", r6("evidence").alias("evidence"))


@query("score_decode", f"{DEC} SELECT region, run, count(*) AS n, {rnd('avg(evidence)', 'mean_evidence')} FROM dec GROUP BY GROUPING SETS ((region, run), (region))")
def score_decode(spark, sf):
    return decoded(spark, sf).groupingSets([["region", "run"], ["region"]], "region", "run").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("evidence")).alias("mean_evidence")
    )


@query(
    "accuracy_metrics",
    f"{DEC} SELECT region, run, count(*) AS n, {rnd('avg(CASE WHEN predicted = item THEN 1.0 ELSE 0.0 END)', 'fold_accuracy')} FROM dec GROUP BY 1, 2",
)
def accuracy_metrics(spark, sf):
    hit = (F.col("predicted") == F.col("item")).cast("double")
    return decoded(spark, sf).groupBy("region", "run").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(hit)).alias("fold_accuracy"))


@query(
    "confusion_matrix",
    f"""{DEC}, c AS (SELECT region, item, predicted, count(*) AS n FROM dec GROUP BY ALL), t AS (SELECT region, item, sum(n) AS tot FROM c GROUP BY ALL)
SELECT t.region, t.item, g AS predicted, coalesce(c.n, 0) AS n, {rnd('coalesce(c.n, 0) / CAST(tot AS DOUBLE)', 'fraction')} FROM t CROSS JOIN (SELECT item AS g FROM dec UNION SELECT predicted FROM dec) q LEFT JOIN c ON c.region = t.region AND c.item = t.item AND c.predicted = g""",
)
def confusion_matrix(spark, sf):
    c = summaries.confusion(decoded(spark, sf), ["region"], "item", "predicted")
    return c.withColumn("fraction", r6("fraction"))


@query(
    "join_templates",
    f"WITH {S.CENTRED}, {S.decode('cent', ['region'], 'item')} SELECT region, run, cand, count(*) AS n, {rnd('avg(s)', 'mean_r')}, {rnd('max(s)', 'max_r')} FROM sims GROUP BY ALL",
)
def join_templates(spark, sf):
    u = V.units(spark, sf)
    sums, means = patterns.cube(u, [], "run", ["item"], "x", V.WIDTH)
    t = REGIONS.cut(patterns.leave_out(sums, [], "run", "item", V.WIDTH), "template")
    tests = REGIONS.cut(patterns.centre_blocks(u, means, ["run"], "x"), "x")
    sims = patterns.similarities(tests, t, ["region", "run"], "x", "item")
    return sims.groupBy("region", "run", F.col("candidate").alias("cand")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("similarity")).alias("mean_r"), r6(F.max("similarity")).alias("max_r")
    )


def _loo_sql():
    return f"""WITH {S.CENTRED}, cs AS (SELECT region, dim, context AS cand, sum(v) AS s, count(*) AS n FROM cent GROUP BY ALL),
g AS (SELECT dim, sum(v) AS s1, sum(v * v) AS s2, count(*) AS n FROM cent GROUP BY dim),
p AS (SELECT c.region, c.unit, c.context, cs.cand, c.dim, c.v, (cs.s - CASE WHEN cs.cand = c.context THEN c.v ELSE 0 END) / (cs.n - CASE WHEN cs.cand = c.context THEN 1 ELSE 0 END) AS t,
 (g.s1 - c.v) / (g.n - 1) AS mu, sqrt(((g.s2 - c.v * c.v) / (g.n - 1) - pow((g.s1 - c.v) / (g.n - 1), 2)) * (g.n - 1) / (g.n - 2)) AS sd FROM cent c JOIN cs ON cs.region = c.region AND cs.dim = c.dim JOIN g ON g.dim = c.dim),
sims AS (SELECT region, unit, context, cand, corr((v - mu) / sd, (t - mu) / sd) AS s FROM p GROUP BY ALL),
{S.decide('sims', ['region', 'unit'], 'context', 'dec')} SELECT region, unit, context, predicted, {rnd('evidence', 'evidence')} FROM dec"""


@query("template_decode_loo", _loo_sql())
def template_decode_loo(spark, sf):
    u = centred_regions(spark, sf)
    d = patterns.decode_one_out(u, ["region"], "unit", "context", "x", scale=True, width=V.REGION_WIDTH)
    return d.select("region", "unit", "context", "predicted", r6("evidence").alias("evidence"))


@query(
    "kfold_by_block",
    f"WITH {V.UNITS}, r AS (SELECT DISTINCT run FROM units) SELECT run, CAST((row_number() OVER (ORDER BY md5(concat_ws('|', '1', run)), run) - 1) % 5 + 1 AS INT) AS fold FROM r",
)
def kfold_by_block(spark, sf):
    return sampling.fold_by_block(V.units(spark, sf), "run", 5)


@query(
    "folds_all_classes",
    f"""WITH {V.UNITS}, c AS (SELECT run, item * 4 + context AS cell, count(*) AS n FROM units GROUP BY ALL), b AS (SELECT DISTINCT run FROM c),
d AS (SELECT CAST(range AS INT) AS attempt, run, CAST((row_number() OVER (PARTITION BY range ORDER BY md5(concat_ws('|', '1', range, run)), run) - 1) % 2 + 1 AS INT) AS fold FROM b, range(1, 21)),
t AS (SELECT attempt, fold, cell, sum(n) AS te FROM c JOIN d USING (run) GROUP BY ALL), tt AS (SELECT cell, sum(n) AS tot FROM c GROUP BY cell),
ok AS (SELECT attempt FROM t JOIN tt USING (cell) WHERE tot > te GROUP BY attempt HAVING count(*) = 2 * (SELECT count(*) FROM tt))
SELECT attempt, run, fold FROM d WHERE attempt = (SELECT min(attempt) FROM ok)""",
)
def folds_all_classes(spark, sf):
    u = V.units(spark, sf).withColumn("cell", F.col("item") * 4 + F.col("context"))
    return sampling.folds_all_classes(u, "run", "cell", 2, 20).select("attempt", "run", "fold")


@query(
    "template_benchmark",
    f"""WITH {S.CENTRED}, dm AS (SELECT unit, context, run, region, dim, v - avg(v) OVER (PARTITION BY unit, region) AS v FROM cent), {S.decode('dm', ['region'], 'context')},
pc AS (SELECT region, context, count(*) AS n, avg(CASE WHEN predicted = context THEN 1.0 ELSE 0.0 END) AS rec FROM dec GROUP BY 1, 2)
SELECT region, CAST(sum(n) AS BIGINT) AS n_units, {rnd('sum(n * rec) / sum(n)', 'accuracy')}, {rnd('avg(rec)', 'balanced_accuracy')} FROM pc GROUP BY region""",
)
def template_benchmark(spark, sf):
    d = decoded(spark, sf, "context", demean=True)
    acc = summaries.accuracy(d, ["region"], "context", "predicted")
    return acc.withColumns({c: r6(c) for c in ("accuracy", "balanced_accuracy")})


def labels_with_observed(u, label: str, blocks: list[str], count: int):
    """Permutation 0 is the observed labelling, so one pass scores everything."""
    drawn = sampling.permute_within(u, blocks, "unit", label, count)
    own = u.select(F.lit(0).alias("perm"), "unit", F.col(label).alias("permuted"))
    return packed(drawn.select("perm", "unit", "permuted").unionByName(own))


def perm_cte(src: str, label: str, blocks: list[str], count: int) -> str:
    return f"""{S.permuted(src, blocks, 'unit', label, count)},
labs AS (SELECT * FROM perms UNION ALL SELECT DISTINCT 0, unit, {label} FROM {src})"""


INFER = f"""o AS (SELECT * FROM sc WHERE perm = 0), n AS (SELECT * FROM sc WHERE perm > 0), mx AS (SELECT perm, max(v) AS m FROM n GROUP BY perm),
inf AS (SELECT o.region, o.v, count(n.v) AS n_perm, avg(n.v) AS null_mean, stddev_samp(n.v) AS null_sd, (1.0 + count(*) FILTER (WHERE n.v >= o.v)) / (1 + count(*)) AS p FROM o JOIN n USING (region) GROUP BY 1, 2),
fw AS (SELECT o.region, (1.0 + count(*) FILTER (WHERE m >= o.v)) / (1 + count(*)) AS p_fwe FROM o, mx GROUP BY 1)"""


@query(
    "decode_with_permutations",
    f"""WITH {S.CENTRED}, {perm_cte('cent', 'item', ['run'], DECODE_PERMS)}, pc AS (SELECT l.perm, region, c.unit, run, l.permuted AS item, dim, v FROM cent c JOIN labs l ON l.unit = c.unit),
{S.decode_lists('cent', ['perm'], 'region', 'item')}, sc AS (SELECT perm, region, round(avg(CASE WHEN predicted = item THEN 1.0 ELSE 0.0 END), 12) AS v FROM dec GROUP BY 1, 2), {INFER}, {S.bh('inf', [])}
SELECT region, {rnd('v', 'accuracy')}, n_perm, {rnd('null_mean', 'null_mean')}, {rnd('null_sd', 'null_sd')}, {rnd('p', 'p')}, {rnd('q', 'q')}, {rnd('p_fwe', 'p_fwe')} FROM adj JOIN fw USING (region)""",
)
def decode_with_permutations(spark, sf, perms=DECODE_PERMS):
    u = V.units(spark, sf)
    labels = labels_with_observed(u, "item", ["run"], perms)
    regions = blocked.even_places(V.WIDTH // V.REGION_WIDTH, V.REGION_WIDTH, spark)
    scores = blocked.permuted_scores(u, "unit", "run", "item", "x", regions, "region", labels, V.WIDTH)
    return region_inference(durable(scores.select("perm", "region", F.round("accuracy", 12).alias("accuracy"))), "accuracy")


def region_inference(scores, value):
    o, n = scores.where("perm = 0").drop("perm"), scores.where("perm > 0")
    p = inference.p_upper(o, n, ["region"], value)
    fwe = inference.maxstat_fwe(o, n, ["region"], [], value).select("region", "p_fwe")
    out = inference.bh_fdr(p, [], "p").join(fwe, "region")
    return out.select("region", r6(value).alias(value), "n_perm", *[r6(c).alias(c) for c in ("null_mean", "null_sd", "p", "q", "p_fwe")])


def _transfer_sql(src: str, keys: list[str], p: str = "") -> str:
    k = "".join(f"{c}, " for c in keys)
    return f"""{S.templates(src, [*keys, 'context'], 'item', p)},
{p}ts AS (SELECT {S._cols('c', keys)}t.context AS source, c.context AS target, c.unit, c.item, t.cand, corr(c.v, t.v) AS s FROM {src} c JOIN {p}tmpl t
 ON {S._on('c', 't', keys + ['run', 'dim'])} WHERE t.context = 3 OR c.context <> 3 GROUP BY ALL),
{S.decide(f'{p}ts', [*keys, 'source', 'target', 'unit'], 'item', f'{p}td')},
{p}tc AS (SELECT {k}source, target, count(*) AS n, avg(CASE WHEN predicted = item THEN 1.0 ELSE 0.0 END) AS accuracy, avg(evidence) AS evidence FROM {p}td GROUP BY ALL),
{p}tsum AS (SELECT {k}{', '.join(f"avg({m}) FILTER (WHERE source < 3 AND target < 3 AND source = target) AS within_{m}, avg({m}) FILTER (WHERE source < 3 AND target < 3 AND source <> target) AS cross_{m}, avg({m}) FILTER (WHERE source = 3 AND target < 3) AS control_{m}" for m in ('evidence', 'accuracy'))} FROM {p}tc GROUP BY ALL)"""


@query(
    "context_transfer",
    f"WITH {S.CENTRED}, {_transfer_sql('cent', ['region'])} SELECT region, "
    + ", ".join(rnd(f"{a}_{m}", f"{a}_{m}") for m in ("evidence", "accuracy") for a in ("within", "cross", "control"))
    + f", {rnd('within_evidence - cross_evidence', 'evidence_effect')}, {rnd('within_accuracy - cross_accuracy', 'accuracy_effect')} FROM tsum",
)
def context_transfer(spark, sf):
    d = transfer.context_transfer(V.units(spark, sf), V.CONTROL, "x", REGIONS, V.WIDTH)
    s = transfer.transfer_summary(transfer.transfer_cells(d, ["region"]), ["region"], V.CONTROL)
    return s.select("region", *[r6(c).alias(c) for c in s.columns if c != "region"])


@query(
    "diag_offdiag_contrast",
    f"""WITH {S.CENTRED}, {_transfer_sql('cent', ['region'])}, c AS (SELECT * FROM tc WHERE source < 3 AND target < 3)
SELECT region, NULL AS context, {rnd('avg(evidence) FILTER (WHERE source = target) - avg(evidence) FILTER (WHERE source <> target)', 'delta')} FROM c GROUP BY region
UNION ALL SELECT region, q, {rnd('avg(evidence) FILTER (WHERE source = target) - avg(evidence) FILTER (WHERE source <> target)', 'delta')} FROM c, (VALUES (0), (1), (2)) x(q) WHERE source = q OR target = q GROUP BY region, q""",
)
def diag_offdiag_contrast(spark, sf):
    d = transfer.context_transfer(V.units(spark, sf), V.CONTROL, "x", REGIONS, V.WIDTH)
    cells = durable(transfer.transfer_cells(d, ["region"]).where("source < 3 AND target < 3"))
    overall = summaries.diagonal_contrast(cells, ["region"], "source", "target", "evidence").select("region", F.lit(None).cast("int").alias("context"), "delta")
    own = summaries.class_contrast(cells, ["region"], "source", "target", "evidence").select("region", F.col("class").alias("context"), "delta")
    return overall.unionByName(own).withColumn("delta", r6("delta"))


def _cross_item_sql(src: str, keys: list[str]) -> str:
    k = "".join(f"{c}, " for c in keys)
    return f"""xb AS (SELECT {k}dim, item, run, context, sum(v) AS s, count(*) AS n FROM {src} GROUP BY ALL),
xt AS (SELECT {k}dim, context, sum(s) AS s, sum(n) AS n FROM xb GROUP BY ALL), xi AS (SELECT {k}dim, item, context, sum(s) AS s, sum(n) AS n FROM xb GROUP BY ALL), xr AS (SELECT {k}dim, run, context, sum(s) AS s, sum(n) AS n FROM xb GROUP BY ALL),
xc AS (SELECT DISTINCT {k}item, run FROM {src}),
xm AS (SELECT {S._cols('t', keys)}c.item, c.run, t.dim, t.context AS cand, t.n - coalesce(i.n, 0) - coalesce(r.n, 0) + coalesce(b.n, 0) AS n, (t.s - coalesce(i.s, 0) - coalesce(r.s, 0) + coalesce(b.s, 0)) AS s
 FROM xt t JOIN xc c ON {S._on('t', 'c', keys)} LEFT JOIN xi i ON {S._on('t', 'i', keys + ['dim', 'context'])} AND i.item = c.item LEFT JOIN xr r ON {S._on('t', 'r', keys + ['dim', 'context'])} AND r.run = c.run
 LEFT JOIN xb b ON {S._on('t', 'b', keys + ['dim', 'context'])} AND b.item = c.item AND b.run = c.run),
xs AS (SELECT {S._cols('f', keys)}f.item, f.unit, f.context, m.cand, corr(f.v, m.s / m.n) AS s FROM {src} f JOIN xm m ON {S._on('f', 'm', keys + ['item', 'run', 'dim'])} WHERE m.n > 0 GROUP BY ALL),
{S.decide('xs', [*keys, 'item', 'unit'], 'context', 'xd')},
xcell AS (SELECT {k}item, context, avg(CASE WHEN predicted = context THEN 1.0 ELSE 0.0 END) AS accuracy, avg(evidence) AS evidence FROM xd GROUP BY ALL),
xitem AS (SELECT {k}item, avg(accuracy) AS accuracy, avg(evidence) AS evidence FROM xcell GROUP BY ALL)"""


@query(
    "cross_item_transfer",
    f"WITH {S.SEMANTIC}, {_cross_item_sql('sem', ['region'])} SELECT region, {rnd('avg(accuracy)', 'accuracy')}, {rnd('avg(evidence)', 'evidence')}, count(*) AS n_items FROM xitem GROUP BY region",
)
def cross_item_transfer(spark, sf):
    d = transfer.cross_item_transfer(semantic(spark, sf), "x", REGIONS, V.WIDTH)
    out = transfer.cross_item_summary(d, ["region"])
    return out.select("region", r6("accuracy").alias("accuracy"), r6("evidence").alias("evidence"), "n_items")


TRANSFER_PERMS = 100


@query(
    "transfer_null_and_group",
    f"""WITH {S.CENTRED}, sub AS (SELECT unit, CAST(unit % 2 AS INT) AS subject, item, context, run, region, dim, v - avg(v) OVER (PARTITION BY unit % 2, run, dim) AS v FROM feats),
{S.permuted('sub', ['subject', 'context', 'run'], 'unit', 'item', TRANSFER_PERMS)}, labs AS (SELECT * FROM perms UNION ALL SELECT DISTINCT 0, unit, item FROM sub),
pc AS (SELECT l.perm, subject, region, s.unit, run, context, l.permuted AS item, dim, v FROM sub s JOIN labs l ON l.unit = s.unit),
{_transfer_sql('pc', ['perm', 'subject', 'region'])},
fr AS ({" UNION ALL ".join(f"SELECT perm, subject, region, 'primary_{m}' AS family, -1 AS target, within_{m} - cross_{m} AS v FROM tsum UNION ALL SELECT perm, subject, region, 'control_mean_{m}', -1, control_{m} FROM tsum UNION ALL SELECT perm, subject, region, 'control_target_{m}', target, {m} FROM tc WHERE source = 3 AND target < 3" for m in ('evidence', 'accuracy'))}),
f AS (SELECT perm, subject, region, family, target, round(v, 12) AS v FROM fr), o AS (SELECT * FROM f WHERE perm = 0), n AS (SELECT * FROM f WHERE perm > 0),
sp AS (SELECT subject, region, family, target, o.v AS observed, avg(n.v) AS null_mean, (1.0 + count(*) FILTER (WHERE n.v >= o.v)) / (1 + count(*)) AS p FROM o JOIN n USING (subject, region, family, target) GROUP BY ALL),
e AS (SELECT subject, region, family, target, observed - null_mean AS v FROM sp),
fl AS (SELECT region, family, target, range AS pat, round(avg(CASE WHEN (range >> subject) & 1 = 1 THEN v ELSE -v END), 12) AS x FROM e, range(4) GROUP BY ALL),
ob AS (SELECT region, family, target, round(avg(v), 12) AS observed FROM e GROUP BY ALL), mx AS (SELECT family, pat, max(x) AS m FROM fl GROUP BY ALL),
pl AS (SELECT region, family, target, observed, avg(CASE WHEN x >= observed THEN 1.0 ELSE 0.0 END) AS p FROM fl JOIN ob USING (region, family, target) GROUP BY ALL),
fw AS (SELECT region, family, target, avg(CASE WHEN m >= observed THEN 1.0 ELSE 0.0 END) AS p_fwe FROM ob JOIN mx USING (family) GROUP BY ALL), {S.bh('pl', ['family'])}
SELECT 'group' AS level, NULL AS subject, family, region, nullif(target, -1) AS target, {rnd('observed', 'observed')}, NULL AS null_mean, {rnd('p', 'p')}, {rnd('p_fwe', 'p_fwe')}, {rnd('q', 'q')} FROM adj JOIN fw USING (region, family, target)
UNION ALL SELECT 'subject', subject, family, region, nullif(target, -1), {rnd('observed', 'observed')}, {rnd('null_mean', 'null_mean')}, {rnd('p', 'p')}, NULL, NULL FROM sp""",
)
def transfer_null_and_group(spark, sf, perms=TRANSFER_PERMS):
    """p of every subject and region, and sign flips over subjects of the values less their null means.

    Each measure has three families: within less across contexts, control to all contexts, and control to each of them.
    """
    u = V.units(spark, sf).withColumn("subject", (F.col("unit") % 2).cast("int"))
    labels = labels_with_observed(u, "item", ["subject", "context", "run"], perms)
    regions = blocked.even_places(V.WIDTH // V.REGION_WIDTH, V.REGION_WIDTH, spark)
    cells = durable(transfer.permuted_cells(u, V.CONTROL, "x", regions, "region", V.WIDTH, ["subject"], labels))
    keys = ["perm", "subject", "region"]
    s = transfer.transfer_summary(cells, keys, V.CONTROL)
    none, measures = F.lit(-1).cast("bigint"), ("evidence", "accuracy")  # -1: no single target
    row = lambda family, target, v: F.struct(F.lit(family).alias("family"), target.alias("target"), F.round(v, 12).alias("v"))
    overall = [r for m in measures for r in (row(f"primary_{m}", none, F.col(f"{m}_effect")), row(f"control_mean_{m}", none, F.col(f"control_{m}")))]
    single = [row(f"control_target_{m}", F.col("target"), F.col(m)) for m in measures]
    by_target = cells.where((F.col("source") == V.CONTROL) & (F.col("target") != V.CONTROL))
    f = durable(s.select(*keys, F.inline(F.array(*overall))).unionByName(by_target.select(*keys, F.inline(F.array(*single)))))
    tests = ["region", "target"]
    observed, null = f.where("perm = 0").drop("perm"), f.where("perm > 0")
    own = inference.p_upper(observed, null, ["subject", "family", *tests], "v")
    effects = inference.null_centre(observed, null, ["subject", "family", *tests], "v")
    group = inference.sign_flip_exact(effects, ["family"], tests, "subject", "centred")
    missing = F.lit(None).cast("double")
    target = F.nullif(F.col("target"), none).alias("target")
    group = group.select(F.lit("group").alias("level"), F.lit(None).cast("int").alias("subject"), "family", "region", target, r6("observed").alias("observed"), missing.alias("null_mean"), *[r6(c).alias(c) for c in ("p", "p_fwe", "q")])
    own = own.select(F.lit("subject").alias("level"), "subject", "family", "region", target, r6("v").alias("observed"), r6("null_mean").alias("null_mean"), r6("p").alias("p"), missing.alias("p_fwe"), missing.alias("q"))
    return group.unionByName(own)


# Cross-half similarity.

SPLITS, ATTEMPTS = 4, 60


def run_splits(spark, sf):
    u = selection.drop_control(V.units(spark, sf).drop("x"), "context", V.CONTROL)
    return durable(sampling.split_halves(u, "run", "session", ["item", "context"], SPLITS, ATTEMPTS))


SH_COLS = ", ".join(rnd(c, c) for c in ("mean_delta", "max_delta", "sd_delta")) + ", n_splits"


def _sh_round(df, *keys):
    return df.select(*keys, "context", *[r6(c).alias(c) for c in ("mean_delta", "max_delta", "sd_delta")], "n_splits")


@query(
    "split_half_similarity",
    f"WITH {S.SEMANTIC}, {S.splits(SPLITS, ATTEMPTS)}, {S.split_half('sem', [])} SELECT context, {SH_COLS} FROM sh",
)
def split_half_similarity(spark, sf):
    return _sh_round(splithalf.split_half(semantic(spark, sf), run_splits(spark, sf), [], "x", width=V.WIDTH))


# A permutation stays only if every item has every context in both halves of every split.
COVERED = S.permuted_until(
    "sem", ["run"], "unit", "context", PERMS, 60, "JOIN (SELECT DISTINCT unit, run, item FROM sem) USING (unit) JOIN splits USING (run)", ["split", "in_a", "item"],
    "SELECT (SELECT count(DISTINCT split) * 2 FROM splits) * count(DISTINCT item) * count(DISTINCT context) FROM sem",
)


def _perm_sem(keys: str = "") -> str:
    return f"""{COVERED}, labs AS (SELECT perm, unit, permuted FROM perms UNION ALL SELECT DISTINCT 0, unit, context FROM sem),
pc AS (SELECT l.perm, {keys}region, s.unit, run, item, l.permuted AS context, dim, v FROM sem s JOIN labs l ON l.unit = s.unit)"""


@query(
    "split_half_roi",
    f"""WITH {S.SEMANTIC}, {S.splits(SPLITS, ATTEMPTS)}, {_perm_sem()}, {S.split_half('pc', ['perm', 'region'])}, r AS (SELECT perm, region, context, round(mean_delta, 12) AS a, round(max_delta, 12) AS b FROM sh),
o AS (SELECT * FROM r WHERE perm = 0), n AS (SELECT * FROM r WHERE perm > 0)
SELECT o.region, o.context, {rnd('o.a', 'mean_delta')}, {rnd('o.b', 'max_delta')}, {rnd('(1.0 + count(*) FILTER (WHERE n.a >= o.a)) / (1 + count(*))', 'p_mean')}, {rnd('(1.0 + count(*) FILTER (WHERE n.b >= o.b)) / (1 + count(*))', 'p_max')}
FROM o JOIN n ON o.region = n.region AND o.context IS NOT DISTINCT FROM n.context GROUP BY o.region, o.context, o.a, o.b""",
)
def split_half_roi(spark, sf):
    scores = split_half_null(spark, sf, REGIONS)
    o, n = scores.where("perm = 0").drop("perm"), scores.where("perm > 0")
    a = inference.p_upper(o, n, ["region", "ctx"], "mean_delta").select("region", "ctx", "mean_delta", F.col("p").alias("p_mean"))
    b = inference.p_upper(o, n, ["region", "ctx"], "max_delta").select("region", "ctx", "max_delta", F.col("p").alias("p_max"))
    out = a.join(b, ["region", "ctx"])
    return out.select(
        "region", F.when(F.col("ctx") >= 0, F.col("ctx")).alias("context"), *[r6(c).alias(c) for c in ("mean_delta", "max_delta", "p_mean", "p_max")]
    )


def covered_labels(u, splits, count):
    """Observed labels as permutation 0, and shuffled ones redrawn until both halves of all splits hold all cells."""
    cells = u.select("unit", "run", "item").join(splits, "run").select("unit", "split", "in_a", "item")
    valid = lambda drawn: sampling.covering(drawn, cells, "unit", ["in_a", "item"], ["split"])
    drawn = sampling.permute_until_valid(u.drop("x"), ["run"], "unit", "context", count, valid)
    own = u.select(F.lit(0).alias("perm"), "unit", F.col("context").alias("permuted"))
    return durable(drawn.select("perm", "unit", "permuted").unionByName(own))


def split_half_null(spark, sf, places):
    """Scores per permutation and place; the overall contrast has ctx -1 so that keys join."""
    u, splits = semantic(spark, sf), run_splits(spark, sf)
    labels = covered_labels(u, splits, PERMS)
    pu = patterns.permuted_units(u, labels, "unit", "context")
    sh = splithalf.split_half(pu, splits, ["perm"], "x", places, V.WIDTH)
    return durable(sh.select(
        "perm", places.key, F.coalesce("context", F.lit(-1)).alias("ctx"), F.round("mean_delta", 12).alias("mean_delta"), F.round("max_delta", 12).alias("max_delta")
    ))


@query(
    "split_half_group",
    f"""WITH {S.SEMANTIC}, {S.splits(SPLITS, ATTEMPTS)}, {_perm_sem()}, {S.split_half('pc', ['perm', 'region'])},
g AS (SELECT perm, context, round(avg(mean_delta), 12) AS a FROM sh GROUP BY ALL), o AS (SELECT * FROM g WHERE perm = 0), n AS (SELECT * FROM g WHERE perm > 0)
SELECT o.context, {rnd('o.a', 'mean_delta')}, count(*) AS n_perm, {rnd('avg(n.a)', 'null_mean')}, {rnd('(1.0 + count(*) FILTER (WHERE n.a >= o.a)) / (1 + count(*))', 'p')} FROM o JOIN n ON o.context IS NOT DISTINCT FROM n.context GROUP BY o.context, o.a""",
)
def split_half_group(spark, sf):
    # The four regions stand for subjects: equal weights, permutation k averaged with permutation k.
    g = inference.group_null_mean(split_half_null(spark, sf, REGIONS), ["ctx"], "mean_delta")
    g = g.select("ctx", "perm", F.round("mean", 12).alias("mean_delta"))
    p = inference.p_upper(g.where("perm = 0").drop("perm"), g.where("perm > 0"), ["ctx"], "mean_delta")
    return p.select(F.when(F.col("ctx") >= 0, F.col("ctx")).alias("context"), r6("mean_delta").alias("mean_delta"), "n_perm", r6("null_mean").alias("null_mean"), r6("p").alias("p"))


# Neighbourhood scans on the 4 x 4 x 4 grid of features.

NB = """nb AS (SELECT a.d AS centre, b.d AS dim FROM range(64) a(d), range(64) b(d) WHERE pow(a.d % 4 - b.d % 4, 2) + pow((a.d // 4) % 4 - (b.d // 4) % 4, 2) + pow(a.d // 16 - b.d // 16, 2) <= 1),
nbs AS (SELECT centre, dim FROM nb WHERE centre IN (SELECT centre FROM nb GROUP BY centre HAVING count(*) >= 5))"""


def membership(spark, sf):
    """(centre, dim) neighbourhoods of at least five features within one step."""
    cells = V.features(spark, sf).select("dim").distinct().select(
        (F.col("dim") % 4).alias("i"), F.expr("CAST((dim div 4) % 4 AS INT)").alias("j"), F.expr("CAST(dim div 16 AS INT)").alias("k")
    )
    near = spatial.neighbours(cells, cells, spatial.offsets_voxel(1.0), 5)
    at = lambda i, j, k: (F.col(i) + 4 * (F.col(j) + 4 * F.col(k))).cast("int")
    return near.select(at("i", "j", "k").alias("centre"), at("ni", "nj", "nk").alias("dim"))


LIGHT = f"""WITH {S.CENTRED}, {NB}, {perm_cte('cent', 'context', ['run'], SCAN_PERMS)}, pc AS (SELECT l.perm, n.centre, c.unit, run, l.permuted AS context, c.dim, v FROM cent c JOIN labs l ON l.unit = c.unit JOIN nbs n ON n.dim = c.dim),
{S.decode('pc', ['perm', 'centre'], 'context')}"""


def scan_scores(spark, sf, value, perms):
    """``value`` of every centre and permutation, rounded so that ties between permutations are ties on any engine."""
    u = V.units(spark, sf)
    labels = labels_with_observed(u, "context", ["run"], perms)
    near = blocked.near_places(membership(spark, sf))
    scores = blocked.permuted_scores(u, "unit", "run", "context", "x", near, "centre", labels, V.WIDTH)
    return durable(scores.select("perm", F.col("centre").alias("region"), F.round(value, 12).alias(value)))


@query(
    "searchlight_template",
    f"""{LIGHT}, sc AS (SELECT perm, centre AS region, round(avg(CASE WHEN predicted = context THEN 1.0 ELSE 0.0 END), 12) AS v FROM dec GROUP BY ALL), {INFER}, {S.bh('inf', [])}
SELECT CAST(region AS INT) AS region, {rnd('v', 'accuracy')}, n_perm, {rnd('null_mean', 'null_mean')}, {rnd('null_sd', 'null_sd')}, {rnd('p', 'p')}, {rnd('q', 'q')}, {rnd('p_fwe', 'p_fwe')} FROM adj JOIN fw USING (region)""",
)
def searchlight_template(spark, sf, perms=SCAN_PERMS):
    return region_inference(scan_scores(spark, sf, "accuracy", perms), "accuracy")


@query(
    "searchlight_score",
    f"""{LIGHT}, sc AS (SELECT perm, centre AS region, round(avg(evidence), 12) AS v FROM dec GROUP BY ALL), {INFER}, {S.bh('inf', [])}
SELECT CAST(region AS INT) AS region, {rnd('v', 'evidence')}, n_perm, {rnd('null_mean', 'null_mean')}, {rnd('null_sd', 'null_sd')}, {rnd('p', 'p')}, {rnd('q', 'q')}, {rnd('p_fwe', 'p_fwe')} FROM adj JOIN fw USING (region)""",
)
def searchlight_score(spark, sf, perms=SCAN_PERMS):
    return region_inference(scan_scores(spark, sf, "evidence", perms), "evidence")


@query(
    "searchlight_split_half",
    f"""WITH {S.SEMANTIC}, {NB}, {S.splits(SPLITS, ATTEMPTS)}, {COVERED}, labs AS (SELECT perm, unit, permuted FROM perms UNION ALL SELECT DISTINCT 0, unit, context FROM sem),
pc AS (SELECT l.perm, n.centre, s.unit, run, item, l.permuted AS context, s.dim, v FROM sem s JOIN labs l ON l.unit = s.unit JOIN nbs n ON n.dim = s.dim), {S.split_half('pc', ['perm', 'centre'])},
r AS (SELECT perm, centre, context, round(mean_delta, 12) AS v FROM sh WHERE context IS NOT NULL), st AS (SELECT centre, context, avg(v) AS m, stddev_samp(v) AS s FROM r GROUP BY ALL),
z AS (SELECT perm, centre, context, v, m, s, round((v - m) / s, 10) AS z FROM r JOIN st USING (centre, context)), mx AS (SELECT perm, max(z) AS mz FROM z WHERE perm > 0 GROUP BY perm),
o AS (SELECT * FROM z WHERE perm = 0), pu AS (SELECT o.centre, o.context, (1.0 + count(*) FILTER (WHERE n.v >= o.v)) / (1 + count(*)) AS p FROM o JOIN r n ON n.perm > 0 AND n.centre = o.centre AND n.context = o.context GROUP BY ALL)
SELECT CAST(o.centre AS INT) AS centre, o.context, {rnd('o.v', 'delta')}, {rnd('o.z', 'z')}, {rnd('pu.p', 'p_uncorrected')}, {rnd('(1.0 + (SELECT count(*) FROM mx WHERE mz >= o.z)) / (1 + (SELECT count(*) FROM mx))', 'p_fwe')} FROM o JOIN pu ON pu.centre = o.centre AND pu.context = o.context""",
)
def searchlight_split_half(spark, sf):
    scores = split_half_null(spark, sf, patterns.neighbourhoods(membership(spark, sf)))
    r = scores.where("ctx >= 0").select("perm", "centre", F.col("ctx").alias("context"), F.col("mean_delta").alias("delta"))
    out = inference.maxstat_studentised(r.where("perm = 0").drop("perm"), r.where("perm > 0"), ["centre", "context"], [], "delta")
    return out.select("centre", "context", *[r6(c).alias(c) for c in ("delta", "z", "p_uncorrected", "p_fwe")])


# Tables around the decoders.


SHIFT = 8  # the second alignment reads every feature this many places later


@query(
    "decode_alignment_change",
    f"""{DEC}, cent2 AS (SELECT unit, item, run, CAST(d // 16 AS INT) AS region, CAST(d AS INT) AS dim, v - avg(v) OVER (PARTITION BY run, d) AS v
 FROM (SELECT unit, item, run, d, CAST(x[(d + {SHIFT}) % {V.WIDTH} + 1] AS DOUBLE) AS v FROM units, range({V.WIDTH}) t(d))), {S.decode('cent2', ['region'], 'item', 'b_')},
a AS (SELECT region, item, avg(CASE WHEN predicted = item THEN 1.0 ELSE 0.0 END) AS r FROM dec GROUP BY ALL),
b AS (SELECT region, item, avg(CASE WHEN predicted = item THEN 1.0 ELSE 0.0 END) AS r FROM b_dec GROUP BY ALL)
SELECT region, item, {rnd('b.r - a.r', 'recall_change')}, b.r - a.r > 0.05 AS improved FROM a JOIN b USING (region, item)""",
)
def decode_alignment_change(spark, sf):
    """Recall per class with the features of a second alignment, all units, less that of the first."""
    u = V.units(spark, sf)
    moved = u.withColumn("x", F.concat(F.slice("x", SHIFT + 1, V.WIDTH - SHIFT), F.slice("x", 1, SHIFT)))
    first, second = (patterns.decode(one, "unit", "run", "item", "x", REGIONS, V.WIDTH) for one in (u, moved))
    out = responses.metric_change(_recall(first), _recall(second), ["region", "item"], "recall")
    return out.select("region", "item", r6("recall_change").alias("recall_change"), (F.col("recall_change") > 0.05).alias("improved"))


def _recall(d):
    return d.groupBy("region", "item").agg(F.avg((F.col("predicted") == F.col("item")).cast("double")).alias("recall"))


@query("region_mean_response", f"WITH {V.FEATURES} SELECT region, unit, {rnd('avg(v)', 'response')} FROM feats WHERE dim % 3 <> 0 GROUP BY 1, 2")
def region_mean_response(spark, sf):
    mask = V.features(spark, sf).select("dim").distinct().where("dim % 3 <> 0")
    f = V.features(spark, sf).join(mask, "dim", "left_semi")
    return f.groupBy("region", "unit").agg(r6(F.avg("v")).alias("response"))


@query(
    "context_contrast",
    f"WITH {V.FEATURES}, m AS (SELECT context, dim, avg(v) AS v FROM feats GROUP BY ALL) SELECT q AS target, dim, {rnd('sum(v * CASE WHEN context = q THEN 1.0 ELSE -1.0 / 3 END)', 'contrast')} FROM m, (VALUES (0), (1), (2), (3)) x(q) GROUP BY ALL",
)
def context_contrast(spark, sf):
    out = responses.class_contrasts(V.features(spark, sf), "context", ["dim"], "v", [0, 1, 2, 3])
    return out.select("target", "dim", r6("contrast").alias("contrast"))


@query(
    "event_design",
    f"""WITH {V.SIGNAL}, e AS (SELECT key, event_type, (t - (SELECT min(t) FROM signal)) / 1e6 AS s FROM signal WHERE event_type IN ('view', 'purchase'))
SELECT key, event_type, CAST(ceil(s / 60.0) AS BIGINT) AS frame, count(*) AS n_events FROM (SELECT key, event_type, CASE WHEN event_type = 'purchase' THEN s - 3 ELSE s END AS s FROM e) WHERE s > 0 GROUP BY ALL""",
)
def event_design(spark, sf):
    s = V.signal(spark, sf)
    start = s.agg(F.min("t").alias("_start"))
    e = s.where("event_type IN ('view', 'purchase')").join(start, F.lit(True))
    e = e.withColumn("onset", (F.col("t") - F.col("_start")) / 1e6)
    e = e.withColumn("onset", F.when(F.col("event_type") == "purchase", F.col("onset") - 3).otherwise(F.col("onset")))
    return responses.event_design(e, ["key", "event_type"], "onset", 60.0)


@query(
    "contrast_weights_by_run",
    f"""WITH {V.RATINGS}, c AS (SELECT DISTINCT subject, context, trial % 8 AS run FROM ratings), n AS (SELECT subject, context, count(*) AS k FROM c GROUP BY ALL)
SELECT subject, run, context, {rnd("CASE WHEN context = 'AF' THEN 1.0 ELSE -0.2 END / k", 'weight')} FROM c JOIN n USING (subject, context)""",
)
def contrast_weights_by_run(spark, sf):
    c = V.ratings(spark, sf).select("subject", "context", (F.col("trial") % 8).alias("run"))
    weight = F.when(F.col("context") == "AF", 1.0).otherwise(-0.2)
    return responses.weights_by_run(c, ["subject"], "run", "context", weight).select("subject", "run", "context", r6("weight").alias("weight"))


@query("mass_univariate_ols")
def mass_univariate_ols(spark, sf):
    u = V.units(spark, sf)
    long = vectors.to_long(u.select("unit", "run", "context", "x"), "x", "dim", "v")
    design = [F.lit(1.0), *[(F.col("context") == c).cast("double") for c in range(3)], F.col("run").cast("double")]
    out = responses.mass_univariate_ols(long, ["dim"], "v", design, [0.0, 1.0, -0.5, -0.5, 0.0])
    return out.select("dim", r6("estimate").alias("estimate"), r6("t").alias("t"), "dof")


@query(
    "epoch_average",
    f"""WITH {V.FRAMES}, o AS (SELECT run, frame AS onset, CAST(frame % 3 AS INT) AS class FROM frames WHERE signal = 50), mu AS (SELECT run, avg(p2) AS mu FROM frames GROUP BY run),
e AS (SELECT o.run, onset, class, CAST(f.frame - onset AS INT) AS rel, 100 * f.p2 / mu AS v FROM o JOIN frames f ON o.run = f.run AND f.frame BETWEEN onset - 5 AND onset + 15 JOIN mu ON mu.run = o.run),
b AS (SELECT run, onset, avg(v) AS b FROM e WHERE rel BETWEEN -3 AND -1 GROUP BY ALL) SELECT class, rel, count(*) AS n, {rnd('avg(v - b)', 'mean')} FROM e JOIN b USING (run, onset) GROUP BY ALL""",
)
def epoch_average(spark, sf):
    f = V.frames(spark, sf).select("run", "frame", "p2", "signal")
    onsets = f.where("signal = 50").select("run", "frame", (F.col("frame") % 3).cast("int").alias("class"))
    out = responses.epoch_average(onsets, f.select("run", "frame", "p2"), "run", "frame", "class", "p2")
    return out.select("class", "rel", "n", r6("mean").alias("mean"))


@query("svm_one_vs_one")
def svm_one_vs_one(spark, sf):
    u = centred_regions(spark, sf)
    d = learners.svm_cross_validate(u, ["region"], "unit", "run", "context", "x", [0, 1, 2, 3], cost=1.0)
    acc = summaries.accuracy(d, ["region"], "context", "predicted")
    return acc.withColumns({c: r6(c) for c in ("accuracy", "balanced_accuracy")})


@query("lda_shrinkage")
def lda_shrinkage(spark, sf):
    u = centred_regions(spark, sf)
    d = learners.lda_cross_validate(u, ["region"], "unit", "run", "context", "x", gammas=[0.5])
    acc = summaries.accuracy(d, ["region", "gamma"], "context", "predicted")
    return acc.withColumns({c: r6(c) for c in ("accuracy", "balanced_accuracy")})


@query("nested_model_selection")
def nested_model_selection(spark, sf):
    u = centred_regions(spark, sf)
    folds = sampling.fold_by_block(V.units(spark, sf), "run", 5)
    u = u.join(folds, "run")
    out = learners.nested_selection(u, ["region"], "unit", "run", "fold", "context", "x", [0, 1, 2, 3])
    return out.withColumns({c: r6(c) for c in ("accuracy", "balanced_accuracy")})


@query(
    "argbest_with_tolerance",
    f"""WITH {V.RATINGS}, c AS (SELECT subject, item * 6 + dense_rank() OVER (ORDER BY context) AS candidate, round(avg(m2), 1) AS score FROM ratings GROUP BY subject, item, context)
SELECT subject, CAST(min(candidate) AS BIGINT) AS candidate FROM (SELECT *, max(score) OVER (PARTITION BY subject) AS best FROM c) WHERE score >= best - 1e-12 GROUP BY subject""",
)
def argbest_with_tolerance(spark, sf):
    cells = V.ratings(spark, sf).groupBy("subject", "item", "context").agg(F.round(F.avg("m2"), 1).alias("score"))
    coded = selection.encode_labels(cells, "context", ["AF", "AO", "NF", "NO", "RF", "RO"], "_c")
    coded = coded.withColumn("candidate", (F.col("item") * 6 + F.col("_c")).cast("bigint"))
    return learners.best_candidate(coded, ["subject"], "candidate", "score").select("subject", "candidate")
