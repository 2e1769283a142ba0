"""SQL text of the pattern pipelines, in long form, for the checks."""

from __future__ import annotations

from ..sources import views as V


def _on(a: str, b: str, cols: list[str]) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols) or "true"


def _cols(prefix: str, cols: list[str]) -> str:
    return "".join(f"{prefix}.{c}, " for c in cols)


CENTRED = V.FEATURES + """,
cent AS (SELECT unit, item, context, run, session, region, dim, v - avg(v) OVER (PARTITION BY run, dim) AS v FROM feats)"""

SEMANTIC = V.FEATURES + """,
sem AS (SELECT unit, item, context, run, session, region, dim, v - avg(v) OVER (PARTITION BY run, dim) AS v FROM feats WHERE context <> 3)"""


def templates(src: str, keys: list[str], label: str, p: str = "", block: str = "run") -> str:
    k = "".join(f"{c}, " for c in keys)
    return f"""{p}bs AS (SELECT {k}dim, {block}, {label}, sum(v) AS s, count(*) AS n FROM {src} GROUP BY ALL),
{p}tot AS (SELECT {k}dim, {label}, sum(s) AS s, sum(n) AS n FROM {p}bs GROUP BY ALL),
{p}folds AS (SELECT DISTINCT {k}{block} FROM {src}),
{p}tmpl AS (SELECT {_cols('t', keys)}f.{block}, t.dim, t.{label} AS cand, (t.s - coalesce(b.s, 0)) / (t.n - coalesce(b.n, 0)) AS v
 FROM {p}tot t JOIN {p}folds f ON {_on('t', 'f', keys)} LEFT JOIN {p}bs b ON {_on('t', 'b', keys + ['dim', label])} AND b.{block} = f.{block}
 WHERE t.n - coalesce(b.n, 0) > 0)"""


def decide(sims: str, unit: list[str], label: str, out: str) -> str:
    u = ", ".join(unit)
    return f"""{out} AS (SELECT {u}, {label}, arg_max(cand, struct_pack(s := round(s, 12), c := -cand)) AS predicted,
 sum(s) FILTER (WHERE cand = {label}) - (sum(s) - sum(s) FILTER (WHERE cand = {label})) / (count(s) - 1) AS evidence FROM {sims} GROUP BY ALL)"""


def decode(src: str, keys: list[str], label: str, p: str = "") -> str:
    k = keys
    return templates(src, keys, label, p) + f""",
{p}sims AS (SELECT {_cols('c', k)}c.unit, c.run, c.{label}, t.cand, corr(c.v, t.v) AS s FROM {src} c JOIN {p}tmpl t
 ON {_on('c', 't', keys + ['run', 'dim'])} GROUP BY ALL),
{decide(f'{p}sims', [*keys, 'unit', 'run'], label, f'{p}dec')}"""


def decode_lists(src: str, keys: list[str], region: str, label: str) -> str:
    """``decode`` for many permutations: vectors as lists, one product for each unit and template."""
    k = "".join(f"{c}, " for c in keys)
    return templates("pc", [*keys, region], label) + f""",
cu AS (SELECT unit, run, {region}, list(v ORDER BY dim) AS x FROM {src} GROUP BY ALL),
cx AS (SELECT unit, run, {region}, list_transform(x, lambda e: e - list_avg(x)) AS x FROM cu),
tl AS (SELECT {k}run, {region}, cand, list(v ORDER BY dim) AS t, sqrt(sum(v * v) - count(*) * avg(v) * avg(v)) AS size FROM tmpl GROUP BY ALL),
sims AS (SELECT {_cols('l', keys)}c.{region}, c.unit, c.run, l.{label}, t.cand, list_dot_product(c.x, t.t) / (sqrt(list_dot_product(c.x, c.x)) * t.size) AS s FROM cx c
 JOIN (SELECT {k}unit, permuted AS {label} FROM labs) l ON l.unit = c.unit JOIN tl t ON {_on('l', 't', keys)} AND t.run = c.run AND t.{region} = c.{region}),
{decide('sims', [*keys, region, 'unit', 'run'], label, 'dec')}"""


def permuted(src: str, blocks: list[str], unit: str, label: str, count: int, out: str = "perms", seed: int = 1) -> str:
    """(perm, unit, permuted)."""
    b = ", ".join(blocks)
    return f"""{out}_u AS (SELECT DISTINCT {b}, {unit}, {label} FROM {src}),
{out}_p AS (SELECT {b}, {unit}, row_number() OVER (PARTITION BY {b} ORDER BY {unit}) AS pl FROM {out}_u),
{out}_d AS (SELECT CAST(range AS INT) AS perm, {b}, {label}, row_number() OVER (PARTITION BY {b}, range ORDER BY md5(concat_ws('|', '{seed}', range, {unit})), {unit}) AS pl FROM {out}_u, range(1, {count + 1})),
{out} AS (SELECT perm, {unit}, {label} AS permuted FROM {out}_p JOIN {out}_d USING ({b}, pl))"""


def permuted_until(src: str, blocks: list[str], unit: str, label: str, count: int, attempts: int, cover: str, cell: list[str], need: str, out: str = "perms", seed: int = 1) -> str:
    """(perm, attempt, unit, permuted) of each permutation's first attempt that has ``need`` cells.

    ``cover`` joins the drawn rows {out}_a to what ``cell`` names.
    """
    b = ", ".join(blocks)
    return f"""{out}_u AS (SELECT DISTINCT {b}, {unit}, {label} FROM {src}),
{out}_p AS (SELECT {b}, {unit}, row_number() OVER (PARTITION BY {b} ORDER BY {unit}) AS pl FROM {out}_u),
{out}_d AS (SELECT CAST(p.range AS INT) AS perm, CAST(a.range AS INT) AS attempt, {b}, {label}, row_number() OVER (PARTITION BY {b}, p.range, a.range ORDER BY md5(concat_ws('|', '{seed}', p.range, a.range, {unit})), {unit}) AS pl FROM {out}_u, range(1, {count + 1}) p, range(1, {attempts + 1}) a),
{out}_a AS (SELECT perm, attempt, {unit}, {label} AS permuted FROM {out}_p JOIN {out}_d USING ({b}, pl)),
{out}_c AS (SELECT DISTINCT perm, attempt, {', '.join(cell)}, permuted FROM {out}_a {cover}),
{out}_b AS (SELECT perm, min(attempt) AS attempt FROM (SELECT perm, attempt FROM {out}_c GROUP BY ALL HAVING count(*) = ({need})) GROUP BY perm),
{out} AS (SELECT perm, attempt, {unit}, permuted FROM {out}_a JOIN {out}_b USING (perm, attempt))"""


def splits(count: int, attempts: int, seed: int = 1) -> str:
    """(split, run, in_a) of the stratified halves of the semantic units."""
    return f"""ruz AS (SELECT DISTINCT run, session FROM units WHERE context <> 3),
szz AS (SELECT session, count(*) AS sz FROM ruz GROUP BY session),
plz AS (SELECT sum(sz) // 2 - sum(sz // 2) AS extra FROM szz),
odz AS (SELECT range AS attempt, session, sz, row_number() OVER (PARTITION BY range, sz % 2 ORDER BY md5(concat_ws('|', '{seed}', range, session)), session) AS r FROM szz, range(1, {attempts + 1})),
tkz AS (SELECT attempt, session, sz // 2 + CASE WHEN sz % 2 = 1 AND r <= extra THEN 1 ELSE 0 END AS t FROM odz, plz),
drz AS (SELECT range AS attempt, run, session, row_number() OVER (PARTITION BY range, session ORDER BY md5(concat_ws('|', '{seed}', range, session, run)), run) AS r FROM ruz, range(1, {attempts + 1})),
hfz AS (SELECT attempt, run, r <= t AS a FROM drz JOIN tkz USING (attempt, session)),
caz AS (SELECT attempt, run, a = first_value(a) OVER (PARTITION BY attempt ORDER BY run) AS in_a FROM hfz),
sgz AS (SELECT attempt, string_agg(CASE WHEN in_a THEN CAST(run AS VARCHAR) END, ',' ORDER BY run) AS members FROM caz GROUP BY attempt),
cez AS (SELECT run, item, context, count(*) AS c FROM units WHERE context <> 3 GROUP BY ALL),
coz AS (SELECT attempt FROM (SELECT attempt, item, context, sum(CASE WHEN in_a THEN c ELSE 0 END) AS na, sum(CASE WHEN in_a THEN 0 ELSE c END) AS nb FROM cez JOIN caz USING (run) GROUP BY ALL) GROUP BY attempt HAVING min(least(na, nb)) > 0),
unz AS (SELECT min(attempt) AS attempt FROM sgz GROUP BY members),
vaz AS (SELECT attempt, row_number() OVER (ORDER BY attempt) AS split FROM unz WHERE attempt IN (SELECT attempt FROM coz)),
splits AS (SELECT CAST(split AS INT) AS split, run, in_a FROM caz JOIN vaz USING (attempt) WHERE split <= {count})"""


def split_half(src: str, keys: list[str], p: str = "") -> str:
    """{p}sh: (keys, context, mean_delta, max_delta, sd_delta, n_splits); context NULL = overall."""
    k = "".join(f"{c}, " for c in keys)
    return f"""{p}hm AS (SELECT {k}split, in_a, context, item, dim, avg(v) AS v FROM {src} JOIN splits USING (run) GROUP BY ALL),
{p}ht AS (SELECT {k}split, in_a, context, dim, avg(v) AS v FROM {p}hm GROUP BY ALL),
{p}hr AS (SELECT {_cols('x', keys)}x.split, x.context AS a, y.context AS b, corr(x.v, y.v) AS r FROM {p}ht x JOIN {p}ht y ON {_on('x', 'y', keys + ['split', 'dim'])} AND x.in_a AND NOT y.in_a GROUP BY ALL),
{p}hz AS (SELECT *, atanh(least(greatest(r, -1 + 1e-12), 1 - 1e-12)) AS z FROM {p}hr),
{p}hd AS (SELECT {k}split, NULL AS context, avg(z) FILTER (WHERE a = b) - avg(z) FILTER (WHERE a <> b) AS delta FROM {p}hz GROUP BY ALL
 UNION ALL SELECT {k}split, c AS context, avg(z) FILTER (WHERE a = b) - avg(z) FILTER (WHERE a <> b) AS delta FROM {p}hz, (VALUES (0), (1), (2)) q(c) WHERE a = c OR b = c GROUP BY ALL),
{p}sh AS (SELECT {k}context, avg(delta) AS mean_delta, max(delta) AS max_delta, stddev_samp(delta) AS sd_delta, count(delta) AS n_splits FROM {p}hd GROUP BY ALL)"""


def bh(src: str, part: list[str], p: str = "p", out: str = "adj") -> str:
    by = "PARTITION BY " + ", ".join(part) if part else ""
    same = "PARTITION BY " + ", ".join([*part, p])
    return f"""{out}_r AS (SELECT *, rank() OVER ({by} ORDER BY {p}) + count(*) OVER ({same}) - 1 AS _rn, count({p}) OVER ({by}) AS _m FROM {src}),
{out} AS (SELECT * EXCLUDE (_rn, _m), least(1, min({p} * _m / _rn) OVER ({by} ORDER BY {p} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM {out}_r)"""
