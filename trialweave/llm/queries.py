"""Registered queries of the subpackage: one per numbered operator."""

from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, language, licenses, linededup, merkle, neardup, periodic, pii, preference, toxicity, warc
from .common import QUERIES, SQL, query, table  # noqa: F401


@query("op1_multiprobe_neighbours")
def op1_multiprobe_neighbours(spark, sf):
    """The twenty nearest of every row of ``embeddings`` whose id is divisible by twenty, found by multiprobe hashing."""
    vectors = table(spark, sf, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query("op2_license_digests", licenses.scan_sql())
def op2_license_digests(spark, sf):
    """The licence that each whole document is, and those that its lines name."""
    found = licenses.scan(table(spark, sf, "documents").select("doc_id", "text"), licenses.known_licenses(spark))
    lines = F.col("license.lines")
    return found.select(
        "doc_id", F.col("license.whole").alias("whole_license"), F.size(lines).cast("bigint").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(lines, lambda x: x.license))), ",").alias("licenses"),
    )


@query("op3_pii_weak_supervision")
def op3_pii_weak_supervision(spark, sf):
    """Personal data in every document: base spans and those that the trained span classifier adds."""
    found = pii.personal_data(table(spark, sf, "documents").select("doc_id", "text"))
    p = F.col("pii")
    return found.select("doc_id", *[p[f"n_{k}"].alias(f"n_{k}") for k in pii.KINDS[:4]], F.sha2(pii.listed(p["base"]), 256).alias("base_sha256"), pii.listed(p["spans"]).alias("spans"))


@query("op4_warc_zstandard")
def op4_warc_zstandard(spark, sf):
    """Every page as a WARC record, written to Zstandard archives and read back."""
    back = warc.round_trip(spark, table(spark, sf, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op5_line_site_spread",
    """WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, source, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
wide AS (SELECT trim(line) AS t, min(row(doc_id, pos)) AS least FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 3),
marked AS (SELECT doc_id, line, pos, t IS NOT NULL AND least <> row(doc_id, pos) AS gone FROM lines LEFT JOIN wide ON t = trim(line))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed,
sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256 FROM marked GROUP BY doc_id""",
)
def op5_line_site_spread(spark, sf):
    """Documents without the lines that stand on three or more sources, but for each line's first occurrence."""
    done = linededup.remove_boilerplate(table(spark, sf, "documents").select("doc_id", "text", "source"))
    r = F.col("line_dedup")
    return done.select("doc_id", r.n_lines.alias("n_lines"), r.n_removed.alias("n_removed"), F.sha2(r.getField("text"), 256).alias("text_sha256"))


@query("op6_minhash_near_dedup")
def op6_minhash_near_dedup(spark, sf):
    """Component and survivor of every document at similarity 0.75 on five-word shingles."""
    return neardup.near_components(table(spark, sf, "documents"))


@query("op7_wu_manber_decontamination")
def op7_wu_manber_decontamination(spark, sf):
    """Words of every document inside occurrences of 13-word benchmark windows."""
    found = decontaminate.find_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])
    p = F.col("passages")
    return found.select(
        "doc_id", p.n_words.alias("n_words"), p.n_hit.alias("n_hit"), F.size(p.getField("items")).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(p.getField("items")), ","), 256).alias("items_sha256"),
        ((p.n_hit > 0) & (20 * p.n_hit >= p.n_words)).alias("contaminated"),
    )


@query("op8_toxicity_instances")
def op8_toxicity_instances(spark, sf):
    """Noisy-or toxicity of every document, learned from two thirds of the labels."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.trained(docs, table(spark, sf, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    value = F.col("toxicity.score")
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), value.alias("score"), (value >= 0.7).cast("int").alias("predicted"),
        F.size("toxicity.offending").alias("n_offending"),
    )


@query("op9_language_crf")
def op9_language_crf(spark, sf):
    """Language of every document from word labels, learned from three quarters of the rows."""
    docs = table(spark, sf, "documents")
    found = language.identify(docs, language.trained(docs), keep=["doc_id"])
    return found.select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        F.size("language.runs").alias("n_runs"),
    )


def piece_model() -> str:
    """Path of the public merge-type model; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op10_sentencepiece_codec")
def op10_sentencepiece_codec(spark, sf, model: str | None = None):
    """Encode every text with the merge-type vocabulary and decode it again."""
    with open(model or piece_model(), "rb") as file:
        vocabulary = bpe.Vocabulary(file.read())
    ids = bpe.encode(table(spark, sf, "documents"), vocabulary, keep=["doc_id"])
    back = bpe.decode(ids, vocabulary)
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


MANIFEST_SQL = """WITH RECURSIVE coded AS (SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
texts AS (SELECT doc_id, lang, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail, xor(crc, 4294967295) % 7 = 0 AS hit FROM coded),
leaves AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, leaf, sent, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT *, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN hit THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS sent FROM texts)),
nodes AS (SELECT 0 AS lvl, lang, rank, n, leaf AS digest FROM leaves
  UNION ALL SELECT lvl + 1, lang, rank // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY rank)) FROM nodes WHERE n > 1 GROUP BY lvl, lang, rank // 2, n),
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, place AS rank, n, subroot AS digest FROM subroots
  UNION ALL SELECT lvl + 1, rank // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY rank)) FROM tops WHERE n > 1 GROUP BY lvl, rank // 2, n),
lower AS (SELECT l.lang, l.rank, list(CASE WHEN s.digest IS NULL THEN 'n' WHEN s.rank < a.rank THEN 'l' || s.digest ELSE 'r' || s.digest END ORDER BY a.lvl) AS path
  FROM leaves l JOIN nodes a ON a.n > 1 AND a.lang IS NOT DISTINCT FROM l.lang AND a.rank = l.rank >> a.lvl
  LEFT JOIN nodes s ON s.lvl = a.lvl AND s.lang IS NOT DISTINCT FROM a.lang AND s.rank = xor(a.rank, 1) GROUP BY l.lang, l.rank),
upper AS (SELECT l.lang, list(CASE WHEN s.digest IS NULL THEN 'n' WHEN s.rank < a.rank THEN 'l' || s.digest ELSE 'r' || s.digest END ORDER BY a.lvl) AS path
  FROM subroots l JOIN tops a ON a.n > 1 AND a.rank = l.place >> a.lvl LEFT JOIN tops s ON s.lvl = a.lvl AND s.rank = xor(a.rank, 1) GROUP BY l.lang),
paths AS (SELECT doc_id, leaf, sent, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, list_concat(coalesce(o.path, []), coalesce(u.path, [])) AS path
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang LEFT JOIN lower o ON o.lang IS NOT DISTINCT FROM l.lang AND o.rank = l.rank LEFT JOIN upper u ON u.lang IS NOT DISTINCT FROM l.lang),
folds AS (SELECT *, list_reduce(list_prepend(coalesce(sent, leaf), path), lambda own, s: sha256(CASE s[1] WHEN 'l' THEN s[2:] || own WHEN 'r' THEN own || s[2:] ELSE own END)) AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds"""


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11_merkle_manifest(spark, sf):
    """Every document's proof, descended from the root, and the root that it folds to after some rows were tampered with."""
    docs = table(spark, sf, "documents")
    fields = {c: F.col(c) for c in merkle.DOCUMENT}
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = merkle.leaf_digest(*(fields | {"n_chars": F.col("n_chars") + 1}).values())
    made = merkle.manifest(docs, merkle.leaf_digest(*fields.values()), "lang", "doc_id", {"doc_id": F.col("doc_id"), "sent": F.when(hit, tampered)})
    found = merkle.proofs(made, made.leaves)
    end = merkle.folded(F.coalesce("sent", "leaf"), F.col("proof"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"), end.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_pairwise_quality")
def op12_pairwise_quality(spark, sf):
    """Quality of every document, ranked from preference pairs of three quarters of the labels."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = preference.score(docs, preference.trained(docs, table(spark, sf, "labels")), keep=["doc_id"])
    return scored.select("doc_id", preference.held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= preference.THRESHOLD).cast("int").alias("predicted"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf):
    """Periodic runs of every document, a tenth of them made periodic first, and the collapsed texts."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = periodic.find_runs(docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text")), keep=["doc_id"])
    runs = F.col("periodic.runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("shorter"))))
    listed = F.array_join(F.transform(runs, lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)), "")
    found = found.select(
        "doc_id", F.size(runs).cast("bigint").alias("n_runs"), longest.alias("longest"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"),
    )
    best, period = F.col("longest"), -F.col("longest.shorter")
    return found.select(
        "doc_id", "n_runs", (-best.before).alias("start"), best.length.alias("length"), period.alias("period"),
        F.floor(1000 * best.length / period).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
