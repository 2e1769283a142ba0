"""Readers: run listings, trial tables, ratings, matrices, label tables, motion text, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import finite, nan_to_null
from ..operators.ordered import number_rows


def pair_run_files(images: DataFrame, motions: DataFrame, path: str = "path") -> DataFrame:
    """One row per run found in either listing: key, ordinal, counts, gap flag and status.

    The ordinal follows numeric session then run; there are as many rows as runs.
    """
    def keyed(df: DataFrame, out: str) -> DataFrame:
        session = F.regexp_extract(path, r"session(\d+)_run(\d+)", 1).cast("int")
        run = F.regexp_extract(path, r"session(\d+)_run(\d+)", 2).cast("int")
        return df.groupBy(session.alias("session"), run.alias("run")).agg(F.count(F.lit(1)).alias(out))

    both = keyed(images, "n_images").join(keyed(motions, "n_motions"), ["session", "run"], "full_outer")
    both = both.withColumn("key", F.col("session") * 1000 + F.col("run"))
    status = (
        F.when(F.col("n_images").isNull(), "missing_image").when(F.col("n_motions").isNull(), "missing_motion")
        .when((F.col("n_images") > 1) | (F.col("n_motions") > 1), "duplicate").otherwise("paired")
    )
    numbered = number_rows(both, [], "session", ["key"], "ordinal")
    within = Window.partitionBy("session").orderBy("run")  # runs of one session: tens
    gap = F.coalesce(F.col("run") - F.lag("run").over(within) > 1, F.lit(False))
    return numbered.select("session", "run", "key", F.col("ordinal").cast("bigint").alias("ordinal"), status.alias("status"), gap.alias("gap"))


def trial_ordinals(df: DataFrame, subject: str, session: str, run: str, trial: str, chunk: Column) -> DataFrame:
    """Adds run_id, run_in_session, trial_in_run and trial_index.

    Run ordinals come from the table of runs; only the place inside a run looks at trials.
    """
    keys = [subject, session, run]
    runs = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    by_subject = Window.partitionBy(subject).orderBy(session, run)  # one row per run
    runs = runs.select(
        *keys, F.row_number().over(by_subject).alias("run_id"),
        F.row_number().over(Window.partitionBy(subject, session).orderBy(run)).alias("run_in_session"),
        F.coalesce(F.sum("_n").over(by_subject.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    placed = number_rows(df, keys, chunk, [trial], "trial_in_run")
    return placed.join(runs, keys).withColumn("trial_index", F.col("_before") + F.col("trial_in_run")).drop("_before")


def two_layout_ratings(labelled: DataFrame, plain: DataFrame) -> DataFrame:
    """Ratings from fields 2 and 3 where a label field exists, else from fields 4 and 5."""
    both = labelled.unionByName(plain, allowMissingColumns=True)
    has_label = F.col("label").isNotNull()
    return both.withColumns({
        "m1": nan_to_null(F.when(has_label, F.col("f2")).otherwise(F.col("f4"))),
        "m2": nan_to_null(F.when(has_label, F.col("f3")).otherwise(F.col("f5"))),
    }).drop("label", "f2", "f3", "f4", "f5")


def same_geometry(volumes: DataFrame, reference: DataFrame, key: str, dims: list[str], affine: list[str], tolerance: float = 1e-4) -> DataFrame:
    """(key, matches): dimensions equal and every affine entry within the tolerance of the one-row reference."""
    r = reference.select(*[F.col(c).alias(f"_r_{c}") for c in [*dims, *affine]])
    ok = F.lit(True)
    for c in dims:
        ok = ok & (F.col(c) == F.col(f"_r_{c}"))
    for c in affine:
        ok = ok & (F.abs(F.col(c) - F.col(f"_r_{c}")) < tolerance)
    return volumes.join(r, F.lit(True)).select(key, ok.alias("matches"))


def atlas_lut(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="id int, name string, r int, g int, b int, a int")


def atlas_xml(spark: SparkSession, path: str) -> DataFrame:
    schema = "index int, name string, x double, y double, z double"
    return spark.read.format("xml").option("rowTag", "label").schema(schema).load(path)


def motion_text(spark: SparkSession, path: str) -> DataFrame:
    """run, frame and six whitespace-separated parameters per line; ``ok`` where all six are finite."""
    raw = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("_w"))
    named = raw.select(
        *[F.get("_w", F.lit(n)).try_cast("bigint").alias(c) for n, c in enumerate(("run", "frame"))],
        *[F.get("_w", F.lit(n + 1)).try_cast("double").alias(f"p{n}") for n in range(1, 7)],
        F.size("_w").alias("_n"),
    )
    ok = F.col("_n") == 8
    for n in range(1, 7):
        ok = ok & F.coalesce(finite(f"p{n}"), F.lit(False))
    return named.withColumn("ok", ok).drop("_n")


def select_chunks(df: DataFrame, key: str, low: int, high: int, overrides: DataFrame) -> DataFrame:
    """(key, n, kept, reason): chunks by length, with explicit (key, action) overrides keep / drop."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(overrides, key, "left")
    fits = (F.col("n") >= low) & (F.col("n") <= high)
    kept = F.when(F.col("action") == "keep", True).when(F.col("action") == "drop", False).otherwise(fits)
    reason = F.when(F.col("action").isNotNull(), F.concat(F.lit("forced_"), F.col("action"))).when(fits, "length_ok").otherwise("length")
    return sizes.select(key, "n", kept.alias("kept"), reason.alias("reason"))


def region_manifest(spark: SparkSession, path: str, chunk_digits: int = 1) -> DataFrame:
    """(ordinal, stem, n_rows, duplicate) of a tab-separated manifest, stems in case-insensitive order."""
    raw = spark.read.csv(path, sep="\t", header=True)
    stem = F.lower(F.regexp_replace("output_file", r"\.nii(\.gz)?$", ""))
    stems = raw.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("n_rows"))
    out = number_rows(stems, [], F.substring("stem", 1, chunk_digits), ["stem"], "ordinal")
    return out.select(F.col("ordinal").cast("bigint").alias("ordinal"), "stem", "n_rows", (F.col("n_rows") > 1).alias("duplicate"))
