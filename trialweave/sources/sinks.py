"""Sinks: result tables, maps, safe writes, provenance, nested export, resumable permutations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import assert_invariants


class AlreadyWritten(FileExistsError):
    pass


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Result table as parquet, csv or tsv; an existing table is never replaced."""
    writer = df.write.mode("errorifexists")
    try:
        if form == "parquet":
            writer.parquet(path)
        else:
            writer.csv(path, header=True, sep="\t" if form == "tsv" else ",")
    except AnalysisException as error:
        if "ALREADY_EXISTS" in str(error):
            raise AlreadyWritten(path) from error
        raise


def write_validated(df: DataFrame, path: str, checks: dict) -> None:
    """All checks first, then one write; Spark's committer shows the table only when it is whole."""
    assert_invariants(checks)
    write_table(df, path)


def dense_map(grid: DataFrame, sparse: DataFrame, at: list[str], value: str, fill) -> DataFrame:
    """Sparse results on every cell of the grid; cells outside get ``fill`` (None = missing)."""
    out = grid.select(*at).join(sparse.select(*at, value), at, "left")
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def content_digest(df: DataFrame, source: str) -> DataFrame:
    """(source, n_rows, digest): row hashes added up, so that order and partitioning do not matter but repeats do.

    A field is written with its length before it and a missing one as ``-``: no two rows have the same text.
    """
    field = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in df.columns]
    part = F.conv(F.substring(F.sha2(F.concat_ws(",", *field), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    digest = F.coalesce(F.sum(part), F.lit(0)).cast("string")
    return df.agg(F.lit(source).alias("source"), F.count(F.lit(1)).alias("n_rows"), digest.alias("digest"))


def selection_key(names: list[str]) -> str:
    """Short digest naming a selection of files or regions."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:12]


def provenance(inputs: dict[str, DataFrame], parameters: dict) -> DataFrame:
    """(source, n_rows, digest, manifest): one row per input, its manifest as JSON text."""
    parts = None
    for name, df in inputs.items():
        one = content_digest(df, name)
        parts = one if parts is None else parts.unionByName(one)
    settings = F.struct(*[F.lit(v).alias(k) for k, v in parameters.items()])
    manifest = F.to_json(F.struct("source", "n_rows", "digest", settings.alias("parameters")))
    return parts.withColumn("manifest", manifest)


def nested_json(df: DataFrame, key: str, index: str, name: str) -> DataFrame:
    """One JSON document per key with its short list of children, in index order."""
    children = F.sort_array(F.collect_list(F.struct(F.col(index).alias("index"), F.col(name).alias("name"))))
    return df.groupBy(key).agg(F.to_json(children).alias("doc"))


def resume_permutations(
    spark: SparkSession, path: str, wanted: list[int], signature: str, compute: Callable[[list[int]], DataFrame]
) -> DataFrame:
    """Compute only the permutations not stored yet, append them, and return all.

    The stored configuration must equal ``signature``. Results lie in one folder per
    permutation, so finished ids are a listing, not a scan.
    """
    done: set[int] = set()
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        other = stored.where(~F.col("signature").eqNullSafe(F.lit(signature))).limit(1).count()
        if other:
            raise ValueError(f"{path} was written with another configuration")
        done = {r[0] for r in stored.select("perm").distinct().collect()}
    missing = [p for p in wanted if p not in done]
    if missing:
        compute(missing).withColumn("signature", F.lit(signature)).write.mode("append").partitionBy("perm").parquet(path)
    return spark.read.parquet(path).where(F.col("perm").isin(wanted)).drop("signature")
