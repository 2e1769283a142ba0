"""Session helpers: a local session for tests, durable lineage cuts, shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, app: str = "trialweave") -> SparkSession:
    """Session for tests and the bench, with a folder of this machine for its checkpoints; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="trialweave-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session. A session without one is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local["):  # one machine: its folders are shared by all there is
        folder = tempfile.mkdtemp(prefix="trialweave-")
        spark.sparkContext.setCheckpointDir(folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


METHOD_BYTES = 8_000  # the virtual machine only interprets a method of more bytecode than this


def compiled(spark: SparkSession) -> SparkSession:
    """``spark`` with generated code kept below METHOD_BYTES a method, where the session has Spark's own limit.

    A wide projection is one long method otherwise, which runs several times slower than its parts.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_BYTES))
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def packed(df: DataFrame) -> DataFrame:
    """As ``durable``, in compressed columns: for tables of many short rows that repeat few values."""
    path = scratch_path(df.sparkSession, "packed")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_folder(spark)}/trialweave-scratch/{name}-{uuid.uuid4().hex}"
