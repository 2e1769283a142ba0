"""Training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; the caller writes it
and the next stage reads it again. All but the last keep the columns of ``documents`` (and any further ones).
Empty tables stay empty; what nulls, repeated rows and ties do is stated with each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import bpe, decontaminate, linededup, neardup, toxicity
from trialweave.llm.common import free, table, written
from trialweave.llm.queries import piece_model

REJECT = 0.7  # toxicity from which a document goes
CONTAMINATED = 20  # a document goes if one word in this many lies in a benchmark window


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below REJECT by the model that the labels train."""
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    out = free(docs.columns, "toxicity")
    return toxicity.score(docs, model, out=out).where(F.col(f"{out}.score") < REJECT).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand on many sites; a document that loses its last worded line goes."""
    out = free(docs.columns, "line_dedup")
    new = F.col(out)
    done = linededup.remove_boilerplate(docs, out=out).where((new.n_removed == 0) | (F.trim(new.getField("text")) != ""))
    size = F.length(new.getField("text")).cast(docs.schema["n_chars"].dataType)
    done = done.withColumns({
        "n_chars": F.when(new.n_removed > 0, size).otherwise(F.col("n_chars")),
        "text": F.when(new.n_removed > 0, new.getField("text")).otherwise(F.col("text")),
    })
    return done.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, also of copies that repeat an id or have none."""
    return neardup.one_of_each(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    out = free(docs.columns, "passages")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"), out=out)
    p = F.col(out)
    return found.where(~((p.n_hit > 0) & (CONTAMINATED * p.n_hit >= p.n_words))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number, and a digest of the text that they decode to."""
    with open(piece_model(), "rb") as file:
        vocabulary = bpe.Vocabulary(file.read())
    back = bpe.decode(bpe.encode(docs, vocabulary, keep=["doc_id"]), vocabulary)
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
