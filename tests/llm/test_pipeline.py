"""The pipeline over planted rows, and queries with a SQL twin."""

import os
import random

import fixtures as X
import pytest

import __spark_entry__ as entry
import corpus_pipeline
import oracle
from trialweave.llm import queries
from trialweave.llm.common import table, written

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, len(numbers) + 1)) and set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]


def planted(spark, folder):
    rng = random.Random(12)
    rows = []
    for k in range(300):
        text = ". ".join(X.sentence(rng, 12) for _ in range(5))
        rows.append((k, text + (". you villain" if k % 5 == 0 else ""), "en", f"s{k % 6}"))
    clean = [k for k in range(300) if k % 5]
    passage = X.sentence(rng, 60)
    for n, k in enumerate(clean[:8]):
        rows[k] = (k, f"{rows[k][1]}\n{passage}", "en", f"s{n % 6}")
    item = X.sentence(rng, 30)
    rows += [(1000, f"{X.sentence(rng, 50)} {item}", "en", "s1"), (1001, rows[clean[20]][1], "en", "s1"), (1002, rows[clean[21]][1] + " more", "en", "s2")]
    X.documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, clean, passage


def test_pipeline_catches_what_is_planted_and_keeps_the_rest(spark, tmp_path):
    rows, clean, passage = planted(spark, str(tmp_path))
    docs, kept = table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "sentencepiece" or docs.columns == before
    assert set(kept["toxicity"]) == {i for i, *_ in rows} - set(range(0, 300, 5))
    holders = [k for k, r in kept["line_dedup"].items() if passage in r["text"]]
    assert holders == [min(clean[:8])] and set(kept["line_dedup"]) == set(kept["toxicity"])
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"].values())
    assert set(kept["line_dedup"]) - set(kept["near_dedup"]) == {1001, 1002}
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {1000}
    assert all(r["n_tokens"] == len(r["ids"]) for r in kept["sentencepiece"].values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(clean)


def test_stages_take_an_empty_table(spark, tmp_path):
    planted(spark, str(tmp_path))
    docs = table(spark, str(tmp_path), "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert oracle.compare(got, oracle.connect(SF).execute(queries.SQL[name]).df()) is None


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op1_multiprobe_neighbours"}))
def test_query_has_a_row_for_each_input_row(spark, name):
    source = "pages" if name.startswith("op4") else "documents"
    assert queries.QUERIES[name](spark, SF).count() == table(spark, SF, source).count()
