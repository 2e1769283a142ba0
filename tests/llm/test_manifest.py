"""The dataset manifest against a plain tree, with small segments so that proofs pass many records."""

import hashlib
import random

import fixtures as X
import pytest
from pyspark.sql import functions as F
from trialweave.llm import merkle


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, more=0):
    i, text, lang, source = r
    n = None if text is None else len(text) + more
    return H("".join(map(coded, (i, source, lang, n, text))))


def climb(nodes, arity):
    """(top, for each place its steps from the leaf upwards)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            run = a - a % arity
            steps[k].append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + arity])))
        at = [a // arity for a in at]
        nodes = [H("".join(nodes[k : k + arity])) for k in range(0, len(nodes), arity)]
    return nodes[0], steps


def brute(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[g] = climb([leaf(r) for r in groups[g]], arity)
    root, upper = climb([made[g][0] for g in order], arity)
    return sorted((leaf(r), made[g][0], root, tuple(made[g][1][k] + up)) for g, up in zip(order, upper) for k, r in enumerate(groups[g]))


def build(spark, rows, arity, most):
    docs = X.documents(spark, rows)
    return merkle.manifest(docs, merkle.leaf_digest(*[F.col(c) for c in merkle.DOCUMENT]), "lang", "doc_id", {"doc_id": F.col("doc_id")}, arity, most)


def rows_of(count):
    rng = random.Random(count)
    rows = [(k, X.sentence(rng, 3), "en", "a") for k in range(count)]
    rows += [(k, "été", "de", None) for k in range(5)] + [(9, None, None, "x"), (None, "t", None, ""), (3, "", "", "b"), (1, "Z", "zz", "b"), (1, "Z", "Z", "b")]
    return rows + [(7, "same", "fr", "s")] * 6 + [(None, None, "fr", None)] * 3 + [(7, "other", "fr", "s")]


@pytest.mark.parametrize("arity,most,count", [(2, 10, 33), (2, 1, 9), (2, 2, 37), (3, 2, 30)])
def test_proofs_equal_a_plain_tree(spark, arity, most, count):
    rows = rows_of(count)
    made = build(spark, rows, arity, most)
    got = merkle.proofs(made, made.leaves).withColumn("end", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r["end"] == r["root"] for r in got)
    assert sorted((r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["proof"])) for r in got) == brute(rows, arity)


def test_some_requests_and_tampering(spark):
    made = build(spark, rows_of(40), 2, 2)
    asked = made.leaves.where("doc_id % 5 = 1")
    found = merkle.proofs(made, asked).withColumn("end", merkle.folded(F.sha2(F.concat("leaf", F.lit("x")), 256), F.col("proof")))
    assert found.count() == asked.count() > 8 and found.where("end = root").count() == 0


def test_one_row_and_none(spark):
    row = (1, "only", "en", "a")
    made = build(spark, [row], 2, 10)
    (r,) = merkle.proofs(made, made.leaves).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == leaf(row) and r["proof"] == []
    none = build(spark, [], 2, 10)
    assert merkle.proofs(none, none.leaves).count() == 0 and none.root.tops.count() == 0
