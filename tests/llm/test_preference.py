"""Pairwise quality: numbers of a text, pairs, likelihood, quantile, and planted quality on held-out rows."""

import random
import re
import zlib

import fixtures as X
import numpy as np
import pyarrow as pa
import pytest
from trialweave.llm import preference as P
from trialweave.llm import queries
from trialweave.llm.common import Hasher

TEXTS = [None, "", " \n", "Hi", "A b, a B! ok?? 12 NATO.\nA b, a B! ok??", "one two three four five one two three four five", "ÉTÉ été 7", "a\n\na\nb", "x" * 3000, "no no no yes"]


def plain(text):
    """The same numbers, text by text."""
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
    lines = [x for x in t.split("\n") if x]
    low = [w.lower() for w in words]
    n, letters, size = len(words), [c for c in t if c.isalpha()], max(1, len(t.encode()) + 1)

    def per(part, whole):
        return part / max(1, whole)

    def again(items):
        return per(len(items) - len(set(items)), len(items))

    def ends(w):
        return w[-1] in ".!?"

    capitals = sum(c.isupper() for c in letters)
    return {
        "words": np.log1p(n), "word length": np.log1p(per(sum(len(w.encode()) for w in words), n)), "line length": np.log1p(per(n, len(lines))),
        "sentence length": np.log1p(per(n, sum(map(ends, words)))), "capitals": per(capitals, sum(len(c.encode()) for c in letters)),
        "digits": per(sum(c.isdigit() for c in t), size), "words without a letter": per(sum(not any(map(str.isalpha, w)) for w in words), n),
        "words in capitals": per(sum(w.isupper() and sum(map(str.isalpha, w)) > 1 for w in words), n), "words ending a sentence": per(sum(map(ends, words)), n),
        "words ending in two signs": per(sum(len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum() for w in words), n),
        "words like the one before": per(sum(a == b for a, b in zip(low, low[1:])), n), "repeated words": again(low),
        "repeated pairs": again(list(zip(low, low[1:]))), "repeated passages": again(list(zip(*[low[k:] for k in range(5)]))), "repeated lines": again([x.lower() for x in lines]),
        "?": np.log1p(20 * per(t.count("?"), n)), ",": np.log1p(20 * per(t.count(","), n)),
    }


@pytest.mark.parametrize("cut", [1, 3, len(TEXTS)])
def test_numbers_of_a_text(cut):
    got = np.concatenate([P.features(pa.array(TEXTS[k : k + cut], pa.string()), Hasher(fold=False)) for k in range(0, len(TEXTS), cut)])
    for t, row in zip(TEXTS, got):
        own = dict(zip(P.NAMES, row))
        for name, value in plain(t).items():
            assert own[name] == pytest.approx(value), (t, name)


def test_pairs_use_every_row():
    for better, worse, most in ((3, 2, 99), (50, 7, 100), (7, 50, 100), (900, 20, 1000), (5, 0, 9), (0, 0, 9)):
        a, b = P.pairs(better, worse, most)
        assert len(a) == len(b) == len(set(zip(a, b))) <= max(most, better, worse)
        assert not (better and worse) or (set(a) == set(range(better)) and set(b) == set(range(worse)))


def test_gradient_and_optimum():
    rng = np.random.default_rng(1)
    d = rng.normal(0.4, 1, (200, 4))
    w = rng.normal(size=4)
    value, gradient, hessian = P.loss(w, d)
    assert value == pytest.approx(np.mean([np.log1p(np.exp(-r @ w)) for r in d]) + P.RIDGE / 2 * (w @ w))
    for k in range(4):
        e = np.eye(4)[k] * 1e-5
        assert gradient[k] == pytest.approx((P.loss(w + e, d)[0] - P.loss(w - e, d)[0]) / 2e-5, abs=1e-6)
        assert hessian[k] == pytest.approx((P.loss(w + e, d)[1] - P.loss(w - e, d)[1]) / 2e-5, abs=1e-5)
    x, y = rng.normal(size=(60, len(P.NAMES))), np.repeat([0, 1], 30)
    model = P.fit(x + y[:, None] * 0.3, y, (30, 30))
    z = np.clip((x + y[:, None] * 0.3 - model.centre) / model.scale, -8, 8)
    pairs = np.array([g - b for g in z[y > 0] for b in z[y == 0]])
    assert np.abs(P.loss(model.weight, pairs)[1]).max() < 1e-6


def test_quantile_follows_the_label_counts():
    raw, y = np.arange(10.0), np.array([0] * 5 + [1] * 5)
    assert P.quantile(raw, y, (5, 5)) == 4.5 and P.quantile(raw, y, (50, 50)) == 4.5
    assert P.quantile(raw, y | 1, (0, 9)) == -1 and P.quantile(raw, y * 0, (9, 0)) == 10
    assert P.quantile(raw, 1 - y, (100, 100)) == 4.5


def test_planted_quality_is_found_where_it_was_not_learned(spark, tmp_path):
    rng, rows, labels = random.Random(2), [], []
    for k in range(400):
        text = X.sentence(rng, rng.randrange(20, 80)) + "."
        if k % 3 == 0:
            text = re.sub(" ", "!! ", text).upper() if k % 2 else " ".join(w for w in text.split() for _ in "ab")
        rows.append((k, text, "en", "s"))
        labels.append((k, int(k % 3 != 0), 0))
    rows += [(None, None, None, None), (500, "", None, None), (501, " \n", None, None), (7, rows[7][1], "en", "t"), (502, "word " * 200_000, "en", "s")]
    X.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels += [(None, 1, 0), (9, None, 0), (3, 0, 1), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op12_pairwise_quality"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(out) > 60 and np.mean([r["predicted"] == (r["doc_id"] % 3 != 0) for r in out]) > 0.95


def test_no_labels_and_no_rows(spark):
    docs = X.documents(spark, [(1, "a b", "en", "s")])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = P.trained(docs, labels)
    assert P.score(docs, model).count() == 1 and P.score(docs.limit(0), model).count() == 0
    one = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert P.score(docs, P.trained(docs, one)).first()["quality"] > 0.7


def test_every_labelled_row_takes_part_in_the_fit(spark, monkeypatch):
    """The distributed fit equals the plain one over all rows, whatever the driver may look at."""
    monkeypatch.setattr(P, "CUT_ROWS", 5)
    rng = np.random.default_rng(3)
    for good, bad in ((300, 40), (30, 200)):
        y = np.array([True] * good + [False] * bad)
        x = rng.normal(0, 1, (len(y), len(P.NAMES))) + 0.3 * y[:, None]
        monkeypatch.setattr(P, "PAIRS", good * bad)  # all pairs, so that their choice is no matter
        rows = spark.createDataFrame([(k, bool(b), v.tolist()) for k, (b, v) in enumerate(zip(y, x))], "doc_id long, y boolean, features array<double>")
        got = P.fitted(rows, (bad, good))
        assert P.paired(rows, good, bad).count() == good * bad
        monkeypatch.setattr(P, "PAIRS", 1)
        met = P.paired(rows, good, bad)
        assert met.count() == max(good, bad)
        assert met.select("better").distinct().count() == good and met.select("worse").distinct().count() == bad
        monkeypatch.undo()
        monkeypatch.setattr(P, "CUT_ROWS", 5)
        want = P.fit(x, y.astype(int), (bad, good))
        z = np.clip((x - want.centre) / want.scale, -8, 8)
        a, b = np.divmod(np.arange(good * bad), bad)
        want.weight = P.newton(lambda w: P.loss(w, z[y][a] - z[~y][b]), np.zeros(len(P.NAMES)))
        want.cut = P.quantile(want.raw(x), y.astype(int), (bad, good))
        assert np.allclose(got.centre, want.centre) and np.allclose(got.scale, want.scale)
        assert np.allclose(got.weight, want.weight, atol=1e-6) and got.cut == pytest.approx(want.cut, abs=1e-5)
