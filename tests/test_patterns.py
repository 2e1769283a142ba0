"""Planted patterns must be found, noise must not."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.functions import vectors
from trialweave.operators import learners, patterns, sampling, spatial, splithalf, summaries, transfer

WHOLE = lambda width: patterns.slices(1, width)


def make(spark, rows, x):
    pdf = pd.DataFrame(rows, columns=["unit", "item", "context", "run", "session"])
    pdf["x"] = list(np.asarray(x, dtype=float).tolist())
    return spark.createDataFrame(pdf, "unit bigint, item int, context int, run int, session int, x array<double>").cache()


def transfer_units(spark, by_context):
    rng = np.random.default_rng(7)
    code = rng.normal(size=(4, 20, 120)) if by_context else np.repeat(rng.normal(size=(1, 20, 120)), 4, 0)
    rows, x = [], []
    for r in range(1, 4):
        for c in range(4):
            for i in range(1, 21):
                rows.append((len(rows), i, c, r, 1))
                x.append(code[c, i - 1] + 0.15 * rng.normal(size=120))
    return make(spark, rows, x)


def summary(spark, units):
    d = transfer.context_transfer(units, 3, "x", WHOLE(120), 120)
    return transfer.transfer_summary(transfer.transfer_cells(d, ["region"]), ["region"], 3).first()


def test_shared_item_patterns_transfer(spark):
    s = summary(spark, transfer_units(spark, False))
    assert s.within_accuracy > 0.95 and s.cross_accuracy > 0.95 and abs(s.evidence_effect) < 0.02


def test_context_bound_item_patterns_do_not_transfer(spark):
    s = summary(spark, transfer_units(spark, True))
    assert s.within_accuracy > 0.95 and s.cross_accuracy < 0.20 and s.evidence_effect > 0.70


def test_shuffled_items_give_no_evidence(spark):
    u = transfer_units(spark, False)
    drawn = sampling.permute_within(u, ["context", "run"], "unit", "item", 1)
    s = summary(spark, patterns.permuted_units(u, drawn, "unit", "item").drop("perm"))
    assert abs(s.within_evidence) < 0.10 and s.within_accuracy < 0.15


def cross_units(spark, kind):
    rng = np.random.default_rng(5)
    shared, own = rng.normal(size=(3, 180)), rng.normal(size=(3, 20, 180))
    rows, x = [], []
    for r in range(1, 5):
        for i in range(1, 21):
            for c in range(3):
                rows.append((len(rows), i, c, r, 1))
                base = {"shared": shared[c], "item": own[c, i - 1], "none": 0}[kind]
                x.append(base + rng.normal(size=180))
    return make(spark, rows, x)


@pytest.mark.parametrize("kind", ["shared", "item", "none"])
def test_cross_item_transfer(spark, kind):
    s = transfer.cross_item_summary(transfer.cross_item_transfer(cross_units(spark, kind), "x", WHOLE(180), None), ["region"]).first()
    if kind == "shared":
        assert s.accuracy > 0.90 and s.evidence > 0.25
    elif kind == "item":
        assert abs(s.evidence) < 0.10 and s.accuracy < 0.50
    else:
        assert abs(s.evidence) < 0.05 and abs(s.accuracy - 1 / 3) < 0.10


@pytest.fixture(scope="module")
def halves(spark):
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.normal(size=(40, 3)))[0].T * 4
    rows, x = [], []
    for r in range(1, 9):
        for i in range(1, 5):
            for c in range(3):
                rows.append((len(rows), i, c, r, (r + 1) // 4))
                x.append(q[c] + 0.7 * rng.normal(size=40))
    u = make(spark, rows, x)
    return u, sampling.split_halves(u, "run", "session", ["item", "context"], 5, 60).cache()


def test_split_half_finds_planted_contexts(spark, halves):
    u, s = halves
    out = splithalf.split_half(u, s, [], "x").toPandas()
    overall, own = out[out.context.isna()].iloc[0], out[out.context.notna()]
    assert overall.mean_delta > 0.5 and overall.n_splits == 5
    assert own.mean_delta.mean() == pytest.approx(overall.mean_delta, abs=1e-10)


def test_neighbourhood_equals_region_estimator(spark, halves):
    u, s = halves
    members = spark.createDataFrame([(1, d) for d in range(12)] + [(2, d) for d in range(9, 25)], "centre int, dim int")
    near = splithalf.split_half(u, s, [], "x", patterns.neighbourhoods(members)).toPandas()
    for centre, (a, b) in {1: (0, 12), 2: (9, 25)}.items():
        cut = u.withColumn("x", F.slice("x", a + 1, b - a))
        want = splithalf.split_half(cut, s, [], "x").toPandas().set_index("context")["mean_delta"]
        got = near[near.centre == centre].set_index("context")["mean_delta"]
        np.testing.assert_allclose(got.sort_index().to_numpy(), want.sort_index().to_numpy(), atol=1e-10)


def numpy_decode(pdf, label, scale):
    x, y, run = np.stack(pdf["x"]), pdf[label].to_numpy(), pdf["run"].to_numpy()
    x = x - np.stack([x[run == r].mean(0) for r in run])
    out = np.zeros(len(y), dtype=int)
    for r in np.unique(run):
        tr, te = run != r, run == r
        a, b = x[tr], x[te]
        if scale:
            mu, sd = a.mean(0), a.std(0, ddof=1)
            a, b = (a - mu) / sd, (b - mu) / sd
        classes = np.unique(y[tr])
        t = np.stack([a[y[tr] == c].mean(0) for c in classes])
        out[te] = classes[np.argmax(np.corrcoef(np.vstack([b, t]))[: len(b), len(b):], axis=1)]
    return out


@pytest.mark.parametrize("scale", [False, True])
@pytest.mark.parametrize("width", [None, 40])
def test_decode_equals_numpy(spark, halves, scale, width):
    u, _ = halves
    got = patterns.decode(u, "unit", "run", "item", "x", WHOLE(40), width, scale=scale).toPandas().sort_values("unit")
    pdf = u.toPandas().sort_values("unit")
    assert (got["predicted"].to_numpy() == numpy_decode(pdf, "item", scale)).all()


def test_decode_with_labels_equals_decode_of_relabelled_units(spark, halves):
    u, _ = halves
    drawn = sampling.permute_within(u, ["run"], "unit", "context", 2)
    own = u.select(F.lit(0).alias("perm"), "unit", F.col("context").alias("permuted"))
    labels = drawn.select("perm", "unit", "permuted").unionByName(own)
    both = patterns.decode(u, "unit", "run", "context", "x", WHOLE(40), 40, labels).toPandas()
    for p in (0, 2):
        moved = patterns.permuted_units(u, labels.where(F.col("perm") == p), "unit", "context").drop("perm")
        want = patterns.decode(moved, "unit", "run", "context", "x", WHOLE(40), 40).toPandas().sort_values("unit")
        got = both[both.perm == p].sort_values("unit")
        assert (got["predicted"].to_numpy() == want["predicted"].to_numpy()).all()
        np.testing.assert_allclose(got["evidence"], want["evidence"], atol=1e-10)


def test_learners_find_planted_contexts(spark, halves):
    u, _ = halves
    u = u.withColumn("region", F.lit(1))
    for d in (
        learners.svm_cross_validate(u, ["region"], "unit", "run", "context", "x", [0, 1, 2], 1.0),
        learners.lda_cross_validate(u, ["region"], "unit", "run", "context", "x", [0.5]),
    ):
        acc = summaries.accuracy(d, ["region"], "context", "predicted").first()
        assert acc.n_units == 96 and acc.accuracy > 0.9


def test_nested_selection_scores_every_unit_once(spark, halves):
    u, _ = halves
    u = u.withColumns({"region": F.lit(1), "fold": ((F.col("run") - 1) % 3 + 1).cast("int"), "x": F.slice("x", 1, 8)})
    out = learners.nested_selection(u, ["region"], "unit", "run", "fold", "context", "x", [0, 1, 2], [0.1, 0.9], [0.1, 1.0]).toPandas()
    assert out.n_units.sum() == 96 and len(out) == 3 and out.candidate.between(1, 4).all() and (out.accuracy > 0.6).all()


def test_sphere_has_33_cells_and_isolated_cell_is_dropped(spark):
    cube = [(i, j, k) for i in range(9) for j in range(9) for k in range(9)]
    mm = [[2.0, 0, 0, 0], [0, 2.0, 0, 0], [0, 0, 2.0, 0]]
    offsets = spatial.offsets_mm(mm, 4.0)
    assert len(offsets) == 33
    mask = spark.createDataFrame([*cube, (40, 40, 40)], "i int, j int, k int")
    n = spatial.neighbours(mask, mask, offsets, 10).groupBy("i", "j", "k").count().toPandas()
    assert n[(n.i == 4) & (n.j == 4) & (n.k == 4)]["count"].iloc[0] == 33
    assert not (n.i == 40).any() and len(n) == 729


def test_components_across_tiles(spark):
    line = [(i, 0, 0) for i in range(150)] + [(i, 5, 0) for i in range(10, 75)] + [(149, j, 0) for j in range(1, 40)] + [(70, 5, k) for k in range(1, 90)]
    lone = [(3, 9, 9)]
    out = spatial.connected_components(spark.createDataFrame(line + lone, "i int, j int, k int")).toPandas()
    assert out.label.nunique() == 3
    assert set(out.groupby("label").size()) == {150 + 39, 65 + 89, 1}


def test_wide_and_narrow_sums_agree(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(k), rng.normal(size=5).tolist()) for k in rng.integers(0, 3, 50)], "k int, x array<double>")
    a = vectors.sum_vectors(df, ["k"], "x").toPandas().sort_values("k")
    b = vectors.sum_vectors(df, ["k"], "x", width=5).toPandas().sort_values("k")
    np.testing.assert_allclose(np.stack(a["total"]), np.stack(b["total"]))
    assert (a["n"].to_numpy() == b["n"].to_numpy()).all()
