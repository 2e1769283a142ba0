"""Fits under permuted conditions against plain least squares, and the queries that use them."""

import inspect
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from trialweave.operators import gather, regression

SF = "/root/testdata/sf0.001"


def standardised(x):
    return (x - x.mean(0)) / x.std(0, ddof=1)


def rows(spark, hole=False):
    rng = np.random.default_rng(3)
    names = [3, 4, 7, 10, 11, 20, 21, 30, 33]  # condition codes need not be places
    up = [(a, b) for a in range(9) for b in range(a + 1, 9)]
    d = {r: (lambda m: (m + m.T) / 2)(rng.random((9, 9))) for r in (1, 2)}
    neural = [(0, r, names[a], names[b], None if hole and (r, a, b) == (2, 0, 5) else float(d[r][a, b])) for r in d for a, b in up]
    x = rng.random((len(up), 2))
    extra = (rng.random(len(up)) < 0.5).astype(float)
    design = [(0, names[a], names[b], float(x[k, 0]), float(x[k, 1]), float(extra[k])) for k, (a, b) in enumerate(up) if k % 4]
    kept = [k for k in range(len(up)) if k % 4]
    frames = spark.createDataFrame(neural, "subject int, region int, i int, j int, d double"), spark.createDataFrame(design, "subject int, i int, j int, p double, q double, f double")
    return *frames, d, [up[k] for k in kept], x[kept], extra[kept], names


@pytest.mark.parametrize("block", [1, 4, 250])
def test_fits_equal_least_squares_for_every_permutation(spark, block):
    neural, design, d, pairs, x, extra, names = rows(spark)
    done = gather.fits(neural, design, ["subject"], ["region"], ["p", "q"], ["f"], 9, block=block).toPandas()
    assert sorted(zip(done.region, done.perm)) == [(r, p) for r in (1, 2) for p in range(10)] and (done.status == "ok").all()
    drawn = gather.mappings(neural.select("subject", F.explode(F.array("i", "j")).alias("index")), ["subject"], "index", 9, block=block).collect()
    maps = {r["block"] + k: m for r in drawn for k, m in enumerate(r["maps"])}
    assert maps[0] == list(range(9)) and all(sorted(m) == maps[0] for m in maps.values()) and len({tuple(m) for m in maps.values()}) == 10
    a = np.column_stack([np.ones(len(pairs)), standardised(x), extra])
    for r in done.itertuples():
        m = maps[r.perm]
        y = standardised(np.array([d[r.region][m[i], m[j]] for i, j in pairs]))
        want = np.linalg.lstsq(a, y, rcond=None)[0]
        np.testing.assert_allclose(r.beta, want[1:], atol=1e-9)
        r2 = 1 - ((y - a @ want) ** 2).sum() / (y**2).sum()
        assert r.r2 == pytest.approx(r2) and r.adjusted_r2 == pytest.approx(1 - (1 - r2) * (len(y) - 1) / (len(y) - 4)) and r.n == len(pairs)


def test_draws_are_those_of_the_plain_path(spark):
    """With conditions 0, 1, ... the blocked fits equal the join of permutations x pairs."""
    neural, design, *_, names = rows(spark)
    place = F.create_map(*[F.lit(v) for k, c in enumerate(names) for v in (c, k)])
    neural, design = (t.withColumns({c: place[F.col(c)] for c in ("i", "j")}) for t in (neural, design))
    done = gather.fits(neural, design, ["subject"], ["region"], ["p", "q"], ["f"], 6)
    maps = gather.mappings(neural.select("subject", F.explode(F.array("i", "j")).alias("index")), ["subject"], "index", 6)
    flat = maps.select("subject", "block", F.posexplode("maps").alias("k", "m")).select("subject", (F.col("block") + F.col("k")).alias("perm"), F.posexplode("m").alias("index", "mapped"))
    observed, null = regression.rsa(neural, design, flat.where("perm > 0"), ["subject"], ["region"], ["p", "q"], ["f"])
    want = {(r["region"], r["perm"], r["predictor"]): r["beta"] for r in null.collect()} | {(r["region"], 0, r["predictor"]): r["beta"] for r in observed.collect()}
    got = {(r["region"], r["perm"], r["predictor"]): r["beta"] for r in gather.coefficients(done, ["subject", "region"], ["p", "q"]).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_what_cannot_be_fitted_keeps_its_rows(spark):
    neural, design, *_ = rows(spark, hole=True)
    done = gather.fits(neural, design, ["subject"], ["region"], ["p", "q"], [], 20).toPandas()
    assert set(done[done.region == 1].status) == {"ok"} and set(done[done.region == 2].status) == {"ok", "missing_distance"}
    lost = done[done.status != "ok"]
    assert lost.beta.isna().all() and lost.r2.isna().all() and len(done) == 42
    flat = gather.fits(neural.withColumn("d", F.lit(1.0)), design, ["subject"], ["region"], ["p"], [], 2).toPandas()
    assert set(flat.status) == {"constant_outcome"}
    twice = gather.fits(neural, design.withColumn("q", F.col("p")), ["subject"], ["region"], ["p", "q"], [], 2).toPandas()
    assert set(twice.status) == {"unusable_design"}
    assert gather.fits(neural.limit(0), design, ["subject"], ["region"], ["p"], [], 2).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_queries_return_full_tables(spark):
    from trialweave.plans import geometry

    for name in ("omnibus_rsa", "displacement_rsa", "rsa_statistics"):
        assert inspect.signature(getattr(geometry, name)).parameters["perms"].default == 5_000
    got = geometry.rsa_statistics(spark, SF, perms=40).toPandas()
    tested = got[got.level.isin(["subject", "group"])]
    assert (tested.n_perm == 40).all() and tested.p.between(1 / 41 - 1e-6, 1).all() and tested.null_sd.notna().all()
    assert set(got.model) == {"omnibus", "pair_and_item", "pair"} and set(got.level) == {"subject", "group", "nuisance", "fit"}
    assert got[got.level == "fit"].beta.between(-1, 1).all()
