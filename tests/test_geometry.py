"""Distances and regressions against closed forms and NumPy."""

import inspect
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.operators import distances, regression, responses


def test_crossnobis_closed_form(spark):
    x = [[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]]
    df = spark.createDataFrame([(1, 1, c, x[c], x[c]) for c in range(3)], "k int, split int, c int, a array<double>, b array<double>")
    d = {(r.i, r.j): r.d for r in distances.crossnobis(df, ["k"], "c").collect()}
    assert d == {(0, 1): 0.5, (0, 2): 2.0, (1, 2): 2.5}
    flipped = df.withColumn("b", F.transform("b", lambda v: -v))
    assert {(r.i, r.j): r.d for r in distances.crossnobis(flipped, ["k"], "c").collect()}[(0, 1)] == -0.5


def test_contrast_closed_form(spark):
    df = spark.createDataFrame([(c, 0, 4.0 if c == 1 else 1.0) for c in range(4)], "c int, dim int, v double")
    out = {r.target: r.contrast for r in responses.class_contrasts(df, "c", ["dim"], "v", [0, 1, 2, 3]).collect()}
    assert out[1] == pytest.approx(3.0) and sum(out.values()) == pytest.approx(0.0)


def test_residuals_covariance_and_whitener(spark):
    rng = np.random.default_rng(8)
    n, d = 240, 6
    run, cond = rng.integers(0, 8, n), rng.integers(0, 10, n)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + run[:, None] * 0.5 + cond[:, None] * 0.3
    pdf = pd.DataFrame({"unit": range(n), "run": run, "condition": cond, "x": x.tolist(), "region": 1})
    u = spark.createDataFrame(pdf, "unit bigint, run int, condition int, x array<double>, region int")
    res = distances.run_condition_residuals(u, "run", "condition", "x", d)
    design = np.column_stack([run[:, None] == np.arange(8), cond[:, None] == np.arange(10)]).astype(float)
    want = x - design @ np.linalg.lstsq(design, x, rcond=None)[0]
    got = res.toPandas().sort_values("unit")
    np.testing.assert_allclose(np.stack(got["residual"]), want, atol=1e-8)
    dof = n - np.linalg.matrix_rank(design)
    assert (got["dof"] == dof).all()
    sums = distances.product_sums(res.select("region", "dof", "residual"), ["region", "dof"], "residual")
    w = distances.shrink_covariance(sums, ["region"], "dof").first()
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = w.covariance
    cov = cov + np.triu(cov, 1).T
    np.testing.assert_allclose(np.diag(cov), np.diag(want.T @ want / dof), atol=1e-8)
    assert 0 <= w.shrinkage <= 1
    m = np.asarray(w.whitener)
    np.testing.assert_allclose(m @ cov @ m, np.eye(d), atol=1e-8)


def standardised(a):
    return (a - a.mean(0)) / a.std(0, ddof=1)


def test_ols_matches_numpy_and_reports_status(spark):
    rng = np.random.default_rng(6)
    n = 200
    x = rng.normal(size=(n, 3))
    f = (rng.random(n) < 0.4).astype(float)
    y = x @ [1.0, -2.0, 0.3] + f + rng.normal(size=n)
    pdf = pd.DataFrame({"g": 1, "y": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "f": f})
    flat, few = pdf.assign(g=2, b=1.0), pdf.head(3).assign(g=3)
    gap = pdf.assign(g=4)
    gap.loc[:9, "a"] = np.nan
    out = regression.ols(spark.createDataFrame(pd.concat([pdf, flat, few, gap])), ["g"], "y", ["a", "b", "c"], ["f"]).toPandas().set_index("g")
    design = np.column_stack([np.ones(n), standardised(x), f])
    z = standardised(y)
    beta, *_ = np.linalg.lstsq(design, z, rcond=None)
    np.testing.assert_allclose(out.loc[1, "beta"], beta[1:], atol=1e-8)
    r2 = 1 - ((z - design @ beta) ** 2).sum() / (z**2).sum()
    assert out.loc[1, "r2"] == pytest.approx(r2, abs=1e-8)
    less = np.delete(design, 1, 1)
    sse = ((z - less @ np.linalg.lstsq(less, z, rcond=None)[0]) ** 2).sum()
    assert out.loc[1, "delta_r2"][0] == pytest.approx(r2 - (1 - sse / (z**2).sum()), abs=1e-8)
    assert out.loc[2, "status"] == "constant_predictor:b" and out.loc[3, "status"] == "too_few_valid_rows"
    assert out.loc[4, "n_dropped"] == 10 and out.loc[4, "status"] == "ok"


def test_rsa_matches_numpy(spark):
    rng = np.random.default_rng(11)
    k, perms = 8, 3
    up = [(i, j) for i in range(k) for j in range(i + 1, k)]
    d = rng.random((k, k))
    d = (d + d.T) / 2
    p1, p2 = rng.random(len(up)), rng.random(len(up))
    neural = spark.createDataFrame([(0, 1, i, j, float(d[i, j])) for i, j in up], "subject int, region int, i int, j int, d double")
    design = spark.createDataFrame([(0, i, j, float(a), float(b)) for (i, j), a, b in zip(up, p1, p2)], "subject int, i int, j int, p1 double, p2 double")
    maps = [rng.permutation(k) for _ in range(perms)]
    mapping = spark.createDataFrame([(0, p + 1, i, int(maps[p][i])) for p in range(perms) for i in range(k)], "subject int, perm int, index int, mapped int")
    observed, null = regression.rsa(neural, design, mapping, ["subject"], ["region"], ["p1", "p2"], [])
    x = np.column_stack([np.ones(len(up)), standardised(np.column_stack([p1, p2]))])

    def beta(m):
        y = standardised(np.array([m[i, j] for i, j in up]))
        return np.linalg.lstsq(x, y, rcond=None)[0][1:]

    got = observed.toPandas().set_index("predictor")["beta"]
    np.testing.assert_allclose(got[["p1", "p2"]], beta(d), atol=1e-9)
    n = null.toPandas()
    for p in range(perms):
        moved = d[np.ix_(maps[p], maps[p])]
        got = n[n.perm == p + 1].set_index("predictor")["beta"]
        np.testing.assert_allclose(got[["p1", "p2"]], beta(moved), atol=1e-9)


def test_mass_univariate_matches_numpy(spark):
    rng = np.random.default_rng(12)
    n = 60
    g = rng.integers(0, 2, n).astype(float)
    y = rng.normal(size=(n, 2)) + g[:, None]
    rows = [(int(k), dim, float(g[k]), float(y[k, dim])) for k in range(n) for dim in range(2)]
    out = responses.mass_univariate_ols(spark.createDataFrame(rows, "u int, dim int, g double, v double"), ["dim"], "v", [F.lit(1.0), F.col("g")], [0.0, 1.0]).toPandas()
    x = np.column_stack([np.ones(n), g])
    for r in out.itertuples():
        b, sse, *_ = np.linalg.lstsq(x, y[:, r.dim], rcond=None)
        se = np.sqrt(sse[0] / (n - 2) * np.linalg.inv(x.T @ x)[1, 1])
        assert r.estimate == pytest.approx(b[1]) and r.t == pytest.approx(b[1] / se) and r.dof == n - 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_omnibus_rsa_returns_its_null(spark):
    from trialweave.plans import geometry

    got = geometry.omnibus_rsa(spark, "/root/testdata/sf0.001", perms=30).toPandas()
    assert len(got) and (got.n_perm == 30).all() and got.p.between(1 / 31 - 1e-6, 1).all() and got.null_sd.notna().all()
    assert inspect.signature(geometry.omnibus_rsa).parameters["perms"].default == 5_000
