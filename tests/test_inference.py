"""Closed-form values of the inference operators."""

import numpy as np
import pandas as pd
import pytest

from trialweave.operators import inference, sampling


@pytest.mark.parametrize("observed,p", [(10.0, 0.2), (0.0, 0.2), (5.0, 1.0)])
def test_two_sided(spark, observed, p):
    o = spark.createDataFrame([(1, observed)], "k int, v double")
    n = spark.createDataFrame([(1, i, float(i)) for i in range(1, 10)], "k int, perm int, v double")
    assert inference.p_two_sided(o, n, ["k"], "v").first()["p"] == pytest.approx(p)


def test_two_sided_all_ties(spark):
    o = spark.createDataFrame([(1, 2.0)], "k int, v double")
    n = spark.createDataFrame([(1, i, 2.0) for i in range(9)], "k int, perm int, v double")
    assert inference.p_two_sided(o, n, ["k"], "v").first()["p"] == 1.0


def test_maximum_statistic(spark):
    rng = np.random.default_rng(1)
    obs = rng.normal(size=(4, 3))
    obs[1, 2] = 6.0
    o = spark.createDataFrame([(c, x, float(obs[c, x])) for c in range(4) for x in range(3)], "centre int, context int, v double")
    null = rng.normal(size=(4, 3, 99))
    n = spark.createDataFrame([(c, x, p + 1, float(null[c, x, p])) for c in range(4) for x in range(3) for p in range(99)], "centre int, context int, perm int, v double")
    out = inference.maxstat_studentised(o, n, ["centre", "context"], [], "v").toPandas()
    hit = out[(out.centre == 1) & (out.context == 2)].iloc[0]
    assert hit.p_uncorrected == pytest.approx(0.01) and hit.p_fwe == pytest.approx(0.01)
    assert (out.p_fwe >= out.p_uncorrected - 1e-12).all()


def test_sign_flip_floor(spark):
    e = spark.createDataFrame([(s, t, 1.0) for s in range(5) for t in range(2)], "subject int, test int, v double")
    out = inference.sign_flip_exact(e, [], ["test"], "subject", "v").toPandas()
    assert (out.p == 1 / 32).all() and (out.p_fwe >= out.p).all()


def test_stouffer(spark):
    df = spark.createDataFrame([(1, 0.01), (1, 0.01), (2, 0.0), (2, 1.0), (3, 0.5)], "k int, p double")
    out = inference.stouffer(df, ["k"], "p", 2).toPandas().set_index("k")
    assert out.loc[1, "p"] < 0.01 and np.isfinite(out.loc[2, "z"]) and 3 not in out.index


def test_pooled_p_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    null, obs = rng.integers(0, 30, 400).astype(float), rng.integers(0, 32, 40).astype(float)
    o = spark.createDataFrame(pd.DataFrame({"id": range(40), "v": obs}))
    got = inference.p_pooled(o, spark.createDataFrame(pd.DataFrame({"v": null})), "v").toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(got["p"], [(null >= v).mean() for v in obs])


def test_permutation_keeps_counts_and_repeats(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"unit": range(200), "run": np.where(np.arange(200) < 120, 0, rng.integers(1, 5, 200)), "y": rng.integers(0, 3, 200)})
    df = spark.createDataFrame(pdf)
    a = sampling.permute_within(df, ["run"], "unit", "y", 3).toPandas().sort_values(["perm", "unit"]).reset_index(drop=True)
    b = sampling.permute_within(df.repartition(17), ["run"], "unit", "y", 3).toPandas().sort_values(["perm", "unit"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a[["perm", "unit", "permuted"]], b[["perm", "unit", "permuted"]])
    c = sampling.permute_within(df, ["run"], "unit", "y", 3, seed=2).toPandas().sort_values(["perm", "unit"]).reset_index(drop=True)
    assert not a["permuted"].equals(c["permuted"])
    for _, part in a.merge(pdf[["unit", "y"]], on="unit").groupby(["perm", "run"]):
        assert sorted(part["permuted"]) == sorted(part["y"])


def test_halves_cover_and_are_distinct(spark):
    rows = [(r, r // 5, i, c) for r in range(20) for i in range(3) for c in range(2)]
    df = spark.createDataFrame(rows, "run int, session int, item int, context int")
    s = sampling.split_halves(df, "run", "session", ["item", "context"], 6, 40).toPandas()
    assert s.split.nunique() == 6
    sets = {tuple(sorted(p[p.in_a].run)) for _, p in s.groupby("split")}
    assert len(sets) == 6 and all(len(x) == 10 and 0 in x for x in sets)
    per = s.assign(session=s.run // 5).groupby(["split", "session"])["in_a"].sum()
    assert set(per) <= {2, 3}


def test_uncovered_halves_give_no_split(spark):
    df = spark.createDataFrame([(r, 0, 0, int(r == 0)) for r in range(4)], "run int, session int, item int, context int")
    assert sampling.split_halves(df, "run", "session", ["item", "context"], None, 10).count() == 0


NAN = float("nan")


def test_missing_observed_values_get_no_p(spark):
    from trialweave.operators import inference

    obs = spark.createDataFrame([(1, None), (2, NAN), (3, float("inf")), (4, 0.5)], "t int, v double")
    null = spark.createDataFrame([(t, k, NAN if k == 1 else None if k == 2 else k / 100) for t in (1, 2, 3, 4) for k in range(100)], "t int, perm int, v double")
    for fn in (inference.p_upper, inference.p_two_sided):
        got = {r["t"]: r for r in fn(obs, null, ["t"], "v").collect()}
        assert [got[t]["p"] for t in (1, 2, 3)] == [None] * 3 and got[4]["n_perm"] == 98
    assert abs(got[4]["p"] - 2 * (98 - 48 + 1 - 1) / 99) < 0.05
    fwe = {r["t"]: r["p_fwe"] for r in inference.maxstat_fwe(obs, null, ["t"], [], "v").collect()}
    assert fwe[1] is None and fwe[2] is None and fwe[3] is None and fwe[4] > 0.4
    full = {r["t"]: r for r in inference.maxstat_studentised(obs, null, ["t"], [], "v").collect()}
    assert len(full) == 4 and full[2]["p_fwe"] is None and full[4]["p_uncorrected"] is not None
    pooled = {r["t"]: r["p"] for r in inference.p_pooled(obs, null, "v").collect()}
    assert pooled[2] is None and 0.4 < pooled[4] < 0.6


def test_sign_flips_use_the_place_of_a_subject(spark):
    import pytest
    from trialweave.operators import inference

    rows = [(s, "a", 1.0 + s / 10) for s in (2, 3, 4, 6, 7)]
    got = inference.sign_flip_exact(spark.createDataFrame(rows, "s int, t string, v double"), [], ["t"], "s", "v").collect()
    assert [(r["p"], r["p_fwe"]) for r in got] == [(1 / 32, 1 / 32)]
    with pytest.raises(Exception, match="several values"):
        inference.sign_flip_exact(spark.createDataFrame(rows + rows[:1], "s int, t string, v double"), [], ["t"], "s", "v").collect()
