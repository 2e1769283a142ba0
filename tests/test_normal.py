"""Normal functions against the standard library."""

import math
from statistics import NormalDist

from trialweave.functions.normal import normal_cdf, normal_quantile


def test_normal_functions(spark):
    n = NormalDist()
    xs = [-38.0, -9.0, -7.5, -7.0, -1.96, -0.3, 0.0, 1e-9, 0.5, 3.0, 7.2, 40.0, None, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(normal_cdf("x")).collect()]
    assert got[-2] is None and math.isnan(got[-1])
    assert all(math.isclose(g, n.cdf(x), rel_tol=1e-9, abs_tol=1e-15) for g, x in zip(got, xs[:-2]))
    ps = [1e-15, 1e-9, 0.001, 0.02425, 0.3, 0.5, 0.9, 0.97575, 0.999999, None, float("nan"), -1.0, 0.0, 1.0]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").orderBy("i").select(normal_quantile("p")).collect()]
    assert all(math.isclose(g, n.inv_cdf(p), rel_tol=3e-9, abs_tol=1e-8) for g, p in zip(got, ps[:9]))
    assert got[9] is None and math.isnan(got[10]) and math.isnan(got[11]) and got[12:] == [-math.inf, math.inf]
