"""The low-pass filter by chunks with borders against the moving sum."""

import math
import random

import pytest
from trialweave.operators import timeseries


@pytest.mark.parametrize("taps,chunk", [(5, 7), (4, 10), (31, 8), (301, 1 << 15), (1, 3)])
def test_filter_equals_the_moving_sum(spark, taps, chunk):
    rng = random.Random(taps)
    rows = [(r, f, None if rng.random() < 0.1 else rng.random(), f"note{f}") for r in (1, 2) for f in range(-20, 400) if rng.random() < 0.9]
    rows += [(3, 5, None, None), (3, 6, None, None), (1, 50, 0.25, "again")]
    rng.shuffle(rows)
    w = timeseries.fir_weights(taps, 0.1, 1.0)
    df = spark.createDataFrame(rows, "run int, frame int, v double, note string").repartition(3)
    got = timeseries.lowpass_fir(df, ["run"], "frame", "v", w, "smooth", chunk)
    assert got.columns == [*df.columns, "smooth"]
    have = sorted((tuple(r) for r in got.collect()), key=str)
    want = []
    for run, f, v, note in rows:
        top = low = 0.0
        seen = False
        for r, g, x, _ in rows:
            n = f - g + (taps - 1) // 2
            if r == run and 0 <= n < taps:
                low += w[n]
                seen = seen or x is not None
                top += w[n] * (x or 0.0)
        want.append((run, f, v, note, top / low if seen else None))
    want.sort(key=str)
    assert len(have) == len(want)
    for a, b in zip(sorted(have, key=lambda r: str(r[:4])), sorted(want, key=lambda r: str(r[:4]))):
        assert a[:4] == b[:4] and (a[4] is None) == (b[4] is None) and (a[4] is None or math.isclose(a[4], b[4], abs_tol=1e-9))


def test_empty_series(spark):
    assert timeseries.lowpass_fir(spark.createDataFrame([], "run int, frame int, v double"), ["run"], "frame", "v", [0.5, 0.5], "s").count() == 0
