"""Periodic runs against the definition, word by word."""

import hashlib
import random
import re
import zlib

import fixtures as X
import pyarrow as pa
import pytest
from trialweave.llm import periodic, queries


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def brute(w):
    """(start, length, period) of all runs: every lag, every maximal matching stretch, smallest period kept."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(12, 2 * q):
                found.setdefault((s, length), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def change(ident, text):
    w, h = words(text), zlib.crc32(str(ident).encode())
    g, n = h // 10, len(w)
    if ident is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def odd_texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a " * 11, "a " * 12, "a " * 400, "a b " * 50 + "a " + "a b " * 50, "x " + "a b c " * 4, "a b c d e f " * 2, "a b c d e f g " * 2]
    out += ["  é ü " * 9, "a\x0bb\x0ca b\ra\nb a b a b a b", "a\x1cb " * 12, "A a " * 8]
    for _ in range(150):  # few different words: many overlapping runs
        out.append(" ".join(rng.choice("ab") for _ in range(rng.randrange(80))))
        out.append(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20))) + " z")
    for _ in range(60):  # planted powers, nested ones among them
        unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 30))] * rng.randrange(1, 4)
        noise = [f"n{rng.randrange(99)}" for _ in range(rng.randrange(25))]
        w = noise + (unit * rng.randrange(2, 9))[: rng.randrange(10, 260)] + noise
        out.append(" ".join(w * rng.randrange(1, 4)))
    a, b = "a", "b"
    for _ in range(11):  # a Fibonacci text holds as many runs as a text can
        a, b = f"{a} {b}", a
    return [*out, a]


def test_runs_equal_the_definition():
    texts = odd_texts()
    for group in ([*texts], *[[t] for t in texts[:40]]):
        got = periodic.analyse(pa.array(group, pa.string())).to_pylist()
        for t, r in zip(group, got):
            w = words(t)
            own = [(x["start"], x["length"], x["period"]) for x in r["runs"]]
            assert own == brute(w), t
            assert r["collapsed"] == collapsed(w, own)


def test_one_word_repeated_and_long_texts_stay_linear():
    long = ["w " * 300_000, "a b " * 60_000 + "a " + "a b " * 60_000, " ".join(f"w{k % 50_000}" for k in range(200_000))]
    got = periodic.analyse(pa.array(long, pa.string())).to_pylist()
    assert [(r["start"], r["length"], r["period"]) for r in got[0]["runs"]] == [(0, 300_000, 1)] and got[0]["collapsed"] == "w"
    assert (0, 200_000, 50_000) in [(r["start"], r["length"], r["period"]) for r in got[2]["runs"]]
    assert len(got[1]["runs"]) > 50_000  # one run for each odd period around the joint


@pytest.mark.parametrize("extra", [True, False])
def test_query_equals_brute_force(spark, tmp_path, extra):
    rng = random.Random(8)
    texts = [*odd_texts()[:60], *[X.sentence(rng, rng.randrange(120)) for _ in range(160)]]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(5, "a b " * 20, None, None), (5, "a b " * 20, None, None), (None, "a b " * 20, None, None), (-90, "a b " * 20, None, None)]
    X.documents(spark, rows, extra).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, _, _ in rows:
        w = change(i, t)
        runs = brute(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        fields = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *fields, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert [c for c, k in got.dtypes if k == "bigint"] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_no_rows(spark):
    assert periodic.find_runs(X.documents(spark, [])).count() == 0
