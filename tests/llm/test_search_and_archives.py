"""Neighbour search and WARC archives."""

import io
import random
import re

import numpy as np
import pytest
from trialweave.llm import ann, warc


def brute(ids, x, q, count):
    own = np.flatnonzero(ids == q)[0]
    score = np.cumsum(x * x[own], axis=1)[:, -1]
    order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-score[i], ids[i]))
    return [(int(ids[i]), score[i]) for i in order[:count]]


def test_neighbours_reach_the_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 16))
    x = centre[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    x[:900] = x[0]  # a third of the rows are one vector
    ids = np.arange(3000)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [None] + [1.0] * 15), (5060, [float("nan")] * 16), (5080, [float("inf")] * 16), (5100, [1.0]), (None, [1.0] * 16), (5120, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 3000, 20)) and all(len(v) == 20 for v in by.values())
    recall = []
    for q, found in by.items():
        want = brute(ids, x, q, 20)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        recall.append(len({i for i, _ in found} & {i for i, _ in want}) / 20)
        if q < 900:
            assert [i for i, _ in found] == [i for i, _ in want]  # ties go to the smaller ids
    assert np.mean(recall) >= 0.9


def test_repeated_ids_are_one_candidate(spark):
    rng = np.random.default_rng(5)
    base = 5 + rng.normal(size=(60, 8))
    ids = np.concatenate([np.arange(60), np.repeat([7, 8], 40)])
    x = np.concatenate([base, np.repeat(base[[7]], 40, axis=0), base[8] + 2 + 0.01 * rng.normal(size=(40, 8))])  # 7: one vector, 8: others
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>").repartition(4)
    got = ann.nearest(df, df.where("vec_id IN (0, 20, 40)")).orderBy("query_id", "rank").collect()
    for q in (0, 20, 40):
        best = {}
        for i, s in zip(ids.tolist(), np.cumsum(x * x[q], axis=1)[:, -1].tolist()):
            if i != q:
                best[i] = max(s, best.get(i, -np.inf))
        found = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        assert sum(r["query_id"] == q for r in got) == len(found) == 20 and all(found[i] == best[i] for i in found)
        assert 8 in found


def test_best_pairs_rank_ids_not_rows():
    query, place = np.zeros(30, np.int64), np.arange(30)
    ident, score = np.repeat([4, 5, 6], [25, 3, 2]), np.linspace(3, 1, 30)
    assert ident[ann.best_pairs(query, place, score, ident, 3)].tolist() == [4, 5, 6]
    assert len(ann.best_pairs(query[:0], place[:0], score[:0], ident, 3)) == 0


def test_all_candidates_of_a_small_table(spark):
    rng = np.random.default_rng(8)
    for n in (12, 21):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(n, 16)))], "vec_id bigint, embedding array<double>")
        got = ann.nearest(df, df).groupBy("query_id").count().collect()
        assert {r["query_id"]: r["count"] for r in got} == {k: n - 1 for k in range(n)}


def test_isolated_queries_are_asked_again(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    x = np.concatenate([centre + 0.01 * rng.normal(size=(1980, 16)), 0.01 * rng.normal(size=(5, 16)) - centre])  # the five are far from the rest
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
    by = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0 OR vec_id >= 1980")).orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append(r["rank"])
    assert set(by) == {*range(0, 1980, 100), *range(1980, 1985)} and all(v == list(range(1, 21)) for v in by.values())


def test_all_buckets_where_no_moves_reach_the_aim(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST_PROBES", 1)  # even all sets of moves are too few
    rng = np.random.default_rng(10)
    ids, x = np.arange(300), rng.normal(size=(300, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(ids.tolist(), x)], "vec_id bigint, embedding array<double>")
    assert ann.fitted_probes(x, float(np.linalg.norm(x, axis=1).max())) is None
    got = ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    for q in range(0, 300, 50):
        assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q] == brute(ids, x, q, 20)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in ann.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 0.5)]
    assert ann.nearest(df.limit(0), df).count() == 0


def test_probes_start_at_home_and_never_move_twice():
    order = ann.probe_order(5, 200)
    assert not order[0].any() and len({tuple(o) for o in order.tolist()}) == len(order)
    assert all(not (o & o[::-1]).any() for o in order)


def pages():
    rng = random.Random(1)
    html = ["<p>%s</p>" % ("word " * rng.randrange(400)) for _ in range(30)]
    rows = [(k, f"http://h/{k}", rng.choice(html)) for k in range(200)]
    return rows + [(500, None, None), (501, "http://x", ""), (502, "http://y\r\nX: 1", "é" * 1000), (503, "u", "z" * 3_000_000), (7, "http://h/7", rows[7][2]), (None, "http://n", html[0])]


def test_archives_come_back_whole(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("refers_to", warc.F.lit("clash")).withColumn("_d", warc.F.lit(1)).repartition(4)
    got = warc.round_trip(spark, df).collect()
    first: dict = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    assert len(got) == len(rows)
    for r in got:
        body = next((h or "").encode() for i, _, h in rows if i == r["page_id"])
        least = first[body.decode()]
        revisit = r["page_id"] is not None and r["page_id"] > least
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"]) == (len(body), warc.digest(body), "revisit" if revisit else "response")
        assert r["refers_to"] == (least if revisit else None) and r["payload"] == (None if revisit else body)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_damage_is_found(tmp_path):
    raw = [warc.record(k, "http://h", b"<p>%d</p>" % k * 50, None) for k in range(20)]
    name, count = warc.Writer(f"file://{tmp_path}", 0).archive(iter(raw))
    data = open(name, "rb").read()
    assert count == 20 and list(warc.frames(io.BytesIO(data))) == raw
    for bad in (data[4:], data[:-3], data[:8] + data[200:]):
        with pytest.raises(Exception):
            list(warc.frames(io.BytesIO(bad)))
    one = raw[0]
    for bad in (one[5:], one.replace(b"WARC-Date", b"WARC-Dated"), one.replace(b"<p>0", b"<p>9", 1), one[:-4], re.sub(rb"(Content-Length: )(\d+)(\r\n\r\nHTTP)", rb"\g<1>9\2\3", one)):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    assert warc.parsed(one)[1] == 0


def test_archives_roll_over(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 500)
    rng = random.Random(2)
    raw = [warc.record(k, "u", bytes(rng.randrange(256) for _ in range(400)), None) for k in range(30)]
    writer, source, names = warc.Writer(f"file://{tmp_path}", 3), iter(raw), []
    while (done := writer.archive(source)) is not None:
        names.append(done)
    assert len(names) > 3 and sum(n for _, n in names) == 30
    back = [f for name, _ in names for f in warc.frames(open(name, "rb"))]
    assert back == raw
