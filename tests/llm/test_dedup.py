"""Near-duplicates, components and line dedup against plain restatements."""

import random

import fixtures as X
import numpy as np
from trialweave.llm import components as C
from trialweave.llm import linededup, neardup


def near_rows():
    rng = random.Random(4)
    base = X.sentence(rng, 60).split()
    rows = [(None, None, "en", None), (1, "", "en", "a"), (2, " \n\t ", None, "a"), (3, "one two", "en", "b"), (4, "ONE  two", "en", "b"), (5, "a b c d e", "en", "c")]
    rows += [(10, " ".join(base), "en", "a"), (10, " ".join(base), "en", "a"), (None, " ".join(base).upper(), "en", "a")]
    for k in range(40):  # loose copies: similar to the base, often not to each other
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(60)] = f"x{k}"
        rows.append((100 + k, " ".join(words), "en", f"s{k % 5}"))
    rows += [(200 + k, X.sentence(rng, 40), "fr", "z") for k in range(20)]
    rows.append((300, "long " * 200_000, "en", "z"))
    return rows


def test_near_components_equal_brute_force(spark):
    rows = near_rows()
    got = neardup.near_components(X.documents(spark, rows)).collect()
    sets = [X.shingles(t) for _, t, _, _ in rows]
    reach = X.components(sets, [i for i, *_ in rows])
    want = sorted(((i if s else None, len(s), c if s else i, True if not s else i == c) for (i, *_), s, c in zip(rows, sets, reach)), key=str)
    have = sorted(((r["doc_id"] if r["n_shingles"] else None, r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str)
    assert have == want and len(got) == len(rows)


def test_many_rows_share_an_id_or_have_none(spark):
    rng = random.Random(6)
    bodies = [X.sentence(rng, 20).split() for _ in range(60)]
    rows = []
    for k in range(240):  # four loose copies of each body, under one id or none
        words = list(bodies[k % 60])
        words[k // 60] = "other" if k >= 60 else words[0]
        rows.append(((None, 7)[k % 2], " ".join(words), "en", "s"))
    rows += [(None, "  ", "en", "s"), (None, "  ", "en", "s"), (7, rows[1][1], "fr", "t"), (None, rows[0][1], "fr", "t")]
    docs = X.documents(spark, rows)
    sets = [X.shingles(t) for _, t, _, _ in rows]
    reach = X.components(sets, list(range(len(rows))))
    got = neardup.near_components(docs).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got), key=str) == [(7, 7, 121), (None, None, 123)]
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("  ") == 2 and len(texts) == 2 + len({reach[k] for k, s in enumerate(sets) if s})
    assert len({reach[[t for _, t, _, _ in rows].index(t)] for t in texts if t.strip()}) == len(texts) - 2


def test_near_components_of_nothing(spark):
    assert neardup.near_components(X.documents(spark, [])).count() == neardup.one_of_each(X.documents(spark, [])).count() == 0
    assert [r["kept"] for r in neardup.near_components(X.documents(spark, [(None, None, None, None)])).collect()] == [True]


def test_sketches_find_pairs_at_the_threshold():
    """Sets at similarity 0.75 share a bucket, short sets too, in all of many trials."""
    rng, sketch = np.random.default_rng(1), neardup.Sketch()
    for size in (4, 8, 40, 400, 4000):
        for _ in range(60):
            items = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            other = items[: -(-3 * len(items) // 4)]
            assert np.intersect1d(sketch.keys(items), sketch.keys(other)).size


def test_overlap_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(2)
    for size in (5, 200, 3000):
        a, b = np.unique(rng.integers(0, 2 * size, size, dtype=np.uint64)), np.unique(rng.integers(0, 2 * size, size, dtype=np.uint64))
        x, y = neardup.levels(a), neardup.levels(b)
        bound = sum(int(p & q).bit_count() for p, q in zip(x[:-1].view(np.uint64).tolist(), y[:-1].view(np.uint64).tolist())) + min(x[-1], y[-1])
        assert bound >= np.intersect1d(a, b).size


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r["node"]: r["label"] for r in C.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(30)}}


def test_lines_leave_all_but_their_first_place(spark):
    menu = "Home | About | Contact"
    rows = [(k, f"{menu}\nown {k}\n\n{menu} ", "en", f"s{k % 4}") for k in range(1, 9)]
    rows += [(20, "two sites only\nx", "en", "s1"), (21, "two sites only\ny", "en", "s2"), (22, menu, "en", None), (23, None, None, None), (24, "", None, "s1"), (8, rows[7][1], "en", "s0")]
    got = {(r["doc_id"], r["line_dedup"]["text"]): r["line_dedup"] for r in linededup.remove_boilerplate(X.documents(spark, rows)).collect()}
    assert got[(1, f"{menu}\nown 1\n")]["n_removed"] == 1
    assert got[(8, "own 8\n")]["n_removed"] == 2 and got[(22, "")]["n_removed"] == 1
    assert got[(20, "two sites only\nx")]["n_removed"] == 0 and got[(23, "")]["n_lines"] == 1 and got[(24, "")]["n_lines"] == 1
    assert linededup.remove_boilerplate(X.documents(spark, rows)).count() == len(rows)
    assert linededup.remove_boilerplate(X.documents(spark, [])).count() == 0


def test_far_spread_lines_need_no_exact_count(spark):
    rows = [(k, "hot line\nrare line" if k < 3 else "hot line", "en", f"site{k}") for k in range(60)]
    got = {r["doc_id"]: r["line_dedup"]["n_removed"] for r in linededup.remove_boilerplate(X.documents(spark, rows, extra=False)).collect()}
    assert got[0] == 0 and got[1] == 2 and all(got[k] == 1 for k in range(3, 60))
