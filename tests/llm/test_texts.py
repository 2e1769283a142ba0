"""Operators that work on one text at a time: codec, passages, toxicity, language, personal data."""

import hashlib
import random
import re
import zlib

import fixtures as X
import numpy as np
import pyarrow as pa
import pytest
from trialweave.llm import bpe, decontaminate, language, pii, toxicity
from trialweave.llm.common import Hasher
from trialweave.llm.queries import piece_model

EMPTY = [(None, None, None, None), (1, "", None, "a"), (2, " .,;\n", "en", "a"), (3, "ok", "en", "a"), (3, "ok", "en", "a")]


def odd_texts(count=400):
    rng = random.Random(9)
    parts = ["a", "be", " ", "  ", "\n", "▁", "é", "𐍈", "<s>", "\x00", "1", ".", "the ", "日本", "　", "👩‍👧", "wordword"]
    return ["", " ", "▁", "x" * 5000, "long word " * 20_000] + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(count)]


@pytest.fixture(scope="module")
def model():
    with open(piece_model(), "rb") as file:
        return file.read()


def test_codec_equals_the_library(spark, model):
    texts = odd_texts()
    rows = [(k, t, None, None) for k, t in enumerate(texts)] + [(None, None, None, None)]
    vocabulary = bpe.Vocabulary(model)
    ids = bpe.encode(X.documents(spark, rows), vocabulary)
    assert ids.columns[-1] == "ids" and bpe.checked(ids, model).where("NOT agrees").count() == 0
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=model)
    for r in bpe.decode(ids.select("doc_id", "text", "ids"), vocabulary).collect():
        assert r["decoded"] == library.decode(r["ids"]) and r["ids"] == library.encode(r["text"] or "")
    assert bpe.decode(bpe.encode(X.documents(spark, []), vocabulary), vocabulary).count() == 0


def test_decoder_takes_any_ids(model):
    from sentencepiece import SentencePieceProcessor

    library, rng = SentencePieceProcessor(model_proto=model), random.Random(3)
    ids = [[rng.choice([0, 1, 2, 3 + rng.randrange(256), rng.randrange(32_000)]) for _ in range(rng.randrange(9))] for _ in range(1500)]
    assert bpe.Decoder(bpe.Vocabulary(model))(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [library.decode(i) for i in ids]


def test_other_models_are_refused(model):
    with pytest.raises(ValueError):
        bpe.Vocabulary(model.replace(b"identity", b"nmt_nfkc"))


def passages(items, text):
    words = lambda t: [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())) if w]
    own, found, hit = words(text), set(), set()
    for item, t in items:
        w = words(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if item is not None and m else 0):
            for at in range(len(own) - m + 1):
                if own[at : at + m] == w[k : k + m]:
                    found.add(str(item))
                    hit.update(range(at, at + m))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_passages_equal_brute_force(spark, block_bytes):
    rng = random.Random(5)
    long = X.sentence(rng, 40)
    items = [(1, long), (2, " ".join(long.split()[10:30])), (3, "short test"), (3, "Été"), (4, None), (None, long), (5, ""), (6, "x"), (1, long)]
    texts = [None, "", "nothing here", f"pre {long.upper()} post", ", ".join(long.split()[5:25]), "short, TEST! short test x", "Été été", f"{long}\n{long}", "x" * 10, "a " * 3000 + long]
    texts += [" ".join(rng.choice([long, "short", "test", *long.split()[:20]]) for _ in range(25)) for _ in range(8)]
    docs = X.documents(spark, [(k, t, None, None) for k, t in enumerate(texts)] + [(None, texts[3], None, None)])
    got = decontaminate.find_passages(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        p = r["passages"]
        assert (p["n_words"], p["n_hit"], p["items"]) == passages(items, r["text"])
        assert sum(h["last"] - h["first"] + 1 for h in p["hits"]) == p["n_hit"]
    assert decontaminate.find_passages(docs, spark.createDataFrame([], "item_id bigint, text string")).where("passages.n_hit > 0").count() == 0


def toxic_set(count):
    rng = random.Random(7)
    rows = []
    for k in range(count):
        bad = rng.random() < 0.3
        lines = [X.sentence(rng, 8) for _ in range(rng.randrange(2, 9))]
        if bad:
            lines[rng.randrange(len(lines))] += rng.choice([" scoundrel", " villain", " vermin"])
        rows.append((k, ". ".join(lines), bad))
    return rows


def test_toxicity_learns_and_locates(spark):
    rows = toxic_set(900)
    docs = X.documents(spark, [(k, t, "en", "s") for k, t, _ in rows] + EMPTY[:1] + [(5000, "", "en", "s"), (5001, "villain " * 100_000, "en", "s")])
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows] + [(None, 1), (3, None), (4, int(rows[4][2]))], "doc_id bigint, toxic int")
    scored = toxicity.score(docs, toxicity.trained(docs, labels)).select("doc_id", "text", "toxicity", toxicity.held_out(toxicity.F.col("doc_id")).alias("out"))
    truth = {k: y for k, _, y in rows}
    got = {r["doc_id"]: r for r in scored.collect()}
    assert got[None]["toxicity"]["score"] == 0 and got[5000]["toxicity"]["score"] == 0 and not got[None]["out"] and got[5001]["toxicity"]["score"] > 0.9
    held = [r for k, r in got.items() if k in truth and zlib.crc32(str(k).encode()) % 3 == 1]
    assert held and all(r["out"] for r in held)
    right = [(r["toxicity"]["score"] >= 0.7) == truth[r["doc_id"]] for r in held]
    assert np.mean(right) > 0.95
    for r in held:
        for s in r["toxicity"]["offending"]:
            assert re.search("scoundrel|villain|vermin", r["text"][s["start"] : s["end"]])
    assert toxicity.score(docs.limit(0), toxicity.trained(docs.limit(0), labels)).count() == 0


def test_toxicity_equals_a_plain_noisy_or():
    """Scores and listed sentences, sentence by sentence and word by word in plain Python, from the fitted weights."""
    rows = toxic_set(400)
    model = toxicity.fit([t for _, t, _ in rows], np.array([int(y) for _, _, y in rows]), np.ones(len(rows)))
    weight = dict(zip(model.code.tolist(), model.weight.tolist()))
    known = {}

    def word_logit(word):
        if word not in known:
            _, slots = toxicity.features(toxicity.Words(pa.array([word]), Hasher(fold=False)))
            known[word] = sum(weight.get(c, 0.0) for c in slots.tolist())
        return known[word]

    texts = [t for _, t, _ in rows[:120]] + [None, "", " .!?\n", "é Villain!? ok\nvermin", "a villain. " * 50, "scoundrels " * 300]
    got = model.score(pa.array(texts, pa.string()), Hasher(fold=False)).to_pylist()
    listed = 0
    for text, have in zip(texts, got):
        clean, offending = 1.0, []
        for part in re.finditer(r"[^.!?\n]+", text or ""):
            words = list(re.finditer(r"[A-Za-z\x80-\U0010ffff]+", part.group()))
            if words:
                p = 1 / (1 + np.exp(-(model.bias + sum(word_logit(w.group()) for w in words))))
                clean *= 1 - p
                if p >= toxicity.OFFENDING:
                    offending.append((part.start() + words[0].start(), part.start() + words[-1].end()))
        assert abs(have["score"] - (1 - clean)) < 1e-9
        assert [(o["start"], o["end"]) for o in have["offending"]] == offending
        listed += len(offending)
    assert len(weight) and listed > 20


def test_language_labels_switched_words(spark):
    rng = random.Random(8)
    stems = {"xx": ("ka", "ri", "mo", "shi", "to"), "yy": ("blen", "ough", "sth", "wr", "ick"), "zz": ("çã", "lho", "nhé", "õe", "qua")}
    rows = [(k, X.sentence(rng, 30, stems[lang]), lang, "s") for k, lang in enumerate(list(stems) * 60)]
    more = [(900, None, "xx", "s"), (901, "12 34 !?", "xx", "s"), (902, "", None, None), (903, X.sentence(rng, 40_000, stems["yy"]), None, "s"), (None, rows[0][1], None, None)]
    docs = X.documents(spark, rows + more)
    model = language.trained(docs)
    got = {(r["doc_id"]): r["language"] for r in language.identify(docs, model).collect()}
    assert all(got[k]["lang"] == lang for k, _, lang, _ in rows)
    assert [got[k]["lang"] for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "yy", "xx"] and got[901]["score"] == 0
    mixed = " ".join(X.sentence(rng, 12, stems[lang]) for lang in ("xx", "zz", "yy"))
    runs = model.predict(pa.array([mixed]), Hasher(fold=False)).to_pylist()[0]["runs"]
    assert [r["lang"] for r in runs] == ["xx", "zz", "yy"] and runs[0]["start"] == 0 and runs[-1]["end"] == len(mixed)
    assert {r["language"]["lang"] for r in language.identify(docs, language.trained(docs.limit(0))).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_language_fit_covers_all_rows(spark, monkeypatch):
    from collections import Counter

    rng = random.Random(4)
    stems = {"xx": ("ka", "ri", "mo"), "yy": ("blen", "ough", "sth")}
    rows = [(k, X.sentence(rng, rng.randrange(1, 60), stems[lang]), lang, "s") for k, lang in enumerate(list(stems) * 50)]
    rows += [(7, X.sentence(rng, 9, stems["yy"]), "yy", "s") for _ in range(800)]  # one id holds most rows
    docs = X.documents(spark, rows)
    monkeypatch.setattr(language, "LEXICON", 5)
    listed = {int(h) for h in language.frequent(docs.select("lang", "text"))}
    hasher, want = Hasher(fold=False), set()
    for lang in stems:
        count = Counter(w for _, t, own, _ in rows if own == lang for w in t.split())
        code = {w: int(hasher.load(np.frombuffer(w.encode(), np.uint8))(np.array([0]), np.array([len(w)]))[0]) for w in count}
        ranked = sorted(count, key=lambda w: (-count[w], code[w] - (1 << 64 if code[w] >> 63 else 0)))
        want |= {code[w] for w in ranked[:5]}
    assert listed == want
    one, two = language.trained(docs), language.trained(docs.repartition(7, "n_chars"))
    assert np.array_equal(one.weight, two.weight) and np.array_equal(one.move, two.move) and one.langs == ["xx", "yy"]
    long = X.sentence(rng, 3000, stems["xx"]).split()
    drawn = language.stretches(" 1, ".join(long), hasher)
    assert language.ROW_WORDS <= len(drawn.split()) < language.ROW_WORDS + 40 and all(" " + line + " " in " " + " ".join(long) + " " for line in drawn.split("\n"))
    short = " ".join(long[:50])
    assert Counter(language.stretches(short, hasher).split()) == Counter(short.split()) and language.stretches("1 2", hasher) == ""


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(6)
    emit, move, size = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), np.array([4, 2])
    marginal, moves, log_z = language.forward_backward(emit, size, move)
    pairs = np.zeros((3, 3))
    for c in range(2):
        paths = list(product(range(3), repeat=int(size[c])))
        score = np.exp([sum(emit[c, t, s] for t, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths])
        for t in range(size[c]):
            assert np.allclose(marginal[c, t], [score[[p[t] == s for p in paths]].sum() / score.sum() for s in range(3)])
        for p, w in zip(paths, score / score.sum()):
            for a, b in zip(p, p[1:]):
                pairs[a, b] += w
        assert np.isclose(log_z[c], np.log(score.sum()))
    assert np.allclose(moves, pairs)


def test_personal_data_equals_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["a", "b.", "@", "1", "22", "333", ".", "-", " ", "+", "(", ")", "_", "%", "é", "𐍈", "4111 1111 1111 1111", "10.0.0.1", "+1 (017) 555-7713", "x@y.z", "0.", "\n", "4111111111111111"]
    texts = [None, "", "a" * 100_000, "1" * 60_000, "1 " * 30_000, "1." * 30_000, "a.b" * 30_000 + "@", "x@" + "a." * 20_000 + "b", "+1 " + "0 " * 30_000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)] + ['token = "0123456789abcdef0123456789abcdef01234567"'] * 3
    docs = X.documents(spark, [(k, t, None, None) for k, t in enumerate(texts)] + [(None, "x@y.z", None, None)])
    found = pii.personal_data(docs)
    got = {r["doc_id"]: r["pii"] for r in found.collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        want = X.base_spans(t)
        have = sorted((s["start"], pii.KINDS.index(s["kind"]), s["kind"], s["end"]) for s in got[k]["base"])
        assert have == want
        assert {tuple(s) for s in got[k]["base"]} <= {tuple(s) for s in got[k]["spans"]}
        assert [got[k][f"n_{kind}"] for kind in X.PII] == [sum(s[2] == kind for s in want) for kind in X.PII]
    assert any(s["kind"] == "secret" for s in got[len(texts) - 1]["spans"])
    text = found.select("doc_id", pii.listed(found["pii"]["base"]).alias("b")).where("doc_id IS NULL").first()["b"]
    assert text == "email:0:5" and pii.personal_data(docs.limit(0)).count() == 0 and hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_expectation_maximisation_finds_reliable_labelers():
    from pyspark.sql import Row

    rng = random.Random(2)
    counts: dict = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = [(1 if (rng.random() < q) == true else -1) if rng.random() < 0.8 else 0 for q in (0.95, 0.9, 0.6, 0.85, 0.55)]
        counts[tuple(votes)] = counts.get(tuple(votes), 0) + 1
    rows = [Row(kind="ip", n=n, **dict(zip(pii.VOTES, v)), **{f: 0 for f in pii.FEATURES}) for v, n in counts.items()]
    prior, rate, _ = pii.estimated(rows)
    assert abs(prior - 0.4) < 0.06 and rate["shape"][0] > 0.9 and rate["shape"][1] < 0.1 and rate["gazetteer"][0] < 0.7


def test_many_matches_in_one_text(spark):
    """More matches than one block of positions holds, at and around its size."""
    for count in (pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 5 * pii.BLOCK + 3):
        text = " é ".join(f"u{k}@x{k}.com 10.0.{k % 300}.1" for k in range(count))
        found = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["pii"]
        assert sorted((s["start"], pii.KINDS.index(s["kind"]), s["kind"], s["end"]) for s in found["base"]) == X.base_spans(text)
