"""Toxic documents by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is a bias plus the weights of its words' features (the word
and its beginnings), and the document's score is the noisy-or of its sentence probabilities. Only document labels
are known; the gradient of the bag likelihood shares each document's error among its sentences, so the fitted
sentence scores also locate the offending sentences.

The fit uses at most POSITIVES + NEGATIVES labelled rows, chosen by a hash of the id and weighted back to the
label counts of the whole table. Every whole text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hasher, lists, slices, with_column
from .wordstats import Words

POSITIVES, NEGATIVES = 2_500, 5_000  # bound of the labelled rows used for the fit
SLOT_BITS = 22  # hashed feature space
FIT_BYTES = 1 << 19  # text bytes that the fit handles at once
FEATURES = 6_000  # features kept, by association with the label
GAIN = 7.0  # least log likelihood ratio of a kept feature
STEPS, RATE, RIDGE = 300, 0.15, 0.02
OFFENDING = 0.5  # probability from which a sentence is listed

KIND = "struct<score:double,offending:array<struct<start:bigint,end:bigint,score:double>>>"


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place of the distinct word, slot of a feature): the word and its beginnings of 4 to 8 bytes."""
    parts = [words.whole(1), *[words.ends(2, size, False) for size in range(4, 9)]]
    slot = np.concatenate([f for _, f in parts]) >> np.uint64(64 - SLOT_BITS)
    return np.concatenate([p for p, _ in parts]), slot.astype(np.int64)


def sentences(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every sentence that has a word, and the sentence of each word."""
    stop = np.isin(words.raw, np.frombuffer(b".!?\n", np.uint8))
    place = np.cumsum(stop)[words.start]
    opens = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
    number = np.cumsum(np.concatenate(([0], place[1:] != place[:-1]))) if len(place) else place
    close = np.concatenate((opens[1:] - 1, [len(place) - 1])).astype(np.int64) if len(opens) else opens
    text = np.searchsorted(words.first, words.start[opens], side="right") - 1
    return words.start[opens], words.end[close], text, number


@dataclass
class Model:
    code: np.ndarray  # sorted slots of features
    weight: np.ndarray
    bias: float

    def sentence_logits(self, words: Words, number: np.ndarray, count: int) -> np.ndarray:
        own, code = features(words)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        value = np.bincount(own, np.where(self.code[at] == code, self.weight[at], 0.0), len(words.distinct)) if len(self.code) else np.zeros(len(words.distinct))
        return self.bias + np.bincount(number, value[words.form], count)

    def score(self, column: pa.Array, hasher: Hasher) -> pa.StructArray:
        words = Words(column, hasher)
        start, end, text, number = sentences(words)
        z = self.sentence_logits(words, number, len(start))
        clean = np.bincount(text, -np.logaddexp(0, z), len(column))  # sum of log(1 - p)
        p = np.exp(-np.logaddexp(0, -z))
        bad = np.flatnonzero(p >= OFFENDING)
        listed = pa.StructArray.from_arrays([pa.array(words.point(start[bad])), pa.array(words.point(end[bad])), pa.array(p[bad])], names=["start", "end", "score"])
        return pa.StructArray.from_arrays([pa.array(-np.expm1(clean)), lists(listed, np.bincount(text[bad], minlength=len(column)))], names=["score", "offending"])


def fit(texts: list[str | None], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Weights of the noisy-or model by full-batch adaptive gradient steps; deterministic."""
    batch = pa.record_batch({"text": pa.array(texts, pa.string()), "row": pa.array(np.arange(len(texts)))})
    hasher, counts = Hasher(fold=False), np.zeros((2, 1 << SLOT_BITS), np.float32)
    for part in slices([batch], "text", FIT_BYTES):
        words = Words(part.column("text"), hasher)
        row = np.repeat(part.column("row").to_numpy(), np.diff(words.bound))
        pairs = np.unique(words.form * np.int64(len(texts)) + row)  # each form once in a text
        at, slot = entries(words, pairs // max(1, len(texts)))
        row = pairs[at] % max(1, len(texts))
        pairs = np.unique(slot * np.int64(len(texts)) + row)
        slot, row = pairs // max(1, len(texts)), pairs % max(1, len(texts))
        for y in (0, 1):
            own = labels[row] == y
            np.add.at(counts[y], slot[own], weights[row[own]].astype(np.float32))
    kept = select(*counts, weights[labels == 0].sum(), weights[labels == 1].sum())
    rows, total = [], 0
    for part in slices([batch], "text", FIT_BYTES):
        words = Words(part.column("text"), hasher)
        start, _, text, number = sentences(words)
        at, slot = entries(words, words.form)
        place = np.searchsorted(kept, slot)
        own = np.flatnonzero(kept[np.minimum(place, max(0, len(kept) - 1))] == slot) if len(kept) else place[:0]
        rows.append((number[at[own]] + total, place[own], part.column("row").to_numpy()[text]))
        total += len(start)
    sentence, index, document = (np.concatenate([np.zeros(0, np.int64), *[r[k] for r in rows]]) for k in range(3))
    w, y = np.zeros(len(kept) + 1), labels
    w[-1] = -6.0
    m = v = np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = w[-1] + np.bincount(sentence, w[index], total)
        p = np.exp(-np.logaddexp(0, -z))
        clean = np.bincount(document, -np.logaddexp(0, z), len(y))
        bag = np.maximum(-np.expm1(clean), 1e-9)
        share = np.where(y > 0, -np.exp(clean) / bag, 1.0) * weights
        g = p * share[document]
        grad = np.append(np.bincount(index, g[sentence], len(kept)) + RIDGE * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(kept, w[:-1], float(w[-1]))


def entries(words: Words, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``forms``, slot) of every feature of the listed forms."""
    own, slot = features(words)
    order = np.argsort(own, kind="stable")
    count = np.bincount(own, minlength=len(words.distinct))
    first, size = (np.cumsum(count) - count)[forms], count[forms]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.arange(len(forms)), size), slot[order[np.repeat(first, size) + inside]]


def select(negative: np.ndarray, positive: np.ndarray, clean: float, toxic: float) -> np.ndarray:
    """The slots, FEATURES at most, that speak for the positive label by GAIN or more of log likelihood."""
    known = np.flatnonzero(positive)
    negative, positive = negative[known].astype(float), positive[known].astype(float)
    seen = positive + negative
    expected = seen * toxic / max(clean + toxic, 1e-9)
    gain = positive * np.log((positive + 1e-9) / (expected + 1e-9)) + negative * np.log((negative + 1e-9) / (seen - expected + 1e-9))
    gain = np.where(positive > expected, gain, 0)
    best = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    return known[best[gain[best] >= GAIN]]


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """A bounded set of labelled texts: ids are drawn from the labels alone, then only their texts are read."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg((F.max("toxic") > 0).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for y, bound in ((True, POSITIVES), (False, NEGATIVES)):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        drawn = one if drawn is None else drawn.unionByName(one)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], bool)
    weights = np.array([counts[r["y"]] / max(1, int((y == r["y"]).sum())) for r in rows], float)
    return [r["text"] for r in rows], y.astype(np.int64), weights * (len(rows) / max(weights.sum(), 1e-9))


def held_out(ident: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a missing id is neither held out nor learned from."""
    return F.coalesce(F.crc32(ident.cast("string")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*training_rows(docs, labels, ~held_out(F.col("doc_id"))))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``: the noisy-or score and the offending sentences (code point ranges).

    A text without words, empty or null, has score 0 and no sentence. One row for each row; ties cannot arise;
    a column already called ``out`` is replaced. Without any labelled row the model has no weights.
    """

    def make():
        hasher = Hasher(fold=False)
        return lambda column: model.score(column, hasher)

    return with_column(docs, text, out, KIND, make, keep)
