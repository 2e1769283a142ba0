"""Quality of documents by Bradley-Terry pairwise ranking.

Each text becomes some sixty numbers: lengths, shares of letters, capitals, digits and each ASCII sign, how often words,
word pairs, five-word passages and lines repeat, how sentences end. A document labelled 1 is preferred to one labelled
0; the weights w maximise the likelihood of all preference pairs, sigma(w . (x_better - x_worse)), with a ridge. The
difference cancels any common offset, so a document's score w . x has no natural zero: the threshold is the score
quantile at the share of worse documents among the labels, and is mapped to THRESHOLD on the 0 to 1 scale.

The fit uses every labelled row that is not held out: its text is measured, and it takes part in at least one pair. All
pairs are formed where there are at most PAIRS; else each row of the more frequent label meets equally many of the other
label, in hash order, so that the pairs grow like the rows. Tasks add up moments, gradients and Hessians of their rows
and pairs, and the quantile is narrowed down by counts; only such sums reach the driver. Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import number_rows
from ..session import durable
from .common import Hasher, byte_set, lists, mix, packed, per_text, spans, with_column
from .wordstats import LETTER, folded

PAIRS = 40_000  # preference pairs, or one for each row of the more frequent label where that is more
SHORT = 16_384  # numbers of at most this many rows are sent to all tasks
KNOWN = 2_000_000  # ids with labels that are sent to all tasks, at most
CUT_ROWS = 10_000  # scores the driver looks at to place the quantile
RIDGE, STEPS = 1e-3, 30  # of a pair's mean loss; Newton steps
THRESHOLD = 0.7  # score to which the quantile is mapped
WORD = byte_set((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))
SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
SHARES = ["capitals", "digits", "other bytes", "words without a letter", "words in capitals", "words ending a sentence", "words ending in two signs",
          "words like the one before", "repeated words", "repeated pairs", "repeated passages", "repeated lines"]
NAMES = ["words", "word length", "line length", "sentence length", *SHARES, *[chr(b) for b in SIGNS]]


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def repeated(code: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """Share of the entries of each text that are not the first with their code."""
    _, seen = np.unique(mix(code + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    n = np.bincount(text, minlength=count)
    return share(n - np.bincount(text[seen], minlength=count), n)


def features(column: pa.Array, hasher: Hasher) -> np.ndarray:
    """One row of numbers for each text; a text without words is all zeros but for its signs, of which it has none."""
    data, first = packed(column)
    count = len(first) - 1
    inside = np.repeat(np.arange(count), np.diff(first))  # text of each byte after the first
    body, low = data[1 : len(inside) + 1], folded(data)
    start, end = spans(data, WORD)
    bound = per_text(start, first)
    n = np.diff(bound)
    text = np.repeat(np.arange(count), n)

    def of_bytes(member: np.ndarray) -> np.ndarray:
        return np.bincount(inside[member], minlength=count)

    def of_words(member: np.ndarray) -> np.ndarray:
        return share(np.bincount(text[member], minlength=count), n)

    letter, capital = LETTER[data], low != data
    capital &= letter
    letters, capitals = (np.concatenate(([0], np.cumsum(x))) for x in (letter & ((data & 0xC0) != 0x80), capital))
    in_word = (letters[end] - letters[start], capitals[end] - capitals[start])
    sign = np.isin(data, np.array(SIGNS, np.uint8))
    stop = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8)) if len(end) else np.zeros(0, bool)
    two = sign[end - 1] & sign[end - 2] & (end - start > 2) if len(end) else stop
    code = hasher.load(low)(start, end)
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (text[1:] == text[:-1])

    def grams(size: int) -> np.ndarray:
        last = len(code) - size + 1
        if last <= 0:
            return np.zeros(count)
        own = np.flatnonzero(text[: max(0, last)] == text[size - 1 :])
        value = np.zeros(len(own), np.uint64)
        for k in range(size):
            value = mix(value + code[own + k])
        return repeated(value, text[own], count)

    line_start, line_end = spans(data, byte_set((0x00, 0x09), (0x0B, 0xFF)))
    line_text = np.searchsorted(first, line_start, side="right") - 1
    total = of_bytes(LETTER[body])
    rows = [
        np.log1p(n), np.log1p(share(np.bincount(text, end - start, count), n)), np.log1p(share(n, np.bincount(line_text, minlength=count))),
        np.log1p(share(n, np.bincount(text[stop], minlength=count))),
        share(of_bytes(capital[1 : len(inside) + 1]), total), share(of_bytes((body >= 0x30) & (body <= 0x39)), np.diff(first)), share(of_bytes((body < 0x20) & (body != 10)), np.diff(first)),
        of_words(in_word[0] == 0), of_words((in_word[0] > 1) & (in_word[0] == in_word[1])), of_words(stop), of_words(two), of_words(again),
        repeated(code, text, count), grams(2), grams(5), repeated(hasher(line_start, line_end), line_text, count),
    ]
    table = np.bincount(inside * 256 + body, minlength=count * 256).reshape(count, 256)[:, SIGNS]
    return np.column_stack([*rows, np.log1p(20 * share(table, n[:, None]))])


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float = 0.0  # raw score of the quantile

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return np.exp(-np.logaddexp(0, -z))


def pairs(better: int, worse: int, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two sides of at most ``most`` preference pairs: every row takes part, as evenly as they allow.

    All pairs where there are few enough; else row k of the longer side meets rows k, k + 1, ... of the shorter one.
    """
    if better * worse <= most:
        a, b = np.divmod(np.arange(better * worse), max(1, worse))
        return a, b
    long, short = max(better, worse), min(better, worse)
    rounds = min(short, max(1, most // long))
    a = np.tile(np.arange(long), rounds)
    b = (a + np.repeat(np.arange(rounds) * max(1, short // rounds), long)) % short
    return (a, b) if better >= worse else (b, a)


def loss(w: np.ndarray, difference: np.ndarray, ridge: float = RIDGE) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the pairs with its gradient and Hessian."""
    z = difference @ w
    p = np.exp(-np.logaddexp(0, z))  # probability of the wrong order
    value = np.logaddexp(0, -z).mean() + ridge / 2 * w @ w
    gradient = ridge * w - difference.T @ p / len(z)
    hessian = (difference * (p * (1 - p))[:, None]).T @ difference / len(z) + ridge * np.eye(len(w))
    return value, gradient, hessian


def fit(x: np.ndarray, y: np.ndarray, counts: tuple[int, int]) -> Model:
    """Weights by damped Newton steps, and the quantile; ``counts`` are the label counts of the whole table."""
    model = Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES)))
    if not len(y):
        return model
    model.centre = x.mean(0)
    model.scale = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    good, bad = z[y > 0], z[y == 0]
    if len(good) and len(bad):
        a, b = pairs(len(good), len(bad))
        difference = good[a] - bad[b]
        model.weight = newton(lambda w: loss(w, difference), model.weight)
    model.cut = quantile(model.raw(x), y, counts)
    return model


def newton(loss_at: Callable, w: np.ndarray) -> np.ndarray:
    """Minimum by damped Newton steps; ``loss_at`` gives value, gradient and Hessian."""
    value, gradient, hessian = loss_at(w)
    for _ in range(STEPS):
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while True:
            tried = loss_at(w - size * step)
            if tried[0] <= value or size < 1e-6:
                break
            size /= 2
        done = value - tried[0] < 1e-12
        w, (value, gradient, hessian) = w - size * step, tried
        if done:
            break
    return w


def quantile(raw: np.ndarray, y: np.ndarray, counts: tuple[int, int]) -> float:
    """The raw score below which the share of worse documents lies: midway between the scores on its two sides."""
    weight = np.where(y > 0, counts[1] / max(1, (y > 0).sum()), counts[0] / max(1, (y == 0).sum()))
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order])
    at = int(np.searchsorted(below, counts[0] - 0.5))
    values = raw[order]
    if counts[0] == 0:
        return float(values[0] - 1)
    if counts[1] == 0 or at >= len(values) - 1:
        return float(values[-1] + 1)
    return float((values[at] + values[at + 1]) / 2)


def measured(docs: DataFrame, text: str = "text", out: str = "features", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``: the numbers of each whole text, named in NAMES."""

    def make():
        hasher = Hasher(fold=False)

        def apply(column: pa.Array) -> pa.ListArray:
            x = features(column, hasher)
            return lists(pa.array(x.ravel()), np.full(len(x), x.shape[1]))

        return apply

    return with_column(docs, text, out, "array<double>", make, keep)


def held_out(ident: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a missing id is neither held out nor learned from."""
    return F.coalesce(F.crc32(ident.cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labels that are not held out; of a repeated id the higher label and the least text count."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("quality") > 0).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = F.broadcast(known) if sum(counts.values()) <= KNOWN else known
    texts = docs.select("doc_id", "text").join(found, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return fitted(durable(measured(texts, keep=["doc_id", "y"])), (counts.get(False, 0), counts.get(True, 0)))


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), float).reshape(batch.num_rows, len(NAMES))


def summed(df: DataFrame, one: Callable, size: int) -> np.ndarray:
    """Sum over all batches of the ``size`` numbers that ``one`` makes of a batch; a task sends one row."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += one(batch)
        yield pa.RecordBatch.from_arrays([lists(pa.array(total), np.array([size]))], ["sums"])

    return np.sum([r["sums"] for r in df.mapInArrow(run, "sums array<double>").collect()] or [np.zeros(size)], axis=0)


def paired(rows: DataFrame, better: int, worse: int) -> DataFrame:
    """(better, worse): the numbers of both sides of the preference pairs, by the rule of ``pairs``."""
    key = F.xxhash64("doc_id")
    placed = number_rows(rows.withColumn("_key", key), ["y"], F.shiftright("_key", 56), ["_key", "doc_id"], "_row")
    placed = durable(placed.select("y", (F.col("_row") - 1).alias("_row"), "features"))
    long, short = max(better, worse), min(better, worse)
    rounds = short if better * worse <= PAIRS else min(short, max(1, PAIRS // long))
    more = better >= worse
    a = placed.where(F.col("y") == more).select("_row", F.col("features").alias("better" if more else "worse"))
    a = a.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    a = a.withColumn("_other", (F.col("_row") + F.col("_round") * max(1, short // rounds)) % short)
    b = placed.where(F.col("y") != more).select(F.col("_row").alias("_other"), F.col("features").alias("worse" if more else "better"))
    met = a.join(F.broadcast(b) if short <= SHORT else b, "_other")
    return durable(met.repartition("_row").sortWithinPartitions("_row", "_round").select("better", "worse"))


def fitted(rows: DataFrame, counts: tuple[int, int]) -> Model:
    """``fit`` of all rows (doc_id, y, features), whose sums tasks add up."""
    size = len(NAMES)
    model = Model(np.zeros(size), np.ones(size), np.zeros(size))
    own = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = own.get(False, 0), own.get(True, 0)
    if not bad + good:
        return model
    model.centre = summed(rows, lambda batch: matrix(batch, "features").sum(0), size) / (bad + good)
    centre = model.centre
    spread = np.sqrt(summed(rows, lambda batch: ((matrix(batch, "features") - centre) ** 2).sum(0), size) / (bad + good))
    model.scale = scale = np.where(spread > 1e-9, spread, 1.0)
    if good and bad:
        met = paired(rows, good, bad)

        def whole(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            """``loss`` of all pairs."""

            def one(batch):
                better, worse = (np.clip((matrix(batch, side) - centre) / scale, -8, 8) for side in ("better", "worse"))
                value, gradient, hessian = loss(w, better - worse, 0.0)
                return batch.num_rows * np.concatenate([[1.0, value], gradient, hessian.ravel()]) if batch.num_rows else 0.0

            total = summed(met, one, 2 + size + size * size)
            value, gradient, hessian = total[1] / total[0], total[2 : 2 + size] / total[0], total[2 + size :].reshape(size, size) / total[0]
            return value + RIDGE / 2 * w @ w, gradient + RIDGE * w, hessian + RIDGE * np.eye(size)

        model.weight = newton(whole, model.weight)
    model.cut = quantile_of(rows, model, (bad, good), counts)
    return model


def quantile_of(rows: DataFrame, model: Model, own: tuple[int, int], counts: tuple[int, int]) -> float:
    """``quantile`` of the raw scores of all rows; the range that holds it is cut until it has at most CUT_ROWS scores."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(matrix(batch, "features"))), batch.column("y")], ["raw", "y"])

    weight = F.when(F.col("y"), counts[1] / max(1, own[1])).otherwise(counts[0] / max(1, own[0]))
    scores = rows.select("features", "y").mapInArrow(run, "raw double, y boolean")
    part = durable(scores.groupBy("raw").agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n")))
    ends = part.agg(F.min("raw"), F.max("raw")).first()
    if counts[0] == 0:
        return float(ends[0] - 1)
    if counts[1] == 0:
        return float(ends[1] + 1)
    target, below, above = counts[0] - 0.5, 0.0, None  # weight below the range, least score above it
    while part.count() > CUT_ROWS:
        edges = sorted(set(part.agg(F.percentile_approx("raw", [k / 64 for k in range(1, 64)], 2_000)).first()[0]))
        place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("raw")))
        sums = part.groupBy(place.alias("place")).agg(F.sum("weight").alias("weight"), F.min("raw").alias("least")).orderBy("place").collect()
        at = 0
        while at < len(sums) - 1 and below + sums[at]["weight"] < target:
            below, at = below + sums[at]["weight"], at + 1
        if at < len(sums) - 1:
            above = sums[at + 1]["least"]
        part = part.where(place == sums[at]["place"])
    last = sorted(part.collect(), key=lambda r: r["raw"])
    for k, r in enumerate(last):
        below += r["weight"]
        if below >= target:
            if r["n"] > 1 and below - r["weight"] / r["n"] >= target:
                return float(r["raw"])  # the next score is the same
            after = last[k + 1]["raw"] if k + 1 < len(last) else above
            return float(ends[1] + 1 if after is None else (r["raw"] + after) / 2)
    return float(ends[1] + 1)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``, the score of each whole text: 0 to 1, THRESHOLD at the quantile.

    A null text scores as an empty one, which has a score like any other. One row for each row; equal texts score the
    same; a column already called ``out`` is replaced. Without labels of both kinds all weights are zero.
    """

    def make():
        hasher = Hasher(fold=False)
        return lambda column: pa.array(model.score(features(column, hasher)))

    return with_column(docs, text, out, "double", make, keep)
