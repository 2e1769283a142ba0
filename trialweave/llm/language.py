"""Language of the words of code-switched texts by a linear-chain conditional random field.

Words are letter runs. A word's potentials are the summed weights of its prefixes, suffixes, inner n-grams and its
entry in a lexicon of frequent words; transitions between the languages of neighbouring words are learned too.
The chain is trained on spliced sequences, cut from labelled texts of different languages, so that switches are
seen, and words are labelled by forward-backward marginals. A chain is a whole line, however long, and every word
of the whole text is labelled.

The lexicon is counted over all rows that may be learned from. The weights are fitted on a bounded sample of them: the
PER_LANGUAGE ids of each language that come first by a hash, one text of each id, and of a text of more than ROW_WORDS
words so many of its stretches, drawn from all over it, as reach that number.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Hasher, bounded, slices, trim, with_column
from .wordstats import Words

PER_LANGUAGE = 250  # labelled ids of each language used for the fit
ROW_WORDS = 200  # words of each such row, at least, that enter the spliced sequences
SPLICED = 64  # words of a spliced sequence, at least
BITS = 16  # hashed feature space
LEXICON = 300  # frequent words of each language with a feature of their own
STEPS, RATE, RIDGE = 60, 0.1, 1e-4
UNKNOWN = "und"
HAS_LETTER = re.compile(r"[^\W\d_]")

KIND = "struct<lang:string,score:double,runs:array<struct<start:bigint,end:bigint,lang:string>>>"


def features(words: Words, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the distinct word, hashed feature)."""
    parts = [words.ends(1, n, False) for n in (1, 2, 3, 4)] + [words.ends(2, n, True) for n in (1, 2, 3, 4)] + [words.inner(3, n) for n in (2, 3)]
    own = np.concatenate([p for p, _ in parts])
    code = (np.concatenate([f for _, f in parts]) >> np.uint64(64 - BITS)).astype(np.int64)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, words.distinct), len(lexicon) - 1)
        listed = np.flatnonzero(lexicon[at] == words.distinct)
        own, code = np.concatenate((own, listed)), np.concatenate((code, (1 << BITS) + at[listed]))
    return own, code


def forward_backward(emit: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, expected transitions, log partition) of chains sorted by falling size; emit [chain, place, label]."""
    n, width, labels = emit.shape
    top = emit.max(axis=2, keepdims=True)
    local, step = np.exp(emit - top), np.exp(move)
    alpha, beta, scale = np.zeros_like(local), np.ones_like(local), np.ones((n, width))
    alive = [int(np.searchsorted(-size, -t)) for t in range(width)]  # chains longer than t
    for t in range(width):
        k = alive[t]
        a = local[:k, t] * (alpha[:k, t - 1] @ step if t else 1.0)
        scale[:k, t] = a.sum(axis=1)
        alpha[:k, t] = a / scale[:k, t, None]
    for t in range(width - 2, -1, -1):
        k = alive[t + 1]
        beta[:k, t] = (beta[:k, t + 1] * local[:k, t + 1]) @ step.T / scale[:k, t + 1, None]
    within = np.arange(width)[None, :] < size[:, None]
    both = within[:, 1:]
    left, right = alpha[:, :-1][both], (beta * local / scale[:, :, None])[:, 1:][both]
    return alpha * beta, (left.T @ right) * step, ((np.log(scale) + top[:, :, 0]) * within).sum(axis=1)


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # [feature, language]
    move: np.ndarray  # [language, language]
    lexicon: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """Potentials of the distinct words."""
        own, code = features(words, self.lexicon)
        return np.stack([np.bincount(own, self.weight[code, j], len(words.distinct)) for j in range(len(self.langs))], axis=1)

    def predict(self, column: pa.Array, hasher: Hasher) -> pa.StructArray:
        words = Words(column, hasher)
        emit = self.emissions(words)
        first, size = chains(words)
        order = np.argsort(-size, kind="stable")
        marginal = np.zeros((len(words.start), len(self.langs)))
        low = 0
        while low < len(order):
            width = size[order[low]]
            group = order[low : low + max(1, 60_000 // width)]
            low += len(group)
            at = first[group][:, None] + np.arange(width)
            within = np.arange(width) < size[group][:, None]
            at = np.where(within, at, 0)
            m, _, _ = forward_backward(emit[words.form[at]], size[group], self.move)
            marginal[at[within]] = m[within]
        text = np.repeat(np.arange(len(column)), np.diff(words.bound))
        mass = np.stack([np.bincount(text, marginal[:, j], len(column)) for j in range(len(self.langs))], axis=1)
        best, total = mass.argmax(axis=1), np.maximum(mass.sum(axis=1), 1e-12)
        known = [t is not None and HAS_LETTER.search(t) is not None for t in column.to_pylist()]
        lang = [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known)]
        share = np.where(known, mass[np.arange(len(best)), best] / total, 0.0)
        label = marginal.argmax(axis=1)
        opens = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (text[1:] != text[:-1])))) if len(label) else label
        close = np.concatenate((opens[1:] - 1, [len(label) - 1])).astype(np.int64) if len(label) else label
        runs = pa.StructArray.from_arrays(
            [pa.array(words.point(words.start[opens])), pa.array(words.point(words.end[close])), pa.array(self.langs, pa.string()).take(pa.array(label[opens]))],
            names=["start", "end", "lang"])
        bound = np.concatenate(([0], np.cumsum(np.bincount(text[opens], minlength=len(column)))))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.clip(share, 0, 1)), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), runs)], names=["lang", "score", "runs"])


def chains(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each chain: the words of a line."""
    line = np.cumsum(words.data == 10)[words.start]
    if not len(line):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    return first, np.diff(np.concatenate((first, [len(line)])))


def stretches(text: str, hasher: Hasher) -> str:
    """Stretches of 4 to 40 words of a text, one on each line: in random order, until ROW_WORDS words are reached.

    The draw depends on the text alone.
    """
    words = Words(pa.array([text], pa.string()), hasher)
    raw, total = words.raw.tobytes(), len(words.start)
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    cut = np.cumsum(rng.integers(4, 41, total // 4 + 1))
    cut = np.concatenate(([0], cut[cut < total], [total]))
    lines, taken = [], 0
    for k in rng.permutation(len(cut) - 1):
        if taken >= ROW_WORDS:
            break
        lines.append(b" ".join(raw[s:e] for s, e in zip(words.start[cut[k] : cut[k + 1]], words.end[cut[k] : cut[k + 1]])))
        taken += cut[k + 1] - cut[k]
    return b"\n".join(lines).decode()


def fit(texts: list[str], langs: list[str], lexicon: np.ndarray, seed: int = 5) -> Model:
    """Penalised likelihood of spliced lines of ``texts`` by full-batch adaptive gradient steps; deterministic.

    ``lexicon`` holds the hashes of the frequent words in rising order.
    """
    names = sorted(set(langs))
    words = Words(pa.array(texts, pa.string()), Hasher(fold=False))
    label_of = np.array([names.index(lang) for lang in langs], np.int64)
    first, size = chains(words)
    label = label_of[np.searchsorted(words.bound, first, side="right") - 1]
    rows, labels = [], []
    have: list[np.ndarray] = []
    tags: list[np.ndarray] = []
    held = 0
    order = np.random.default_rng(seed).permutation(len(first))
    for k in order:
        have.append(words.form[first[k] : first[k] + size[k]])
        tags.append(np.full(size[k], label[k]))
        held += size[k]
        if held >= SPLICED or k == order[-1]:
            rows.append(np.concatenate(have))
            labels.append(np.concatenate(tags))
            have, tags, held = [], [], 0
    order = sorted(range(len(rows)), key=lambda k: -len(rows[k]))
    size = np.array([len(rows[k]) for k in order], np.int64)
    model = Model(names, np.zeros(((1 << BITS) + len(lexicon), len(names))), np.zeros((len(names), len(names))), lexicon)
    if len(names) < 2 or not len(size):
        return model
    width = int(size[0])
    form, gold = np.zeros((len(order), width), np.int64), np.full((len(order), width), -1)
    for i, k in enumerate(order):
        form[i, : size[i]], gold[i, : size[i]] = rows[k], labels[k]
    within = gold >= 0
    truth = np.zeros((*form.shape, len(names)))
    truth[within, gold[within]] = 1
    seen = np.zeros((len(names), len(names)))
    pairs = within[:, 1:]
    np.add.at(seen, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    own, code = features(words, lexicon)
    used = np.unique(form[within])
    mask = np.zeros(len(words.distinct), bool)
    mask[used] = True
    own, code = own[mask[own]], code[mask[own]]
    total = within.sum()
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weight, model.move)]
    for step in range(1, STEPS + 1):
        emit = np.stack([np.bincount(own, model.weight[code, j], len(words.distinct)) for j in range(len(names))], axis=1)
        m, moves, _ = forward_backward(emit[form], size, model.move)
        error = np.where(within[:, :, None], m - truth, 0)
        by_form = np.stack([np.bincount(form.ravel(), error[:, :, j].ravel(), len(words.distinct)) for j in range(len(names))], axis=1)
        grads = [
            np.stack([np.bincount(code, by_form[own, j], len(model.weight)) for j in range(len(names))], axis=1) / total + RIDGE * model.weight,
            (moves - seen) / total + RIDGE * model.move,
        ]
        for value, grad, s in zip((model.weight, model.move), grads, state):
            s[0], s[1] = 0.9 * s[0] + 0.1 * grad, 0.99 * s[1] + 0.01 * grad**2
            value -= RATE * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-9)
    return model


def held_out(ident: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a missing id is neither held out nor learned from."""
    return F.coalesce(F.crc32(ident.cast("string")) % 4 == 2, F.lit(False))


def frequent(rows: DataFrame) -> np.ndarray:
    """Hashes of the LEXICON most frequent words of each language of (lang, text), ties to the smaller; counted over all rows."""

    def count(batches):
        hasher = Hasher(fold=False)
        for part in slices(batches, "text"):
            words = Words(part.column("text"), hasher)
            langs = part.column("lang").dictionary_encode()
            own = np.repeat(np.asarray(langs.indices), np.diff(words.bound)).astype(np.int64)
            pair, n = np.unique(own * len(words.distinct) + words.form, return_counts=True)
            at = pair % max(1, len(words.distinct))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(pair // max(1, len(words.distinct)))), pa.array(words.distinct[at].view(np.int64)), pa.array(n.astype(np.int64))],
                names=["lang", "word", "n"])
        trim()

    counts = rows.mapInArrow(count, "lang string, word bigint, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("place", place).where(F.col("place") <= LEXICON).select("word").distinct().collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def trained(docs: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows, with a lexicon of all of them.

    Languages are few by nature: LEXICON hashes and PER_LANGUAGE x ROW_WORDS words of each reach the driver. The result
    depends neither on the order nor on the partitions of the rows; of rows that repeat an id, the smallest text counts.
    """
    bounded(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("language sample")), "doc_id"))
    ids = usable.select("lang", "doc_id").distinct().withColumn("place", place).where(F.col("place") <= PER_LANGUAGE).select("lang", "doc_id")
    drawn = usable.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def draw(batches):
        hasher = Hasher(fold=False)
        for part in slices(batches, "text"):
            cut = [stretches(t, hasher) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("doc_id").cast(pa.string()), pa.array(cut, pa.string())], names=["lang", "doc_id", "text"])
        trim()

    rows = sorted(drawn.mapInArrow(draw, "lang string, doc_id string, text string").collect())
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], frequent(usable.select("lang", "text")))


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``: language of the text, its share of the words, and runs of words of one language.

    Null texts and texts without a letter are ``und`` with score 0; ties go to the first language in order; one row
    for each row; a column already called ``out`` is replaced. Without labelled rows every text is ``und``.
    """

    def make():
        hasher = Hasher(fold=False)
        return lambda column: model.predict(column, hasher)

    if not model.langs:
        names = [c for c in (docs.columns if keep is None else keep) if c != out]
        return docs.select(*names).withColumn(out, F.lit(None).cast(KIND)).withColumn(
            out, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.array().cast("array<struct<start:bigint,end:bigint,lang:string>>").alias("runs")))
    return with_column(docs, text, out, KIND, make, keep)
