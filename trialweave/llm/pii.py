"""Personal data in texts by weak supervision, in DataFrame functions only.

* Candidates: the base spans (email, ip, card, phone: leftmost, non-overlapping per kind, then checked) and wider
  ones: digit runs of seven digits or more, and long hexadecimal strings.
* Labelers vote yes, no or nothing on each candidate: shape and checksum patterns, gazetteers (top-level domains,
  calling codes, card issuers, reserved networks), and words before the span.
* Votes and features are small integers, so the whole table is summed up by its distinct patterns; there are at most
  3^5 votes x 5 kinds x 2^4 features of them, whatever the number of rows. Expectation-maximisation over the counted
  patterns estimates the prior and how reliable each labeler is; a logistic span classifier is trained on the
  posteriors and applied as a column expression.
* Spans the classifier accepts are added; base spans always stay.

Patterns use possessive repeats and look-behinds where the plain ones could recurse or rescan a run; they match the
same spans.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import free, written

# Base kinds in order, the added kinds after them.
KINDS = ["email", "ip", "card", "phone", "number", "secret"]
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "digits": r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9]){6,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[0-9a-f]{32,64}+(?![A-Za-z0-9_])",
}
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "digits": r"[0-9](?:[ -]?[0-9]){6}", "phone": "+", "secret": "[0-9a-f]{32}"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Gazetteers.
DOMAINS = "com org net edu gov info io de fr es it uk eu ch at nl be pl us ca".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 55 61 81 86 91".split()
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
RESERVED = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."
YES_WORDS = r"(?i)(?:mail|contact|call|phone|tel|fax|mobile|card|visa|account|iban|ssn|passport|host|server|address|login|token|key|secret|password)\W*(?:is|=|:|no|number)?\W*$"
NO_WORDS = r"(?i)(?:version|isbn|issn|order|page|fig|figure|table|section|item|v)\W*$"
BEFORE = 32  # characters before a span that labelers read
BLOCK = 128  # matches whose positions are summed at once

VOTES = ["shape", "checksum", "gazetteer", "context", "counter"]
FEATURES = ["long", "parted", "mixed", "named"]
ROUNDS, STEPS, RATE = 60, 400, 0.5


def matches(text: Column, kind: str) -> Column:
    """(start, end, hit, before) of the matches of one pattern, in code points; empty without the guard.

    Positions are running sums of the lengths of gaps and hits. A fold that appends to an array copies it each time,
    so the sums run inside blocks of BLOCK matches and then over the blocks. ``before`` reaches back to the match
    before at most: a word that stands before two spans of one kind speaks for the first.
    """
    pattern, guard = PATTERNS[kind], GUARDS[kind]
    there = F.instr(text, guard) > 0 if len(guard) == 1 else F.regexp_like(text, F.lit(guard))
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    match = "struct<start:bigint,end:bigint,hit:string,before:string>"
    none = F.array().cast(f"array<{match}>")
    zero = F.lit(0).cast("bigint").alias("at")

    def step(state: Column, z: Column) -> Column:
        start = state.at + F.length(z.gap)
        end = start + F.length(z.hit)
        one = F.struct(start.alias("start"), end.alias("end"), z.hit.alias("hit"), F.substring(z.gap, -BEFORE, BEFORE).alias("before"))
        return F.struct(end.alias("at"), F.concat(state.out, F.array(one)).alias("out"))

    def moved(m: Column, by: Column) -> Column:
        return F.struct((m.start + by).alias("start"), (m.end + by).alias("end"), m.hit.alias("hit"), m.before.alias("before"))

    def join(state: Column, block: Column) -> Column:
        here = F.transform(block.out, lambda m: moved(m, state.at))
        return F.struct((state.at + block.at).alias("at"), F.concat(state.out, F.array(here)).alias("out"))

    def placed(kept: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.size(kept) + 1, F.lit(BLOCK)), lambda k: k <= F.size(kept))
        blocks = F.transform(firsts, lambda k: F.aggregate(F.slice(kept, k, F.lit(BLOCK)), F.struct(zero, none.alias("out")), step))
        return F.flatten(F.aggregate(blocks, F.struct(zero, F.array().cast(f"array<array<{match}>>").alias("out")), join, lambda state: state.out))

    kept = F.filter(both, lambda z: z.hit.isNotNull())
    return F.when(there, F.get(F.transform(F.array(kept), placed), F.lit(0))).otherwise(none)  # the matches are bound once


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def only_digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def judged(kind: str, m: Column) -> Column:
    """A candidate with its final kind, whether it is a base span, its votes and its features."""
    hit, digits, none = m.hit, only_digits(m.hit), F.lit(0)
    count = F.length(digits)
    if kind == "email":
        tld = F.lower(F.substring_index(hit, ".", -1))
        name, base = F.lit("email"), F.lit(True)
        shape, checksum = vote(F.regexp_like(tld, F.lit("^[a-z]{2,}$")), F.regexp_like(tld, F.lit("[0-9]"))), vote(F.regexp_like(hit, F.lit("^[A-Za-z0-9]")), F.regexp_like(hit, F.lit(r"^[.]|\.\.|\.@")))
        gazetteer = vote(tld.isin(DOMAINS))
    elif kind == "ip":
        name, base = F.lit("ip"), F.regexp_like(hit, F.lit(rf"^(?:{BYTE}\.){{3}}{BYTE}$"))
        shape, checksum, gazetteer = vote(base, ~base), vote(~F.regexp_like(hit, F.lit(r"(?:^|\.)0[0-9]"))), vote(F.lit(False), F.regexp_like(hit, F.lit(RESERVED)))
    elif kind == "digits":
        sized = count.between(12, 19)
        valid = F.when(sized, luhn(digits)).otherwise(F.lit(False))
        name, base = F.when(valid, "card").otherwise("number"), valid
        shape, checksum, gazetteer = vote(count.isin(13, 14, 15, 16), ~sized), vote(valid, sized & ~valid), vote(sized & F.regexp_like(digits, F.lit(ISSUERS)), sized)
    elif kind == "phone":
        name, base = F.lit("phone"), count.between(9, 15)
        shape, checksum = vote(base, ~base), vote(F.regexp_like(hit, F.lit(r"^\+[0-9]{1,3}[ (.-]")))
        gazetteer = vote(F.regexp_extract(hit, r"^\+([0-9]{1,3})", 1).isin(CALLING))
    else:
        name, base = F.lit("secret"), F.lit(False)
        shape, checksum = vote(F.length(hit).isin(32, 40, 64), ~F.length(hit).isin(32, 40, 64)), vote(F.regexp_like(hit, F.lit("[0-9]")) & F.regexp_like(hit, F.lit("[a-f]")), F.regexp_like(hit, F.lit("^(?:[0-9]+|[a-f]+)$")))
        gazetteer = none
    context, counter = vote(F.regexp_like(m.before, F.lit(YES_WORDS))), vote(F.lit(False), F.regexp_like(m.before, F.lit(NO_WORDS)))
    bits = [F.length(hit) >= 16, F.regexp_like(hit, F.lit("[ ().-]")), F.regexp_like(hit, F.lit("[A-Za-z]")) & (count > 0), F.regexp_like(m.before, F.lit(r"[=:(\"']\s*$"))]
    return F.struct(
        m.start.alias("start"), m.end.alias("end"), name.alias("kind"), F.coalesce(base, F.lit(False)).alias("base"),
        *[F.coalesce(v, none).cast("tinyint").alias(n) for n, v in zip(VOTES, (shape, checksum, gazetteer, context, counter))],
        *[F.coalesce(b, F.lit(False)).cast("tinyint").alias(n) for n, b in zip(FEATURES, bits)],
    )


def candidates(docs: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """``docs`` with ``out``: the judged candidates of each whole text; null is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    names = {k: free(docs.columns, f"_{k}") for k in PATTERNS}
    found = docs.withColumns({n: matches(whole, k) for k, n in names.items()})
    judge = [F.transform(n, partial(judged, k)) for k, n in names.items()]
    return found.withColumn(out, F.concat(*judge)).drop(*names.values())


def estimated(patterns: list[Row]) -> tuple[float, dict[str, list[float]], list[float]]:
    """(prior, reliabilities, posterior of each pattern) of the labelers by expectation-maximisation over counts.

    A labeler's reliability is the chance of a yes, given that it votes, on true and on false candidates; it starts
    from better than chance and is smoothed by one pseudo vote each way.
    """
    prior, rate = 0.5, {v: [0.8, 0.2] for v in VOTES}
    post = [0.5] * len(patterns)
    for _ in range(ROUNDS):
        for i, p in enumerate(patterns):
            true, false = math.log(prior), math.log(1 - prior)
            for v in VOTES:
                if p[v]:
                    a, b = rate[v]
                    true += math.log(a if p[v] > 0 else 1 - a)
                    false += math.log(b if p[v] > 0 else 1 - b)
            post[i] = 1 / (1 + math.exp(min(700.0, false - true)))
        weight = sum(p["n"] for p in patterns)
        prior = min(0.99, max(0.01, (1 + sum(p["n"] * q for p, q in zip(patterns, post))) / (2 + weight)))
        for v in VOTES:
            for side in (0, 1):
                mass = [(p["n"] * (q if side == 0 else 1 - q), p[v]) for p, q in zip(patterns, post) if p[v]]
                rate[v][side] = (sum(m for m, sign in mass if sign > 0) + (1.6, 0.4)[side]) / (sum(m for m, _ in mass) + 2)
    return prior, rate, post


def trained(patterns: list[Row], post: list[float]) -> dict[str, float]:
    """Logistic span classifier on kind, votes and features, fitted to the posteriors; a weight for each input."""
    inputs = [{"bias": 1.0, f"kind={p['kind']}": 1.0, **{n: float(p[n]) for n in (*VOTES, *FEATURES) if p[n]}} for p in patterns]
    weight: dict[str, float] = {n: 0.0 for x in inputs for n in x}
    total = sum(p["n"] for p in patterns) or 1
    for _ in range(STEPS):
        grad = {n: 0.001 * w for n, w in weight.items()}
        for x, p, q in zip(inputs, patterns, post):
            z = sum(weight[n] * v for n, v in x.items())
            g = p["n"] / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - q)
            for n, v in x.items():
                grad[n] += g * v
        for n in weight:
            weight[n] -= RATE * grad[n]
    return weight


def accepted(c: Column, weight: dict[str, float]) -> Column:
    z = F.lit(weight.get("bias", 0.0))
    for kind in KINDS:
        if f"kind={kind}" in weight:
            z = z + F.when(c.kind == kind, weight[f"kind={kind}"]).otherwise(0.0)
    for name in (*VOTES, *FEATURES):
        if name in weight:
            z = z + c.getField(name) * weight[name]
    return z > 0


def listed(found: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keys = F.array_sort(F.transform(found, lambda c: F.struct(c.start.alias("start"), rank[c.kind].alias("rank"), c.end.alias("end"), c.kind.alias("kind"))))
    return F.array_join(F.transform(keys, lambda c: F.concat_ws(":", c.kind, c.start.cast("string"), c.end.cast("string"))), ",")


def of_kind(kind: str, c: Column) -> Column:
    return c.kind == kind


def personal_data(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: counts of the base kinds, base spans and all spans (kind, start, end).

    One row for each row, whatever repeats. Null and empty texts have no spans; spans of one start are ordered by
    kind. The text itself is not returned. ``out`` replaces a column of that name. With no candidate at all the
    classifier accepts nothing.
    """
    rows = written(candidates(docs.drop(out), text, out).drop(text), "candidates")
    single = rows.select(F.explode(out).alias("c")).select("c.*")
    patterns = single.groupBy("kind", *VOTES, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns.sort(key=lambda p: tuple(p[n] for n in ("kind", *VOTES, *FEATURES)))
    _, _, post = estimated(patterns)
    weight = trained(patterns, post) if patterns else {}
    base = F.filter(out, lambda c: c.base)
    spans = F.filter(out, lambda c: c.base | accepted(c, weight))
    plain = lambda found: F.transform(found, lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end")))
    counts = [F.size(F.filter(base, partial(of_kind, k))).cast("bigint").alias(f"n_{k}") for k in KINDS[:4]]
    return rows.withColumn(out, F.struct(*counts, plain(base).alias("base"), plain(spans).alias("spans")))
