"""Small hostile tables and plain restatements of the rules, shared by the tests of this folder."""

from __future__ import annotations

import random
import re

BASE = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", id bigint, row string, at int, h bigint, key string, node string, label int, n int, _text string, _gone array<int>"


def documents(spark, rows, extra=True):
    """rows: (doc_id, text, lang, source); further columns have names that operators use inside."""
    full = [(i, t, lang, s, None if t is None else len(t), *((1, "r", 2, 3, "k", "n", 4, 5, "t", [0]) if extra else ())) for i, t, lang, s in rows]
    return spark.createDataFrame(full, BASE + (EXTRA if extra else "")).repartition(3)


def sentence(rng: random.Random, words: int, stems=("al", "be", "ti", "on", "re", "th", "ou", "en")) -> str:
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def shingles(text: str | None) -> frozenset:
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def components(sets: list[frozenset], ids: list) -> list:
    """Smallest id reachable from each row over links of similarity 0.75 or more."""
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least: dict = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(sets))]


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple]:
    """(start, kind number, kind, end) by the plain patterns."""
    out = []
    for number, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), number, kind, m.end()))
    return sorted(out)
