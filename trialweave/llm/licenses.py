"""Licences by canonical digest: whole texts, and single lines, looked up among the digests of known texts.

A text is folded to lower case, loses its copyright lines and punctuation, and has equivalent spellings unified;
the SHA-256 of what remains is hash-joined to the digests of the known licences and notices. The known texts are a
parameter; they are few (at most KNOWN_ROWS, which is checked) and so can be sent to every executor. By default they
are the whole texts in the folder ``texts``, MIT and ISC, with usual titles and with and without the appendix, and
the notices and SPDX lines made for each licence id.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free

KNOWN_ROWS = 50_000

# Public licence texts and the customary notices that name a licence.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"],
}
# How BSD texts name the holder: in the third clause, where the software is provided, where liability is excluded.
HOLDERS = [
    ("University", "REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"), ("copyright holder", "COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"),
    ("copyright holder", "COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS"), ("author", "AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"),
]
NAMES = {
    "MIT": ["MIT License"], "ISC": ["ISC License"], **{k: [t.removeprefix("The ") for t in TITLES[k]] for k in ("BSD-2-Clause", "BSD-3-Clause")},
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    **{f"MPL-{v}": [f"Mozilla Public License, Version {v}", f"Mozilla Public License {v}", f"Mozilla Public License, v. {v}", f"MPL {v}"] for v in ("1.1", "2.0")},
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero 1.0 Universal"],
}
for _code, _name in [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]:
    NAMES[f"CC-{_code}-4.0"] = [f"CC {_code} 4.0", *[f"Creative Commons {_name} 4.0{end}" for end in ("", " License", " International", " International License")]]
GNU = {"GPL": ("General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("Lesser General Public License", ("2.1", "3.0")), "AGPL": ("Affero General Public License", ("3.0",)), "GFDL": ("Free Documentation License", ("1.2", "1.3"))}
for _code, (_name, _versions) in GNU.items():
    for _v in _versions:
        _all = [w for w in dict.fromkeys((_v, _v.removesuffix(".0")))]
        NAMES[f"{_code}-{_v}"] = [form for w in _all for form in (f"GNU {_name}, version {w}", f"GNU {_name} v{w}", f"GNU {_code} v{w}", f"GNU {_code}v{w}", f"{_code} version {w}", f"{_code}v{w}")]
NAMES["LGPL-2.0"] = ["GNU Library General Public License, version 2", "GNU Library General Public License, version 2.0"]
LATER = ["or later", "or (at your option) any later version"]
OPENINGS = [f"{a} under {b}" for a in ("Licensed", "Released", "Distributed", "Published", "Available", *(f"This {x} is licensed" for x in ("work", "project", "software", "program"))) for b in ("", "the ", "the terms of the ")]
SPDX = ["0BSD", "AFL-3.0", "Artistic-1.0-Perl", "Artistic-2.0", "BSL-1.0", "CDDL-1.0", "CECILL-2.1", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "MS-PL", "MIT-0", "NCSA", "OFL-1.1", "PostgreSQL", "Unlicense", "WTFPL", "Zlib"]
END = "END OF TERMS AND CONDITIONS"  # what follows in whole texts may be left out


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of whole licences, in their usual forms."""
    out = []
    for path in sorted((Path(__file__).parent / "texts").glob("*.txt")):
        text, name = path.read_text(encoding="utf-8"), path.name.removesuffix(".txt")
        if name != "BSD-3-Clause":
            head = text.partition(END)[0]
            out += [(name, t) for t in dict.fromkeys((text, head, head + END if head != text else text))]
            continue
        for third, by, event in HOLDERS:
            three = text.replace("name of the University", f"name of the {third}").replace("REGENTS AND CONTRIBUTORS", by).replace("REGENTS OR CONTRIBUTORS", event)
            two = re.sub(r"(?s)\n3\. .*?\n\n", "\n\n", three)
            for own, body in (("BSD-3-Clause", three), ("BSD-2-Clause", two)):
                out += [(own, f"{title}\n{b}") for b in (body, re.sub(r"(?m)^[123]\. ", "* ", body)) for title in ("", *TITLES[own])]
    for name, text in (("MIT", MIT), ("ISC", ISC)):
        out += [(name, f"{title}\n{text.partition(chr(10))[2]}") for title in ("", *TITLES[name])]
    return out


def notices() -> list[tuple[str, str]]:
    """(license, line) of the customary notices and SPDX lines for each licence id."""
    out = []
    for name, forms in NAMES.items():
        gnu = name.split("-")[0] in GNU
        out += [(name, f"{opening}{form}") for opening in OPENINGS for form in forms]
        out += [(f"{name}-or-later", f"{opening}{form} {later}") for opening in OPENINGS for form in forms for later in LATER if gnu]
        out += [(own, f"SPDX-License-Identifier: {code}") for own, code in ((name, name), (name, f"{name}-only"), (f"{name}-or-later", f"{name}-or-later"))[: 3 if gnu else 1]]
    return out + [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]


KNOWN = [
    ("MIT", MIT),
    ("ISC", ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    *whole_texts(),
    *notices(),
]
# Equivalent spellings, as words after folding.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "http": "https", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n©]*(?:copyright\b|\(c\)|©|all rights reserved\b)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
VARIANTS = r"\b(" + "|".join(sorted(SPELLINGS)) + r")\b"


def canonical_lines(text: str | Column) -> Column:
    """The canonical form of each line that has any; nulls have none."""
    folded = F.regexp_replace(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), COPYRIGHT, "")
    plain = F.regexp_replace(folded, PUNCTUATION, " ")
    unified = plain
    for variant, usual in SPELLINGS.items():
        unified = F.regexp_replace(unified, rf"\b{variant}\b", usual)
    plain = F.when(F.regexp_like(plain, F.lit(VARIANTS)), unified).otherwise(plain)
    return F.filter(F.transform(F.split(plain, "\n", -1), lambda line: F.trim(line)), lambda line: line != "")


def canonical(text: str) -> str:
    """The canonical whole text, in Python; restates the column expression for the SQL twin and the tests."""
    def letter(c: str) -> bool:
        return c.isalpha() or c.isnumeric()

    lines = []
    for line in text.lower().split("\n"):
        start = next((k for k, c in enumerate(line) if letter(c) or c == "©"), len(line))
        opening = line.find("(c)")
        if re.match(r"(?:copyright|all rights reserved)\b|©", line[start:], re.ASCII) or (opening >= 0 and opening < start):
            continue
        words = "".join(c if letter(c) else " " for c in line).split()
        lines += [SPELLINGS.get(w, w) for w in words]
    return " ".join(lines)


def known_licenses(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, text) of the licences and notices that come with the operator, or of ``rows``."""
    return spark.createDataFrame(KNOWN if rows is None else rows, "license string, text string")


def digests(known: DataFrame) -> DataFrame:
    """(digest, license): one row for each known canonical text; the first name in order where several share it."""
    whole = F.array_join(canonical_lines("text"), " ")
    rows = known.where(F.col("license").isNotNull()).select("license", whole.alias("whole")).where("whole <> ''")
    rows = rows.groupBy(F.sha2("whole", 256).alias("digest")).agg(F.min("license").alias("license"))
    if (n := rows.count()) > KNOWN_ROWS:
        raise ValueError(f"{n} known texts; at most {KNOWN_ROWS} are sent to every executor")
    return F.broadcast(rows)


def scan(docs: DataFrame, known: DataFrame, ident: str = "doc_id", text: str = "text", out: str = "license") -> DataFrame:
    """``docs`` without the text, with ``out``: the licence that the whole text is, and those its lines name.

    One row for each row. Null, empty and unknown texts have a null ``whole`` and no ``lines`` (line number from 0
    among the lines with words, licence). Rows that share id and text share the result; ``out`` replaces a column.
    """
    names = [c for c in docs.columns if c not in (out, text)]
    key, lines_at, digest, whole, hit_row, hit_id, hits = (free([*names, out], n) for n in ("_row", "_lines", "_digest", "_whole", "_hit_row", "_hit_id", "_hits"))
    found = digests(known)
    rows = docs.select(*names, F.xxhash64(ident, text).alias(key), canonical_lines(text).alias(lines_at))
    single = rows.select(F.col(key).alias("row"), F.col(ident).alias("id"), F.posexplode(F.transform(lines_at, lambda line: F.sha2(line, 256))).alias("at", "digest"))
    named = single.join(found, "digest").groupBy(F.col("row").alias(hit_row), F.col("id").alias(hit_id)).agg(F.array_sort(F.collect_set(F.struct("at", "license"))).alias(hits))
    entire = found.select(F.col("digest").alias(digest), F.col("license").alias(whole))
    both = rows.select(*names, key, F.sha2(F.array_join(lines_at, " "), 256).alias(digest)).join(F.broadcast(entire), digest, "left")
    both = both.join(named, (F.col(key) == F.col(hit_row)) & F.col(ident).eqNullSafe(F.col(hit_id)), "left")
    none = F.array().cast("array<struct<at:int,license:string>>")
    return both.select(*names, F.struct(F.col(whole).alias("whole"), F.coalesce(hits, none).alias("lines")).alias(out))


def scan_sql() -> str:
    """SQL twin of the query over ``documents``."""
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted({hashlib.sha256(canonical(t).encode()).hexdigest(): n for n, t in reversed(KNOWN)}.items()))
    plain = rf"regexp_replace(regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT}', '', 'g'), '{PUNCTUATION}', ' ', 'g')"
    for variant, usual in SPELLINGS.items():
        plain = rf"regexp_replace({plain}, '\b{variant}\b', '{usual}', 'g')"
    return f"""WITH known(digest, license) AS (VALUES {values}), d AS (SELECT doc_id, list_filter(list_transform(string_split({plain}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
n AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM (SELECT doc_id, unnest(l) AS line FROM d) JOIN known ON sha256(line) = digest GROUP BY doc_id)
SELECT d.doc_id, k.license AS whole_license, coalesce(n_notices, 0) AS n_notices, coalesce(licenses, '') AS licenses FROM d LEFT JOIN known k ON sha256(array_to_string(l, ' ')) = k.digest LEFT JOIN n ON n.doc_id = d.doc_id"""
