"""Licence scan: equivalent texts share a digest, others do not."""

import fixtures as X

from trialweave.llm import licenses as L


def test_equivalent_texts_are_found(spark):
    mit = L.MIT.replace("<year> <copyright holders>", "2020 Jane Doe").upper().replace(",", " ,").replace("\n\n", "\n")
    isc = "© 1999 someone\n" + L.ISC.replace("Copyright (c) <year> <owner>", "(c) 2001 A\nAll rights reserved.")
    notice = "Intro text.\n  ** Licenced under the Apache License -- Version 2.0 **\nmore\nReleased under the MIT licence!"
    rows = [(1, mit, None, None), (2, isc, None, None), (3, notice, None, None), (4, L.MIT + " with changes", None, None), (5, None, None, None), (6, "", None, None), (7, " \n.", None, None)]
    rows += [(None, mit, None, None), (1, mit, None, None), (8, "x" * 300_000, None, None), (9, "Copyright 2020 A\nCopyright 2021 B", None, None)]
    docs = X.documents(spark, rows)
    got = [(r["doc_id"], r["license"]["whole"], [tuple(x) for x in r["license"]["lines"]]) for r in L.scan(docs, L.known_licenses(spark)).collect()]
    by = {i: (w, n) for i, w, n in got}
    assert len(got) == len(rows) and sum(i == 1 for i, *_ in got) == 2
    assert by[1][0] == by[None][0] == "MIT" and by[2][0] == "ISC" and by[4][0] is None
    assert by[3] == (None, [(1, "Apache-2.0"), (3, "MIT")])
    assert all(by[i] == (None, []) for i in (5, 6, 7, 8, 9))
    assert L.scan(docs.limit(0), L.known_licenses(spark)).count() == 0
    assert all(r["license"]["whole"] is None for r in L.scan(docs, L.known_licenses(spark, []).limit(0)).collect())


def test_usual_licences_and_notices_are_known(spark):
    folder = L.Path(L.__file__).parent / "texts"
    whole = {k: (folder / f"{k}.txt").read_text() for k in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")}
    whole["BSD-3-Clause"] = "BSD 3-Clause License\n\nCopyright (c) 2020, A\n" + (folder / "BSD-3-Clause.txt").read_text().replace("University nor", "copyright holder nor").replace("REGENTS AND", "COPYRIGHT HOLDERS AND").replace("REGENTS OR", "COPYRIGHT HOLDER OR")
    whole["BSD-2-Clause"] = whole["BSD-3-Clause"].replace("BSD 3", "BSD 2").split("3. Neither")[0] + "\nTHIS SOFTWARE" + whole["BSD-3-Clause"].partition("THIS SOFTWARE")[2]
    whole["MIT"], whole["Apache-2.0 "] = L.MIT.partition("\n")[2], whole["Apache-2.0"].split("APPENDIX")[0]
    lines = [("MPL-2.0", "/* SPDX-License-Identifier: MPL-2.0 */"), ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-only"), ("LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0-or-later"), ("BSD-3-Clause", "This project is licensed under the BSD 3-Clause License."), ("GPL-3.0-or-later", "Licensed under the GNU General Public License v3 or later")]
    rows = [(k, t, None, None) for k, t in enumerate([*whole.values(), *[t for _, t in lines]])]
    got = {r["doc_id"]: r["license"] for r in L.scan(X.documents(spark, rows), L.known_licenses(spark)).collect()}
    assert [got[k]["whole"] for k in range(len(whole))] == [k.strip() for k in whole]
    assert [got[len(whole) + k]["lines"][0]["license"] for k in range(len(lines))] == [k for k, _ in lines]


def test_known_texts_name_one_licence():
    names: dict = {}
    for name, text in L.KNOWN:
        names.setdefault(L.canonical(text), set()).add(name)
    assert "" not in names and all(len(n) == 1 for n in names.values())


def test_the_python_form_is_the_column_form(spark):
    texts = [t for _, t in L.KNOWN] + ["Licence — Organisation’s © x", "  (c) me\nkept ÉCOLE", "a (c) b", "©x\n-- Copyright z\nhttp://X.y/Z", "copyrighted work\ncopyright"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = df.select("k", L.F.array_join(L.canonical_lines("text"), " ").alias("c")).orderBy("k").collect()
    assert [r["c"] for r in got] == [L.canonical(t) for t in texts]
