"""Compare queries with their SQL twins in DuckDB: row count, column types by family, values."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == object or str(frame[c].dtype) in ("string", "str"):
            frame[c] = frame[c].map(lambda v: None if v is None or (isinstance(v, float) and v != v) else str(v))
        elif str(frame[c].dtype).startswith("float"):
            frame[c] = frame[c].astype("float64")
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


def family(dtype) -> str:
    d = str(dtype)
    return "int" if d.startswith(("int", "Int", "uint")) else d


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    g, w = canonical(got), canonical(want)
    for c in g.columns:
        a, b = g[c], w[c]
        if family(a.dtype) != family(b.dtype) and a.notna().all() and b.notna().all():
            return f"type of {c}: {a.dtype} vs {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = same[~same].index[:3]
            return f"{(~same).sum()} values of {c} differ, e.g.\n{g.loc[at]}\n{w.loc[at]}"
    return None


def main(names: list[str], sf: str) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from trialweave.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf), entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in names)]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            got = df.toPandas()
            took = time.time() - start
            if name not in sql:
                note = f"rows only ({len(got)})"
            else:
                want = con.execute(sql[name]).df()
                note = compare(got, want)
                if note:
                    bad += 1
                    note = "MISMATCH " + note
                else:
                    note = f"ok ({len(got)})"
        except Exception as error:  # report and go on: this is a check tool
            took, bad = time.time() - start, bad + 1
            note = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        print(f"{name:32s} {took:6.2f}s {note}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    main(args, sf)
