"""Runs registered queries next to their SQL in an in-process DuckDB and compares values.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tidemark.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}"
    if v is None or isinstance(v, (bool, str, bytes)):
        return repr(v)
    if isinstance(v, int):
        return str(v)
    try:
        f = float(v)
        return f"{f:.9g}" if f != int(f) else str(int(f))
    except (TypeError, ValueError):
        return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name):
    t = time.time()
    df = entry.queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    compare.spark_time = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows", len(got[1]), None
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return "columns", len(got[1]), f"{got[0]} vs {want[0]}"
    if got[1] != want[1]:
        g, w = set(got[1]), set(want[1])
        return "DIFF", len(got[1]), f"spark {len(got[1])} sql {len(want[1])}; only spark {sorted(g - w)[:3]}; only sql {sorted(w - g)[:3]}"
    return "ok", len(got[1]), None


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    want = argv[1:]
    spark, con, bad = build_session("oracle-check"), connect(sf), 0
    for name in entry.queries():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            state, n, note = compare(spark, con, sf, name)
        except Exception as e:  # report and go on
            state, n, note = "ERROR", 0, "".join(traceback.format_exception_only(e))[:600]
        took = time.time() - t
        bad += state not in ("ok", "rows")
        print(f"{state:8} {getattr(compare, 'spark_time', 0):6.2f}s of {took:6.2f}s {n:7d} {name}" + (f"  {note}" if note else ""), flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
