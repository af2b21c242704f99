"""Runs a registered query next to its SQL twin in DuckDB and compares whole results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool) or isinstance(v, (int, str)):
        return v
    if type(v).__name__ == "Decimal":
        return float(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, con, fn, sql, folder) -> tuple[bool, str, int]:
    df = fn(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, "rows only", len(got)
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns differ\n  spark {got_cols}\n  sql   {want_cols}", len(got)
    if len(got) != len(want):
        return False, f"row counts differ: spark {len(got)} sql {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b]
        return False, f"{len(bad)} of {len(got)} rows differ; first: {cells[:6]} in {g}", len(got)
    return True, "match", len(got)


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = make_session()
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failures = 0
    for name, fn in queries.items():
        if argv and not any(a in name for a in argv):
            continue
        t = time.time()
        try:
            ok, note, n = compare(spark, con, fn, oracle.get(name), folder)
        except Exception as exc:  # report and go on with the next query
            ok, note, n = False, f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        failures += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:38s} {n:7d} rows {time.time() - t:6.2f}s {'' if note == 'match' else note}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
