"""Run registered queries against their SQL in DuckDB, the way the check does.

    python tests/compare.py /root/testdata/sf0.01 [name prefix …]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    return v


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def sort_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(df, con, sql):
    """Empty text when equal, else what differs."""
    pdf = df.collect()
    cols = sorted(df.columns)
    if sql is None:
        return "" if pdf else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    a = sorted(([norm(r[c]) for c in cols] for r in pdf), key=sort_key)
    b = sorted(([norm(r[i]) for i in order] for r in want), key=sort_key)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; first {a[:2]} vs {b[:2]}"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"{cols}: {x} vs {y}"
    return "" if a else "no rows"


def main(folder, prefixes):
    import __spark_entry__ as entry
    from runlattice.session import build_session

    spark = build_session("compare", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = run(spark, folder)
            diff = compare(df, con, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - t:.2f}s{'' if name in sqls else ' (rows only)'} {diff}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
