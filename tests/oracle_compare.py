"""Run registered queries against their SQL on one data folder: python tests/oracle_compare.py."""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def canonical(v):
    if isinstance(v, float):
        if v != v:
            return "nan"
        return repr(round(v, 9) + 0.0)
    return repr(v)


def compare(spark, con, name, fn, sql, sf):
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(canonical(x) for x in r) for r in df.select(*cols).collect())
    if sql is None:
        return len(got), None, []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(names) != cols:
        return len(got), len(rows), [f"columns {cols} != {sorted(names)}"]
    pick = [names.index(c) for c in cols]
    want = sorted(tuple(canonical(r[i]) for i in pick) for r in rows)
    problems = []
    duck = {d[0]: str(d[1]) for d in cur.description}
    for f in df.dtypes:
        w = TYPES.get(f[1], f[1]).upper()
        if not duck[f[0]].upper().startswith(w):
            problems.append(f"type {f[0]}: spark {f[1]} duck {duck[f[0]]}")
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
        problems.append(f"rows {len(got)} vs {len(want)}; first differences {diff}")
    return len(got), len(want), problems


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as entry

    from stormledger.session import local_session

    spark = local_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(a.sf)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if a.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in a.names):
            continue
        t = time.time()
        try:
            n, m, problems = compare(spark, con, name, fn, oracles.get(name), a.sf)
        except Exception as e:
            if os.environ.get("TRACE"):
                traceback.print_exc()
            n, m, problems = -1, -1, [f"{type(e).__name__}: {str(e)[:700]}"]
        bad += bool(problems)
        tag = "FAIL" if problems else ("ok" if m is not None else "rows")
        print(f"{tag:5s}{name:32s}{n:9d}{time.time() - t:8.1f}s {' | '.join(problems)[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
