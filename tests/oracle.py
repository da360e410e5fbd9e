"""Runs a registered query and its SQL check, and compares the rows of both.

As a script: ``python -m tests.oracle SF_DIR [name ...]``.
"""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, run, sql) -> dict:
    start = time.time()
    df = run(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    start = time.time()
    wanted = con.execute(sql)
    columns = [(d[0], str(d[1])) for d in wanted.description]
    rows = wanted.fetchall()
    result = {"spark": took, "duckdb": time.time() - start, "n": len(got)}
    if sorted(df.columns) != sorted(c for c, _ in columns):
        return {**result, "problem": f"columns {sorted(df.columns)} {sorted(c for c, _ in columns)}"}
    mine, theirs = _rows(df.columns, got), _rows([c for c, _ in columns], rows)
    if mine != theirs:
        only = list((mine - theirs).items())[:2], list((theirs - mine).items())[:2]
        count = sum((mine - theirs).values()), sum((theirs - mine).values())
        return {**result, "problem": f"{len(got)} against {len(rows)} rows, differing {count}: {only}"}
    result["types"] = [
        f"{c}:{dict(df.dtypes)[c]}/{t}"
        for c, t in columns
        if _KINDS.get(dict(df.dtypes)[c]) != t
    ]
    return {**result, "problem": None}


_KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.conftest import session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(sf)
    checks = entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            if name in checks:
                r = compare(spark, con, sf, run, checks[name])
                state = "OK " if r["problem"] is None else "BAD"
                print(f"{state} {name} n={r['n']} spark={r['spark']:.2f} duckdb={r['duckdb']:.2f}",
                      r["problem"] or (r["types"] or ""), flush=True)
            else:
                start = time.time()
                n = run(spark, sf).count()
                print(f"ROWS {name} n={n} spark={time.time() - start:.2f}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERR {name} {type(e).__name__}: {str(e)[:1500]}", flush=True)
