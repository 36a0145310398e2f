"""Run registered queries in Spark and their SQL in DuckDB over the same tables and compare the values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def value(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return float(x) if not isinstance(x, int) else x


def canonical(rows):
    return sorted((tuple(value(v) for v in row) for row in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    start = time.time()
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    mine = canonical(frame.select(*columns).collect())
    spark_seconds = time.time() - start
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns if c in names]
    theirs = canonical(tuple(row[i] for i in order) for row in result.fetchall())
    duck_seconds = time.time() - start
    problem = ""
    if sorted(names) != columns:
        problem = f"columns {columns} against {sorted(names)}"
    elif len(mine) != len(theirs):
        problem = f"{len(mine)} rows against {len(theirs)}"
    elif mine != theirs:
        odd = [(a, b) for a, b in zip(mine, theirs) if a != b]
        problem = f"{len(odd)} rows differ, e.g. {str(odd[0])[:600]}"
    return problem, len(mine), spark_seconds, duck_seconds


if __name__ == "__main__":
    import __spark_entry__ as entry
    from charlascope.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if name not in sqls or (only and name not in only):
            continue
        try:
            problem, rows, s, d = compare(session, con, name, query, sqls[name], sf_dir)
        except Exception as error:  # noqa: BLE001
            problem, rows, s, d = f"{type(error).__name__}: {str(error)[:900]}", -1, 0, 0
        bad += bool(problem)
        print(f"{name:32s} rows={rows:7d} spark={s:6.2f}s duckdb={d:6.2f}s {problem or 'ok'}", flush=True)
    print("failed:", bad)
