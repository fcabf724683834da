"""Run registered queries next to their SQL in DuckDB and report differences.

usage: python tools/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


spent: dict[str, float] = {}
KINDS = {"int": "int", "bigint": "bigint", "double": "double", "string": "varchar", "boolean": "boolean"}


def compare(spark, con, folder, name, query, sql) -> str | None:
    df = query(spark, folder)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent["spark"] = time.time() - spent.get("start", 0.0)
    if sql is None:
        return None if got else "no rows"
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    types = {d[0]: str(d[1]).lower() for d in found.description}
    want, wanted = rows_of(columns, found.fetchall())
    if names != wanted:
        return f"columns {names} != {wanted}"
    for c, t in df.dtypes:
        known = {"integer": "int"}.get(types[c], types[c])
        if KINDS.get(t, t) != known:
            return f"type of {c}: {t} != {types[c]}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if got != want:
        a, b = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"values differ: {str(a)[:400]} / {str(b)[:400]}"
    return None if got else "no rows"


def main() -> int:
    from markbook.plans import catalog
    from markbook.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), connect(folder)
    limit = int(os.environ.get("QUERY_SECONDS", "90"))
    queries, sql = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in wanted or queries:
        timer = threading.Timer(limit, lambda: (spark.sparkContext.cancelAllJobs(), con.interrupt()))
        timer.start()
        spent.update(start=time.time(), spark=0.0)
        try:
            problem = compare(spark, con, folder, name, queries[name], sql.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        timer.cancel()
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {spent['spark']:.1f}s + sql {time.time() - spent['start'] - spent['spark']:.1f}s {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
