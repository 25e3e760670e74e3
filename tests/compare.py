"""Compare queries with their SQL on DuckDB.

    python tests/compare.py [name-part ...]      (folder: $SF_DIR, default sf0.01)
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (v + 0.0 if v else 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_result(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, sql):
    cur = con.execute(sql)
    return canonical([c[0] for c in cur.description], cur.fetchall())


def difference(a, b) -> str | None:
    if a[0] != b[0]:
        return f"columns {a[0]} vs {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} vs {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if bad:
        return f"{len(bad)} of {len(a[1])} rows differ, e.g.\n   {str(bad[0][0])[:600]}\n   {str(bad[0][1])[:600]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from topicloom.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 1 and not any(part in name for part in sys.argv[1:]):
            continue
        start = time.time()
        try:
            got = spark_result(query(spark, folder))
            took = time.time() - start
            diff = difference(got, duck_result(con, oracles[name])) if name in oracles else None
            tag = "rows-only" if name not in oracles else ("OK" if diff is None else "DIFF")
            note = f"{len(got[1])} rows" if diff is None else diff
        except Exception as e:  # report and go on with the other queries
            took, tag, note = time.time() - start, "ERROR", str(e)[:700]
        bad += tag in ("DIFF", "ERROR")
        print(f"{tag:9} {took:6.2f}s {name}: {note}", flush=True)
    print("failures:", bad)
