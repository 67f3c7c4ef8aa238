"""Compare registered queries with their SQL twins: python check.py [sf_dir] [name …]."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from changetide.session import get_session
from workload import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, entry):
    run, sql = entry
    start = time.time()
    frame = run(spark, sf_dir)
    found = frame.collect()
    spent = time.time() - start
    if sql is None:
        return f"rows {len(found)}", spent
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    wanted = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"COLUMNS {sorted(frame.columns)} != {sorted(columns)}", spent
    a, b = rows_of(frame.columns, found), rows_of(columns, wanted)
    if a == b:
        return f"ok {len(found)}", spent
    missing, extra = list((b - a).items())[:2], list((a - b).items())[:2]
    return f"DIFF spark {len(found)} sql {len(wanted)}\n   only sql {missing}\n   only spark {extra}", spent


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, entry in registry().items():
        if only and name not in only:
            continue
        try:
            outcome, spent = compare(spark, con, sf_dir, name, entry)
        except Exception as exc:  # noqa: BLE001 - a report over all queries
            outcome, spent = f"ERROR {type(exc).__name__}: {str(exc)[:600]}", 0.0
        bad += not outcome.startswith(("ok", "rows"))
        print(f"{name:28s} {spent:6.2f}s  {outcome}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
