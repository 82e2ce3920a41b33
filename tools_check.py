"""Compare registered queries with their SQL: python tools_check.py [sf] [name ...]."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

from registry import ORACLES, QUERIES, load_all
from tocsin.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        "check", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    load_all()
    bad = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = fn(spark, folder)
            found = [tuple(row) for row in df.collect()]
        except Exception as error:  # noqa: BLE001
            print(f"{name}: SPARK ERROR {str(error)[:1500]}")
            bad += 1
            continue
        spent = time.time() - started
        if name not in ORACLES:
            print(f"{name}: rows {len(found)} (no SQL) {spent:.1f}s")
            continue
        try:
            started = time.time()
            result = con.execute(ORACLES[name])
            columns = [item[0] for item in result.description]
            expected = result.fetchall()
            sql_spent = time.time() - started
        except Exception as error:  # noqa: BLE001
            print(f"{name}: SQL ERROR {str(error)[:1500]}")
            bad += 1
            continue
        if sorted(columns) != sorted(df.columns):
            print(f"{name}: COLUMNS {sorted(set(columns) ^ set(df.columns))}")
            bad += 1
            continue
        left, right = rows_of(df.columns, found), rows_of(columns, expected)
        if left != right:
            bad += 1
            print(f"{name}: DIFFERS rows {len(left)} / {len(right)}; columns {sorted(columns)}")
            for only, label in ((set(left) - set(right), "spark"), (set(right) - set(left), "sql")):
                for row in sorted(only)[:3]:
                    print("   ", label, len(only), row)
        else:
            print(f"{name}: ok {len(left)} rows {spent:.1f}s (sql {sql_spent:.1f}s)")
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
