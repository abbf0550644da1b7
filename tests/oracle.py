"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ALLOWED = {"BIGINT", "INTEGER", "DOUBLE", "VARCHAR", "BOOLEAN", "TIMESTAMP", "DATE"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~null"
    if isinstance(value, bool):
        return f"bool {value}"
    if isinstance(value, (int, float)):
        return f"{float(value):.6g}" if isinstance(value, float) else f"{float(value):.15g}" if abs(value) > 999999 else f"{float(value):.6g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat(timespec="microseconds")
    return str(value)


def compare(spark, name: str, query, sql: str | None, folder: str, db) -> tuple[bool, str]:
    started = time.time()
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    rows = [tuple(row[c] for c in columns) for row in frame.collect()]
    took = time.time() - started
    if sql is None:
        return len(rows) > 0, f"{name}: {len(rows)} rows, no SQL, {took:.1f}s"
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != columns:
        return False, f"{name}: columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    wanted = [tuple(row[i] for i in order) for row in result.fetchall()]
    odd = {c: k for c, k in kinds.items() if k not in ALLOWED}
    mine = sorted(tuple(map(_cell, row)) for row in rows)
    theirs = sorted(tuple(map(_cell, row)) for row in wanted)
    note = f"{name}: {len(rows)} rows, {took:.1f}s" + (f", types {odd}" if odd else "")
    if mine == theirs:
        return not odd, note
    extra, missing = set(mine) - set(theirs), set(theirs) - set(mine)
    return False, (
        f"{note} DIFFER sql {len(wanted)} rows, spark only {len(extra)} e.g. {sorted(extra)[:2]}, sql only {len(missing)} e.g. {sorted(missing)[:2]}, columns {columns}"
    )


def main() -> None:
    from corpusmill.session import local_session

    import __spark_entry__ as contract

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, db = local_session(), connect(folder)
    oracles = contract.oracle_sql()
    bad = 0
    for name, query in contract.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, name, query, oracles.get(name), folder, db)
        except Exception as error:  # a report for the person at the keyboard
            ok, note = False, f"{name}: {type(error).__name__} {str(error)[:900]}"
        bad += not ok
        print("ok  " if ok else "BAD ", note[:1800], flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
