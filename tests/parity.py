"""Compares queries with their SQL: python tests/parity.py [--sf DIR] [NAME...]; also used by the tests."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    """One form for what both engines return."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows(table) -> list[tuple]:
    columns = sorted(table.column_names)
    return sorted(zip(*(map(plain, table.column(c).to_pylist()) for c in columns), strict=True), key=repr)


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    ours, theirs = query(spark, sf_dir).toArrow(), con.execute(sql).to_arrow_table()
    out = []
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return [f"columns {sorted(ours.column_names)} and {sorted(theirs.column_names)}"]
    for c in ours.column_names:
        a, b = str(ours.schema.field(c).type).replace("large_", ""), str(theirs.schema.field(c).type).replace("large_", "")
        if a != b:
            out.append(f"type of {c}: {a} and {b}")
    a, b = rows(ours), rows(theirs)
    if len(a) != len(b):
        out.append(f"{len(a)} and {len(b)} rows")
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        out.append(f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}")
    if not a:
        out.append("no rows")
    return out


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tideline.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args[:1] == ["--sf"] and args.pop(0) else "/root/testdata/sf0.01"
    spark, con = local_session(8), oracle(sf)
    all_queries, all_sql = entry.queries(), entry.oracle_sql()
    for name in args or [n for n in all_queries if n in all_sql]:
        t = time.time()
        try:
            found = differences(spark, con, all_queries[name], all_sql[name], sf)
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:1500]}"]
        print(name, "ok" if not found else found, f"{time.time() - t:.1f} s", flush=True)
