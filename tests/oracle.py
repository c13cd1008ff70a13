"""Compare registered queries with their DuckDB SQL: `python tests/oracle.py [sf] [name ...]`."""

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


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, int):
        return f"{value:.6f}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.6f}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name, folder, queries, oracles):
    df = queries[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return len(got), None, []
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), len(want), [f"columns {sorted(df.columns)} != {sorted(names)}"]
    bad = [(a, b) for a, b in zip(got, want, strict=False) if a != b]
    if len(got) != len(want) or bad:
        extra = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return len(got), len(want), [f"spark only {extra[0]}", f"duckdb only {extra[1]}"]
    return len(got), len(want), []


def main() -> int:
    import __spark_entry__ as entry
    from citadex.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = get_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    con, failed = database(folder), 0
    for name in names:
        start = time.time()
        try:
            n, m, problems = compare(spark, con, name, folder, queries, oracles)
        except Exception as error:  # report and go on with the next query
            n, m, problems = None, None, [str(error)[:900]]
        state = "FAIL" if problems else ("rows" if m is None else "ok")
        failed += bool(problems)
        print(f"{state:5} {name:20} {n} {m} {time.time() - start:.1f}s", flush=True)
        for problem in problems:
            print("      ", problem[:1500], flush=True)
    print("unmatched oracles:", sorted(set(oracles) - set(queries)), "failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
