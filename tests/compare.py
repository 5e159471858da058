"""Runs registered queries next to their SQL and compares row counts, columns and values.

    python tests/compare.py [--sf 0.01] [query ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(float(v) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and an SQL text; empty when they agree."""
    columns, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    other, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    problems = []
    if columns != other:
        problems.append(f"columns {columns} / {other}")
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} / {len(theirs)}")
    if ours != theirs:
        a, b = set(ours) - set(theirs), set(theirs) - set(ours)
        problems.append(f"{len(a)} rows differ, e.g. {sorted(a)[:2]} / {sorted(b)[:2]}")
    return problems


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as contract
    from revwatch.session import build_session

    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": f"/tmp/revwatch-compare-{os.getpid()}",
    }
    spark = build_session(master="local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    queries, oracle = contract.queries(), contract.oracle_sql()
    print(f"{len(queries)} queries, {len(oracle)} with SQL, without: {sorted(set(queries) - set(oracle))}")
    failed = 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problems = compare(df, con, oracle[name]) if name in oracle else []
            note = "" if name in oracle else f"{df.count()} rows, no SQL"
        except Exception as e:  # report and go on with the next query
            problems, note = [f"{type(e).__name__}: {str(e)[:400]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:28s} {time.time() - start:6.2f}s {note} {'; '.join(problems)[:700]}",
              flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
