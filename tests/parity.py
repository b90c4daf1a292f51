"""Compare registered queries with their DuckDB twins.

``python -m tests.parity [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return value
    return repr(value) if isinstance(value, int) else str(value)


def spark_rows(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(tuple(_cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def duckdb_rows(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(_cell(r[i]) for i in order) for r in cursor.fetchall())
    return [names[i] for i in order], rows


def difference(spark, con, query, sql: str, sf_dir: str = SF_DIR) -> str | None:
    """What differs, or None."""
    got_columns, got = spark_rows(query(spark, sf_dir))
    want_columns, want = duckdb_rows(con, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; extra {list(extra)[:2]};"
            f" missing {list(missing)[:2]}"
        )
    return None if got else "no rows on either side"


def main(names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import local_session

    spark, con, bad = local_session(), connect(), 0
    oracles = oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = difference(spark, con, query, oracles[name]) if name in oracles else "no oracle"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{time.time() - start:6.2f}s {name}: {problem or 'ok'}", flush=True)
    print(f"{bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
