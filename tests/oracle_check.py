"""Run queries on Spark and their SQL on DuckDB and compare all rows.

    python tests/oracle_check.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (bool, int)):
        return plain(float(value))
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None) -> tuple[str, str]:
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return ("rows" if got else "EMPTY"), f"{len(got)} rows in {took:.1f}s (no SQL)"
    start = time.time()
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    expected = result.fetchall()
    duck = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return "FAIL", f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, expected)
    if a != b:
        return "FAIL", f"{len(got)} vs {len(expected)} rows; only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}"
    return ("ok" if got else "EMPTY"), f"{len(got)} rows in {took:.1f}s, sql {duck:.1f}s"


def main() -> int:
    import __spark_entry__ as entry
    from duskwatch.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            state, note = compare(spark, con, sf_dir, name, queries[name], sql.get(name))
        except Exception as error:  # noqa: BLE001
            state, note = "FAIL", f"{type(error).__name__}: {str(error)[:600]}"
        bad += state in ("FAIL", "EMPTY")
        print(f"{state:5} {name}: {note}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
