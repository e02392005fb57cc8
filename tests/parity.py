"""Run queries and their SQL side by side: ``python -m tests.parity <sf_dir> [query ...]``.

``PARITY_CONF="name=value,name=value"`` sets session options, such as the spark.cardwatch limits.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def differences(spark_rows, spark_columns, cursor) -> list[str]:
    """Empty when both sides hold the same columns and, in any order, the same rows."""
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(spark_columns):
        return [f"columns {sorted(spark_columns)} != {sorted(columns)}"]
    order = sorted(columns)
    place = {c: columns.index(c) for c in order}
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    ours = sorted((tuple(_norm(r[c]) for c in order) for r in spark_rows), key=key)
    theirs = sorted((tuple(_norm(r[place[c]]) for c in order) for r in cursor.fetchall()), key=key)
    found = [] if len(ours) == len(theirs) else [f"rows {len(ours)} != {len(theirs)}"]
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        found.append(f"{len(bad)} rows differ in {order}, first: {bad[0]}")
    return found


def check(spark, con, name: str, sf_dir: str) -> tuple[list[str], int]:
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = oracle_sql().get(name)
    return (differences(rows, df.columns, con.execute(sql)) if sql else []), len(rows)


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    for option in filter(None, os.environ.get("PARITY_CONF", "").split(",")):
        spark.conf.set(*option.split("="))
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            found, rows = check(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            found, rows = [f"{type(error).__name__}: {str(error)[:800]}"], -1
        failed += bool(found)
        kind = "sql " if name in oracle_sql() else "rows"
        print(f"{'FAIL' if found else 'ok  '} {kind} {name:24s} {rows:8d} rows {time.time() - start:6.2f}s", *found[:2],
              flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
