"""Compare registered queries with their SQL on DuckDB: `python -m tests.oracle [folder] [name-prefix ...]`."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return ("", "")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return ("n", "nan" if math.isnan(number) else f"{number + 0.0:.9g}" if not isinstance(value, int) else f"{number:.9g}" if abs(value) < 10**8 else str(value))
    if isinstance(value, datetime.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    if isinstance(value, (list, tuple)):
        return ("l", str([_cell(v) for v in value]))
    return ("s", str(value))


def normalised(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str:
    """Empty if equal, else the first difference."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = normalised(names, result.fetchall())
    actual = normalised(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows != {len(expected)}; got {actual[:2]}, want {expected[:2]}"
    for a, e in zip(actual, expected, strict=True):
        if a != e:
            return f"got {a}, want {e}"
    return ""


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, oracles, bad = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            problem = compare(df, con, oracles[name]) if name in oracles else f"(no SQL) {len(df.collect())} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        good = problem == "" or problem.startswith("(no SQL)")
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {time.time() - start:6.2f}s {name} {problem[:900]}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
