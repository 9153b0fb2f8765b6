"""Compare every registered query with its SQL on DuckDB.

    python tests/oracle.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def rows_of(arrow) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(arrow.column_names)
    types = [str(arrow.schema.field(n).type).replace("large_", "") for n in names]
    columns = [arrow.column(n).to_pylist() for n in names]
    rows = [tuple(_plain(v) for v in row) for row in zip(*columns, strict=True)]
    return names, types, sorted(rows, key=repr)


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def compare(result, connection, sql: str) -> str | None:
    """None when the DataFrame equals the SQL, else what differs."""
    got = rows_of(result.toArrow())
    want = rows_of(connection.sql(sql).to_arrow_table())
    for label, left, right in zip(("columns", "types", "rows"), got, want, strict=True):
        if left == right:
            continue
        if label != "rows":
            return f"{label}: {left} / {right}"
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        return f"{len(left)} / {len(right)} rows; {only_left!r:.400} / {only_right!r:.400}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    oracles = contract.oracle_sql()
    bad = 0
    for name, query in contract.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        begin = time.time()
        if name in oracles:
            try:
                difference = compare(query(spark, folder), connection, oracles[name])
            except Exception as error:
                difference = f"{type(error).__name__}: {str(error)[:1500]}"
        else:
            difference = None if (n := query(spark, folder).count()) else "no rows"
            name += f" (rows only: {n})"
        bad += difference is not None
        print(f"{'ok  ' if difference is None else 'DIFF'} {time.time() - begin:6.2f}s {name} {difference or ''}")
    print(f"{bad} differ")
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
