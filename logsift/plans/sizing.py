"""Size checks in front of everything that is broadcast or held on the driver.

Cursor tables hold one row per partition of the log, so they are normally small, but nothing
guarantees it. Every use counts first: see ``small_side``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logsift.plans.session import scratch_path

HELD_ROWS = 50_000
BROADCAST_BYTES = 64 << 20


def held_rows(table: DataFrame, limit: int | None = None) -> list[dict] | None:
    """The rows of ``table`` on the driver, or None when there are more than ``limit``."""
    limit = HELD_ROWS if limit is None else limit
    rows = table.limit(limit + 1).collect()
    return [row.asDict() for row in rows] if len(rows) <= limit else None


def local_frame(like: DataFrame, rows: list[dict]) -> DataFrame:
    """``rows`` as a local relation with the column types of ``like``; its size is exact."""
    schema = to_arrow_schema(like.schema)
    columns = [pa.array([row[f.name] for row in rows], f.type) for f in schema]
    return like.sparkSession.createDataFrame(pa.Table.from_arrays(columns, schema=schema), like.schema)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table below the checkpoint folder and go on from there.

    It cuts the lineage, survives lost executors, and unlike a checkpoint of rows it is compressed
    and lets later passes read single columns.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(table: DataFrame, limit: int | None = None) -> DataFrame:
    """Fix a catalog-sized table at this moment, so that later steps do not compute it again.

    Small tables become a local relation; larger ones a written table.
    """
    rows = held_rows(table, limit)
    return materialise(table) if rows is None else local_frame(table, rows)


def small_side(table: DataFrame) -> tuple[DataFrame, list[dict] | None]:
    """``table`` as the small side of a join, with its rows when they are held on the driver.

    Up to ``HELD_ROWS`` rows it is a broadcast local relation, up to ``BROADCAST_BYTES`` a broadcast
    written table, beyond that a written table that is joined by shuffle.
    """
    rows = held_rows(table)
    if rows is not None:
        return F.broadcast(local_frame(table, rows)), rows
    table = materialise(table)
    return (F.broadcast(table) if measured_bytes(table) <= BROADCAST_BYTES else table), None


def measured_bytes(table: DataFrame) -> int:
    """Size in memory: 16 bytes a value, and the texts."""
    kinds = (T.StringType, T.BinaryType)
    texts = [F.octet_length(f.name) for f in table.schema if isinstance(f.dataType, kinds)]
    text = F.sum(sum(texts, F.lit(0))) if texts else F.lit(0)
    n, length = table.agg(F.count("*"), F.coalesce(text, F.lit(0))).first()
    return n * 16 * len(table.columns) + length


def join_small(big: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``big`` with ``table``: by broadcast when it is proven small, else by shuffle."""
    return big.join(small_side(table)[0], keys, how)
