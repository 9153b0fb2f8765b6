"""Helpers that several operators of this folder use."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.plans.sizing import materialise


def read_columns(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    """The named columns of a table; other columns cannot clash with what an operator adds."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns.split())


def shared(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage and outlives lost executors."""
    return materialise(df)


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a task exchanges with Python, and a function sees, at once: long texts and what is made of them fit in memory.
SLICE = 1024
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the rows of an Arrow batch; a smaller bound of the session stays."""
    rows = int(spark.conf.get(ARROW_ROWS))
    if not 0 < rows <= SLICE:
        spark.conf.set(ARROW_ROWS, SLICE)
    return spark


#: Bytes that a task exchanges with Python at once where rows are long.
BATCH_BYTES = 4 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_bytes(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch as well; a smaller bound of the session stays."""
    known = int(spark.conf.get(ARROW_BYTES).rstrip("b"))
    if not 0 < known <= BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch | pa.Table]], schema: str
) -> DataFrame:
    """``function`` on slices of every Arrow batch, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for out in function(batch.slice(at, SLICE)):
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of the named columns, from batches in the order of those columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in names], axis=1)
        cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(marks)], strict=True):
            mark = tuple(marks[low])
            if held and mark != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(low, high - low))
            last = mark
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def in_blocks(rows: DataFrame, group: list[str], node: str, size: int) -> DataFrame:
    """``rows`` of groups with two rows or more, dealt into cells (i, j) of two blocks of a group.

    A group of more than ``size`` rows is split into blocks by a hash of ``node``. A row is in the cells of its
    block with every block, so two rows of a group meet in one cell; in those with i = j both are of one block.
    """
    sizes = rows.groupBy(*group).agg(F.count("*").alias("c")).where("c > 1")
    sizes = sizes.select(*group, F.expr(f"cast((c - 1) div {size} + 1 as int)").alias("blocks"))
    rows = rows.join(sizes, group).withColumn("block", F.expr(f"cast(pmod(xxhash64({node}, 7), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    return rows


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A string column as Python texts, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected links: (id, component), component the smallest id reachable.

    Alternating large and small stars: every round is joins and minima over the links, and is written
    to the shared folder. Ids without a link to another id do not appear. A hot id is only a join key,
    which adaptive execution splits; nothing is gathered per id.
    """
    edges = shared(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    )
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(
                edges.select("lo", "lo").distinct()
            )
        seen = mark
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = shared(
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
            .distinct()
        )
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hang = large.join(root, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = shared(root.select("hi", F.col("m").alias("lo")).union(hang).distinct())
