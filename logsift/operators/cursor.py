"""Moves of the cursors of a partition table. Every result stays inside ``[start, end]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.ranges import in_range
from logsift.plans.sizing import pin
from logsift.sources.log import KEYS, Log


def move(cursors: DataFrame, n: int) -> DataFrame:
    """Positive ``n``: on from the current cursor. Zero or negative: back from the end."""
    return move_forward(cursors, n) if n > 0 else move_back(cursors, n)


def move_forward(cursors: DataFrame, n: int) -> DataFrame:
    """``offset + n``, at most the last message."""
    if n <= 0:
        raise ValueError("n must be positive")
    return _with_offset(cursors, F.greatest(F.least(F.col("offset") + n, F.col("end") - 1), F.col("start")))


def move_back(cursors: DataFrame, n: int) -> DataFrame:
    """The last ``|n|`` offsets of every partition; 0 places the cursor at the end."""
    if n > 0:
        raise ValueError("n must not be positive")
    return _with_offset(cursors, F.greatest(F.col("end") + n, F.col("start")))


def jump(
    cursors: DataFrame, offset: int, topic: str | None = None, partition: int | None = None
) -> DataFrame:
    """Place cursors at ``offset``, in one topic or partition if named; at or past the end: no move."""
    chosen = F.lit(True)
    if topic is not None:
        chosen = chosen & (F.col("topic") == topic)
    if partition is not None:
        chosen = chosen & (F.col("partition") == partition)
    target = F.greatest(F.lit(offset).cast("bigint"), F.col("start"))
    return _with_offset(
        cursors, F.when(chosen & (F.lit(offset) < F.col("end")), target).otherwise(F.col("offset"))
    )


def remaining(log: Log, cursors: DataFrame) -> DataFrame:
    """Number of messages between every cursor and its end; reads the address columns only."""
    cursors = pin(cursors)
    counts = in_range(log, cursors).groupBy(*KEYS).agg(F.count("*").alias("n_records"))
    return cursors.join(counts, KEYS, "left").fillna(0, ["n_records"])


def _with_offset(cursors: DataFrame, offset: Column) -> DataFrame:
    return cursors.withColumn("offset", offset.cast("bigint"))
