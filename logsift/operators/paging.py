"""Pages of messages, found by offset instead of by counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.operators.ranges import in_range
from logsift.operators.scan import filtered_head
from logsift.sources.log import ADDRESS, Log
from logsift.sources.stored import StoredLog


def page_messages(
    log: Log,
    cursors: DataFrame,
    page: int,
    height: int,
    dense: bool = False,
    step: int | None = None,
) -> DataFrame:
    """Page ``page`` of every partition: the first ``height`` messages from ``start + page * height``.

    On a ``dense`` log the page is the offset range itself; no ranking is needed. On a log with
    gaps ``step`` reads growing offset ranges until every partition has its page, for logs stored
    in offset order. Of a ``stored_log`` no more files are read than the page needs by their record counts.
    """
    first = F.col("start") + page * height
    seek = cursors.withColumn("offset", first)
    if dense:
        return in_range(log, seek.withColumn("end", F.least("end", first + height)))
    if isinstance(log, StoredLog):
        seek = log.enough(seek, height)
    return filtered_head(log, F.lit(True), height, seek, step=step)


def page_ids(log: Log, cursors: DataFrame, height: int) -> DataFrame:
    """The page of every message, by arithmetic on its offset."""
    rows = in_range(log, cursors, keep=("start",))
    return rows.select(*ADDRESS, F.expr(f"(offset - start) div {int(height)}").alias("page"))
