"""Bounded reads of a log: ranges, lookups, first messages, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsift.functions.text import byte_cut, char_cut
from logsift.operators.decode import decode
from logsift.operators.ranges import at_addresses, in_range
from logsift.operators.waves import first_addresses
from logsift.plans.sizing import join_small, materialise, pin
from logsift.sources.log import ADDRESS, KEYS, Log
from logsift.sources.stored import StoredLog

BLOCK_BITS = 16


def range_scan(log: Log, cursors: DataFrame | None = None) -> DataFrame:
    """Messages from every cursor to the end snapshot, all partitions in one job."""
    return in_range(log, cursors)


def lookup(log: Log, requests: DataFrame) -> DataFrame:
    """Messages at a table of (topic, partition, offset) requests."""
    return at_addresses(log, requests)


def message_at_position(log: Log, cursors: DataFrame, n: int, dense: bool = False) -> DataFrame:
    """The ``n``-th message (from 0) after the start of every partition.

    On a ``dense`` log, one without gaps, that is the offset ``start + n`` and only it is read. A ``stored_log`` tells
    the file from its record counts, and only the file with the message is read.
    """
    if dense:
        at = cursors.select(*KEYS, (F.col("start") + n).alias("offset"), "end").where("offset < end")
        return at_addresses(log, at)
    cursors = cursors.withColumn("offset", F.col("start"))
    if isinstance(log, StoredLog):
        places = pin(log.ranked(cursors, n))
        inside = in_range(log, places.withColumnsRenamed({"low": "offset", "high": "end"})).select(*ADDRESS)
        ends = cursors.select(*KEYS, "end")
        found = nth_offset(inside, places.select(*KEYS, (F.col("skip") + 1).alias("_nth"))).join(ends, KEYS).where("offset < end")
        return at_addresses(log, found)
    return at_addresses(log, nth_offset(in_range(log, cursors).select(*ADDRESS), n + 1))


def nth_offset(log: DataFrame, n: int | DataFrame) -> DataFrame:
    """(topic, partition, offset) of the ``n``-th message (from 1) of every partition that has as many.

    ``n`` may be a table (topic, partition, _nth). Messages are counted per block of offsets with a map-side combine; the counts add up to the rank before
    every block, and only the offsets of the one block that holds the ``n``-th are gathered.
    """
    block = F.shiftright("offset", BLOCK_BITS).alias("_block")
    counts = log.groupBy(*KEYS, block).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*KEYS).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    counts = counts.withColumn("_nth", F.lit(n)) if isinstance(n, int) else join_small(counts, n, KEYS)
    at = counts.where("_before < _nth and _before + _n >= _nth").select(*KEYS, "_block", (F.col("_nth") - F.col("_before") - 1).alias("_at"))
    inside = join_small(log.select(*ADDRESS, block), at, [*KEYS, "_block"])
    offsets = F.sort_array(F.collect_list("offset"))
    nth = F.get(offsets, F.first("_at").cast("int"))
    return inside.groupBy(*KEYS).agg(nth.alias("offset"))


def first_n(log: DataFrame, n: int) -> DataFrame:
    """The ``n`` messages with the smallest offsets of every partition.

    A few are ranked per map task and then together. Spark limits such ranks early only up to
    a threshold; beyond it every partition is cut at the offset of its ``n``-th message instead, so that no task
    ever ranks the messages of a hot partition.
    """
    if n > _ranked_early(log.sparkSession):
        last = nth_offset(log, n).withColumnRenamed("offset", "_last")
        return join_small(log, last, KEYS, "left").where("_last is null or offset <= _last").drop("_last")
    in_block = Window.partitionBy(*KEYS, F.shiftright("offset", BLOCK_BITS)).orderBy("offset")
    in_partition = Window.partitionBy(*KEYS).orderBy("offset")
    nearest = log.withColumn("_rank", F.row_number().over(in_block)).where(F.col("_rank") <= n)
    ranked = nearest.withColumn("_rank", F.row_number().over(in_partition)).where(F.col("_rank") <= n)
    return ranked.select(*log.columns)


def filtered_head(
    log: Log,
    predicate: Column,
    n: int,
    cursors: DataFrame | None = None,
    decoders: dict | None = None,
    step: int | None = None,
) -> DataFrame:
    """The first ``n`` messages of every partition, from its cursor, that satisfy ``predicate``.

    The predicate sees the raw value, once per message; only the kept messages are decoded, and one that cannot be
    decoded fails the query. With ``step`` the log is read in growing offset ranges, and partitions
    that already have ``n`` matches are not read further. Then, and for more messages than Spark ranks early, the addresses of matches are
    kept and the messages are looked up.
    """
    if step is not None:
        if cursors is None:
            raise ValueError("step needs cursors")
        head = at_addresses(log, first_addresses(log, cursors, predicate, n, step, first_n))
    else:
        rows = in_range(log, cursors)
        if n > _ranked_early(rows.sparkSession):
            head = at_addresses(log, first_n(materialise(rows.where(predicate).select(*ADDRESS)), n))
        else:
            head = first_n(rows.where(predicate), n)
    return head if decoders is None else decode(head, decoders, "fail")


def _ranked_early(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


def preview(log: DataFrame, width: int, unit: str = "byte") -> DataFrame:
    """Address and the first ``width`` bytes or characters of every value."""
    if unit not in ("byte", "char"):
        raise ValueError(f"unit must be 'byte' or 'char', not {unit!r}")
    cut = byte_cut if unit == "byte" else char_cut
    return log.select(*ADDRESS, cut("value", width).alias("preview"))


def with_context(log: Log, cursors: DataFrame) -> DataFrame:
    """Start and end of the partition beside each message from its cursor on."""
    return in_range(log, cursors, keep=("start", "end"))


# The headings of a partition and of a message.
PARTITION_HEADING = "topic: %s partition: %d start: %d end: %d"
MESSAGE_HEADING = "topic: %s partition: %d offset: %d"


def partition_header() -> Column:
    """Heading of a partition for rows with the columns of a cursor table."""
    return F.format_string(PARTITION_HEADING, "topic", "partition", "start", "end")


def message_header() -> Column:
    """Heading of a message."""
    return F.format_string(MESSAGE_HEADING, "topic", "partition", "offset")
