"""Catalog of topics and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.sources.log import KEYS


def topic_catalog(log: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Topics by name with their number of partitions.

    ``declared`` (topic, partition) adds partitions that hold no message.
    """
    pairs = log.select(*KEYS)
    if declared is not None:
        pairs = pairs.union(declared.select(*KEYS))
    return (
        pairs.distinct().groupBy("topic").agg(F.count("partition").alias("n_partitions")).orderBy("topic")
    )


def list_topics(log: DataFrame, declared: DataFrame | None = None) -> list[str]:
    """Sorted topic names, all of them: use ``topic_catalog`` for a table. A log without topics is an error."""
    names = [row["topic"] for row in topic_catalog(log, declared).select("topic").toLocalIterator()]
    if not names:
        raise LookupError("no topics found in the log")
    return sorted(names)


def partition_offsets(log: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Cursor table: first offset, end (exclusive) and the cursor at the first offset.

    Reads the address columns only and combines in the map tasks, so a hot partition costs one
    row per task. Partitions that are only ``declared`` get ``start = end = offset = 0``.
    """
    ranges = log.groupBy(*KEYS).agg(F.min("offset").alias("start"), (F.max("offset") + 1).alias("end"))
    if declared is not None:
        ranges = declared.select(*KEYS).join(ranges, KEYS, "left").fillna(0, ["start", "end"])
    return as_cursors(ranges)


def as_cursors(ranges: DataFrame) -> DataFrame:
    """Cursor table over (topic, partition, start, end) with every cursor at its start."""
    return ranges.select(*KEYS, "start", "end", F.col("start").alias("offset"))


def partition_table(cursors: DataFrame) -> DataFrame:
    """Cursor table with the size of every partition."""
    return cursors.select(
        *KEYS, "start", "offset", "end", (F.col("end") - F.col("start")).alias("size")
    ).orderBy(*KEYS)


def non_empty(cursors: DataFrame) -> DataFrame:
    """Partitions that have something to open."""
    return partition_table(cursors).where("size > 0")


def open_topic(log: DataFrame, topic: str, catalog: DataFrame | None = None) -> DataFrame:
    """Messages of one topic by exact name; a name the catalog lacks is an error."""
    known = (log if catalog is None else catalog).where(F.col("topic") == topic)
    if known.select("topic").isEmpty():
        raise LookupError(f"no topic named {topic!r}")
    return log.where(F.col("topic") == topic)


def partition_json(cursors: DataFrame) -> DataFrame:
    """Every partition as one JSON object."""
    row = F.struct(*KEYS, "start", "end", "offset", F.lit("").alias("filter"))
    return cursors.select(F.to_json(row).alias("json"))
