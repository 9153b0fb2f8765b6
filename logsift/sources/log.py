"""The message log as a table: one row per message, identified by (topic, partition, offset)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.plans.session import scratch_path
from logsift.plans.sizing import held_rows, local_frame, pin
from logsift.sources import commits
from logsift.sources.commits import KEYS, write_log
from logsift.sources.stored import StoredLog

ADDRESS = [*KEYS, "offset"]

# A log is a DataFrame, or a function that reads the ranges of a cursor table. The function suits
# sources that seek by other means than a filter, such as ``read_kafka`` and ``stored_log``.
Log = DataFrame | Callable[[DataFrame], DataFrame]

__all__ = ["ADDRESS", "KEYS", "Log", "as_log", "manifest", "read_log", "stored_log", "stored_offsets", "stream_log", "write_log"]

LOG_SCHEMA = "topic STRING, partition INT, offset BIGINT, key BINARY, timestamp TIMESTAMP, value BINARY"
CURSOR_SCHEMA = "topic STRING, partition INT, start BIGINT, end BIGINT, offset BIGINT"


def as_log(
    df: DataFrame,
    *,
    topic: Column | str,
    partition: Column | str,
    offset: Column | str,
    value: Column | str,
    key: Column | str | None = None,
    timestamp: Column | str | None = None,
) -> DataFrame:
    """Present any table as a log. ``value`` may be BINARY or STRING."""

    def column(source: Column | str) -> Column:
        return F.col(source) if isinstance(source, str) else source

    columns = [
        column(topic).cast("string").alias("topic"),
        column(partition).cast("int").alias("partition"),
        column(offset).cast("bigint").alias("offset"),
    ]
    if key is not None:
        columns.append(column(key).cast("string").cast("binary").alias("key"))
    if timestamp is not None:
        columns.append(column(timestamp).cast("timestamp").alias("timestamp"))
    return df.select(*columns, column(value).alias("value"))


def read_log(
    spark: SparkSession, path: str, schema: str | T.StructType = LOG_SCHEMA, version: int | None = None
) -> DataFrame:
    """Read a stored log. Topic and partition prune folders, offset bounds prune row groups.

    A log that ``write_log`` stored is read as its newest version, or as ``version``; any other folder as it is.
    """
    now = commits.state(spark, path, version)
    if now is None:
        return spark.read.schema(schema).parquet(path)
    folder = commits.Folder(spark, path)
    if now.whole:
        return spark.read.schema(schema).parquet(folder.pattern)
    return commits.open_files(folder, schema, [row["file"] for row in now.files.select("file").toLocalIterator()])


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """(topic, partition, file, start, end, n, bytes) of the files of a log that ``write_log`` stored."""
    now = commits.state(spark, path, version)
    return now and now.files


def stored_log(
    spark: SparkSession, path: str, schema: str | T.StructType = LOG_SCHEMA, version: int | None = None
) -> StoredLog:
    """A stored log, as it is now or at a version, that opens only the files with wanted messages.

    It takes the place of the DataFrame in every operator that takes cursors.
    """
    now = commits.state(spark, path, version)
    if now is None:
        raise ValueError(f"{path!r} has no manifest: store the log with write_log, or use read_log")
    return StoredLog(commits.Folder(spark, path), schema, now.files)


def stream_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, **options: str) -> DataFrame:
    """A stored log as a file stream: every file once, whatever versions say."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def stored_offsets(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, version: int | None = None) -> DataFrame:
    """Cursor table of a stored log from its manifest, or else from the parquet footers, without reading a row.

    For the footers the aggregate is pushed into the columnar reader, because topic and partition are folder
    columns. The two reader settings it needs are made in a session of its own; the result belongs to
    ``spark``.
    """
    now = commits.state(spark, path, version)
    if now is not None:
        return pin(StoredLog(commits.Folder(spark, path), schema, now.files).offsets())
    reader = spark.newSession()
    v1_sources = reader.conf.get("spark.sql.sources.useV1SourceList").split(",")
    reader.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in v1_sources if s != "parquet"))
    reader.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    ranges = (
        read_log(reader, path, schema)
        .groupBy(*KEYS)
        .agg(F.min("offset").alias("start"), (F.max("offset") + 1).alias("end"))
        .withColumn("offset", F.col("start"))
    )
    rows = held_rows(ranges)
    if rows is not None:
        return local_frame(spark.createDataFrame([], ranges.schema), rows)
    folder = scratch_path(spark, "offsets")
    ranges.write.parquet(folder)
    return spark.read.schema(ranges.schema).parquet(folder)
