"""Bounded replay: consume a log as a stream up to the end it has now, and no further than the answer needs."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.functions.text import has
from logsift.operators.ranges import in_range
from logsift.plans.session import scratch_path
from logsift.plans.sizing import join_small, pin
from logsift.sources import commits
from logsift.sources.log import ADDRESS, KEYS, LOG_SCHEMA, stored_log, stream_log

FOUND = "topic STRING, partition INT, offset BIGINT"
ORDERED = FOUND + ", low BIGINT, high BIGINT"
FILES = FOUND + ", file STRING"


def replay_first_match(
    stream: DataFrame, needle: str, cursors: DataFrame | None = None, folder: str | None = None, ordered: bool = False
) -> DataFrame:
    """First match of every partition from a stream, as ``search_topic`` finds it in a batch.

    Every micro-batch writes its own first matches, at most one row per partition, to a folder
    named by the batch, so a repeated batch replaces itself and no streaming state is kept. With
    ``folder`` a replay that was interrupted goes on where it stopped.

    ``ordered`` promises that the messages of a partition come in the order of their offsets, as Kafka delivers them, and needs
    ``cursors``: their ends are the snapshot that the replay goes up to. Partitions with a match, or seen to their end, are then left
    out of later batches, and the query stops when none is left. A message that breaks the promise in an open partition is an error.
    """
    if ordered:
        if cursors is None:
            raise ValueError("an ordered replay needs cursors")
        return _ordered(stream, needle, cursors, folder or scratch_path(stream.sparkSession, "replay"))
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, "replay")
    hits = in_range(stream, cursors).where(has(stream, needle)).select(*ADDRESS)

    def keep(batch: DataFrame, number: int) -> bool:
        _write(batch.groupBy(*KEYS).agg(F.min("offset").alias("offset")), folder, number)
        return False

    _run(hits, folder, keep)
    return _first(spark, folder)


def replay_stored(
    spark: SparkSession, path: str, needle: str, schema: str | T.StructType = LOG_SCHEMA, files: int = 16,
    folder: str | None = None,
) -> DataFrame:
    """First match of every partition of a stored log, read ``files`` files at a time as a stream that ends with the answer.

    The manifest at the start is the snapshot: later files are not looked at. A partition is left out of later batches when no file
    that is still to come can hold an earlier match, in whatever order files come, and the query stops when no partition is left.
    """
    folder = folder or scratch_path(spark, "replay")
    place = commits.Folder(spark, path)
    snapshot = _kept(spark, f"{folder}/files", stored_log(spark, path, schema).files.select(*KEYS, "file", "start", "end"))
    stream = stream_log(spark, path, schema, maxFilesPerTrigger=str(files))
    found = has(stream, needle)
    named = stream.select(*ADDRESS, found.alias("_found"), commits.file_name(place).alias("file"))
    read = _read(spark, folder, FILES)
    state = {"open": _waiting(snapshot, read)}

    def keep(batch: DataFrame, number: int) -> bool:
        waiting = state["open"]
        spans = waiting.groupBy(*KEYS).agg(F.min("start").alias("offset"), F.max("end").alias("end"))
        rows = join_small(in_range(batch, spans), waiting.select("file"), ["file"]).groupBy(*KEYS, "file")
        rows = rows.agg(F.min(F.when(F.col("_found"), F.col("offset"))).alias("offset"))
        _write(rows.select(*ADDRESS, "file"), folder, number)
        state["open"] = _waiting(snapshot, _read(spark, folder, FILES))
        return state["open"].isEmpty()

    if not state["open"].isEmpty():
        _run(named, folder, keep)
    return _first(spark, folder)


def _waiting(files: DataFrame, read: DataFrame) -> DataFrame:
    """Files that were not read and may hold a match before the first one known."""
    first = read.groupBy(*KEYS).agg(F.min("offset").alias("_first"))
    left = files.join(read.select("file").distinct(), "file", "left_anti").join(first, KEYS, "left")
    return pin(left.where("_first is null or start < _first").select(*files.columns))


def _ordered(stream: DataFrame, needle: str, cursors: DataFrame, folder: str) -> DataFrame:
    spark = stream.sparkSession
    cursors = _kept(spark, f"{folder}/cursors", cursors.select(*KEYS, "start", "end", "offset"))
    found = has(stream, needle)
    rows = stream.select(*ADDRESS, found.alias("_found"))

    def left(seen: DataFrame) -> DataFrame:
        sums = seen.groupBy(*KEYS).agg(F.min("offset").alias("_first"), F.max("high").alias("_high"))
        states = cursors.join(sums, KEYS, "left").where("offset < end and _first is null")
        return pin(states.where("_high is null or _high < end - 1").drop("_first"))

    state = {"open": left(_read(spark, folder, ORDERED))}

    def keep(batch: DataFrame, number: int) -> bool:
        match = F.min(F.when(F.col("_found"), F.col("offset"))).alias("offset")
        part = in_range(batch, state["open"]).groupBy(*KEYS)
        _write(part.agg(match, F.min("offset").alias("low"), F.max("offset").alias("high")), folder, number)
        now = _batch(spark, folder, number, ORDERED)
        late = now.join(state["open"].select(*KEYS, "_high"), KEYS).where("low <= _high").first()
        if late:
            raise ValueError(f"offset {late['low']} of {late['topic']!r}, partition {late['partition']}, came after {late['_high']}")
        state["open"] = left(_read(spark, folder, ORDERED))
        return state["open"].isEmpty()

    if not state["open"].isEmpty():
        _run(rows, folder, keep)
    return _first(spark, folder)


def _run(rows: DataFrame, folder: str, keep: Callable[[DataFrame, int], bool]) -> None:
    """Give the batches of what is there now to ``keep``, until it says that it has all it needs.

    The query is stopped from here: batches that come until then are not read.
    """
    done = threading.Event()

    def each(batch: DataFrame, number: int) -> None:
        if not done.is_set() and keep(batch, number):
            done.set()

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress")
    query = writer.trigger(availableNow=True).start()
    while query.isActive and not done.wait(0.1):
        pass
    if done.is_set():
        query.stop()
    query.awaitTermination()


def _write(rows: DataFrame, folder: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/matches/batch={number}")


def _batch(spark: SparkSession, folder: str, number: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/matches/batch={number}")


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What the batches have written, this run's and earlier ones'."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/matches").select(*T.StructType.fromDDL(schema).names)
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], schema)


def _first(spark: SparkSession, folder: str) -> DataFrame:
    found = _read(spark, folder, FOUND).where("offset is not null")
    return found.groupBy(*KEYS).agg(F.min("offset").alias("offset"))


def _kept(spark: SparkSession, path: str, table: DataFrame) -> DataFrame:
    """``table`` as the first run of a replay saw it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        table.write.mode("overwrite").parquet(path)
    return pin(spark.read.schema(table.schema).parquet(path))


def first_matches(stream: DataFrame, needle: str) -> DataFrame:
    """First matches of a live log as a running aggregate, for a query that does not end.

    Its state is one number per partition.
    """
    return stream.where(has(stream, needle)).groupBy(*KEYS).agg(F.min("offset").alias("offset"))
