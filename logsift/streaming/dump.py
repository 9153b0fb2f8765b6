"""A dump that goes on: a stream of messages as text files, every message once, with the offsets reached."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsift.functions.decoders import Decoder
from logsift.operators.dump import dump, write_dump
from logsift.plans.sizing import join_small
from logsift.sources.log import KEYS

REACHED = "topic STRING, partition INT, start BIGINT, end BIGINT, n BIGINT, batch BIGINT"


def stream_dump(
    stream: DataFrame, path: str, decoders: Mapping[str, Decoder] | None = None, policy: str = "fail",
    cursors: DataFrame | None = None, tasks: int | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Dump the messages of a stream below ``path``, as ``write_dump`` does, one folder ``batch=N`` per micro-batch.

    The progress of the stream is kept there too: started again with the same ``path``, it goes on where it was. A batch that was
    interrupted comes again under its number and replaces what it had written, so no line is lost or there twice. Its row in the cursor
    table is written last: see ``dumped`` and ``read_stream_dump``. With ``available_now`` the query ends at the end that the
    stream has at the start. ``policy`` is ``fail`` or ``passthrough``; ``stop`` needs the whole partition.
    """
    if policy not in ("fail", "passthrough"):
        raise ValueError(f"policy must be 'fail' or 'passthrough', not {policy!r}")

    def keep(batch: DataFrame, number: int) -> None:
        rows = dump(batch, cursors, decoders, policy)
        write_dump(rows, f"{path}/batch={number}", "overwrite", tasks)
        spans = [F.min("offset").alias("start"), (F.max("offset") + 1).alias("end"), F.count("*").alias("n")]
        reached(rows.groupBy(*KEYS).agg(*spans), path, number)

    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/_progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def reached(spans: DataFrame, path: str, number: int) -> None:
    """Commit a batch: its part of the cursor table."""
    spans.write.mode("overwrite").parquet(f"{path}/_cursors/batch={number}")


def _batches(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(REACHED).parquet(f"{path}/_cursors")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], REACHED)


def dumped(spark: SparkSession, path: str) -> DataFrame:
    """(topic, partition, start, end, offset, n): what was dumped, the cursor at the end of it."""
    spans = [F.min("start").alias("start"), F.max("end").alias("end"), F.max("end").alias("offset"), F.sum("n").alias("n")]
    return _batches(spark, path).groupBy(*KEYS).agg(*spans)


def read_stream_dump(spark: SparkSession, path: str) -> DataFrame:
    """(topic, partition, batch, value) of the batches that were committed."""
    schema = "value STRING, batch BIGINT, topic STRING, partition INT"
    known = _batches(spark, path).select("batch").distinct()
    if known.isEmpty():
        return spark.createDataFrame([], schema).select(*KEYS, "batch", "value")
    return join_small(spark.read.schema(schema).text(path), known, ["batch"]).select(*KEYS, "batch", "value")
