"""The log on a Kafka cluster, through Spark's own source and sink.

The connector is a package of its own (``spark-sql-kafka-0-10``) that the cluster has to provide.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.plans.sizing import pin
from logsift.sources.log import LOG_SCHEMA

READ_CURSORS = 20_000
LOG_COLUMNS = ["topic", "partition", "offset", "key", "timestamp", "value"]


def kafka_options(
    addresses: str | list[str],
    cert_file: str | None = None,
    key_file: str | None = None,
    ca_file: str | None = None,
) -> dict[str, str]:
    """Connection options for every read and write.

    Each address may itself be a comma-separated list. TLS is used only when the client
    certificate, its key and the CA certificate are all given, as PEM files.
    """
    given = [addresses] if isinstance(addresses, str) else addresses
    servers = [a.strip() for entry in given for a in entry.split(",") if a.strip()]
    if not servers:
        raise ValueError("no address given")
    options = {"kafka.bootstrap.servers": ",".join(servers)}
    if cert_file and key_file and ca_file:
        options |= {
            "kafka.security.protocol": "SSL",
            "kafka.ssl.keystore.type": "PEM",
            "kafka.ssl.keystore.certificate.chain": Path(cert_file).read_text(),
            "kafka.ssl.keystore.key": Path(key_file).read_text(),
            "kafka.ssl.truststore.type": "PEM",
            "kafka.ssl.truststore.certificates": Path(ca_file).read_text(),
        }
    return options


def offset_options(cursors: list[dict]) -> dict[str, str]:
    """``assign`` and the offset bounds that make the source seek to every cursor."""
    assign: dict[str, list[int]] = {}
    starting: dict[str, dict[str, int]] = {}
    ending: dict[str, dict[str, int]] = {}
    for row in cursors:
        topic, partition = row["topic"], row["partition"]
        assign.setdefault(topic, []).append(partition)
        starting.setdefault(topic, {})[str(partition)] = row["offset"]
        ending.setdefault(topic, {})[str(partition)] = row["end"]
    return {
        "assign": json.dumps(assign),
        "startingOffsets": json.dumps(starting),
        "endingOffsets": json.dumps(ending),
    }


def cursors_from_offsets(spark: SparkSession, starting: str, ending: str) -> DataFrame:
    """Cursor table from two offset documents of the source, ``{"topic": {"0": 23}}``.

    That is the form of its options and of the ``startOffset``, ``endOffset`` and ``latestOffset``
    that a streaming query reports, so the ranges of a cluster are known without reading a message.
    """
    first, last = json.loads(starting), json.loads(ending)
    rows = [
        (topic, int(partition), first.get(topic, {}).get(partition, 0), end)
        for topic, partitions in last.items()
        for partition, end in partitions.items()
    ]
    ranges = spark.createDataFrame(rows, "topic STRING, partition INT, start BIGINT, end BIGINT")
    return pin(ranges.select("*", F.col("start").alias("offset")))


def read_options(
    rows: list[dict] | None, topics: list[str] | None = None, min_partitions: int | None = None
) -> dict[str, str]:
    """Source options for a bounded read: the ranges of cursor rows, else whole named topics.

    ``min_partitions`` makes the source split hot partitions by offset range.
    """
    options = {} if min_partitions is None else {"minPartitions": str(min_partitions)}
    if rows:
        return options | offset_options(rows)
    if not topics:
        raise ValueError("name topics or give cursors")
    return options | {"subscribe": ",".join(topics), "startingOffsets": "earliest", "endingOffsets": "latest"}


def read_kafka(
    spark: SparkSession,
    connection: dict[str, str],
    cursors: DataFrame | None = None,
    topics: list[str] | None = None,
    min_partitions: int | None = None,
) -> DataFrame:
    """Bounded scan of a cluster as a log: from the cursors to their ends, or whole topics.

    The offsets of cursors go into the source options, so only their ranges are fetched, by several
    reads where there are more than ``READ_CURSORS``. The source keeps an offset per
    partition on the driver, and so does this. Spark's connector tells the offsets of a cluster only to a query: take them from
    the progress of a stream (``cursors_from_offsets``) or from ``partition_offsets``, which reads the log.
    """
    if cursors is None:
        reads = [read_options(None, topics, min_partitions)]
    else:
        rows = [row.asDict() for row in cursors.where(F.col("offset") < F.col("end")).toLocalIterator()]
        reads = [read_options(part, None, min_partitions) for part in in_parts(rows)]
    if not reads:
        return spark.createDataFrame([], LOG_SCHEMA)
    logs = [spark.read.format("kafka").options(**connection, **o).load().select(*LOG_COLUMNS) for o in reads]
    return reduce(DataFrame.unionAll, logs)


def in_parts(rows: list[dict]) -> list[list[dict]]:
    return [rows[i : i + READ_CURSORS] for i in range(0, len(rows), READ_CURSORS)]


def stream_options(
    topics: list[str] | None = None, starting: str = "earliest", cursors: list[dict] | None = None
) -> dict[str, str]:
    """Source options of a stream: topics from a named place, or partitions from their cursors."""
    if cursors:
        options = offset_options(cursors)
        return {name: options[name] for name in ("assign", "startingOffsets")}
    if not topics:
        raise ValueError("name topics or give cursors")
    return {"subscribe": ",".join(topics), "startingOffsets": starting}


def stream_kafka(
    spark: SparkSession,
    connection: dict[str, str],
    topics: list[str] | None = None,
    starting: str = "earliest",
    cursors: DataFrame | None = None,
) -> DataFrame:
    """A cluster as a stream: whole topics, or the partitions of a cursor table from their cursors on."""
    rows = None if cursors is None else [row.asDict() for row in cursors.toLocalIterator()]
    source = spark.readStream.format("kafka").options(**connection, **stream_options(topics, starting, rows))
    return source.load().select(*LOG_COLUMNS)


def write_kafka(records: DataFrame, connection: dict[str, str]) -> None:
    """Publish (topic, key, value) records; the producer waits for all replicas."""
    columns = ["topic", "key", "value", *(["partition"] if "partition" in records.columns else [])]
    options = {"kafka.acks": "all", "kafka.retries": "5"} | connection
    records.select(*columns).write.format("kafka").options(**options).save()
