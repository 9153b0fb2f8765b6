"""The test tables as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.sources.log import as_log

PARTITIONS = 4
DECLARED = 6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def part_of(column: str):
    return (F.col(column) % PARTITIONS).cast("int")


def as_events_log(events: DataFrame) -> DataFrame:
    return as_log(
        events, topic="event_type", partition=part_of("user_id"), offset="event_id", value="props",
        key="user_id", timestamp="ts",
    )


def log_events(spark: SparkSession, folder: str) -> DataFrame:
    """Gappy offsets, small JSON values."""
    return as_events_log(table(spark, folder, "events"))


def log_json(spark: SparkSession, folder: str) -> DataFrame:
    """Events as nested JSON objects with unordered keys."""
    text = F.concat(
        F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "type": "'), "event_type",
        F.lit('", "props": '), "props", F.lit("}"),
    )
    return as_log(
        table(spark, folder, "events"),
        topic="event_type", partition=part_of("user_id"), offset="event_id", value=text,
    )


def log_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """A different text format for each of two topics, JSON for the others."""
    delimited = F.concat_ws(",", "user_id", "event_type", "event_id")
    user, number = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    labelled = F.concat(F.lit("user: "), user, F.lit(", type: "), "event_type", F.lit(", id: "), number)
    text = (
        F.when(F.col("event_type") == "click", delimited)
        .when(F.col("event_type") == "view", labelled)
        .otherwise(F.col("props"))
    )
    return as_log(
        table(spark, folder, "events"),
        topic="event_type", partition=part_of("user_id"), offset="event_id", value=text,
    )


def log_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Long multi-line, multi-byte bodies."""
    return as_log(
        table(spark, folder, "documents"),
        topic="source", partition=part_of("doc_id"), offset="doc_id", value="text",
    )


def log_chat(spark: SparkSession, folder: str) -> DataFrame:
    return as_log(
        table(spark, folder, "conversations"),
        topic="role", partition=part_of("conv_id"),
        offset=F.col("conv_id") * 1000 + F.col("turn"), value="text",
    )


def log_pages(spark: SparkSession, folder: str) -> DataFrame:
    return as_log(
        table(spark, folder, "pages"),
        topic=F.lit("pages"), partition=part_of("page_id"), offset="page_id", value="html",
    )


def declared_partitions(log: DataFrame) -> DataFrame:
    """Every topic with partitions 0 to 5; the last two never hold a message."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(DECLARED - 1)))
    return log.select("topic").distinct().select("topic", numbers.alias("partition"))


def last_messages(log: DataFrame) -> DataFrame:
    return log.groupBy("topic", "partition").agg(F.max("offset").alias("offset"))
