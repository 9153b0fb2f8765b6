"""Ranges by bytes, and the dump that goes on."""

from __future__ import annotations

from pathlib import Path

import pytest
from conftest import LOG, rows
from pyspark.sql import functions as F

import logsift
from logsift.operators import balance
from logsift.streaming import dump

SIZED = "topic string, partition int, offset bigint, value string"


def task_sizes(df):
    sized = df.withColumn("task", F.spark_partition_id()).groupBy("task")
    return sorted((r for r in sized.agg(F.sum(F.octet_length("value")).alias("bytes"), F.min(F.struct("topic", "partition", "offset")).alias("low"), F.max(F.struct("topic", "partition", "offset")).alias("high")).collect()), key=lambda r: r.task)


def test_tasks_hold_equal_bytes(spark):
    """One value in a hundred is a thousand times as large, and most of those lie together."""
    log = spark.range(40_000).select(
        F.lit("t").alias("topic"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("partition"), F.col("id").alias("offset"),
        F.expr("repeat('x', if(id between 1000 and 1300 or id % 400 = 0, 20000, 20))").alias("value"),
    )
    total = log.agg(F.sum(F.octet_length("value") + 24)).first()[0]
    dealt = logsift.by_bytes(log, total // 12)
    sizes = task_sizes(dealt)
    assert 11 <= len(sizes) <= 14
    median = sorted(r.bytes for r in sizes)[len(sizes) // 2]
    assert max(r.bytes for r in sizes) <= 2 * median
    for before, after in zip(sizes, sizes[1:], strict=False):
        assert tuple(before.high) < tuple(after.low)
    assert dealt.count() == 40_000 and dealt.select("offset").distinct().count() == 40_000
    assert dealt.columns == log.columns


def test_few_and_huge_messages(spark, make_log):
    log = make_log([("t", 0, 5, "x" * 100_000), ("t", 0, 2**40, "y"), ("t", 3, 0, None), ("u", 0, 7, "")], SIZED)
    for size in (1, 50, 10**9):
        assert rows(logsift.by_bytes(log, size), "topic", "partition", "offset") == rows(log, "topic", "partition", "offset")
    assert len(task_sizes(logsift.by_bytes(log, 10**9))) == 1
    assert logsift.by_bytes(log.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        logsift.by_bytes(log, 0)


def test_sinks_by_bytes(spark, make_log, tmp_path, monkeypatch):
    monkeypatch.setattr(balance, "BITS", (4, 2, 0))
    log = make_log([("t", 0, o, f"{o} " + "x" * (5000 if 40 <= o < 60 else 5)) for o in range(100)])
    logsift.write_log(log, str(tmp_path / "log"), range_bytes=20_000)
    files = rows(logsift.manifest(spark, str(tmp_path / "log")), "start", "end", "n")
    assert len(files) >= 5 and sum(n for *_, n in files) == 100 and all(end - start == n for start, end, n in files)
    logsift.write_dump(logsift.dump(log), str(tmp_path / "dump"), range_bytes=20_000)
    parts = sorted((tmp_path / "dump").rglob("part-*.txt"))
    lines = [line.split()[0] for part in parts for line in part.read_text().splitlines()]
    assert lines == [str(o) for o in range(100)] and len(parts) == len(files)


def values(spark, path):
    return rows(logsift.read_stream_dump(spark, path), "topic", "partition", "value")


def test_a_dump_goes_on_after_an_interruption(spark, tmp_path, monkeypatch):
    source, path = str(tmp_path / "log"), str(tmp_path / "dump")
    for i in range(4):
        spark.createDataFrame([("t", p, 10 * i + k, f'{{"k": {i + 1}{k}}}') for p in (0, 1) for k in range(3)], LOG).coalesce(1).write.mode("append").parquet(source)
    stream = logsift.stream_log(spark, source, LOG, maxFilesPerTrigger="1")
    assert values(spark, path) == [] and rows(logsift.dumped(spark, path)) == []
    reached = dump.reached

    def broken(spans, place, number):
        if number == 2:
            raise OSError("the driver was lost")
        reached(spans, place, number)

    monkeypatch.setattr(dump, "reached", broken)
    with pytest.raises(Exception, match="driver was lost"):
        logsift.stream_dump(stream, path, {"*": logsift.json_body}).awaitTermination()
    monkeypatch.undo()
    assert len(list(Path(path).glob("batch=*"))) == 3 and len(values(spark, path)) == 12
    logsift.stream_dump(stream, path, {"*": logsift.json_body}).awaitTermination()
    log = logsift.read_log(spark, source, LOG)
    want = rows(logsift.dump(log, decoders={"*": logsift.json_body}), "topic", "partition", "value")
    assert values(spark, path) == want and len(want) == 24
    assert rows(logsift.dumped(spark, path)) == [("t", 0, 0, 33, 33, 12), ("t", 1, 0, 33, 33, 12)]
    spark.createDataFrame([("t", 0, 40, "{}")], LOG).write.mode("append").parquet(source)
    logsift.stream_dump(stream, path, {"*": logsift.json_body}).awaitTermination()
    assert len(values(spark, path)) == 25
    with pytest.raises(ValueError, match="policy"):
        logsift.stream_dump(stream, path, policy="stop")


def test_a_dump_from_cursors(spark, tmp_path):
    source, path = str(tmp_path / "log"), str(tmp_path / "dump")
    spark.createDataFrame([("t", 0, o, f"v{o}") for o in range(10)], LOG).write.parquet(source)
    cursors = spark.createDataFrame([("t", 0, 0, 8, 5)], "topic string, partition int, start bigint, end bigint, offset bigint")
    logsift.stream_dump(logsift.stream_log(spark, source, LOG), path, cursors=cursors).awaitTermination()
    assert [v for *_, v in values(spark, path)] == ["v5", "v6", "v7"]
