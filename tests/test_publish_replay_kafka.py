from __future__ import annotations

import json
import os
import time
from pathlib import Path

import pytest
from conftest import LOG, rows
from pyspark.sql import functions as F

import logsift
from logsift.functions.hashing import fnv1a32, key_partition
from logsift.operators import publish
from logsift.sources import kafka


def dense_by_key(result):
    by_key = {}
    for r in result.collect():
        by_key.setdefault((r["topic"], r["partition"]), []).append(r["offset"])
    return {k: sorted(v) for k, v in by_key.items()}


@pytest.fixture
def records(spark):
    """One partition holds nine tenths of the records, over many tasks."""
    return spark.range(0, 5000, 1, 9).selectExpr(
        "'t' as topic", "if(id % 10 = 0, cast(id % 3 as int) + 1, 0) as partition",
        "(id * 7919) % 5000 as at", "id",
    )


def test_offsets_are_dense_and_in_order_with_a_hot_partition(records):
    result = logsift.assign_offsets(records, ["at"])
    assert dense_by_key(result) == {
        k: list(range(len(v))) for k, v in dense_by_key(records.withColumn("offset", F.col("at"))).items()
    }
    hot = sorted(result.where("partition = 0").collect(), key=lambda r: r["offset"])
    assert [r["at"] for r in hot] == sorted(r["at"] for r in hot)


def test_arrival_order_needs_no_shuffle_and_goes_on_from_the_end(records, make_cursors):
    base = make_cursors([("t", 0, 50, 100, 50)])
    result = logsift.assign_offsets(records, base=base)
    got = dense_by_key(result)
    assert got[("t", 0)] == list(range(100, 100 + len(got[("t", 0)])))
    assert got[("t", 1)] == list(range(len(got[("t", 1)])))
    assert result.select("id").distinct().count() == 5000


def brute_fnv(data: bytes) -> int:
    state = 2166136261
    for octet in data:
        state = (state ^ octet) * 16777619 % 2**32
    return state - 2**32 if state >= 2**31 else state


def test_key_hash_against_brute_force(spark):
    keys = ["", "a", "Hill", "é€", "x" * 300, "Hill"]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string").coalesce(1)
    got = [r[0] for r in df.select(fnv1a32(F.col("key"))).collect()]
    assert got == [brute_fnv(k.encode()) for k in keys] + [None]
    parts = df.where("key is not null").select(key_partition(F.col("key"), 7, "fnv1a")).collect()
    assert [r[0] for r in parts] == [abs(brute_fnv(k.encode())) % 7 for k in keys]
    assert all(0 <= r[0] < 7 for r in df.select(key_partition(F.col("key"), 7)).collect())


@pytest.mark.parametrize("method", ["spark", "fnv1a"])
def test_records_without_a_key_are_kept(spark, method):
    records = spark.range(0, 50).selectExpr("'t' as topic", "if(id < 40, null, cast(id as string)) as key", "id")
    log = logsift.append_to_log(records, 5, ["id"], method=method)
    assert log.count() == 50
    assert log.where("key is null").select("partition").distinct().count() == 1


def test_templated_records(spark):
    source = spark.range(0, 1000)
    records = publish.templated_records(source, "id").cache()
    assert rows(records.groupBy("topic").count()) == sorted(
        [(t, 1000) for t in publish.TOPIC_TEMPLATES] + [("miscellany", 3)]
    )
    stuff = records.where("topic = 'stuff'").select("key", F.from_json("value", "first_name string, last_name string, age int").alias("v"))
    assert stuff.where("key <> v.last_name or v.age not between 5 and 84 or v.age is null").count() == 0
    arrays = records.where("topic = 'miscellany'").collect()
    assert sorted(len(json.loads(r["value"])) for r in arrays) == [200, 400, 400]
    log = logsift.append_to_log(records, 5, ["id"])
    assert logsift.partition_offsets(log).where("start <> 0").count() == 0
    again = publish.templated_records(source.repartition(3), "id")
    assert records.exceptAll(again).count() == 0 and again.exceptAll(records).count() == 0


def test_sample_records(spark):
    ages = logsift.sample_records(spark.range(0, 3000), "id").select(
        F.from_json("value", "name string, age int").alias("v")
    )
    bounds = ages.agg(F.min("v.age"), F.max("v.age"), F.count("v.name")).first()
    assert tuple(bounds) == (1, 100, 3000)


def test_replay_equals_batch_search_over_many_batches(spark, tmp_path):
    log = spark.range(0, 3000).selectExpr(
        "if(id % 3 = 0, 'a', 'b') as topic", "cast(id % 4 as int) as partition", "id as offset",
        "cast(id * 37 as string) as value",
    )
    path = str(tmp_path / "log")
    log.repartition(6).write.parquet(path)
    stream = logsift.stream_log(spark, path, LOG, maxFilesPerTrigger="2")
    assert rows(logsift.replay_first_match(stream, "999")) == rows(
        logsift.search_topic(log, "999").select("topic", "partition", "offset")
    )
    cursors = logsift.move(logsift.partition_offsets(log), 900)
    assert rows(logsift.replay_first_match(stream, "99", cursors)) == rows(
        logsift.search_topic(log, "99", cursors).select("topic", "partition", "offset")
    )
    assert rows(logsift.replay_first_match(stream, "absent")) == []


def test_an_interrupted_replay_goes_on_with_new_files(spark, tmp_path):
    path, folder = str(tmp_path / "log"), str(tmp_path / "work")
    spark.createDataFrame([("t", 0, 5, "hit")], LOG).write.parquet(path)
    stream = logsift.stream_log(spark, path, LOG)
    assert rows(logsift.replay_first_match(stream, "hit", folder=folder)) == [("t", 0, 5)]
    spark.createDataFrame([("t", 0, 3, "hit"), ("t", 1, 8, "hit")], LOG).write.mode("append").parquet(path)
    stream = logsift.stream_log(spark, path, LOG)
    assert rows(logsift.replay_first_match(stream, "hit", folder=folder)) == [("t", 0, 3), ("t", 1, 8)]


def test_connection_options(tmp_path):
    files = {}
    for name in ("cert", "key", "ca"):
        (tmp_path / name).write_text(f"PEM {name}")
        files[f"{name}_file"] = str(tmp_path / name)
    plain = logsift.kafka_options(["a:1,b:2", "c:3"])
    assert plain == {"kafka.bootstrap.servers": "a:1,b:2,c:3"}
    assert logsift.kafka_options("a:1", files["cert_file"], files["key_file"]) == {"kafka.bootstrap.servers": "a:1"}
    secure = logsift.kafka_options("a:1", **files)
    assert secure["kafka.security.protocol"] == "SSL"
    assert secure["kafka.ssl.keystore.certificate.chain"] == "PEM cert"
    assert secure["kafka.ssl.keystore.key"] == "PEM key"
    assert secure["kafka.ssl.truststore.certificates"] == "PEM ca"
    with pytest.raises(ValueError):
        logsift.kafka_options([])


def test_cursor_options_seek():
    rows = [
        {"topic": "t", "partition": 0, "offset": 4, "end": 10},
        {"topic": "t", "partition": 3, "offset": 0, "end": 1},
        {"topic": "u", "partition": 2, "offset": 1, "end": 3},
    ]
    options = kafka.read_options(rows, min_partitions=64)
    assert json.loads(options["assign"]) == {"t": [0, 3], "u": [2]}
    assert json.loads(options["startingOffsets"]) == {"t": {"0": 4, "3": 0}, "u": {"2": 1}}
    assert json.loads(options["endingOffsets"]) == {"t": {"0": 10, "3": 1}, "u": {"2": 3}}
    assert options["minPartitions"] == "64"
    assert kafka.read_options(None, ["t", "u"])["subscribe"] == "t,u"
    with pytest.raises(ValueError, match="name topics or give cursors"):
        kafka.read_options(None)


def test_cursors_from_offset_documents(spark):
    cursors = logsift.cursors_from_offsets(spark, '{"t":{"0":3}}', '{"t":{"0":9,"1":4},"u":{"0":0}}')
    assert rows(cursors) == [("t", 0, 3, 9, 3), ("t", 1, 0, 4, 0), ("u", 0, 0, 0, 0)]


def test_running_first_matches(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([("t", 0, 5, "hit"), ("t", 0, 2, "hit"), ("t", 1, 1, "no")], LOG).write.parquet(path)
    found = logsift.first_matches(logsift.stream_log(spark, path, LOG), "hit")
    query = (
        found.writeStream.format("memory").queryName("found").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rows(spark.table("found")) == [("t", 0, 2)]


def test_a_cluster_session_needs_a_shared_folder():
    from logsift.plans.session import scratch_folder

    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, name, default):
            return self.folder

    class Session:
        def __init__(self, folder, master):
            self.conf, self.sparkContext = Conf(folder), self
            self.master = master

        def getCheckpointDir(self):
            return None

    assert scratch_folder(Session("hdfs:///shared", "yarn")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        scratch_folder(Session(None, "yarn"))


def test_empty_ranges_read_nothing(spark, make_cursors):
    cursors = make_cursors([("t", 1, 0, 5, 5)])
    assert logsift.read_kafka(spark, logsift.kafka_options("a:1"), cursors).count() == 0


@pytest.fixture
def read_rows(spark):
    """Rows that the batches of streams have read, by query."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Rows(StreamingQueryListener):
        def __init__(self):
            self.batches, self.ended = [], 0

        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            self.batches.append(event.progress.numInputRows)

        def onQueryTerminated(self, event):
            self.ended += 1

        def read(self, queries):
            begin = time.time()
            while self.ended < queries and time.time() - begin < 20:
                time.sleep(0.1)
            total, self.batches, self.ended = sum(self.batches), [], 0
            return total

    listener = Rows()
    spark.streams.addListener(listener)
    yield listener
    spark.streams.removeListener(listener)


def files_in_order(spark, path, count, rows_of):
    """A log of ``count`` files that come one after the other."""
    for i in range(count):
        spark.createDataFrame(rows_of(i), LOG).coalesce(1).write.mode("append").parquet(path)
        for file in Path(path).glob("part-*.parquet"):
            if file.stat().st_mtime > 1_600_000_000 + count:
                os.utime(file, (1_600_000_000 + i, 1_600_000_000 + i))


def test_an_ordered_replay_ends_with_the_answer(spark, tmp_path, read_rows):
    path = str(tmp_path / "log")
    files_in_order(spark, path, 100, lambda i: [("t", p, 10 * i + k, f"v{10 * i + k}") for p in (0, 1) for k in range(10)])
    stream = logsift.stream_log(spark, path, LOG, maxFilesPerTrigger="1")
    cursors = logsift.partition_offsets(logsift.read_log(spark, path, LOG))
    wanted = logsift.search_topic(logsift.read_log(spark, path, LOG), "v7", cursors).select("topic", "partition", "offset")
    assert rows(logsift.replay_first_match(stream, "v7", cursors, ordered=True)) == rows(wanted)
    assert 0 < read_rows.read(1) <= 10 * 20
    # One partition has its match late, the other is done before: its messages are left out.
    late = logsift.jump(cursors, 120, "t", 1)
    found = logsift.replay_first_match(stream, "v12", late, ordered=True)
    assert rows(found) == [("t", 0, 12), ("t", 1, 120)]
    assert read_rows.read(1) <= 30 * 20
    # The snapshot ends the replay where nothing is found.
    part = cursors.withColumn("end", F.lit(50).cast("long"))
    assert rows(logsift.replay_first_match(stream, "absent", part, ordered=True)) == []
    assert read_rows.read(1) <= 20 * 20
    with pytest.raises(ValueError, match="needs cursors"):
        logsift.replay_first_match(stream, "v7", ordered=True)


def test_an_ordered_replay_goes_on_and_minds_its_order(spark, tmp_path):
    path, folder = str(tmp_path / "log"), str(tmp_path / "work")
    files_in_order(spark, path, 3, lambda i: [("t", 0, i, f"v{i}"), ("t", 1, 50 + i, f"w{i}")])
    cursors = spark.createDataFrame([("t", 0, 0, 10, 0), ("t", 1, 50, 53, 50)], "topic string, partition int, start long, end long, offset long")
    stream = logsift.stream_log(spark, path, LOG, maxFilesPerTrigger="1")
    assert rows(logsift.replay_first_match(stream, "v5", cursors, folder, ordered=True)) == []
    spark.createDataFrame([("t", 0, 5, "v5"), ("t", 1, 99, "v5")], LOG).write.mode("append").parquet(path)
    assert rows(logsift.replay_first_match(stream, "v5", cursors, folder, ordered=True)) == [("t", 0, 5)]
    assert rows(logsift.replay_first_match(stream, "v5", cursors, folder, ordered=True)) == [("t", 0, 5)]
    back = str(tmp_path / "back")
    files_in_order(spark, back, 2, lambda i: [("t", 0, 5 - i, f"v{i}")])
    with pytest.raises(Exception, match="came after 5"):
        logsift.replay_first_match(logsift.stream_log(spark, back, LOG, maxFilesPerTrigger="1"), "x", cursors, ordered=True)


def test_a_replay_of_a_stored_log(spark, tmp_path, read_rows):
    path, folder = str(tmp_path / "log"), str(tmp_path / "work")
    log = spark.range(4000).selectExpr("if(id % 2 = 0, 'a', 'b c') as topic", "cast(id % 4 as int) as partition", "id as offset", "cast(id * 37 as string) as value")
    logsift.write_log(log, path, tasks=8, records_per_file=20)
    wanted = rows(logsift.search_topic(log, "37").select("topic", "partition", "offset"))
    schema = log.schema
    assert rows(logsift.replay_stored(spark, path, "37", schema, files=25)) == wanted
    first = read_rows.read(1)
    assert rows(logsift.replay_stored(spark, path, "14763", schema, files=25)) == rows(logsift.search_topic(log, "14763").select("topic", "partition", "offset"))
    assert rows(logsift.replay_stored(spark, path, "absent", schema, files=25, folder=folder)) == []
    # Every message is in the needle's first file of its partition: once all first files came, nothing else is read.
    read_rows.read(2)
    assert rows(logsift.replay_stored(spark, path, "", schema, files=1)) == [("a", 0, 0), ("a", 2, 2), ("b c", 1, 1), ("b c", 3, 3)]
    assert first <= 4000
    logsift.write_log(log.where("offset < 8").withColumn("offset", F.col("offset") + 5000), path, tasks=1)
    assert rows(logsift.replay_stored(spark, path, "absent", schema, folder=folder)) == []
