"""Stored logs: versions, other writers, files of others, rank and search index."""

from __future__ import annotations

import os
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from conftest import CURSORS, rows
from pyspark.sql import functions as F

import logsift
from logsift.sources import commits, index
from logsift.sources.commits import Folder, LogConflict, versions
from logsift.sources.stored import StoredLog

SCHEMA = "topic string, partition int, offset bigint, value string"


def made(make_log, offsets, topic="a b%c", partition=0, value="x"):
    return make_log([(topic, partition, o, f"{value}{o}") for o in offsets])


def seen(spark, path, **options):
    """Offsets as every way to read the log has them."""
    cursors = logsift.stored_offsets(spark, path, SCHEMA, **options)
    found = rows(logsift.range_scan(logsift.stored_log(spark, path, SCHEMA, **options), cursors), "partition", "offset")
    assert rows(logsift.read_log(spark, path, SCHEMA, **options), "partition", "offset") == found
    return found


@pytest.fixture
def opened(monkeypatch):
    """Names of the files that stored logs open."""
    names = []
    plain = StoredLog.opened
    monkeypatch.setattr(StoredLog, "opened", lambda self, files: names.extend(files) or plain(self, files))
    return names


def test_files_of_others_count(spark, make_log, tmp_path):
    path = str(tmp_path / "log")
    logsift.write_log(made(make_log, range(100)), path, tasks=2)
    made(make_log, range(100, 200)).write.mode("append").partitionBy("topic", "partition").parquet(path)
    made(make_log, range(5), partition=3).write.mode("append").partitionBy("topic", "partition").parquet(path)
    both = [(0, o) for o in range(200)] + [(3, o) for o in range(5)]
    assert seen(spark, path) == sorted(both, key=repr)
    assert rows(logsift.stored_offsets(spark, path, SCHEMA), "partition", "end") == [(0, 200), (3, 5)]
    assert len(seen(spark, path, version=1)) == 100
    assert logsift.adopt_files(spark, path) == 2
    assert seen(spark, path, version=2) == seen(spark, path) == sorted(both, key=repr)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        made(make_log, [7]).write.mode("overwrite").partitionBy("topic", "partition").parquet(path)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert seen(spark, path) == [(0, 7)] + [(3, o) for o in range(5)]


def test_adopting_a_plain_folder(spark, make_log, tmp_path):
    path = str(tmp_path / "log")
    made(make_log, range(4)).write.partitionBy("topic", "partition").parquet(path)
    assert logsift.adopt_files(spark, path) == 1 and len(seen(spark, path)) == 4


def test_overwrites_keep_earlier_versions(spark, make_log, tmp_path):
    path = str(tmp_path / "log")
    assert logsift.write_log(made(make_log, range(4)).union(made(make_log, range(3), partition=1)), path) == 1
    first = seen(spark, path)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        assert logsift.write_log(made(make_log, [9]), path, mode="overwrite") == 2
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert seen(spark, path) == [(0, 9)] + [(1, o) for o in range(3)]
    made(make_log, [50]).write.mode("append").partitionBy("topic", "partition").parquet(path)
    assert logsift.write_log(logsift.read_log(spark, path, SCHEMA).where("offset > 0"), path, mode="overwrite") == 3
    assert seen(spark, path) == [(0, 50), (0, 9), (1, 1), (1, 2)]
    assert seen(spark, path, version=1) == first and len(seen(spark, path, version=2)) == 4
    assert versions(spark, path) == [1, 2, 3]
    assert logsift.vacuum_log(spark, path) > 0
    assert seen(spark, path) == [(0, 50), (0, 9), (1, 1), (1, 2)] and logsift.vacuum_log(spark, path) == 0
    with pytest.raises(ValueError, match="no version 1"):
        logsift.stored_log(spark, path, SCHEMA, version=1)
    files = {str(p.relative_to(path)) for p in tmp_path.rglob("*.parquet") if "_log" not in str(p)}
    assert files == {r["file"] for r in commits.manifest_of(Folder(spark, path), versions(spark, path)[-1]).collect()}


def test_a_moved_log(spark, make_log, tmp_path):
    path = str(tmp_path / "log")
    logsift.write_log(made(make_log, range(6)), path, records_per_file=2)
    want = seen(spark, path)
    moved = str(tmp_path / "an other {[log]}+%20")
    os.rename(path, moved)
    assert seen(spark, moved) == want
    logsift.write_log(made(make_log, [6]), moved)
    assert len(seen(spark, moved)) == 7


def test_writers_at_once(spark, make_log, tmp_path):
    path = str(tmp_path / "log")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda i: logsift.write_log(made(make_log, range(10 * i, 10 * i + 10)), path, tasks=1), range(4)))
    assert sorted(got) == versions(spark, path) == [1, 2, 3, 4]
    assert rows(logsift.manifest(spark, path), "start", "n") == [(0, 10), (10, 10), (20, 10), (30, 10)]
    assert len(seen(spark, path)) == 40


def test_an_overwrite_that_comes_second_fails_whole(spark, make_log, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    logsift.write_log(made(make_log, range(4)), path, tasks=1)
    publish = commits.publish

    def late(folder, change, what, base=None):
        if what == "overwrite":
            publish(folder, lambda known: known, "append")
        return publish(folder, change, what, base)

    monkeypatch.setattr(commits, "publish", late)
    with pytest.raises(LogConflict):
        logsift.write_log(made(make_log, [99]), path, mode="overwrite")
    assert len(seen(spark, path)) == 4 and not [n for n in os.listdir(f"{path}/_log") if n.startswith("writing")]
    assert len([p for p in tmp_path.rglob("log.*.parquet")]) == 1


def test_unfinished_writes_do_not_count(spark, make_log, tmp_path):
    path = str(tmp_path / "log")
    logsift.write_log(made(make_log, range(4)), path)
    folder = Folder(spark, path)
    folder.write("", "_log", "writing-abc")
    option = "mapreduce.output.basename"
    made(make_log, [70]).write.mode("append").option(option, "log.abc").partitionBy("topic", "partition").parquet(path)
    made(make_log, [80]).write.mode("append").option(option, "log.fromelsewhere").partitionBy("topic", "partition").parquet(path)
    assert seen(spark, path) == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 80)]
    logsift.vacuum_log(spark, path)
    assert len(seen(spark, path)) == 5 and not folder.names("_log")[-1].startswith("writing")
    with pytest.raises(Exception, match="no_such"):
        logsift.write_log(made(make_log, [90]).withColumn("value", F.expr("raise_error('no_such')")), path)
    assert len(seen(spark, path)) == 5


def test_modes(spark, make_log, tmp_path):
    path = str(tmp_path / "log")
    assert logsift.write_log(made(make_log, range(2)), path, mode="error") == 1
    assert logsift.write_log(made(make_log, range(2)), path, mode="ignore") is None
    with pytest.raises(FileExistsError):
        logsift.write_log(made(make_log, range(2)), path, mode="errorifexists")
    with pytest.raises(ValueError, match="unknown mode"):
        logsift.write_log(made(make_log, range(2)), path, mode="upsert")
    assert logsift.write_log(made(make_log, []), path) == 2 and len(seen(spark, path)) == 2
    empty = str(tmp_path / "empty")
    assert logsift.write_log(made(make_log, []), empty) == 1 and seen(spark, empty) == []


def test_one_of_many_puts(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "p"))
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda i: folder.put_if_absent(str(i), "_log", "x"), range(16)))
    assert sum(done) == 1 and folder.read("_log", "x") == str(done.index(True)) and folder.names("_log") == ["x"]


@pytest.fixture
def gappy(spark, make_log, tmp_path):
    """Two partitions with gaps, ten files of ten messages each; a third whose files overlap."""
    draw = random.Random(1)
    path, offsets = str(tmp_path / "gaps"), {}
    for p in (0, 1):
        offsets[p] = sorted(draw.sample(range(10_000), 100))
    log = make_log([("t", p, o, f"v{o}") for p, found in offsets.items() for o in found])
    logsift.write_log(log, path, tasks=2, records_per_file=10)
    offsets[2] = sorted(draw.sample(range(1000), 40))
    for part in (offsets[2][::2], offsets[2][1::2]):
        logsift.write_log(made(make_log, part, "t", 2, "v"), path, tasks=1)
    return path, offsets


@pytest.mark.parametrize("n", [0, 9, 10, 39, 57, 99, 100])
def test_position_from_the_counts(spark, gappy, opened, n):
    path, offsets = gappy
    log, cursors = logsift.stored_log(spark, path, SCHEMA), logsift.stored_offsets(spark, path, SCHEMA)
    got = rows(logsift.message_at_position(log, cursors, n), "partition", "offset", "value")
    assert got == [(p, found[n], f"v{found[n]}") for p, found in offsets.items() if n < len(found)]
    for p in (0, 1):
        names = {name for name in opened if f"partition={p}/" in name}
        assert len(names) <= 2 - (n % 10 not in (0, 9)) if n < 100 else not names


def test_position_after_a_cursor_inside_a_file(spark, gappy, opened):
    path, offsets = gappy
    log = logsift.stored_log(spark, path, SCHEMA)
    cursors = spark.createDataFrame([("t", p, found[13] - 0, found[77], 0) for p, found in offsets.items() if p < 2] + [("t", 2, offsets[2][5], 2000, 0)], CURSORS)
    for n in (0, 3, 30, 63, 64):
        got = rows(logsift.message_at_position(log, cursors, n), "partition", "offset")
        want = [(p, found[13 + n]) for p, found in offsets.items() if p < 2 and 13 + n < 77]
        assert got == want + ([(2, offsets[2][5 + n])] if 5 + n < 40 else [])
    assert len({name for name in opened if "partition=0/" in name}) <= 8


def test_pages_read_what_they_need(spark, gappy, opened):
    path, offsets = gappy
    log, cursors = logsift.stored_log(spark, path, SCHEMA), logsift.stored_offsets(spark, path, SCHEMA)
    for page, height in ((0, 5), (3, 12), (40, 25), (900, 12)):
        opened.clear()
        got = rows(logsift.page_messages(log, cursors, page, height), "partition", "offset")
        want = [(p, o) for p, found in offsets.items() for o in [o for o in found if o >= found[0] + page * height][:height]]
        assert got == sorted(want, key=repr)
        assert len({name for name in opened if "partition=0/" in name}) <= height // 10 + 3


def test_lookup_opens_the_files_of_its_addresses(spark, gappy, opened):
    path, offsets = gappy
    log = logsift.stored_log(spark, path, SCHEMA)
    wanted = [("t", 0, offsets[0][0]), ("t", 0, offsets[0][99]), ("t", 0, offsets[0][99]), ("t", 2, offsets[2][7]), ("t", 1, 20_000), ("u", 0, 1)]
    got = rows(logsift.lookup(log, spark.createDataFrame(wanted, "topic string, partition int, offset bigint")), "partition", "offset")
    assert got == sorted([(p, o) for _, p, o in wanted[:4]], key=repr)
    assert len({name for name in opened if "partition=0/" in name}) == 2 and not any("partition=1/" in name for name in opened)


def test_index_leaves_out_files(spark, make_log, tmp_path, opened):
    path = str(tmp_path / "log")
    texts = [(p, o, f"message {o * 7919 % 100_003} of {p}") for p in range(4) for o in range(100)]
    values = {(1, 42): "a needle in the hay", (3, 7): "ein Nädelchen ", (2, 50): None}
    log = make_log([("t", p, o, values.get((p, o), text)) for p, o, text in texts])
    logsift.write_log(log, path, tasks=4, records_per_file=20)
    total = logsift.manifest(spark, path).count()
    assert logsift.stored_log(spark, path, SCHEMA).containing("needle").files.count() == total
    assert logsift.index_log(spark, path, bits=1 << 18) == total and logsift.index_log(spark, path) == 0
    seek, cursors = logsift.stored_log(spark, path, SCHEMA), logsift.stored_offsets(spark, path, SCHEMA)
    plain = logsift.read_log(spark, path, SCHEMA)
    most = {"needle": 1, "Nädel": 1, "absent from all": 0, "hay\x00": 1, "of 3": total, "nee": total, "": total, "message 7919 of 0": 1, "75428 of": 4}
    for needle, files in most.items():
        opened.clear()
        want = rows(logsift.search_topic(plain, needle, cursors))
        assert rows(logsift.search_topic(seek, needle, cursors)) == want
        assert len(set(opened)) <= files + (1 if files < total else 0), needle
    for needle in ("needle", "of 3"):
        want = logsift.search_topic(plain, needle, cursors)
        assert rows(logsift.search_topic(seek, needle, cursors, step=30)) == rows(want)
        assert rows(logsift.search_partition(seek, needle, cursors)) == rows(logsift.search_partition(plain, needle, cursors))
        assert rows(logsift.search_first(seek, needle, cursors, 50)) == rows(logsift.first_result(want))
    for needles in (["message", "needle"], ["needle", "absent"]):
        assert rows(logsift.search_chained(seek, needles, cursors)) == rows(logsift.search_chained(plain, needles, cursors))
    logsift.write_log(make_log([("t", 0, 500, "another needle")]), path, tasks=1)
    seek, cursors = logsift.stored_log(spark, path, SCHEMA), logsift.stored_offsets(spark, path, SCHEMA)
    assert rows(logsift.search_topic(seek, "needle", cursors), "partition", "offset") == [(0, 500), (1, 42)]
    assert logsift.index_log(spark, path, gram=3) == 1
    assert rows(logsift.search_topic(seek, "needle", cursors), "partition", "offset") == [(0, 500), (1, 42)]
    assert logsift.stored_log(spark, path, SCHEMA).containing("nowhere to be seen").files.count() <= 1
    with pytest.raises(ValueError):
        logsift.index_log(spark, path, gram=9)


def test_no_gram_is_missed():
    draw = random.Random(4)
    texts = [bytes(draw.choices(b"ab\xc3\x00", k=draw.randint(0, 40))) for _ in range(50)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    for gram in (1, 3, 8):
        want = {int.from_bytes(t[i : i + gram], "little") for t in texts for i in range(len(t) - gram + 1)}
        assert set(index.grams_of(data, ends, gram).tolist()) == want


def test_pieces_of_long_values(spark, make_log, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    text = "".join(random.Random(5).choices("abcdefghij", k=2_200_000)) + "needle"
    logsift.write_log(make_log([("t", 0, 0, text)]), path)
    logsift.index_log(spark, path)
    log = logsift.stored_log(spark, path, SCHEMA)
    for at in (0, (1 << 21) - 5, (1 << 21) - 1, 1 << 21, len(text) - 9):
        assert log.containing(text[at : at + 9]).files.count() == 1


def test_sums_over_parsed_bodies_read_one_piece(spark, make_log, tmp_path):
    path = str(tmp_path / "log")
    bodies = ['{"k": %d, "n": {"m": [%d]}, "text": "long %d"}' % (o, o % 7, o) for o in range(300)] + ['{"k": "9"}', "no", '{"k": 1e3}', None, "[1]", '{"k": 2.5} x', '{"k": 0.25}']
    log = make_log([("t", o % 2, o, body) for o, body in enumerate(bodies)])
    logsift.write_log(logsift.with_bodies(log), path, tasks=2)
    seek, cursors = logsift.stored_log(spark, path, SCHEMA + ", body variant"), logsift.stored_offsets(spark, path, SCHEMA)
    for where in ("$.k", "$.n.m[0]", "$.absent"):
        for place in (cursors, logsift.move(cursors, -40)):
            assert rows(logsift.field_sum(seek, where, place)) == rows(logsift.field_sum(log, where, place))
    plan = logsift.field_sum(logsift.read_log(spark, path, SCHEMA + ", body variant"), "$.k")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "parse_json" not in plan and "ReadSchema: struct<body:struct<0:variant>>" in plan
    whole = logsift.stored_log(spark, path, SCHEMA)
    assert rows(logsift.range_scan(whole, cursors), "offset", "value") == rows(log, "offset", "value")
