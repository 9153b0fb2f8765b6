from __future__ import annotations

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import logsift
from logsift.operators.ranges import merged
from logsift.plans import sizing


@pytest.fixture
def log(make_log):
    return make_log(
        [("b", 0, o, "x") for o in (0, 1, 5, 9)] + [("a", 1, 1000 + o, "y") for o in range(100)]
    )


@pytest.fixture
def declared(spark):
    return spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0)], "topic string, partition int")


def test_topics_are_sorted_and_include_declared_ones(log, declared):
    assert logsift.list_topics(log) == ["a", "b"]
    assert [tuple(r) for r in logsift.topic_catalog(log, declared).collect()] == [("a", 2), ("b", 1), ("c", 1)]


def test_no_topics_is_an_error(log):
    with pytest.raises(LookupError):
        logsift.list_topics(log.where("false"))


def test_offsets_of_gappy_retained_and_empty_partitions(log, declared):
    assert rows(logsift.partition_offsets(log, declared)) == [
        ("a", 0, 0, 0, 0), ("a", 1, 1000, 1100, 1000), ("b", 0, 0, 10, 0), ("c", 0, 0, 0, 0),
    ]


def test_partition_table_size_and_non_empty(log, declared):
    cursors = logsift.partition_offsets(log, declared)
    assert rows(logsift.partition_table(cursors), "topic", "partition", "size") == [
        ("a", 0, 0), ("a", 1, 100), ("b", 0, 10), ("c", 0, 0),
    ]
    assert rows(logsift.non_empty(cursors), "topic", "partition") == [("a", 1), ("b", 0)]


def test_open_topic_by_exact_name(log):
    assert logsift.open_topic(log, "b").count() == 4
    with pytest.raises(LookupError):
        logsift.open_topic(log, "B")


def test_partition_json(make_cursors):
    text = logsift.partition_json(make_cursors([("t", 3, 1, 9, 4)])).first()["json"]
    assert text == '{"topic":"t","partition":3,"start":1,"end":9,"offset":4,"filter":""}'


def moved(cursors):
    return [r["offset"] for r in cursors.orderBy("partition").collect()]


@pytest.fixture
def cursors(make_cursors):
    return make_cursors([("t", 0, 0, 10, 0), ("t", 1, 50, 60, 55), ("t", 2, 0, 0, 0), ("t", 3, 7, 7, 7)])


def test_forward_stops_at_the_last_message_and_never_below_start(cursors):
    assert moved(logsift.move(cursors, 4)) == [4, 59, 0, 7]
    assert moved(logsift.move(cursors, 100)) == [9, 59, 0, 7]


def test_back_from_the_end(cursors):
    assert moved(logsift.move(cursors, -3)) == [7, 57, 0, 7]
    assert moved(logsift.move(cursors, -100)) == [0, 50, 0, 7]
    assert moved(logsift.move(cursors, 0)) == [10, 60, 0, 7]


def test_jump_past_the_end_is_ignored_and_below_start_is_clamped(cursors):
    assert moved(logsift.jump(cursors, 9)) == [9, 50, 0, 7]
    assert moved(logsift.jump(cursors, 58, "t", 1)) == [0, 58, 0, 7]
    assert moved(logsift.jump(cursors, 60, "t", 1)) == [0, 55, 0, 7]


def test_remaining_counts_empty_ranges_as_zero(make_log, make_cursors):
    log = make_log([("t", 0, o, "") for o in (0, 1, 5, 9)])
    cursors = make_cursors([("t", 0, 0, 10, 1), ("t", 1, 0, 0, 0), ("t", 2, 0, 5, 5)])
    assert rows(logsift.remaining(log, cursors), "partition", "n_records") == [(0, 3), (1, 0), (2, 0)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    ranges=st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=6),
    n=st.integers(-80, 80),
)
def test_moves_stay_inside_their_range(make_cursors, ranges, n):
    table = [("t", i, s, s + size, s + min(o, size)) for i, (s, size, o) in enumerate(ranges)]
    for result in (logsift.move(make_cursors(table), n), logsift.jump(make_cursors(table), n)):
        assert all(r["start"] <= r["offset"] <= r["end"] for r in result.collect())


def test_pin_holds_small_tables_and_writes_large_ones(cursors):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan(logsift.pin(cursors))
    assert "LocalRelation" not in plan(logsift.pin(cursors, limit=2))
    assert rows(logsift.pin(cursors, limit=2)) == rows(cursors) == rows(logsift.pin(cursors))


@pytest.mark.parametrize("held, broadcast, expected", [(9, 0, "Broadcast"), (1, 999, "Broadcast"), (1, 9, "SortMerge")])
def test_every_join_strategy_gives_the_same_rows(monkeypatch, spark, make_log, make_cursors, held, broadcast, expected):
    monkeypatch.setattr(sizing, "HELD_ROWS", held)
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", broadcast)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = make_log([("t", p, o, "v") for p in range(3) for o in range(10)])
        cursors = make_cursors([("t", 0, 0, 10, 8), ("t", 1, 0, 5, 3), ("t", 2, 0, 10, 10)])
        result = logsift.range_scan(log, cursors)
        assert expected in result._jdf.queryExecution().executedPlan().toString()
        assert rows(result, "partition", "offset") == [(0, 8), (0, 9), (1, 3), (1, 4)]
        requests = make_cursors([("t", 0, 0, 0, 3), ("t", 2, 0, 0, 9), ("t", 9, 0, 0, 0)])
        assert rows(logsift.lookup(log, requests), "partition", "offset") == [(0, 3), (2, 9)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@given(
    ranges=st.lists(st.tuples(st.integers(0, 300), st.integers(1, 20)), min_size=1, max_size=30),
    most=st.integers(1, 5),
)
def test_merged_ranges_cover_all_and_stay_few(ranges, most):
    spans = [(first, first + size) for first, size in ranges]
    result = merged(spans, most)
    covered = {o for first, end in result for o in range(first, end)}
    wanted = {o for first, end in spans for o in range(first, end)}
    assert wanted <= covered and len(result) <= most
    assert all(a[1] < b[0] for a, b in zip(result, result[1:]))
    assert {o for first, end in merged(spans, 100) for o in range(first, end)} == wanted


def test_distant_ranges_reach_the_scan_apart(spark, make_log, tmp_path):
    log = make_log([("t", p, p * 10**9 + o, "v") for p in range(3) for o in range(20)])
    path = str(tmp_path / "log")
    logsift.write_log(log, path)
    stored = logsift.read_log(spark, path, "topic string, partition int, offset bigint, value string")
    tail = logsift.range_scan(stored, logsift.move(logsift.pin(logsift.partition_offsets(log)), -5))
    explained = tail._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = next(line for line in explained.splitlines() if line.startswith("PushedFilters"))
    assert all(f"GreaterThanOrEqual(offset,{p * 10**9 + 15})" in pushed for p in range(3))
    assert tail.count() == 15


def test_measured_bytes(cursors):
    assert sizing.measured_bytes(cursors) == 4 * (5 * 16 + 1)
    assert sizing.measured_bytes(cursors.where("false")) == 0
    assert sizing.measured_bytes(cursors.select("offset")) == 64


def test_stored_log_offsets_come_from_the_footers(spark, make_log, tmp_path):
    log = make_log([("a", 0, o, "v") for o in range(50)] + [("b", 2, 7, "w")])
    path = str(tmp_path / "log")
    logsift.write_log(log, path)
    schema = "topic string, partition int, offset bigint, value string"
    stored = logsift.stored_offsets(spark, path, schema)
    assert rows(stored) == rows(logsift.partition_offsets(log))
    assert rows(logsift.read_log(spark, path, schema).select(*log.columns)) == rows(log)


def test_stored_log_prunes_folders_and_offsets(spark, make_log, tmp_path):
    log = make_log([(t, p, o, "v") for t in "ab" for p in range(2) for o in range(50)])
    path = str(tmp_path / "log")
    logsift.write_log(log, path)
    stored = logsift.read_log(spark, path, "topic string, partition int, offset bigint, value string")
    cursors = logsift.partition_offsets(log).where("topic = 'a' and partition = 1").withColumn("offset", F.lit(40))
    tail = logsift.range_scan(stored, cursors)
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(offset,40)" in plan and "LessThan(offset,50)" in plan
    assert "PartitionFilters: [isnotnull(topic" in plan and "= a)" in plan
    assert tail.count() == 10
