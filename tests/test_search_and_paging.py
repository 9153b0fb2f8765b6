from __future__ import annotations

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import logsift
from logsift.functions.text import byte_cut, has, string_cut


@pytest.fixture
def log(make_log):
    values = {0: "needle", 1: "x", 5: "a needle b", 9: "Needle", 12: "z or needle"}
    return make_log(
        [("t", 0, o, v) for o, v in values.items()]
        + [("t", 1, o, v) for o, v in ((100, "q"), (103, "needles"), (104, "or"))]
        + [("u", 0, 0, "nothing")]
    )


def test_a_match_at_offset_zero_is_found(log):
    found = rows(logsift.search_topic(log, "needle"))
    assert found == [("t", 0, 0, 13, 0), ("t", 1, 100, 105, 103)]


def test_search_starts_at_the_cursor_and_keeps_real_offsets(log):
    cursors = logsift.move(logsift.partition_offsets(log), 1)
    assert rows(logsift.search_topic(log, "needle", cursors)) == [("t", 0, 0, 13, 5), ("t", 1, 100, 105, 103)]
    assert rows(logsift.search_partition(log, "needle", cursors), "partition", "offset", "value") == [
        (0, 5, "a needle b"), (1, 103, "needles"),
    ]


def test_no_match_is_an_empty_result_and_empty_needle_matches_first(log):
    assert rows(logsift.search_topic(log, "absent")) == []
    assert rows(logsift.search_topic(log, ""), "topic", "partition", "offset") == [
        ("t", 0, 0), ("t", 1, 100), ("u", 0, 0),
    ]


def test_cursor_at_end_finds_nothing(log):
    cursors = logsift.move(logsift.partition_offsets(log), 0)
    assert rows(logsift.search_topic(log, "", cursors)) == []
    assert rows(logsift.range_scan(log, cursors)) == []


@pytest.mark.parametrize("needle, step", [("needle", 1), ("or", 3), ("", 3), ("absent", 1), ("q", 1000)])
def test_waves_agree_with_one_pass(log, needle, step):
    cursors = logsift.partition_offsets(log)
    assert rows(logsift.search_topic(log, needle, cursors, step=step)) == rows(logsift.search_topic(log, needle))
    columns = ["topic", "partition", "offset", "value"]
    assert rows(logsift.search_partition(log, needle, cursors, step=step), *columns) == rows(
        logsift.search_partition(log, needle), *columns
    )
    assert rows(logsift.filtered_head(log, has(log, needle), 2, cursors, step=step)) == rows(
        logsift.filtered_head(log, has(log, needle), 2)
    )


def test_waves_fall_back_when_the_cursors_are_too_many(monkeypatch, log):
    from logsift.plans import sizing

    monkeypatch.setattr(sizing, "HELD_ROWS", 1)
    cursors = logsift.partition_offsets(log)
    assert rows(logsift.search_topic(log, "or", cursors, step=2)) == [
        ("t", 0, 0, 13, 12), ("t", 1, 100, 105, 104),
    ]


def test_a_log_may_be_a_function_that_reads_ranges(log):
    binary = log.withColumn("value", F.col("value").cast("binary"))
    read = []

    def reader(cursors):
        read.append(rows(cursors, "partition", "offset", "end"))
        return logsift.range_scan(binary, cursors)

    cursors = logsift.partition_offsets(log)
    assert rows(logsift.search_topic(reader, "needle", cursors, step=4)) == rows(logsift.search_topic(log, "needle"))
    assert read[0] == [(0, 0, 1), (0, 0, 4), (1, 100, 104)]
    assert rows(logsift.lookup(reader, cursors), "topic", "partition", "offset") == [
        ("t", 0, 0), ("t", 1, 100), ("u", 0, 0),
    ]
    with pytest.raises(ValueError):
        logsift.range_scan(reader)


def test_raw_bytes_are_searched_case_sensitively(make_log):
    log = make_log([("t", 0, 0, b"\xff\xfeab"), ("t", 0, 1, "é".encode())], "topic string, partition int, offset bigint, value binary")
    assert rows(logsift.search_topic(log, "ab"), "offset") == [(0,)]
    assert rows(logsift.search_topic(log, "é"), "offset") == [(1,)]
    assert rows(logsift.search_topic(log, "AB")) == []


def test_tombstones_match_only_the_empty_needle(make_log):
    log = make_log([("t", 0, 0, None), ("t", 0, 1, "a")])
    assert rows(logsift.search_topic(log, "a"), "offset") == [(1,)]
    assert rows(logsift.search_topic(log, ""), "offset") == [(0,)]


def test_first_result_and_count(log):
    found = logsift.search_topic(log, "needle")
    assert rows(logsift.first_result(found)) == [("t", 0, 0)]
    assert rows(logsift.match_count(found)) == [("t", 2)]


def test_chained_search_means_then_in_the_same_partition(log):
    assert rows(logsift.search_chained(log, ["needle", "or"])) == [("t", 0, [0, 12]), ("t", 1, [103, 104])]
    assert rows(logsift.search_chained(log, ["or", "needle"])) == [("t", 0, [12, 12])]
    assert rows(logsift.search_chained(log, ["needle", "needle", "z"])) == [("t", 0, [0, 0, 12])]


def test_the_result_of_a_search_is_a_cursor_table(log):
    found = logsift.search_topic(log, "or", logsift.search_topic(log, "needle"))
    assert rows(found) == [("t", 0, 0, 13, 12), ("t", 1, 100, 105, 104)]
    assert rows(logsift.remaining(log, found), "partition", "n_records") == [(0, 1), (1, 1)]
    assert rows(logsift.range_scan(log, found), "value") == [("or",), ("z or needle",)]


def test_decoded_value_can_be_searched(make_log):
    from logsift.operators.decode import decoded

    log = make_log([("t", 0, 0, "6162"), ("t", 0, 1, "6364")])
    log = log.withColumn("text", decoded({"t": lambda v: F.unhex(v).cast("string")}))
    assert rows(logsift.search_topic(log, "cd", column="text"), "offset") == [(1,)]
    assert rows(logsift.search_topic(log, "cd")) == []


def brute_place(body: bytes, needle: str):
    lines = body.decode().split("\n")
    if lines[-1] == "":
        lines.pop()
    for i, line in enumerate(line.removesuffix("\r") for line in lines):
        if needle in line:
            return i, line.index(needle), len(line[: line.index(needle)].encode())
    return None


@pytest.mark.parametrize("needle", ["b", "é", "\r", "", "a\r", "zz", "\n", "cé"])
def test_body_search_against_brute_force(make_log, needle):
    bodies = ["", "\n", "a", "a\r", "a\n\r", "\r\n", "é\r\nab\n", "x\r\r\ncéb", "a\r\nb\n\nc\n", "\n\nécéb b\r"]
    log = make_log([("t", 0, i, body) for i, body in enumerate(bodies)])
    places = {i: brute_place(body.encode(), needle) for i, body in enumerate(bodies)}
    for unit, at in (("char", 1), ("byte", 2)):
        want = sorted(((i, p[0], p[at]) for i, p in places.items() if p), key=repr)
        assert rows(logsift.search_body(log, needle, unit), "offset", "line_no", "col") == want


def test_match_context_cuts(make_log):
    log = make_log([("t", 0, 0, "abcNEEDLEdefgh"), ("t", 0, 1, "none"), ("t", 0, 2, "NEEDLE")])
    columns = ["before", "match", "after"]
    assert rows(logsift.match_context(log, "NEEDLE"), *columns) == [("", "NEEDLE", ""), ("abc", "NEEDLE", "defgh")]
    assert rows(logsift.match_context(log, "NEEDLE", after=2), *columns)[1] == ("abc", "NEEDLE", "de")
    assert rows(logsift.match_context(log, "NEEDLE", width=10), *columns)[1] == ("abc", "NEEDLE", "d")
    assert rows(logsift.match_context(log, "NEEDLE", width=4), *columns)[1] == ("abc", "NEEDLE", "")


def test_preview_by_bytes_keeps_valid_text(make_log):
    schema = "topic string, partition int, offset bigint, value binary"
    log = make_log([("t", 0, 0, b"a\xc3"), ("t", 0, 1, b"\xffab"), ("t", 0, 2, "aé€".encode())], schema)
    assert rows(logsift.preview(log, 2), "offset", "preview") == [(0, "a�"), (1, "�a"), (2, "a�")]
    assert rows(logsift.preview(log.where("offset = 2"), 2, "char"), "preview") == [("aé",)]
    assert log.where("offset = 2").select(byte_cut("value", 99)).first()[0] == "aé€"


def test_string_cut(spark):
    one = lambda text, n: spark.range(1).select(string_cut(F.lit(text), n)).first()[0]
    assert [one("abcd", n) for n in (0, 3, 4, 5)] == ["abcd", "abc...", "abcd...", "abcd"]
    assert one("éèê", 2) == "éè..."


def test_pages_of_a_gappy_log(log):
    cursors = logsift.partition_offsets(log)
    for step in (None, 1, 64):
        page = lambda k: rows(logsift.page_messages(log, cursors, k, 3, step=step), "topic", "partition", "offset")
        assert page(0) == [("t", 0, 0), ("t", 0, 1), ("t", 0, 5), ("t", 1, 100), ("t", 1, 103), ("t", 1, 104), ("u", 0, 0)]
        assert page(1) == [("t", 0, 12), ("t", 0, 5), ("t", 0, 9), ("t", 1, 103), ("t", 1, 104)]
        assert page(9) == []


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(start=st.integers(0, 100), size=st.integers(1, 40), height=st.integers(1, 9))
def test_page_ids_partition_a_dense_range(make_log, make_cursors, start, size, height):
    log = make_log([("t", 0, start + i, "v") for i in range(size)])
    cursors = make_cursors([("t", 0, start, start + size, start)])
    pages = rows(logsift.page_ids(log, cursors, height), "offset", "page")
    assert sorted(pages) == [(start + i, i // height) for i in range(size)]
    last = (size - 1) // height
    for step, dense in ((None, True), (None, False), (2, False)):
        page = logsift.page_messages(log, cursors, last, height, dense=dense, step=step)
        assert sorted(rows(page, "offset")) == [(o,) for o, p in sorted(pages) if p == last]


def test_head_and_position(log):
    cursors = logsift.partition_offsets(log)
    head = logsift.filtered_head(log, has(log, "needle"), 2, decoders={"t": lambda v: F.upper(v)})
    assert rows(head, "partition", "offset", "value") == [
        (0, 0, "NEEDLE"), (0, 5, "A NEEDLE B"), (1, 103, "NEEDLES"),
    ]
    assert rows(logsift.message_at_position(log, cursors, 2), "partition", "offset") == [(0, 5), (1, 104)]
    assert rows(logsift.message_at_position(log, cursors, 5, dense=True), "partition", "offset") == [(0, 5)]


def test_head_of_a_hot_partition_over_many_blocks(spark):
    log = spark.range(0, 400).selectExpr(
        "'t' as topic", "0 as partition", "(399 - id) * 10000000 as offset", "cast(id as string) as value"
    )
    head = logsift.filtered_head(log.repartition(7), F.lit(True), 5)
    assert sorted(r["offset"] for r in head.collect()) == [i * 10000000 for i in range(5)]
    assert head._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 4


def test_headers_and_context(log):
    cursors = logsift.partition_offsets(log)
    row = logsift.with_context(log, cursors).where("partition = 1 and offset = 103")
    head = row.select(logsift.partition_header().alias("p"), logsift.message_header().alias("m")).first()
    assert tuple(head) == ("topic: t partition: 1 start: 100 end: 105", "topic: t partition: 1 offset: 103")
