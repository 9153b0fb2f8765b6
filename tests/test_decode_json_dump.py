from __future__ import annotations

import json
import random
from decimal import Decimal
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

import logsift
from logsift.functions.jsontext import canonical_json, finite, json_field, json_kind, json_value
from logsift.functions.protobuf import decode_person, encode_person
from logsift.functions.text import body_lines


def only_digits(value):
    return F.when(F.regexp_like(value, F.lit(r"\A\d+\z")), F.concat(F.lit("n"), value))


@pytest.fixture
def log(make_log):
    return make_log(
        [("t", 0, o, "bad" if o == 4 else str(o)) for o in range(10)] + [("t", 1, 5, "7"), ("u", 0, 0, "bad")]
    )


def test_policy_stop_yields_the_prefix_of_each_partition(log):
    got = rows(logsift.decode(log, {"t": only_digits}, "stop"), "topic", "partition", "offset", "value")
    assert got == [("t", 0, o, f"n{o}") for o in range(4)] + [("t", 1, 5, "n7"), ("u", 0, 0, "bad")]


def test_policy_passthrough_flags_the_raw_values(log):
    got = logsift.decode(log, {"t": only_digits}, "passthrough")
    assert rows(got.where("not is_decoded"), "topic", "offset", "value") == [("t", 4, "bad")]
    assert got.where("is_decoded").count() == 11


def test_policy_fail_fails_at_a_bad_record_only(log):
    assert logsift.decode(log.where("offset <> 4"), {"t": only_digits}, "fail").count() == 11
    with pytest.raises(Exception, match="cannot decode topic: t partition: 0 offset: 4"):
        logsift.decode(log, {"t": only_digits}, "fail").collect()


def test_predicate_is_applied_before_decoding(log):
    head = logsift.filtered_head(log, F.col("value") != "bad", 3, decoders={"t": only_digits})
    assert rows(head.where("partition = 0 and topic = 't'"), "value") == [("n0",), ("n1",), ("n2",)]


def test_a_missing_value_is_not_a_decoding_error(make_log):
    log = make_log([("t", 0, 0, None), ("t", 0, 1, "2")])
    assert rows(logsift.decode(log, {"t": only_digits}, "fail"), "value") == [("n2",), (None,)]
    assert logsift.decode(log, {"t": only_digits}, "stop").count() == 2
    assert logsift.decode(log, {"t": only_digits}).where("is_decoded").count() == 2


def test_ready_decoders(make_log):
    person = {"first_name": "STRING", "last_name": "STRING", "age": "INT"}
    log = make_log(
        [
            ("items", 0, 0, "Al,Hill,7"), ("items", 0, 1, "Al,Hill"), ("items", 0, 2, "Al,Hill,old"),
            ("items", 0, 3, '"A,l",Hill,7'), ("items", 0, 4, "Al,Hill,7,x"),
            ("things", 0, 0, "first_name: Al, last_name: Hill, age: 7"),
            ("things", 0, 1, "first_name: Al, last_name: Hill"),
            ("things", 0, 2, "first_name: Al, last_name: Hill, age: x"),
            ("json", 0, 0, '{"b":1,"a":2}'), ("raw", 0, 0, "as it is"),
        ]
    )
    decoders = {
        "items": logsift.delimited(person), "things": logsift.labelled(person), "json": logsift.json_body,
    }
    got = rows(logsift.decode(log, decoders), "topic", "offset", "value", "is_decoded")
    good = '{"first_name":"Al","last_name":"Hill","age":7}'
    assert got == [
        ("items", 0, good, True), ("items", 1, "Al,Hill", False), ("items", 2, "Al,Hill,old", False),
        ("items", 3, good.replace("Al", "A,l"), True), ("items", 4, "Al,Hill,7,x", False),
        ("json", 0, '{"a":2,"b":1}', True), ("raw", 0, "as it is", True),
        ("things", 0, good, True), ("things", 1, "first_name: Al, last_name: Hill", False),
        ("things", 2, "first_name: Al, last_name: Hill, age: x", False),
    ]


def test_protobuf_round_trip_and_wire_format(spark):
    people = spark.createDataFrame([("Al", "Hill", 7), ("é", "", -1), ("", "", 0)], "f string, l string, a int")
    coded = people.select("*", encode_person(F.col("f"), F.col("l"), F.col("a")).alias("value"))
    assert bytes(coded.first()["value"]) == b"\n\x02Al\x12\x04Hill\x18\x07"
    assert rows(coded.select(decode_person(F.col("value")).alias("p")).select("p.*")) == rows(people)
    gap = spark.createDataFrame([(None, None, None)], people.schema)
    coded = gap.select(encode_person(F.col("f"), F.col("l"), F.col("a")).alias("value"))
    assert rows(coded.select(decode_person(F.col("value")).alias("p")).select("p.*")) == [("", "", 0)]
    bad = spark.createDataFrame([(b"\x0a\x7f",), (None,)], "value binary")
    assert rows(bad.select(decode_person(F.col("value")).isNull())) == [(True,), (True,)]


def test_only_the_named_topic_is_decoded_as_protobuf(spark):
    people = logsift.protobuf_records(spark.range(0, 20), "id")
    other = people.withColumn("topic", F.lit("other")).withColumn("value", F.lit("text").cast("binary"))
    log = people.union(other).selectExpr("topic", "0 as partition", "id as offset", "value")
    got = logsift.decode(log, {"proto": logsift.person_body}, "fail")
    texts = got.where("topic = 'proto'").select(F.from_json("value", "first string, age int").alias("p"))
    assert texts.where("p.first is not null and p.age between 5 and 84").count() == 20
    assert rows(got.where("topic = 'other'").select("value").distinct()) == [("text",)]


def test_children_of_nested_bodies(make_log):
    bodies = ['{"b":{"y":[1,"s"],"x":{}},"a":null}', "[true,[2.5]]", "7", "not json", "{}"]
    log = make_log([("t", 0, i, body) for i, body in enumerate(bodies)])
    children = lambda depth: rows(logsift.json_children(log, depth), "offset", "path", "key", "value", "type")
    nothing = [(2, None, None, None, None), (3, None, None, None, None), (4, None, None, None, None)]
    assert children(1) == sorted(nothing + [
        (0, "$.a", "a", "null", "null"), (0, "$.b", "b", '{"x":{},"y":[1,"s"]}', "object"),
        (1, "$[0]", None, "true", "bool"), (1, "$[1]", None, "[2.5]", "array"),
    ], key=repr)
    assert children(3) == sorted(nothing + [
        (0, "$.a", "a", "null", "null"), (0, "$.b.x", "x", "{}", "object"),
        (0, "$.b.y[0]", None, "1", "number"), (0, "$.b.y[1]", None, '"s"', "string"),
        (1, "$[0]", None, "true", "bool"), (1, "$[1][0]", None, "2.5", "number"),
    ], key=repr)


def test_canonical_bodies_keep_what_is_not_json(make_log):
    log = make_log([("t", 0, 0, '{"b":1,"a":2}'), ("t", 0, 1, "plain")])
    assert rows(logsift.canonical_bodies(log), "json", "is_json") == [("plain", False), ('{"a":2,"b":1}', True)]


def test_field_sum_over_the_range_of_the_cursors(make_log, make_cursors):
    log = make_log([("t", 0, o, f'{{"age": {o}}}') for o in range(5)] + [("t", 1, 0, "no"), ("t", 1, 1, '{"age": "9"}')])
    assert rows(logsift.field_sum(log, "$.age"), "partition", "total") == [(0, 10.0), (1, 0.0)]
    cursors = make_cursors([("t", 0, 0, 4, 2)])
    assert rows(logsift.field_sum(log, "$.age", cursors, by=["topic"])) == [("t", 5.0)]


CANONICAL = {
    '{"b":{"z":1,"y":[2,{"d":4,"c":3}]},"a":null}': '{"a":null,"b":{"y":[2,{"c":3,"d":4}],"z":1}}',
    "{}": "{}",
    "[]": "[]",
    "12": "12",
    '"x"': '"x"',
    "null": "null",
    " true\n": "true",
    "9007199254740993": "9007199254740993",
    '{"a":1,"a":2}': '{"a":2}',
    '{"a":"<&>\\u00e9\\n"}': '{"a":"<&>é\\n"}',
    '{"a":1} x': None,
    "1],[2": None,
    "1,2": None,
    '1,"x"],["y"': None,
    "": None,
    "plain text": None,
    "{'a':1}": None,
    "[1,]": None,
    "NaN": None,
}


def test_canonical_json(spark):
    texts = spark.createDataFrame([(t,) for t in CANONICAL], "value string")
    got = {r["value"]: r["json"] for r in texts.select("value", canonical_json("value").alias("json")).collect()}
    assert got == CANONICAL


def test_json_kinds(spark):
    texts = ['"s"', "1", "1.5", "1e3", "true", "null", "{}", "[1]", "no"]
    df = spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
    kinds = [r[0] for r in df.select(json_kind(json_value("value"))).collect()]
    assert kinds == ["string", "number", "number", "number", "bool", "null", "object", "array", None]


def test_json_field_takes_numbers_only(spark):
    texts = ['{"a":{"b":2}}', '{"a":{"b":"2"}}', '{"a":{"b":true}}', '{"a":3}', "no", '{"a":{"b":null}}', '{"a":{"b":1e2}}', '{"a":{"b":"NaN"}}']
    df = spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
    assert [r[0] for r in df.select(json_field("value", "$.a.b").alias("n")).select(finite("n")).collect()] == [2.0, None, None, None, None, None, 100.0, None]
    with pytest.raises(ValueError):
        json_field("value", "a.b")


def brute_lines(text):
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def test_body_lines_against_brute_force(spark):
    texts = ["", "\n", "\r", "a", "a\n", "a\r\n", "a\r", "a\n\r", "a\r\r\nb", "a\r\nb\n\nc\n", "\n\n", "é\nè"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    for row in df.select("value", body_lines("value").alias("lines")).collect():
        assert row["lines"] == brute_lines(row["value"]), repr(row["value"])


def test_dump_files_are_in_offset_order(spark, tmp_path):
    log = spark.range(0, 2000).selectExpr(
        "if(id % 10 = 0, 'cold', 'hot') as topic", "0 as partition", "(id * 7919) % 2000 as offset", "id"
    ).selectExpr("topic", "partition", "offset", "cast(offset as string) as value")
    path = tmp_path / "dump"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        logsift.write_dump(logsift.dump(log.repartition(5)), str(path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for topic in ("hot", "cold"):
        files = sorted(Path(path, f"topic={topic}", "partition=0").glob("part-*"))
        lines = [int(line) for file in files for line in file.read_text().splitlines()]
        assert lines == sorted(r["offset"] for r in log.where(F.col("topic") == topic).collect())
        assert topic == "cold" or len(files) > 1


def test_dump_stops_at_a_bad_record_from_the_cursor_on(log, make_cursors):
    cursors = make_cursors([("t", 0, 0, 10, 2), ("u", 0, 0, 1, 0)])
    assert rows(logsift.dump(log, cursors, {"t": only_digits}), "offset", "value") == [
        (0, "bad"), (2, "n2"), (3, "n3"),
    ]


def test_catalog_export(spark, make_cursors, tmp_path):
    cursors = make_cursors([("t", 1, 2, 9, 2), ("t", 0, 0, 4, 1)])
    logsift.write_catalog(cursors, str(tmp_path / "table"))
    logsift.write_catalog(cursors, str(tmp_path / "json"), "json")
    table = spark.read.option("header", "true").csv(str(tmp_path / "table"))
    assert rows(table) == [("t", "0", "0", "1", "4", "4"), ("t", "1", "2", "2", "9", "7")]
    assert rows(spark.read.json(str(tmp_path / "json")), "partition", "end") == [(0, 4), (1, 9)]


def test_field_sum_is_exact(make_log):
    bodies = ['{"k": 9007199254740993}', '{"k": 1}', '{"k": 2} trailing', '{"k": "5"}', '{"k": 0.1}', '{"k": 0.2}', None, ""]
    log = make_log([("t", 0, i, body) for i, body in enumerate(bodies)])
    assert rows(logsift.field_sum(log, "$.k"), "total") == [(Decimal("9007199254740994.3"),)]


def test_field_sum_paths(make_log):
    log = make_log([("t", 0, 0, '{"a": [4, 5], "b": {"c d": 7}}'), ("t", 0, 1, '{"a[0]": 9}')])
    total = lambda path: rows(logsift.field_sum(log, path), "total")[0][0]
    assert (total("$.a[0]"), total("$.a[1]"), total("$.b['c d']"), total("$.a")) == (4, 5, 7, 0)
    for path in ("$", "$.", "a", "$.a[x]", "$..a", "$.a[*]", "$.a.", "$.a b"):
        with pytest.raises(ValueError):
            logsift.field_sum(log, path)


def test_a_number_too_large_makes_no_sum(make_log):
    log = make_log([("t", 0, 0, '{"k": 1e300}'), ("t", 0, 1, '{"k": 1}'), ("t", 1, 0, '{"k": 1e3}')])
    assert rows(logsift.field_sum(log, "$.k"), "partition", "total") == [(0, None), (1, Decimal(1000))]


PERSON = {"first": "STRING", "_malformed": "STRING", "age": "INT"}


def test_empty_and_missing_values_under_all_policies(make_log):
    values = ["A,B,1", "", None, "A,B", "C,D,2"]
    log = make_log([("t", 0, i, v) for i, v in enumerate(values)] + [("t", 1, 0, None), ("t", 1, 1, "E,F,3")])
    decoders = {"*": logsift.delimited(PERSON)}
    text = lambda a, b, n: f'{{"first":"{a}","_malformed":"{b}","age":{n}}}'
    assert rows(logsift.decode(log, decoders, "passthrough"), "partition", "offset", "value", "is_decoded") == sorted([
        (0, 0, text("A", "B", 1), True), (0, 1, "", False), (0, 2, None, True), (0, 3, "A,B", False),
        (0, 4, text("C", "D", 2), True), (1, 0, None, True), (1, 1, text("E", "F", 3), True),
    ], key=repr)
    assert rows(logsift.decode(log, decoders, "stop"), "partition", "offset") == [(0, 0), (1, 0), (1, 1)]
    with pytest.raises(Exception, match="cannot decode topic: t partition: 0 offset: [13]"):
        logsift.decode(log, decoders, "fail").collect()
    good = log.where("partition = 1")
    assert {r[0] for r in rows(logsift.decode(good, decoders, "fail"), "value")} == {None, text("E", "F", 3)}


def test_labels_are_split_once(make_log):
    values = ["a: x, y, b: 1", "a: l1\nl2, b: 2", "a: , b: 3", "b: 1, a: x", "a: x", "", None, "a: x, b: y", "a: x, b: 4, b: 5", "za: x, b: 1"]
    log = make_log([("t", 0, i, v) for i, v in enumerate(values)])
    got = dict(rows(logsift.decode(log, {"*": logsift.labelled({"a": "STRING", "b": "INT"})}, "passthrough").where("is_decoded"), "offset", "value"))
    assert got == {0: '{"a":"x, y","b":1}', 1: '{"a":"l1\\nl2","b":2}', 2: '{"a":"","b":3}', 6: None}


def test_stop_decodes_every_message_once(spark, make_log, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counting(value):
        calls.add(1)
        return None if value == "bad" else value

    log = make_log([("t", p, o, "bad" if (p, o) == (0, 50) else "x") for p in range(2) for o in range(100)])
    logsift.write_dump(logsift.dump(log, decoders={"*": counting}, policy="stop"), str(tmp_path / "d"))
    assert calls.value == 200
    assert spark.read.text(str(tmp_path / "d")).count() == 150



def exact(token):
    """The number as its shortest text, said with Python's decimals."""
    number = Decimal(token)
    if abs(number.as_tuple().exponent + len(token.lower().split("e")[0].partition(".")[2])) > 308:
        return token
    text = f"{number:f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text.strip("-") in ("0", "") else text


NUMBERS = [
    "1e3", "1E+3", "-1.50e2", "1e-7", "0e5", "-0", "-0.0", "1.0", "1.50", "12.5e1", "1e308", "1e-308", "1e400", "1E-400", "1e99999999999", "0.000e3", "100e-2",
    "123456789012345678901234567890123456789012", "-0.1234567890123456789012345678901234567890123000", "1000000000000000000000000000000000000000.000", "9007199254740993", "5e-324",
]


def test_numbers_are_exact(spark):
    draw = random.Random(8)

    def digits(least=0):
        return "".join(draw.choices("0123456789", k=draw.choice([least, 1, 2, 20, 45])))

    drawn = [f"{draw.choice(['', '-'])}{draw.choice(['0', '7' + digits()])}{draw.choice(['', '.' + digits(1)])}{draw.choice(['', 'e', 'E+', 'e-'])}" for _ in range(400)]
    tokens = NUMBERS + [t.rstrip(".") if t[-1] not in "e+-E" else t + str(draw.choice([0, 1, 7, 30, 307])) for t in drawn if "." not in t or not t.endswith(".")]
    bodies = {}
    for i, t in enumerate(tokens):
        want = exact(t)
        bodies[t], bodies[f" [{t} ,\n{{\"b\": {t}, \"a\":\"{t}\"}}]"] = want, f'[{want},{{"a":"{t}","b":{want}}}]'
    bodies |= {'{"1e3":1e3}': '{"1e3":1000}', '{1e3:1}': None, "1e3 2": None, '[1e3"a"]': None, "01e3": None, "1.e3": None, ".5e3": None, "1e3.5": None, "--1e3": None, '"1e3': None, "[1e3": None}
    bodies |= {'["\\\\", 1e2, "\\"1e2"]': '["\\\\",100,"\\"1e2"]', "[" + '"\\n",' * 30_000 + "1e2]": "[" + '"\\n",' * 30_000 + "100]", "[" * 50 + "1e1" + "]" * 50: "[" * 50 + "10" + "]" * 50}
    df = spark.createDataFrame([(t,) for t in bodies], "value string")
    got = {r["value"]: r["json"] for r in df.select("value", canonical_json("value").alias("json")).collect()}
    assert {k: (v, bodies[k]) for k, v in got.items() if v != bodies[k]} == {}


def test_numbers_are_worked_out_once(spark):
    """An expression named n times is planned n times: then a body was split into tokens 7 times, and each number matched 160 times in each."""
    bodies = {"[1e-2147483648]": "[1e-2147483648]", "[1e2147483647,1e2]": "[1e2147483647,100]", "1e-308": "0." + "0" * 307 + "1", "1e-309": "1e-309"}
    df = spark.createDataFrame([(t,) for t in bodies], "value string").select("value", canonical_json("value").alias("json"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("regexp_extract(") == 4
    assert {r["value"]: r["json"] for r in df.collect()} == bodies


def test_children_to_any_depth(spark, make_log):
    draw = random.Random(9)

    def tree(depth):
        if depth == 0 or draw.random() < 0.2:
            return draw.choice([1, "s", None, True, {}, [], 2.5])
        return [tree(depth - 1) for _ in range(draw.randint(0, 3))] if draw.random() < 0.5 else {f"k{i}": tree(depth - 1) for i in range(draw.randint(0, 3))}

    def leaves(node, path="$", key=None):
        if isinstance(node, dict | list) and node:
            for k, v in node.items() if isinstance(node, dict) else enumerate(node):
                yield from leaves(v, f"{path}.{k}" if isinstance(node, dict) else f"{path}[{k}]", k if isinstance(node, dict) else None)
        else:
            kind = {dict: "object", list: "array", str: "string", bool: "bool", type(None): "null"}.get(type(node), "number")
            yield path, key, json.dumps(node), kind

    deep = 7
    for level in range(200):
        deep = {"d": deep} if level % 2 else [deep]
    trees = [deep, *(tree(6) for _ in range(40))]
    log = make_log([("t", 0, i, json.dumps(t)) for i, t in enumerate(trees)] + [("t", 1, 0, "no"), ("t", 1, 1, None)])
    got = rows(logsift.json_children(log, None), "partition", "offset", "path", "key", "value", "type")
    want = [(1, 0, None, None, None, None), (1, 1, None, None, None, None)]
    for i, t in enumerate(trees):
        want += [(0, i, *leaf) for leaf in leaves(t)] if isinstance(t, dict | list) and t else [(0, i, None, None, None, None)]
    assert got == sorted(want, key=repr)
    assert rows(logsift.json_children(log.limit(0), None)) == []
