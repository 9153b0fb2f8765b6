"""One query per operator over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logsift.functions.decoders import delimited, json_body, labelled, plain
from logsift.functions.protobuf import decode_person, encode_person
from logsift.functions.text import has, string_cut
from logsift.operators import bodies, catalog, cursor, dump, paging, publish, scan, search
from logsift.operators.decode import decode
from logsift.plans import views
from logsift.plans.session import prepare, scratch_path
from logsift.plans.sizing import pin
from logsift.sources import commits
from logsift.sources.index import index_log
from logsift.sources.log import ADDRESS, KEYS, read_log, stored_log, stored_offsets
from logsift.streaming.replay import replay_first_match, replay_stored

Query = Callable[[SparkSession, str], DataFrame]

NEEDLE = "87"
STEP = 1 << 16
ROW = [*ADDRESS, "value"]


def _cursors(log: DataFrame) -> DataFrame:
    return pin(catalog.partition_offsets(log))


def _declared_cursors(log: DataFrame) -> DataFrame:
    return catalog.partition_offsets(log, views.declared_partitions(log))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return views.log_events(spark, folder).select(*ROW)


def log_range_scan(spark, folder):
    log = _events(spark, folder)
    moved = _cursors(log).withColumn("offset", F.col("start") + 100)
    return scan.range_scan(log, moved)


def topic_catalog(spark, folder):
    return catalog.topic_catalog(_events(spark, folder))


def partition_offsets(spark, folder):
    return _declared_cursors(_events(spark, folder))


def open_topic(spark, folder):
    return catalog.open_topic(_events(spark, folder), "click")


def message_lookup(spark, folder):
    log = _events(spark, folder)
    return scan.lookup(log, views.last_messages(log))


def replay(spark, folder):
    schema = views.table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return replay_first_match(views.as_events_log(stream).select(*ROW), NEEDLE)


def partition_dump(spark, folder):
    return dump.dump(_events(spark, folder), decoders={"*": json_body}, policy="passthrough")


def partition_json(spark, folder):
    return catalog.partition_json(catalog.partition_offsets(_events(spark, folder)))


def assign_offsets(spark, folder):
    records = views.table(spark, folder, "events").select(
        F.col("event_type").alias("topic"), views.part_of("user_id").alias("partition"), "ts", "event_id"
    )
    return publish.assign_offsets(records, ["ts", "event_id"]).select(*ADDRESS, "event_id")


def keyed_publish(spark, folder):
    """Events keyed by their user, in the placement of common producers, in the order of their id."""
    records = views.table(spark, folder, "events").select(
        F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), "event_id"
    )
    return publish.append_to_log(records, 8, ["event_id"], method="fnv1a").select(*ADDRESS, "key", "value", "event_id")


def synthetic_log(spark, folder):
    records = publish.templated_records(views.table(spark, folder, "events"), "event_id")
    count = F.lit(0)
    for topic, n in publish.TOPIC_PARTITIONS.items():
        count = F.when(F.col("topic") == topic, n).otherwise(count)
    return publish.append_to_log(records, count, ["id"], method="fnv1a").select(*ADDRESS, "key", "value")


def partition_table(spark, folder):
    return catalog.partition_table(_declared_cursors(_events(spark, folder)))


def message_preview(spark, folder):
    return scan.preview(views.log_docs(spark, folder), 40, "char")


def page_preview(spark, folder):
    return scan.preview(views.log_pages(spark, folder), 60)


def message_context(spark, folder):
    log = _events(spark, folder).select(*ADDRESS)
    return scan.with_context(log, _cursors(log))


def filtered_head(spark, folder):
    log = _events(spark, folder)
    return scan.filtered_head(log, has(log, "8"), 5, _cursors(log), step=STEP)


def non_empty_partitions(spark, folder):
    cursors = _declared_cursors(_events(spark, folder))
    return catalog.non_empty(cursors).select(*KEYS, "size")


def _moved(spark, folder, move) -> DataFrame:
    log = _events(spark, folder)
    cursors = move(_cursors(log))
    return cursor.remaining(log, cursors).select(*ADDRESS, "n_records")


def cursor_forward(spark, folder):
    return _moved(spark, folder, lambda cursors: cursor.move(cursors, 200))


def cursor_tail(spark, folder):
    return _moved(spark, folder, lambda cursors: cursor.move(cursors, -500))


def cursor_jump(spark, folder):
    return _moved(spark, folder, lambda cursors: cursor.jump(cursors, 5000))


def tail_scan(spark, folder):
    log = _events(spark, folder).select(*ADDRESS)
    return scan.range_scan(log, cursor.move(_cursors(log), -500))


def search_partition(spark, folder):
    return search.search_partition(_events(spark, folder), NEEDLE)


def search_topic(spark, folder):
    return search.search_topic(_events(spark, folder), NEEDLE)


def search_topic_from(spark, folder):
    """The same search on the tail of every partition, in growing ranges."""
    log = _events(spark, folder)
    return search.search_topic(log, NEEDLE, cursor.move(_cursors(log), -5000), step=1000)


def search_topic_first(spark, folder):
    return search.first_result(search.search_topic(_events(spark, folder), NEEDLE))


def search_chained(spark, folder):
    found = search.search_chained(views.log_chat(spark, folder), ["the", "or"])
    first, second = F.col("first_match")[0], F.col("first_match")[1]
    return found.select(*KEYS, first.alias("o_first"), second.alias("o_second"))


def search_match_count(spark, folder):
    return search.match_count(search.search_topic(_events(spark, folder), NEEDLE))


def search_body_lines(spark, folder):
    return search.search_body(views.log_docs(spark, folder), "en")


def match_context(spark, folder):
    return search.match_context(views.log_docs(spark, folder), "en", after=40)


def page_messages(spark, folder):
    log = _events(spark, folder).select(*ADDRESS)
    return paging.page_messages(log, _cursors(log), 2, 20, step=STEP)


def page_ids(spark, folder):
    log = _events(spark, folder)
    return paging.page_ids(log, _cursors(log), 20)


MIXED_DECODERS = {
    "click": delimited({"user": "BIGINT", "type": "STRING", "id": "BIGINT"}),
    "view": labelled({"user": "BIGINT", "type": "STRING", "id": "BIGINT"}),
    "purchase": json_body,
}


def decode_dispatch(spark, folder):
    rows = decode(views.log_mixed(spark, folder), MIXED_DECODERS, "fail")
    return rows.withColumnRenamed("value", "decoded")


def decode_protobuf(spark, folder):
    events = views.table(spark, folder, "events")
    encoded = events.select(
        "event_id", encode_person(F.col("event_type"), F.lit(""), F.col("user_id")).alias("value")
    )
    person = encoded.select("event_id", decode_person(F.col("value")).alias("person"))
    return person.select("event_id", "person.first", "person.age")


def dump_until_bad(spark, folder):
    readable = {"*": lambda value: F.when(~F.contains(value, F.lit("99")), plain(value))}
    return dump.dump(_events(spark, folder), decoders=readable, policy="stop")


def decode_passthrough(spark, folder):
    log = views.log_chat(spark, folder).unionByName(views.log_json(spark, folder))
    return decode(log, {"*": json_body}, "passthrough")


def json_canonical(spark, folder):
    log = views.log_json(spark, folder)
    return bodies.canonical_bodies(log).select(F.col("offset").alias("event_id"), "json")


def json_children(spark, folder):
    children = bodies.json_children(views.log_json(spark, folder))
    return children.select(F.col("offset").alias("event_id"), "key", "value", "type")


def json_leaves(spark, folder):
    """Two levels deep, with the path of every value."""
    leaves = bodies.json_children(views.log_json(spark, folder), depth=2)
    return leaves.select(F.col("offset").alias("event_id"), "path", "value", "type")


def body_line_rows(spark, folder):
    return bodies.body_line_rows(views.log_docs(spark, folder))


def cut_strings(spark, folder):
    return views.log_docs(spark, folder).select("offset", string_cut("value", 40).alias("text"))


def json_field_sum(spark, folder):
    total = bodies.field_sum(_events(spark, folder), "$.k")
    return total.select(*KEYS, F.col("total").cast("bigint").alias("sum_k"))


def json_field_sum_topic(spark, folder):
    """The documented pipeline, added up per topic."""
    total = bodies.field_sum(_events(spark, folder), "$.k", by=["topic"])
    return total.select("topic", F.col("total").cast("bigint").alias("sum_k"))


def _stored(spark, folder) -> tuple[str, StructType]:
    """The events as a stored log of two versions, low partitions first."""
    log, path = _events(spark, folder), scratch_path(spark, "log")
    commits.write_log(log.where("partition < 2"), path)
    commits.write_log(log.where("partition >= 2"), path)
    return path, log.schema


def stored_tail(spark, folder):
    """The tail of every partition of a stored log, found through its manifest."""
    path, schema = _stored(spark, folder)
    return scan.range_scan(stored_log(spark, path, schema), cursor.move(stored_offsets(spark, path, schema), -500))


def stored_overwrite(spark, folder):
    """What a stored log is after its values were overwritten with their lengths, and after a file of another writer came."""
    path, schema = _stored(spark, folder)
    lengths = read_log(spark, path, schema).withColumn("value", F.length("value").cast("string"))
    commits.write_log(lengths, path, mode="overwrite")
    later = lengths.groupBy(*KEYS).agg((F.max("offset") + 1).alias("offset"), F.count("*").cast("string").alias("value"))
    later.write.mode("append").partitionBy(*KEYS).parquet(path)
    return scan.range_scan(stored_log(spark, path, schema), stored_offsets(spark, path, schema)).select(*ROW)


def stored_position(spark, folder):
    """The 21st message of every partition, from the record counts of the files."""
    path, schema = _stored(spark, folder)
    return scan.message_at_position(stored_log(spark, path, schema), stored_offsets(spark, path, schema), 20)


def stored_field_sum(spark, folder):
    """``json_field_sum`` over bodies that were parsed when the log was stored."""
    log, path = _events(spark, folder), scratch_path(spark, "log")
    commits.write_log(bodies.with_bodies(log), path)
    schema = log.schema.add("body", "variant")
    total = bodies.field_sum(stored_log(spark, path, schema), "$.k", stored_offsets(spark, path, log.schema))
    return total.select(*KEYS, F.col("total").cast("bigint").alias("sum_k"))


def stored_page(spark, folder):
    path, schema = _stored(spark, folder)
    return paging.page_messages(stored_log(spark, path, schema), stored_offsets(spark, path, schema), 2, 20).select(*ADDRESS)


def indexed_search(spark, folder):
    """``search_topic`` on a stored log with an index of its values."""
    path, schema = _stored(spark, folder)
    index_log(spark, path, gram=2, bits=1 << 16)
    return search.search_topic(stored_log(spark, path, schema), NEEDLE, stored_offsets(spark, path, schema))


def replay_until_found(spark, folder):
    """``replay_first_match`` on a stored log: a stream that ends when every partition has its answer."""
    path, schema = _stored(spark, folder)
    return replay_stored(spark, path, NEEDLE, schema)


def search_first(spark, folder):
    """``search_topic_first`` that stops reading where an answer is known."""
    log = _events(spark, folder)
    return search.search_first(log, NEEDLE, _cursors(log), step=1000)


def filtered_head_long(spark, folder):
    log = _events(spark, folder)
    return scan.filtered_head(log, has(log, "8"), 2000, _cursors(log))


def json_numbers(spark, folder):
    """Numbers with exponents and zeros at the end."""
    number = F.col("event_id").cast("string")
    text = F.concat(F.lit('{"v": '), number, F.lit('.50, "k": '), number, F.lit('e2, "big": '), number, F.lit("e400}"))
    log = views.as_log(views.table(spark, folder, "events"), topic="event_type", partition=views.part_of("user_id"), offset="event_id", value=text)
    return bodies.canonical_bodies(log).select(F.col("offset").alias("event_id"), "json")


def json_all_leaves(spark, folder):
    """All levels, however deep."""
    leaves = bodies.json_children(views.log_json(spark, folder), depth=None)
    return leaves.select(F.col("offset").alias("event_id"), "path", "value", "type")


REGISTRY: dict[str, Query] = {
    "log_range_scan": log_range_scan,
    "topic_catalog": topic_catalog,
    "partition_offsets": partition_offsets,
    "open_topic": open_topic,
    "message_lookup": message_lookup,
    "replay_first_match": replay,
    "partition_dump": partition_dump,
    "partition_json": partition_json,
    "assign_offsets": assign_offsets,
    "keyed_publish": keyed_publish,
    "synthetic_log": synthetic_log,
    "partition_table": partition_table,
    "message_preview": message_preview,
    "page_preview": page_preview,
    "message_context": message_context,
    "filtered_head": filtered_head,
    "non_empty_partitions": non_empty_partitions,
    "cursor_forward": cursor_forward,
    "cursor_tail": cursor_tail,
    "cursor_jump": cursor_jump,
    "tail_scan": tail_scan,
    "search_partition": search_partition,
    "search_topic": search_topic,
    "search_topic_from": search_topic_from,
    "search_topic_first": search_topic_first,
    "search_chained": search_chained,
    "search_match_count": search_match_count,
    "search_body_lines": search_body_lines,
    "match_context": match_context,
    "page_messages": page_messages,
    "page_ids": page_ids,
    "decode_dispatch": decode_dispatch,
    "decode_protobuf": decode_protobuf,
    "dump_until_bad": dump_until_bad,
    "decode_passthrough": decode_passthrough,
    "json_canonical": json_canonical,
    "json_children": json_children,
    "json_leaves": json_leaves,
    "body_lines": body_line_rows,
    "string_cut": cut_strings,
    "json_field_sum": json_field_sum,
    "json_field_sum_topic": json_field_sum_topic,
    "stored_tail": stored_tail,
    "stored_overwrite": stored_overwrite,
    "stored_position": stored_position,
    "stored_field_sum": stored_field_sum,
    "stored_page": stored_page,
    "indexed_search": indexed_search,
    "replay_until_found": replay_until_found,
    "search_first": search_first,
    "filtered_head_long": filtered_head_long,
    "json_numbers": json_numbers,
    "json_all_leaves": json_all_leaves,
}


def registered() -> dict[str, Query]:
    """The queries, each on a session with the options the operators rely on."""

    def on_prepared(query: Query) -> Query:
        return lambda spark, folder: query(prepare(spark), folder)

    return {name: on_prepared(query) for name, query in REGISTRY.items()}
