"""Search and inspection of partitioned message logs as Spark DataFrames."""

from logsift.functions.decoders import delimited, json_body, labelled
from logsift.functions.protobuf import person_body
from logsift.functions.text import string_cut
from logsift.operators.balance import by_bytes
from logsift.operators.bodies import body_line_rows, canonical_bodies, field_sum, json_children, with_bodies
from logsift.operators.catalog import (
    as_cursors,
    list_topics,
    non_empty,
    open_topic,
    partition_json,
    partition_offsets,
    partition_table,
    topic_catalog,
)
from logsift.operators.cursor import jump, move, move_back, move_forward, remaining
from logsift.operators.decode import decode
from logsift.operators.dump import dump, write_catalog, write_dump
from logsift.operators.paging import page_ids, page_messages
from logsift.operators.publish import (
    append_to_log,
    assign_offsets,
    protobuf_records,
    sample_records,
    templated_records,
)
from logsift.operators.scan import (
    filtered_head,
    lookup,
    message_at_position,
    message_header,
    partition_header,
    preview,
    range_scan,
    with_context,
)
from logsift.operators.search import (
    first_result,
    match_context,
    match_count,
    search_body,
    search_chained,
    search_first,
    search_partition,
    search_topic,
)
from logsift.plans.session import clear_scratch, prepare
from logsift.plans.sizing import pin
from logsift.sources.commits import LogConflict, adopt_files, vacuum_log, versions
from logsift.sources.index import index_log
from logsift.sources.kafka import (
    cursors_from_offsets,
    kafka_options,
    read_kafka,
    stream_kafka,
    write_kafka,
)
from logsift.sources.log import as_log, manifest, read_log, stored_log, stored_offsets, stream_log, write_log
from logsift.sources.stored import StoredLog
from logsift.streaming.dump import dumped, read_stream_dump, stream_dump
from logsift.streaming.replay import first_matches, replay_first_match, replay_stored

__all__ = [
    "LogConflict",
    "StoredLog",
    "adopt_files",
    "append_to_log",
    "as_cursors",
    "as_log",
    "assign_offsets",
    "body_line_rows",
    "by_bytes",
    "canonical_bodies",
    "clear_scratch",
    "cursors_from_offsets",
    "decode",
    "delimited",
    "dump",
    "dumped",
    "field_sum",
    "filtered_head",
    "first_matches",
    "first_result",
    "index_log",
    "json_body",
    "json_children",
    "jump",
    "kafka_options",
    "labelled",
    "list_topics",
    "lookup",
    "manifest",
    "match_context",
    "match_count",
    "message_at_position",
    "message_header",
    "move",
    "move_back",
    "move_forward",
    "non_empty",
    "open_topic",
    "page_ids",
    "page_messages",
    "partition_header",
    "partition_json",
    "partition_offsets",
    "partition_table",
    "person_body",
    "pin",
    "prepare",
    "preview",
    "protobuf_records",
    "range_scan",
    "read_kafka",
    "read_log",
    "read_stream_dump",
    "remaining",
    "replay_first_match",
    "replay_stored",
    "sample_records",
    "search_body",
    "search_chained",
    "search_first",
    "search_partition",
    "search_topic",
    "stored_log",
    "stored_offsets",
    "stream_dump",
    "stream_kafka",
    "stream_log",
    "string_cut",
    "templated_records",
    "topic_catalog",
    "vacuum_log",
    "versions",
    "with_bodies",
    "with_context",
    "write_catalog",
    "write_dump",
    "write_kafka",
    "write_log",
]
