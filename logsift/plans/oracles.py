"""The same queries as plain SQL over the test tables, for a second engine to check."""

from __future__ import annotations

from logsift.operators.publish import (
    AGES,
    FIRST_PARTS,
    ITEMS_PER_ARRAY,
    LAST_PARTS,
    TOPIC_PARTITIONS,
    TOPIC_TEMPLATES,
    YOUNGEST,
)

EVENTS = """
log as (
  select event_type as topic, cast(user_id % 4 as integer) as "partition",
         event_id as "offset", props as "value"
  from events)"""
JSON = """
log as (
  select event_type as topic, cast(user_id % 4 as integer) as "partition", event_id as "offset",
         user_id, event_type, props
  from events)"""
DOCS = """
log as (
  select source as topic, cast(doc_id % 4 as integer) as "partition", doc_id as "offset", text as "value"
  from documents)"""
CHAT = """
log as (
  select role as topic, cast(conv_id % 4 as integer) as "partition",
         conv_id * 1000 + turn as "offset", text as "value"
  from conversations)"""
CURSORS = """
cur as (
  select topic, "partition", min("offset") as "start", max("offset") + 1 as "end"
  from log group by topic, "partition")"""
DECLARED = """
declared as (
  select t.topic, cast(p.n as integer) as "partition"
  from (select distinct topic from log) t cross join (select unnest(range(6)) as n) p),
full_cur as (
  select d.topic, d."partition", coalesce(c."start", 0) as "start", coalesce(c."end", 0) as "end"
  from declared d left join cur c on c.topic = d.topic and c."partition" = d."partition")"""
HITS = """
hit as (
  select topic, "partition", min("offset") as "offset"
  from log where contains("value", '87') group by topic, "partition")"""
CANONICAL = """
  '{"props":' || replace(props, ': ', ':') || ',"type":"' || event_type || '","user":' || user_id || '}'"""


def _moved(offset: str) -> str:
    return f"""
with {EVENTS}, {CURSORS},
moved as (select topic, "partition", "start", "end", {offset} as "offset" from cur)
select m.topic, m."partition", m."offset", count(l."offset") as n_records
from moved m left join log l
  on l.topic = m.topic and l."partition" = m."partition" and l."offset" >= m."offset" and l."offset" < m."end"
group by m.topic, m."partition", m."offset" """


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{word}'" for word in words) + "]"


def _name(number: str, parts: tuple[list[str], list[str]]) -> str:
    begin, end = map(_sql_list, parts)
    return f"{begin}[({number}) // 10 + 1] || {end}[({number}) % 10 + 1]"


def _case(column: str, values: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"


def _person(source: str) -> str:
    return f"""
select *, {_name("state % 100", FIRST_PARTS)} as first, {_name("state // 100 % 100", LAST_PARTS)} as last,
       state // 10000 % {AGES} + {YOUNGEST} as age
from (select *, (id * 7 + number + 42) * 48271 % 2147483647 as state from ({source}))"""


def _synthetic() -> str:
    topics = " union all ".join(
        f"select '{topic}' as topic, {number} as number" for number, topic in enumerate(TOPIC_TEMPLATES)
    )
    templates = {t: f"printf('{text}', first, last, age)" for t, text in TOPIC_TEMPLATES.items()}
    counts = {topic: str(n) for topic, n in TOPIC_PARTITIONS.items()}
    return f"""
with ids as (select event_id as id from events),
topics as ({topics}),
person as ({_person("select id, topic, number from ids cross join topics")}),
item as ({_person(f"select id, {len(TOPIC_TEMPLATES)} as number from ids")}),
record as (
  select topic, id, last as "key", {_case("topic", templates)} as "value" from person
  union all
  select 'miscellany', id // {ITEMS_PER_ARRAY}, 'item',
         '[' || string_agg(printf('{{"first":"%s","last":"%s","name":%d}}', first, last, age), ',' order by id)
         || ']'
  from item group by id // {ITEMS_PER_ARRAY}),
hashed as (
  select "key", list_reduce(
    list_transform(range(1, length("key") + 1), lambda i: cast(ascii(substr("key", i, 1)) as bigint)),
    lambda h, b: (xor(h, b) * 16777619) % 4294967296, 2166136261::bigint) as h
  from (select distinct "key" from record)),
placed as (
  select r.topic, r.id, r."key", r."value",
         cast(abs((case when h >= 2147483648 then h - 4294967296 else h end)
                  % {_case("r.topic", counts)}) as integer) as "partition"
  from record r join hashed using ("key"))
select topic, "partition",
       row_number() over (partition by topic, "partition" order by id) - 1 as "offset", "key", "value"
from placed"""


SQL: dict[str, str] = {
    "log_range_scan": f"""
with {EVENTS}, {CURSORS}
select l.topic, l."partition", l."offset", l."value"
from log l join cur c on l.topic = c.topic and l."partition" = c."partition"
where l."offset" >= c."start" + 100 and l."offset" < c."end" """,
    "topic_catalog": f"""
with {EVENTS}
select topic, count(distinct "partition") as n_partitions from log group by topic""",
    "partition_offsets": f"""
with {EVENTS}, {CURSORS}, {DECLARED}
select topic, "partition", "start", "end", "start" as "offset" from full_cur""",
    "open_topic": f"""
with {EVENTS}
select * from log where topic = 'click'""",
    "message_lookup": f"""
with {EVENTS},
wanted as (select topic, "partition", max("offset") as "offset" from log group by topic, "partition")
select l.* from log l join wanted w
  on l.topic = w.topic and l."partition" = w."partition" and l."offset" = w."offset" """,
    "replay_first_match": f"""
with {EVENTS}, {HITS}
select * from hit""",
    "partition_dump": f"""
with {EVENTS}
select topic, "partition", "offset", replace("value", ': ', ':') as "value" from log""",
    "partition_json": f"""
with {EVENTS}, {CURSORS}
select '{{"topic":"' || topic || '","partition":' || "partition" || ',"start":' || "start"
       || ',"end":' || "end" || ',"offset":' || "start" || ',"filter":""}}' as json
from cur""",
    "assign_offsets": """
select event_type as topic, cast(user_id % 4 as integer) as "partition",
       row_number() over (partition by event_type, user_id % 4 order by ts, event_id) - 1 as "offset", event_id
from events""",
    "keyed_publish": """
with hashed as (
  select "key", list_reduce(
    list_transform(range(1, length("key") + 1), lambda i: cast(ascii(substr("key", i, 1)) as bigint)),
    lambda h, b: (xor(h, b) * 16777619) % 4294967296, 2166136261::bigint) as h
  from (select distinct cast(user_id as varchar) as "key" from events)),
placed as (
  select e.event_type as topic, h."key", e.props as "value", e.event_id,
         cast(abs((case when h >= 2147483648 then h - 4294967296 else h end) % 8) as integer) as "partition"
  from events e join hashed h on h."key" = cast(e.user_id as varchar))
select topic, "partition", row_number() over (partition by topic, "partition" order by event_id) - 1 as "offset",
       "key", "value", event_id
from placed""",
    "synthetic_log": _synthetic(),
    "partition_table": f"""
with {EVENTS}, {CURSORS}, {DECLARED}
select topic, "partition", "start", "start" as "offset", "end", "end" - "start" as size from full_cur""",
    "message_preview": f"""
with {DOCS}
select topic, "partition", "offset", left("value", 40) as preview from log""",
    "page_preview": """
with page as (
  select page_id, html, list_max(list_filter(range(61), lambda i: strlen(left(html, i)) <= 60)) as whole
  from pages)
select 'pages' as topic, cast(page_id % 4 as integer) as "partition", page_id as "offset",
       left(html, whole) || case when strlen(left(html, whole)) < 60 and strlen(html) > 60
                                 then chr(65533) else '' end as preview
from page""",
    "message_context": f"""
with {EVENTS}, {CURSORS}
select l.topic, l."partition", l."offset", c."start", c."end"
from log l join cur c on l.topic = c.topic and l."partition" = c."partition" """,
    "filtered_head": f"""
with {EVENTS},
ranked as (
  select *, row_number() over (partition by topic, "partition" order by "offset") as n
  from log where contains("value", '8'))
select topic, "partition", "offset", "value" from ranked where n <= 5""",
    "non_empty_partitions": f"""
with {EVENTS}, {CURSORS}, {DECLARED}
select topic, "partition", "end" - "start" as size from full_cur where "end" > "start" """,
    "cursor_forward": _moved('greatest(least("start" + 200, "end" - 1), "start")'),
    "cursor_tail": _moved('greatest("end" - 500, "start")'),
    "cursor_jump": _moved('case when 5000 < "end" then greatest(5000, "start") else "start" end'),
    "tail_scan": f"""
with {EVENTS}, {CURSORS}
select l.topic, l."partition", l."offset"
from log l join cur c on l.topic = c.topic and l."partition" = c."partition"
where l."offset" >= greatest(c."end" - 500, c."start") and l."offset" < c."end" """,
    "search_partition": f"""
with {EVENTS}, {HITS}
select l.* from log l join hit h
  on l.topic = h.topic and l."partition" = h."partition" and l."offset" = h."offset" """,
    "search_topic": f"""
with {EVENTS}, {CURSORS}, {HITS}
select c.topic, c."partition", c."start", c."end", h."offset"
from cur c join hit h on h.topic = c.topic and h."partition" = c."partition" """,
    "search_topic_from": f"""
with {EVENTS}, {CURSORS},
hit as (
  select l.topic, l."partition", min(l."offset") as "offset"
  from log l join cur c on l.topic = c.topic and l."partition" = c."partition"
  where contains(l."value", '87') and l."offset" >= greatest(c."end" - 5000, c."start")
  group by l.topic, l."partition")
select c.topic, c."partition", c."start", c."end", h."offset"
from cur c join hit h on h.topic = c.topic and h."partition" = c."partition" """,
    "search_topic_first": f"""
with {EVENTS}, {HITS}
select topic, "partition", "offset" from hit h
where "partition" = (select min("partition") from hit i where i.topic = h.topic)""",
    "search_chained": f"""
with {CHAT},
a as (
  select topic, "partition", min("offset") as o from log where contains("value", 'the')
  group by topic, "partition")
select l.topic, l."partition", a.o as o_first, min(l."offset") as o_second
from log l join a on l.topic = a.topic and l."partition" = a."partition"
where contains(l."value", 'or') and l."offset" >= a.o
group by l.topic, l."partition", a.o""",
    "search_match_count": f"""
with {EVENTS}, {HITS}
select topic, count(*) as n_partitions from hit group by topic""",
    "search_body_lines": f"""
with {DOCS},
line as (
  select topic, "partition", "offset",
         unnest(regexp_split_to_array("value", '\\r?\\n')) as line,
         generate_subscripts(regexp_split_to_array("value", '\\r?\\n'), 1) - 1 as line_no
  from log),
ranked as (
  select *, row_number() over (partition by topic, "partition", "offset" order by line_no) as n
  from line where contains(line, 'en'))
select topic, "partition", "offset", cast(line_no as integer) as line_no,
       cast(instr(line, 'en') - 1 as integer) as col
from ranked where n = 1""",
    "match_context": f"""
with {DOCS}
select topic, "partition", "offset", left("value", instr("value", 'en') - 1) as before, 'en' as match,
       substr("value", instr("value", 'en') + 2, 40) as after
from log where contains("value", 'en')""",
    "page_messages": f"""
with {EVENTS}, {CURSORS},
ranked as (
  select l.*, row_number() over (partition by l.topic, l."partition" order by l."offset") as n
  from log l join cur c on l.topic = c.topic and l."partition" = c."partition"
  where l."offset" >= c."start" + 40 and l."offset" < c."end")
select topic, "partition", "offset" from ranked where n <= 20""",
    "page_ids": f"""
with {EVENTS}, {CURSORS}
select l.topic, l."partition", l."offset", (l."offset" - c."start") // 20 as page
from log l join cur c on l.topic = c.topic and l."partition" = c."partition" """,
    "decode_dispatch": f"""
with {JSON}
select topic, "partition", "offset",
       case when topic in ('click', 'view')
              then '{{"user":' || user_id || ',"type":"' || topic || '","id":' || "offset" || '}}'
            when topic = 'purchase' then replace(props, ': ', ':')
            else props end as decoded
from log""",
    "decode_protobuf": """
select event_id, event_type as first, cast(user_id as integer) as age from events""",
    "dump_until_bad": f"""
with {EVENTS},
bad as (
  select topic, "partition", min("offset") as b from log where contains("value", '99')
  group by topic, "partition")
select l.* from log l left join bad on l.topic = bad.topic and l."partition" = bad."partition"
where bad.b is null or l."offset" < bad.b""",
    "decode_passthrough": f"""
with {JSON}, {CHAT.replace("log as", "chat as")}
select topic, "partition", "offset", "value", false as is_decoded from chat
union all
select topic, "partition", "offset", {CANONICAL}, true from log""",
    "json_canonical": f"""
select event_id, {CANONICAL} as json from events""",
    "json_children": """
select event_id, 'user' as key, cast(user_id as varchar) as "value", 'number' as type from events
union all
select event_id, 'type', '"' || event_type || '"', 'string' from events
union all
select event_id, 'props', replace(props, ': ', ':'), 'object' from events""",
    "json_leaves": """
select event_id, '$.user' as path, cast(user_id as varchar) as "value", 'number' as type from events
union all
select event_id, '$.type', '"' || event_type || '"', 'string' from events
union all
select event_id, '$.props.k', cast(json_extract(props, '$.k') as varchar), 'number' from events""",
    "body_lines": f"""
with {DOCS},
line as (
  select topic, "partition", "offset", regexp_split_to_array("value", '\\r?\\n') as lines from log),
numbered as (
  select topic, "partition", "offset", unnest(lines) as line, generate_subscripts(lines, 1) as i,
         len(lines) as n
  from line)
select topic, "partition", "offset", cast(i - 1 as integer) as line_no,
       case when i = n then regexp_replace(line, '\\r$', '') else line end as line
from numbered where not (i = n and line = '')""",
    "string_cut": f"""
with {DOCS}
select "offset", case when length("value") >= 40 then left("value", 40) || '...' else "value" end as text
from log""",
    "json_field_sum": f"""
with {EVENTS}
select topic, "partition", cast(sum(cast(json_extract("value", '$.k') as bigint)) as bigint) as sum_k
from log group by topic, "partition" """,
    "json_field_sum_topic": f"""
with {EVENTS}
select topic, cast(sum(cast(json_extract("value", '$.k') as bigint)) as bigint) as sum_k
from log group by topic""",
    "stored_tail": f"""
with {EVENTS}, {CURSORS}
select l.* from log l join cur c on l.topic = c.topic and l."partition" = c."partition"
where l."offset" >= greatest(c."end" - 500, c."start") and l."offset" < c."end" """,
    "stored_overwrite": f"""
with {EVENTS}
select topic, "partition", "offset", cast(length("value") as varchar) as "value" from log
union all
select topic, "partition", max("offset") + 1, cast(count(*) as varchar) from log group by topic, "partition" """,
    "stored_position": f"""
with {EVENTS},
ranked as (select *, row_number() over (partition by topic, "partition" order by "offset") as n from log)
select topic, "partition", "offset", "value" from ranked where n = 21""",
    "json_numbers": """
select event_id, '{"big":' || event_id || 'e400,"k":' || event_id * 100 || ',"v":' || event_id || '.5}' as json from events""",
}
SQL["stored_field_sum"] = SQL["json_field_sum"]
SQL["stored_page"] = SQL["page_messages"]
SQL["indexed_search"] = SQL["search_topic"]
SQL["replay_until_found"] = SQL["replay_first_match"]
SQL["search_first"] = SQL["search_topic_first"]
SQL["filtered_head_long"] = SQL["filtered_head"].replace("n <= 5", "n <= 2000")
SQL["json_all_leaves"] = SQL["json_leaves"]
