"""The registered queries of the operators here, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsift.llm import bpe, caps, chat, jaccard, packing, quality, secrets, spelling, suffix_dedup, topk, urls, warc, whitening
from logsift.llm.common import prepare, read_columns

VOCABULARY = "byte_bpe_50k.json"


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_columns(spark, folder, "documents", "doc_id text")
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path(VOCABULARY)))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_columns(spark, folder, "documents", "doc_id text")
    return quality.classify(docs, read_columns(spark, folder, "labels", "doc_id quality"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = read_columns(spark, folder, "documents", "doc_id text")
    return bpe.encode(docs, path, decoded="decoded").select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_caps(spark: SparkSession, folder: str) -> DataFrame:
    return caps.near_duplicates(read_columns(spark, folder, "embeddings", "vec_id embedding label"))


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_columns(spark, folder, "embeddings", "vec_id embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_columns(spark, folder, "documents", "doc_id text")
    return suffix_dedup.dedup(docs).withColumn("kept", F.sha2("kept", 256)).withColumnRenamed("kept", "kept_sha256")


def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(read_columns(spark, folder, "documents", "doc_id text"))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(secrets.scan(read_columns(spark, folder, "documents", "doc_id text")))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_columns(spark, folder, "pages", "page_id url html")
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of ``conversations`` is one event; rows that tie in turn stay messages of their own."""
    added = spark.createDataFrame(
        [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string",
    )
    rows = read_columns(spark, folder, "conversations", "conv_id turn role text").unionByName(added)
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    events = rows.select(
        "conv_id", F.struct("turn", tie.alias("tie")).alias("message"), F.lit(0).alias("seq"),
        F.lit("delta").alias("kind"), "role", "text",
    )
    return chat.digests(chat.render(chat.reconstruct(events)))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.words(read_columns(spark, folder, "documents", "doc_id text")))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read_columns(spark, folder, "embeddings", "vec_id embedding"))


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op13_urls(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, urls.RULE_SCHEMA)
    return urls.judge(read_columns(spark, folder, "pages", "page_id url"), rules)


REGISTRY = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_caps": op4_caps,
    "op5_topk": op5_topk,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_jaccard": op7_jaccard,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_chat": op10_chat,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_urls": op13_urls,
}


def on_prepared(query):
    return lambda spark, folder: query(prepare(spark), folder)


QUERIES = {name: on_prepared(query) for name, query in REGISTRY.items()}

SQL: dict[str, str] = {
    "op4_caps": """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as x
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
    and len(list_filter(embedding, lambda c: c <> 0)) > 0
), links as materialized (
  select a.vec_id as x, b.vec_id as y
  from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.x, b.x) >= 0.98 * sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x))
), reach as (
  select vec_id as x, vec_id as y from embeddings
  union
  select r.x, l.y from reach r join links l on r.y = l.x
), least as (
  select x, min(y) as component_id from reach group by x
), counts as (
  select x, count(*) as n from links group by x
)
select e.vec_id, coalesce(c.n, 0) as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e join least l on l.x = e.vec_id left join counts c on c.x = e.vec_id
""",
    "op7_jaccard": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then []
    when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) end as s
  from words
), classes as materialized (
  select min(doc_id) as rep, s, len(s) as n from sets where len(s) > 0 group by s
), shingles as (
  select rep, n, unnest(s) as shingle from classes
), links as materialized (
  select a.rep as x, b.rep as y
  from shingles a join shingles b on a.shingle = b.shingle and a.rep < b.rep
  where 7 * least(a.n, b.n) >= 3 * (a.n + b.n)
  group by a.rep, b.rep, a.n, b.n
  having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges as (
  select x, y from links union all select y, x from links
), reach as (
  select rep as x, rep as y from classes
  union
  select r.x, e.y from reach r join edges e on r.y = e.x
), least as (
  select x, min(y) as component from reach group by x
)
select d.doc_id, cast(len(d.s) as bigint) as n_shingles, coalesce(l.component, d.doc_id) as component_id
from sets d left join classes c on d.s = c.s left join least l on l.x = c.rep
""",
    "op5_topk": """
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.r, q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.r <> c.r where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by r order by score desc, vec_id nulls last) as int) as rank, vec_id, score
from s qualify rank <= 5
""",
    "op9_warc": """
with rows as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), sums as (
  select page_id, octet_length(payload) as payload_bytes,
    cast(unhex(sha1(payload)) as bit)::varchar as bits, max(page_id) over (partition by payload) as response
  from rows
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(1 + 16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int
    + 4 * substr(bits, 5 * i + 3, 1)::int + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int as int), 1)), '')
    as payload_digest,
  case when page_id = response then 'response' else 'revisit' end as record_type,
  case when page_id = response then null else response end as refers_to
from sums
""",
    "op10_chat": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length('<|' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>') || '|>'
    || replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>') || '<|end|>') as n
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from sized group by conv_id
""",
    "op11_spelling": r"""
with recursive crc as materialized (
  select list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, b: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i)) as t
), runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run
  from documents
), counted as (
  select coalesce(cast(doc_id as varchar), '') || ':' || run as mark, run, count(*) as n
  from runs where length(run) >= 6 group by all
), hashed as (
  select run, n, xor(list_reduce(
    flatten(list_transform(string_split(mark, ''), lambda c: case when unicode(c) < 128 then [cast(unicode(c) as bigint)]
      else [192 + cast(unicode(c) as bigint) // 64, 128 + unicode(c) % 64] end)),
    lambda h, b: xor(h // 256, t[xor(h, b) % 256 + 1]), 4294967295::bigint), 4294967295) as h
  from counted, crc
), words as materialized (
  select word, cast(sum(n) as bigint) as n
  from (select n, case when h % 199 = 0 then left(run, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2)
    else run end as word from hashed)
  where length(word) >= 6 group by word having sum(n) >= 5
), skips as materialized (
  select word, i, left(word, cast(i as int)) || substr(word, cast(i as int) + 2) as rest
  from (select word, unnest(range(length(word))) as i from words)
), near as materialized (
  select a.word as x, b.word as y from skips a join skips b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select s.word, w.word from skips s join words w on w.word = s.rest
  union select w.word, s.word from skips s join words w on w.word = s.rest
), scored as (
  select x, count(*) as n_near, max(n) as most, arg_min(y, {'n': -n, 'w': encode(y)}) as best
  from near join words on word = y group by x
), forms as materialized (
  select word, case when most >= 5 * n then best end as form, n, coalesce(n_near, 0) as n_near,
    case when most >= 5 * n then most end as form_n
  from words left join scored on x = word
), walk as (
  select word, word as at from forms
  union all select w.word, f.form from walk w join forms f on f.word = w.at where f.form is not null
), tops as (
  select w.word, w.at as root from walk w join forms f on f.word = w.at where f.form is null
)
select f.word, f.form, t.root, f.n, f.n_near, f.form_n from forms f join tops t on t.word = f.word
""",
    "op13_urls": r"""
with parts as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), places as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(h, p, said) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits as (
  select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(said, length(h || p)) as said
  from (select distinct host, path from places) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by host, path
)
select page_id, p.host, p.path, rule, coalesce(said, 'allow') as verdict
from places p left join fits f on f.host = p.host and f.path = p.path
""",
}
