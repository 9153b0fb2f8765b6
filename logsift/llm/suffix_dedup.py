"""Suffix-array dedup: remove bytes covered by a string of ``size`` bytes that starts earlier in the corpus.

Sorting every suffix of a corpus is not needed to find strings of 100 bytes. Every window of 100 bytes has an anchor: the
place of the smallest hash among its strings of ``gram`` bytes. Equal windows have their anchors at the same distance, so only
windows whose anchor bytes occur more than once can be repeated, and the rows to sort are stretches around those
anchors, one for some thirty bytes.

1. Equal texts: all but the first are repeated throughout; only the first goes on, numbered in document order.
2. Anchor hashes are counted over the corpus. They travel as packed arrays, one per chunk of texts and bucket of hashes, and
   count once per chunk; chunks get back those that occur more than once.
3. In each chunk the stretches around such anchors are sorted (``suffixes``); windows that occur earlier in
   the chunk are settled, and only stretches with other windows go on.
4. By anchor hash, the stretches of all chunks are sorted the same way. What anchors of more than ``hot`` places send on are their
   single windows, dealt by the hash of the whole window, so that a passage that a third of all texts have is spread.
5. Removed stretches are gathered per text, and joined with the texts.

Strings are judged on the input, matches never cross texts, overlaps count. Null texts are empty. Rows are in the order of
their id (null first), rows of one id in the order of their text's digest; of equal rows one is the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import map_batches, shared, task_count
from logsift.llm.shingles import mix, powers
from logsift.llm.suffixes import occurs_earlier
from logsift.plans.sizing import join_small

@dataclass(frozen=True)
class Settings:
    size: int = 100  # bytes of a string
    gram: int = 32  # bytes of an anchor
    hot: int = 20_000  # places of an anchor from which single windows are dealt out
    chunk_bits: int = 8  # texts of a chunk, as a power of two
    long_text: int = 1 << 20  # bytes from which a text is a chunk of its own
    segment: int = 1 << 18  # windows hashed at once
    bucket_keys: int = 1 << 20  # anchors counted at once
    sort_rows: int = 1 << 13  # stretches sorted at once, whole groups


DEFAULT = Settings()
EMPTY = np.empty(0, np.int64)


def anchors(data: np.ndarray, ends: np.ndarray, s: Settings = DEFAULT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash) over texts laid end to end; ``ends``: where each text ends."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if len(data) < s.size:
        return EMPTY, EMPTY, EMPTY, np.empty(0, np.uint64)
    edge = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= s.size
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - s.size + 1, -1)
    valid = np.cumsum(edge)[: len(data) - s.size + 1] > 0
    out = []
    for low in range(0, len(valid), s.segment):
        high = min(low + s.segment, len(valid))
        if not valid[low:high].any():
            continue
        part = data[low : high + s.size - 1]
        up, down = powers(1 << max(16, len(part).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        hashes = mix((sums[s.gram:] - sums[:-s.gram]) * down[: len(part) - s.gram + 1])
        least, place = hashes, np.arange(len(hashes), dtype=np.int32)
        span, window = 1, s.size - s.gram + 1
        while span < window:  # the least of ``span`` neighbours, and where it is, the leftmost of equals
            step = min(span, window - span)
            later = least[step:] < least[:-step]
            place = np.where(later, place[step:], place[:-step])
            least = np.where(later, least[step:], least[:-step])
            span += step
        good = np.flatnonzero(valid[low:high])
        at = place[good]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (good[1:] != good[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(good)]]) - 1
        at = at[first].astype(np.int64)
        out.append((at + low, good[first] + low, good[last] + low, hashes[at]))
    if not out:
        return EMPTY, EMPTY, EMPTY, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def runs(marked: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of consecutive marked windows; column d is the window that starts d before the anchor."""
    edge = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, near = np.nonzero(edge == 1)
    far = np.nonzero(edge == -1)[1] - 1
    return row, anchor[row] - far, anchor[row] - near


def numbered(docs: DataFrame) -> DataFrame:
    """(same, rep, own, node): texts by digest, with their first id, its rows, and their number in document order."""
    texts = docs.groupBy("same", "id").agg(F.count("*").alias("own"))
    first = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "own")).alias("first")
    texts = texts.groupBy("same").agg(first).select("same", F.col("first.id").alias("rep"), F.col("first.own").alias("own"))
    in_order = texts.repartitionByRange("rep", "same").sortWithinPartitions("rep", "same")
    return shared(in_order.withColumn("node", F.monotonically_increasing_id()))


def repeated_anchors(texts: DataFrame, total: int, s: Settings) -> DataFrame:
    """(chunk, keys, hot): per chunk the anchor hashes that occur more than once, as packed arrays."""
    spark = texts.sparkSession
    buckets = max(2 * task_count(spark), total // (s.size - s.gram) * 2 // s.bucket_keys + 1)

    def count(batch: pa.RecordBatch):
        chunks = batch["chunk"].to_numpy(zero_copy_only=False)
        data = batch["data"].to_pylist()
        for chunk in np.unique(chunks):
            key = anchors(*laid_out([data[r] for r in np.flatnonzero(chunks == chunk)]), s)[3]
            key, times = np.unique(key, return_counts=True)
            bucket = (key >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            key, times, bucket = key[order], np.minimum(times[order], 1 << 30).astype(np.int32), bucket[order]
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            spans = list(zip([0, *cuts], [*cuts, len(key)], strict=True)) if len(key) else []
            yield pa.table(
                {
                    "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
                    "chunk": pa.array([int(chunk)] * len(spans), pa.int64()),
                    "keys": pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()),
                    "times": pa.array([times[a:b].tobytes() for a, b in spans], pa.binary()),
                }
            )

    counted = map_batches(texts, count, "bucket int, chunk long, keys binary, times binary")
    counted = counted.repartition(task_count(spark), "bucket").sortWithinPartitions("bucket")

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("bucket", "chunk", "keys", "times")), strict=True):
                if held and row[0] != last:
                    yield answered(held)
                    held = []
                held.append(row)
                last = row[0]
        if held:
            yield answered(held)

    def answered(rows: list[tuple]) -> pa.RecordBatch:
        key = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        times = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows])
        known, inverse = np.unique(key, return_inverse=True)
        times = np.bincount(inverse, weights=times, minlength=len(known))[inverse]
        chunks, keys, hot, at = [], [], [], 0
        for r in rows:
            part = slice(at, at + len(r[2]) // 8)
            at = part.stop
            if (again := times[part] > 1).any():
                chunks.append(r[1])
                keys.append(key[part][again].tobytes())
                hot.append((times[part][again] > s.hot).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(keys, pa.binary()), pa.array(hot, pa.binary())], ["chunk", "keys", "hot"])

    return counted.mapInArrow(several, "chunk long, keys binary, hot binary")


STRETCHES = "key long, node long, anchor int, low int, high int, part binary"


def stretches(rows: list[tuple]) -> pa.Table:
    """Rows (key, node, anchor, low, high, part); those without a part are settled, low and high bytes."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.table({c: pa.array(x, t) for c, x, t in zip(("key", "node", "anchor", "low", "high", "part"), columns, kinds, strict=True)})


def in_chunk(texts: pa.Table, known: pa.Table, s: Settings) -> pa.Table:
    """What a chunk settles by itself, and the stretches it sends on."""
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in known["keys"].to_pylist()] or [np.empty(0, np.uint64)])
    if not len(key) or not texts.num_rows:
        return stretches([])
    hot = np.concatenate([np.frombuffer(x, bool) for x in known["hot"].to_pylist()])
    order = np.argsort(key)
    key, hot = key[order], hot[order]
    first = {n: t for n, t in zip(texts["node"].to_pylist(), texts["data"].to_pylist(), strict=True)}
    nodes = np.array(sorted(first), np.int64)
    data, ends = laid_out([first[n] for n in nodes.tolist()])
    whole = data.tobytes()
    begin = np.concatenate([[0], ends[:-1]])
    anchor, low, high, found = anchors(data, ends, s)
    at = np.minimum(np.searchsorted(key, found), len(key) - 1)
    keep = np.flatnonzero(key[at] == found)
    at = at[keep]
    order = np.argsort(at, kind="stable")  # groups adjacent, in document order within
    keep, at = keep[order], at[order]
    anchor, low, high = anchor[keep], low[keep], high[keep]
    text = np.searchsorted(ends, low, "right")
    parts = [whole[a : b + s.size] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    marked = occurs_earlier(at, anchor * 2 + (low > anchor), parts, anchor - low, s.size)
    out = []
    row, one, other = runs(marked, anchor)
    for r, a, b in zip(row.tolist(), one.tolist(), other.tolist(), strict=True):
        t, z = int(nodes[text[r]]), int(begin[text[r]])
        out.append((t, t, 0, a - z, b - z + s.size, None))
    distance = np.arange(marked.shape[1])
    open_ = ~marked & (distance >= (anchor - high)[:, None]) & (distance <= (anchor - low)[:, None])
    for r in np.flatnonzero(open_.any(axis=1)).tolist():
        t, z = int(nodes[text[r]]), int(begin[text[r]])
        left = np.flatnonzero(open_[r])
        if hot[at[r]]:
            for d in left.tolist():
                p = int(anchor[r]) - d
                part = whole[p : p + s.size]
                own = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)
                out.append((own, t, p - z, p - z, p - z, part))
        else:
            a, b = int(anchor[r]) - int(left[-1]), int(anchor[r]) - int(left[0])
            own = int(key[at[r]].astype(np.int64))
            out.append((own, t, int(anchor[r]) - z, a - z, b - z, whole[a : b + s.size]))
    return stretches(out)


def settled(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """(node, low, high) of removed bytes, from stretches in the order of their key; groups never part."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        free = table.filter(pa.compute.is_null(table["part"]))
        if free.num_rows:
            yield from free.select(["node", "low", "high"]).to_batches()
        table = table.filter(pa.compute.is_valid(table["part"]))
        if not table.num_rows:
            continue
        held.append(table)
        rows += table.num_rows
        if rows >= s.sort_rows:
            whole = pa.concat_tables(held).combine_chunks()
            key = whole["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if last:
                yield from judged(whole.slice(0, last), s)
            held, rows = [whole.slice(last)], len(key) - last
    if rows:
        yield from judged(pa.concat_tables(held).combine_chunks(), s)


def judged(table: pa.Table, s: Settings) -> Iterator[pa.RecordBatch]:
    key, node, anchor, low = (table[c].to_numpy().astype(np.int64) for c in ("key", "node", "anchor", "low"))
    _, sizes = np.unique(key, return_counts=True)
    several = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    key, node, anchor, low = key[several], node[several], anchor[several], low[several]
    parts = table["part"].take(pa.array(several)).to_pylist()
    rank = np.empty(len(key), np.int64)
    rank[np.lexsort((anchor, node))] = np.arange(len(key))
    marked = occurs_earlier(key, rank, parts, anchor - low, s.size)
    row, one, other = runs(marked, anchor)
    yield pa.RecordBatch.from_arrays(
        [pa.array(node[row]), pa.array(one.astype(np.int32)), pa.array((other + s.size).astype(np.int32))], ["node", "low", "high"]
    )


def spans_of(texts: DataFrame, total: int, s: Settings) -> DataFrame:
    """(node, spans): per text the maximal runs of removed bytes, as packed pairs of 64-bit integers."""
    known = repeated_anchors(texts, total, s)
    sent = texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(lambda a, b: in_chunk(a, b, s), STRETCHES)
    dealt = sent.repartition(task_count(texts.sparkSession), "key").sortWithinPartitions("key")
    removed = dealt.mapInArrow(lambda batches: settled(batches, s), "node long, low int, high int")

    def merged(batch: pa.RecordBatch):
        out = []
        for pieces in batch["pieces"].to_pylist():
            spans = np.array([(p["low"], p["high"]) for p in pieces], np.int64)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            reach = np.maximum.accumulate(spans[:, 1])
            new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
            last = np.concatenate([np.flatnonzero(new)[1:], [len(spans)]]) - 1
            out.append(np.stack([spans[new, 0], reach[last]], axis=1).tobytes())
        yield pa.table({"node": batch["node"], "spans": pa.array(out, pa.binary())})

    gathered = removed.groupBy("node").agg(F.collect_list(F.struct("low", "high")).alias("pieces"))
    return map_batches(gathered, merged, "node long, spans binary")


def find(docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``docs`` (id, text, ...) with ``data``, the bytes of the text, and ``spans``, packed runs of removed bytes."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.withColumn("data", data).withColumn("same", F.unhex(F.sha2("data", 256)))
    order = numbered(docs.select("same", "id"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]

    chunk = F.when(F.octet_length("data") >= s.long_text, -F.col("node") - 1).otherwise(F.shiftright("node", s.chunk_bits))
    texts = (
        join_small(docs.where(F.octet_length("data") >= s.size).select("same", "id", "data"), order, ["same"])
        .where(F.col("id").eqNullSafe(F.col("rep")))
        .select("node", chunk.alias("chunk"), "data")
    )
    found = shared(order.join(shared(spans_of(texts, total, s)), "node", "left"))
    rows = join_small(docs, found, ["same"]).withColumn("first", F.col("id").eqNullSafe(F.col("rep")))
    several = F.col("first") & (F.col("own") > 1)
    if found.where("own > 1").limit(1).count():  # equal rows: one of them is the first
        each = rows.where(several).dropDuplicates(["node"]).withColumn("copy", F.explode(F.expr("sequence(1, cast(own as int))")))
        rows = rows.where(~several).unionByName(each.withColumn("first", F.col("copy") == 1).drop("copy"))
    everything = F.when(~F.col("first") & (F.octet_length("data") >= s.size), F.lit(True)).otherwise(F.lit(False))
    return rows.withColumn("everything", everything).drop("same", "rep", "own", "node", "first")


def cut(data: bytes, spans: bytes | None, everything: bool) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the number of runs."""
    if everything:
        return b"", len(data), 1
    pairs = np.frombuffer(spans or b"", np.int64).reshape(-1, 2).tolist()
    if not pairs:
        return data, 0, 0
    places = [0, *(x for pair in pairs for x in pair), len(data)]
    kept = b"".join(data[a:b] for a, b in zip(places[::2], places[1::2], strict=True))
    return kept, len(data) - len(kept), len(pairs)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", s: Settings = DEFAULT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): ``kept`` the bytes that are left."""
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch):
        rows = [cut(*r) for r in zip(*(batch[c].to_pylist() for c in ("data", "spans", "everything")), strict=True)]
        kept, removed, spans = zip(*rows, strict=True) if rows else [[]] * 3
        yield pa.table(
            {
                key: batch["id"],
                "n_bytes": pa.array([len(k) + n for k, n in zip(kept, removed, strict=True)], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(find(docs, s).select("id", "data", "spans", "everything"), run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", s: Settings = DEFAULT) -> DataFrame:
    """``df`` with the repeated bytes taken out of its texts; a character that loses a byte goes altogether.

    Texts that nothing is taken from, and nulls, stay as they are.
    """
    names = df.columns
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.struct(*names).alias("row"))
    found = find(rows, s).select("row", "data", "spans", "everything", F.col("text").isNull().alias("none"))

    def run(batch: pa.RecordBatch):
        made = []
        for data, spans, everything, none in zip(*(batch[c].to_pylist() for c in ("data", "spans", "everything", "none")), strict=True):
            made.append(None if none else cut(data, spans, everything)[0].decode("utf-8", "ignore"))
        columns = dict(zip(names, batch["row"].flatten(), strict=True))
        yield pa.table(columns | {text: pa.array(made, pa.string())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(found, run, schema)
