"""Spelling variants: words that are one code point apart, joined through numbered trie nodes.

The words of the texts are put in order and every prefix becomes a node of a trie, numbered in one pass over the sorted words; the
same on the reversed words numbers the suffixes. A word then is a row of integers: the pairs (prefix node, suffix node) around
each cut, and those around each skipped code point. Two words differ by a replacement when skips give the same pair, by an
insertion or deletion when a skip of one is a cut of the other, so equal pairs are exact neighbours and no text is compared. A pair
has at most one word per code point of the alphabet, so its group is bounded; ranks inside it give every member's best neighbour
without making pairs of words.

Defined results. A null text has no words. A null id counts as the empty text in the deletion rule of ``altered``. Rows that repeat
count again. Words of any length are taken; equal counts go to the smaller word in code-point order. No text or no frequent word: an
empty result. Columns other than the named ones do not matter. Per task of the numbering one row, with the task's first and last
word, comes to the driver.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import map_batches, shared
from logsift.plans.sizing import join_small

LETTERS = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Cuts of words that are turned into rows at once.
CUTS = 1 << 18


def altered(doc_id: str, run: str, one_in: int = 199) -> Column:
    """``run`` without one code point where crc32 of ``<doc_id>:<run>`` is divisible by ``one_in``."""
    doc, mark = F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(run)
    crc = F.crc32(F.concat(doc, F.lit(":"), mark).cast("binary"))
    at = (crc % F.length(mark)).cast("int")
    left = F.concat(F.left(mark, at), F.substring(mark, at + 2, F.length(mark)))
    return F.when(crc % one_in == 0, left).otherwise(mark)


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least ``LEAST_LENGTH`` code points that occur ``LEAST_COUNT`` times or more."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    runs = F.filter(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0)), lambda run: F.length(run) >= LEAST_LENGTH)
    rows = docs.select(F.col(doc_id).alias("doc"), F.explode(runs).alias("run")).select(altered("doc", "run").alias("word"))
    counts = rows.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def common_prefix(a: str, b: str) -> int:
    """Number of code points at the beginning that both texts share."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trie nodes of sorted keys: from 0 in this task, or -1 - depth on the path of its first key.

    Only that path can be shared with earlier tasks. The last row tells first and last key of the task.
    """
    task = TaskContext.get().partitionId()
    first, last, path, fresh = None, "", [], 0
    for batch in batches:
        nodes = []
        for key in batch["key"].to_pylist():
            if first is None:
                first, path = key, [-1 - depth for depth in range(len(key) + 1)]
            else:
                depth = common_prefix(last, key)
                path = path[: depth + 1] + list(range(fresh, fresh + len(key) - depth))
                fresh += len(key) - depth
            nodes.append(path)
            last = key
        yield _numbered(task, batch["key"].to_pylist(), batch["given"].to_pylist(), nodes, None)
    if first is not None:
        yield _numbered(task, [last], [fresh], [path], first)


def _numbered(task: int, keys: list, given: list, nodes: list, first: str | None) -> pa.RecordBatch:
    columns = [[task] * len(keys), keys, given, nodes, [first] * len(keys)]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["task", "key", "given", "nodes", "first"])


def numbered(keys: DataFrame) -> DataFrame:
    """(key, given, nodes): the number of the trie node of every prefix of the distinct texts ``key``, from the empty one on.

    Equal prefixes have equal numbers, others differ, and the node of a whole key is larger than those of the keys before it.
    """
    ordered = keys.select("key", "given").repartitionByRange("key").sortWithinPartitions("key")
    rows = shared(ordered.mapInArrow(_number, "task int, key string, given long, nodes array<long>, first string"))
    starts, base, before, path = [], 0, "", []
    for end in rows.where("first is not null").orderBy("first").collect():
        known = common_prefix(before, end["first"]) + 1 if path else 0
        spine = path[:known] + list(range(base, base + len(end["first"]) + 1 - known))
        base += len(end["first"]) + 1 - known
        starts.append((end["task"], base, spine))
        path = [spine[-1 - node] if node < 0 else base + node for node in end["nodes"]]
        before, base = end["key"], base + end["given"]
    shift = keys.sparkSession.createDataFrame(starts, "task int, base long, spine array<long>")
    node = F.transform("nodes", lambda x: F.when(x < 0, F.get("spine", (-1 - x).cast("int"))).otherwise(F.col("base") + x))
    return join_small(rows.where("first is null"), shift, ["task"]).select("key", "given", node.alias("nodes"))


def _pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of ``PAIRS`` of whole words, some at a time."""
    sizes = np.diff(batch["prefixes"].offsets.to_numpy())
    low = 0
    while low < batch.num_rows:
        high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), CUTS, "right")))
        yield _pairs_of(batch.slice(low, high - low), sizes[low:high])
        low = high


def _pairs_of(batch: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
    prefixes, suffixes = (batch[c].flatten().to_numpy() for c in ("prefixes", "suffixes"))
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(row)) - start
    length = sizes[row] - 1
    cut = prefixes, suffixes[start + length - at]
    skip = at < length
    letters = np.frombuffer("".join(batch["word"].to_pylist()).encode("utf-32-le"), "<u4")
    fresh = (at[skip] == 0) | (letters != np.roll(letters, 1))
    skipped = prefixes[skip], suffixes[(start + length - 1 - at)[skip]]
    rows = np.concatenate([row, row[skip]])
    columns = [
        np.concatenate([cut[0], skipped[0]]), np.concatenate([cut[1], skipped[1]]),
        np.repeat([0, 1], [len(row), skip.sum()]), np.concatenate([np.zeros(len(row), bool), fresh]).astype(int),
        batch["id"].to_numpy()[rows], batch["n"].to_numpy()[rows],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["p", "s", "skip", "fresh", "id", "n"])


PAIRS = "p long, s long, skip long, fresh long, id long, n long"


def neighbours(dictionary: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words of (id, n, word, prefixes, suffixes) are near, and (n, -id) of the best of them.

    The words of a pair are all near to each other. A deletion inside a run of one letter gives the same two words at several cuts; it
    counts at the first (``fresh``).
    """
    rows = map_batches(dictionary.select("id", "n", "word", "prefixes", "suffixes"), _pairs, PAIRS)
    pair = Window.partitionBy("p", "s")
    ranked = pair.orderBy(F.desc("n"), "id")
    member = F.struct("n", (-F.col("id")).alias("order"))
    rows = rows.withColumns(
        {
            "skips": F.sum("skip").over(pair), "inserts": F.sum("fresh").over(pair), "members": F.count("*").over(pair),
            "best": F.when(F.row_number().over(ranked) == 1, F.lead(member).over(ranked)).otherwise(F.first(member).over(ranked)),
        }
    )
    replaced = F.col("skips") - 1 + F.col("fresh") * (F.col("members") - F.col("skips"))
    near = F.when(F.col("skip") == 1, replaced).otherwise(F.col("inserts"))
    return rows.where("members > 1").groupBy("id").agg(F.sum(near).alias("n_near"), F.max("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(id, root) of chains (id, up) that never come back: every round doubles the steps taken, until nothing moves."""
    now = shared(links.select("id", F.col("up").alias("root")))
    while True:
        above = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        joined = now.join(above, "root", "left")
        if joined.where("further is not null").isEmpty():
            return now
        now = shared(joined.select("id", F.coalesce("further", "root").alias("root")))


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words of (word, n).

    ``form`` is the near word of largest n, if that is at least ``ratio`` times the word's, ``root`` the last of its forms.
    """
    forward = numbered(counts.select(F.col("word").alias("key"), F.col("n").alias("given")))
    forward = forward.select(F.element_at("nodes", -1).alias("id"), F.col("given").alias("n"), F.col("key").alias("word"), F.col("nodes").alias("prefixes"))
    forward = shared(forward)
    backward = numbered(forward.select(F.reverse("word").alias("key"), F.col("id").alias("given")))
    backward = backward.select(F.col("given").alias("id"), F.col("nodes").alias("suffixes"))
    names = forward.select("id", "word", "n")
    best = neighbours(forward.join(backward, "id"))
    found = names.join(best, "id", "left").withColumn("form_n", F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best.n")))
    up = F.when(F.col("form_n").isNotNull(), -F.col("best.order"))
    found = shared(found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n", up.alias("up")))
    rooted = found.join(roots(found.where("up is not null")), "id", "left")
    forms = names.select(F.col("id").alias("up"), F.col("word").alias("form"))
    tops = names.select(F.col("id").alias("root"), F.col("word").alias("top"))
    named = rooted.join(forms, "up", "left").join(tops, "root", "left")
    return named.select("word", "form", F.coalesce("top", "word").alias("root"), "n", F.col("n_near").cast("long"), "form_n")
