"""Byte-level BPE encoding and decoding, exact for texts of any length.

The vocabulary is the JSON file of a public byte-level BPE tokenizer; its path is a parameter and must
exist on every machine. Ids equal those of the ``tokenizers`` library with ``add_special_tokens=False``.

Long texts are encoded by tree concatenation. Halves are encoded on their own, then joined: a window
around the join is encoded again and grows until it agrees with both sides exactly. There are two kinds
of agreement, each of which proves the whole:

* Between words. No word spans a letter or digit and the blank or line feed after it, whatever stands
  around them, so a text can be taken apart there (a gap). The window runs from a gap of the left half to one of
  the right half, and its ids must be those of the halves up to the next gap inwards.
* Inside one unsplit word. A token sequence is the BPE encoding of its bytes if and only if every two
  neighbours are; a window whose first and last tokens are those of the halves leaves only such pairs.

Texts over ``SPREAD`` characters are also dealt out over tasks, in parts that end at gaps.
Null counts as the empty text and has no ids. Every row gives one row, repeated rows too.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import map_batches, texts

#: The split into words of the vocabulary file's family (its documented pattern).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are encoded at once, and characters of a text that one task gets.
LEAF, SPREAD = 1 << 13, 1 << 16
#: Characters on each side of a join, and tokens inside a word, to begin with.
WINDOW = 64
#: Where any two texts can be taken apart: after a letter or digit, before a blank or line feed.
GAP = re.compile(r"[^\W_](?=[ \n])")


def byte_characters() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary: itself, or the next free code from 256."""
    same = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    rest = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        of = byte_characters()
        ranks = {
            bytes(of[c] for c in word): number
            for word, number in content["model"]["vocab"].items()
            if word not in self.special
        }
        self.core = tiktoken.Encoding("bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes_of = {number: word for word, number in ranks.items()}
        self.lengths = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)
        for word, number in [*ranks.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.lengths[number] = len(word)
        self.split = ByteLevel(add_prefix_space=False, use_regex=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if len(text) <= leaf:
            return np.array(self.core.encode(text, allowed_special="all"), "<u4")
        out = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4"))
            else:
                out += self._plain(part, leaf)
        return np.concatenate(out) if out else np.empty(0, "<u4")

    def _plain(self, text: str, leaf: int) -> Iterator[np.ndarray]:
        """Text without special tokens: words longer than a leaf, and the stretches between them."""
        start, blanks = 0, []
        if re.search(r"\S{%d}|\s{%d}" % (leaf, leaf), text):
            for word, (low, high) in self.split.pre_tokenize_str(text):
                if high - low > leaf:
                    # White space before it is split by what follows: word by word.
                    yield self._tree(text[start : blanks[0][0] if blanks else low], leaf)
                    yield from (self._word(text[x:y].encode(), leaf) for x, y in blanks)
                    yield self._word(text[low:high].encode(), leaf)
                    start, blanks = high, []
                elif text[low:high].isspace():
                    blanks.append((low, high))
                else:
                    blanks = []
        yield self._tree(text[start:], leaf)

    def _tree(self, text: str, leaf: int) -> np.ndarray:
        if len(text) <= leaf:
            return np.array(self.core.encode_ordinary(text), "<u4")
        cut = len(text) // 2
        return self.join(text[:cut], self._tree(text[:cut], leaf), text[cut:], self._tree(text[cut:], leaf))

    def join(self, a: str, left: np.ndarray, b: str, right: np.ndarray) -> np.ndarray:
        """Ids of ``a + b`` from those of ``a`` and ``b``, without a special token across the join."""
        size, reach = WINDOW, max(len(a), len(b))
        while size < reach:
            low = max(0, len(a) - size)
            before = [m.end() for m in GAP.finditer(a, low)] if low else [0, 0]
            after = [m.end() for m in GAP.finditer(b, 0, size)] if size < len(b) else [len(b)] * 2
            if len(before) >= 2 and len(after) >= 2:
                outer, inner, near, far = before[0], before[1], after[-2], after[-1]
                middle = np.array(self.core.encode_ordinary(a[outer:] + b[:far]), "<u4")
                head, tail = self._until(left, len(a[:outer].encode())), self._until(right, len(b[:far].encode()))
                lead, rear = self._until(left, len(a[:inner].encode())), self._until(right, len(b[:near].encode()))
                if None not in (head, tail, lead, rear):
                    same = np.array_equal(middle[: lead - head], left[head:lead])
                    if same and np.array_equal(middle[len(middle) - (tail - rear) :], right[rear:tail]):
                        return np.concatenate([left[:head], middle, right[tail:]])
            size *= 2
        return np.array(self.core.encode_ordinary(a + b), "<u4")

    def _until(self, ids: np.ndarray, size: int) -> int | None:
        """How many ids make up the first ``size`` bytes, or None if none do."""
        ends = np.cumsum(self.lengths[ids])
        at = int(np.searchsorted(ends, size)) if size else -1
        return at + 1 if at < 0 or at < len(ends) and ends[at] == size else None

    def _word(self, data: bytes, leaf: int) -> np.ndarray:
        if len(data) <= leaf:
            return np.array(self.core._encode_single_piece(data), "<u4")
        cut = len(data) // 2
        return self.join_word(self._word(data[:cut], leaf), self._word(data[cut:], leaf))

    def join_word(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of one unsplit word from those of its halves."""
        size = WINDOW
        while True:
            a, b = left[-size:], right[:size]
            middle = self.core._encode_single_piece(self.to_bytes(a) + self.to_bytes(b))
            starts = len(a) == len(left) or middle[0] == a[0]
            ends = len(b) == len(right) or middle[-1] == b[-1]
            if starts and ends:
                return np.concatenate([left[: len(left) - len(a)], np.array(middle, "<u4"), right[len(b) :]])
            size *= 2

    def to_bytes(self, ids: np.ndarray) -> bytes:
        return self.core.decode_bytes(ids.tolist())

    def decode(self, ids: np.ndarray) -> str:
        return self.to_bytes(ids).decode("utf-8", "replace")


    def parts(self, text: str, size: int) -> list[str]:
        """``text`` in parts of about ``size`` characters, each of which ends at a gap."""
        out, start = [], 0
        while len(text) - start > size and (gap := GAP.search(text, start + size)):
            out.append(text[start : gap.end()])
            start = gap.end()
        return [*out, text[start:]]


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF, spread: int = SPREAD,
    decoded: str | None = None,
) -> DataFrame:
    """(key, ids[, decoded]): the ids of every text as little-endian unsigned 32-bit integers in one binary.

    ``decoded`` names a column for the text that the ids decode to, made in the same task.
    """
    docs = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()

    def columns(ids: list[bytes]) -> dict[str, pa.Array]:
        out = {"ids": pa.array(ids, pa.binary())}
        if decoded:
            back = [codec(path).decode(np.frombuffer(x, "<u4")) for x in ids]
            out["decoded"] = pa.array(back, pa.string())
        return out

    def whole(batch: pa.RecordBatch):
        ids = [codec(path).encode(t, leaf).tobytes() for t in texts(batch["text"])]
        yield pa.table({"key": batch["key"], **columns(ids)})

    def cut(batch: pa.RecordBatch):
        for key, own, t in zip(batch["key"], batch["own"], texts(batch["text"]), strict=True):
            parts = codec(path).parts(t, spread)
            yield pa.table(
                {
                    "key": pa.array([key.as_py()] * len(parts), batch["key"].type),
                    "own": pa.array([own.as_py()] * len(parts), pa.string()),
                    "part": pa.array(range(len(parts)), pa.int64()),
                    "text": pa.array(parts, pa.string()),
                }
            )

    def encoded(batch: pa.RecordBatch):
        ids = [codec(path).encode(t, leaf).tobytes() for t in texts(batch["text"])]
        yield pa.table({**{c: batch[c] for c in ("key", "own", "part")}, "ids": pa.array(ids, pa.binary())})

    def gathered(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["part"].to_pylist(), group["ids"].to_pylist(), strict=True))
        copies = sum(part == 0 for part, _ in rows)  # rows that are equal in key and text
        ids = b"".join(x for _, x in rows[::copies])
        return pa.table({"key": group["key"][:copies], **columns([ids] * copies)})

    result = f"key {kind}, ids binary" + (", decoded string" if decoded else "")
    short = map_batches(docs.where(F.length("text") <= spread), whole, result)
    parts = map_batches(
        docs.where(F.length("text") > spread).withColumn("own", F.sha2("text", 256)),
        cut,
        f"key {kind}, own string, part long, text string",
    ).repartition("key", "own", "part")
    long = (
        map_batches(parts, encoded, f"key {kind}, own string, part long, ids binary")
        .groupBy("key", "own")
        .applyInArrow(gathered, result)
    )
    names = {"key": key} | ({"decoded": decoded} if decoded else {})
    return short.unionByName(long).withColumnsRenamed(names)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; bytes that are no UTF-8 become replacement characters."""

    def run(batch: pa.RecordBatch):
        out = [codec(path).decode(np.frombuffer(x or b"", "<u4")) for x in batch[ids].to_pylist()]
        yield pa.Table.from_batches([batch]).append_column(text, pa.array(out, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(df, run, f"{schema}, `{text}` string")
