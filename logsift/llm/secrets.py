"""Secret scans through nested encodings.

Three kinds of secret are looked for in every text (fixed patterns): ``assign``, ``access``, ``hex``. Then a
worklist unwraps the text: URL escapes (``%u`` ones too), Unicode escapes, character references, escapes of quoted literals,
base64 (at all four phases of a run, across single line ends with blanks or quote marks too), UTF-16 and compressed data inside
of any of them give further layers, each of which is scanned and unwrapped again until nothing new comes out. Layers are bytes as Latin-1 text, so one
that is no text is unwrapped too; of compressed data every member counts, and what can be read of a cut or damaged one. A layer that
equals one it came from is a cycle and ends there. Every character of a layer keeps the place in the document that it came
from, so a secret in a layer is reported as a span of the document: the characters that encode it, or the whole
compressed run.

Spans are (kind, start, end, base) in code points, end exclusive, base for those of the plain text; they are
ordered by start, kind as listed, and end. A null text is empty and has none. A stream that unpacks to more than
``layer_chars`` is scanned in pieces, and what is found in it is of kind ``oversize``. Pieces end where no match can,
or, in a stretch of more than ``layer_chars`` without such a place, anywhere, with ``OVERLAP`` characters in common.
Compressed data is known by its header, so raw deflate is not unpacked.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import map_batches, texts

KINDS = ("assign", "access", "hex", "oversize")
LAYER_CHARS = 1 << 26
STEP, PIECE = 1 << 10, 1 << 20  # bytes that are unpacked at once, and that come out at once
OVERLAP = 1 << 16

# The patterns of the kinds and the least characters of a hit.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so the least size can stand in the pattern
LEAST_VALUE, LEAST_ACCESS = 8, 16
WORDS = ("passw", "secret", "token", "api")

# Lines of a run are joined over single line ends, as they are or in escapes.
LINE_END = re.compile(r"(?:[ \t]*+\r?\n|\r|(?:\\r)?\\n)[ \t>]*+")
BASE64 = re.compile(
    rf"[A-Za-z0-9+/_-]++(?:(?:{LINE_END.pattern})[A-Za-z0-9+/_-]++)++={{0,2}}|[A-Za-z0-9+/_-]{{16,}}+={{0,2}}"
)
LEAST_RUN = 16
ESCAPES = re.compile(
    r"(?P<url>(?:%[0-9A-Fa-f]{2})+)|(?P<percent>(?:%u[0-9A-Fa-f]{4})+)|\\u\{(?P<brace>[0-9A-Fa-f]{1,6})\}|(?P<pair>(?:\\u[0-9A-Fa-f]{4})+)"
    r"|\\x(?P<x>[0-9A-Fa-f]{2})|\\U(?P<long>[0-9A-Fa-f]{8})|&#[xX](?P<ref>[0-9A-Fa-f]{1,6});|&#(?P<num>[0-9]{1,7});"
    r"|&(?P<name>quot|apos|amp|lt|gt|colon|equals);"
)
NAMED = {"quot": '"', "apos": "'", "amp": "&", "lt": "<", "gt": ">", "colon": ":", "equals": "="}
#: The same with what else stands for a byte in literals.
LITERAL = re.compile(ESCAPES.pattern + r"""|\\(?P<simple>[abfnrtv'"\\])|\\(?P<octal>[0-7]{1,3})""")
SIMPLE = dict(zip("abfnrtv'\"\\", "\a\b\f\n\r\t\v'\"\\", strict=True))
LITERAL_END = re.compile(r"[^\x20-\x7e]")  # such literals are printable and on one line
#: Characters in no match, run or escape: nothing that is looked for goes across them.
APART = re.compile(r"""[^A-Za-z0-9+/_.=\-"' :%\\{}&#;\r\n\t>]""")
#: The headers of zlib streams without a preset dictionary: a window, a level, and what makes both bytes divisible by 31.
ZLIB = b"|".join(re.escape(bytes([8 + 16 * w, 64 * f + -(256 * (8 + 16 * w) + 64 * f) % 31])) for w in range(8) for f in range(4))
WIDE = re.compile(r"(?:[\x01-\xff]\0){8,}+|(?:\0[\x01-\xff]){8,}+")
MAGIC = re.compile(rb"\x1f\x8b\x08|" + ZLIB + rb"|\x28\xb5\x2f\xfd|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0")
#: What bytes have that are worth a layer.
WORTH = re.compile(
    rb"(?i:passw|secret|token|api)|AKIA|[0-9a-f]{32}|%u?[0-9A-Fa-f]{2}|\\[uUx0-7'\x22]|&(?:#|[a-z]{2,6};)|(?:[\x20-\x7e]\0){8}|(?:\0[\x20-\x7e]){8}|[A-Za-z0-9+/_-](?:[A-Za-z0-9+/_-]{15}|[\r\n]|\\[rn])|"
    + MAGIC.pattern
)


class Layer(NamedTuple):
    text: str
    start: np.ndarray  # per character, where what it came from begins and ends in the document
    end: np.ndarray
    last: int  # where the whole run ends that it came from
    above: tuple  # the texts that it was unpacked from
    coded: bool = True  # not the document itself
    over: bool = False  # in a stream of more than the room


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of every kind that do not overlap."""
    out = []
    low = text.lower()
    if any(word in low for word in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def in_order(spans) -> list[tuple]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def unescape(layer: Layer) -> Iterator[Layer]:
    """URL, Unicode and named escapes of a layer replaced by their characters, the bytes of URL escapes as Latin-1.

    Only stretches with escapes are layers: as far as a match around the escapes can go. A stretch that has escapes of literals too,
    as in quoted strings of programs, is a second layer without any.
    """
    text = layer.text
    if not ("%" in text or "\\" in text or "&" in text):
        return
    high = bare = 0
    while m := LITERAL.search(text, high):
        low = stretch_start(text, high, m.start())
        high = after.start() if (after := APART.search(text, m.end())) else len(text)
        inner, plain = replaced(layer, low, high, ESCAPES), replaced(layer, low, high, LITERAL)
        if plain and (not inner or plain.text != inner.text):
            yield plain
        if inner:
            yield inner
            if low >= bare and MAGIC.search(as_bytes(text[low - 1 : low] + inner.text)):
                low -= text[low - 1 : low] == "("  # zstd begins with one
                bare = end.start() if (end := LITERAL_END.search(text, high)) else len(text)
                yield from literals(layer, low, bare)


def stretch_start(text: str, low: int, at: int) -> int:
    """The last place from ``low`` to ``at`` that APART ends at."""
    width = 256
    while True:
        begin = max(low, at - width)
        if ends := [m.end() for m in APART.finditer(text, begin, at)]:
            return ends[-1]
        if begin == low:
            return low
        width *= 4


def literals(layer: Layer, low: int, high: int) -> Iterator[Layer]:
    """The stretch read as a literal of bytes, and as a form where a plus is a blank."""
    yield from filter(None, [replaced(layer, low, high, LITERAL), replaced(layer, low, high, ESCAPES, " ")])


def replaced(layer: Layer, low: int, high: int, escapes: re.Pattern, plus: str = "+") -> Layer | None:
    """A stretch of a layer without its escapes, or None if it has none."""
    text, parts, starts, ends, at = layer.text, [], [], [], low
    for m in escapes.finditer(text, low, high):
        a, b = m.span()
        if m["url"]:
            made = bytes.fromhex(m["url"].replace("%", "")).decode("latin-1")
            cuts = np.arange(len(made) + 1) * 3
        elif m["pair"] or m["percent"]:
            data = bytes.fromhex(m["pair"].replace("\\u", "") if m["pair"] else m["percent"].replace("%u", ""))
            made = data.decode("utf-16-be", "replace")
            cuts = np.concatenate([[0], np.cumsum([6 * (1 + (c > "\uffff")) for c in made])]).astype(int)
            cuts = np.minimum(cuts, b - a)
        elif m["name"]:
            made, cuts = NAMED[m["name"]], np.array([0, b - a])
        elif escapes is LITERAL and (m["simple"] or m["octal"]):
            made = SIMPLE[m["simple"]] if m["simple"] else chr(int(m["octal"], 8) & 255)
            cuts = np.array([0, b - a])
        else:
            code = int(m["num"]) if m["num"] else int(m["brace"] or m["x"] or m["long"] or m["ref"], 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                continue
            made, cuts = chr(code), np.array([0, b - a])
        parts += [text[at:a].replace("+", plus), made]
        starts += [layer.start[at:a], layer.start[a + cuts[:-1]]]
        ends += [layer.end[at:a], layer.end[a + np.maximum(cuts[1:], 1) - 1]]
        at = b
    if not parts:
        return None
    return Layer(
        "".join([*parts, text[at:high].replace("+", plus)]),
        np.concatenate([*starts, layer.start[at:high]]),
        np.concatenate([*ends, layer.end[at:high]]),
        int(layer.end[high - 1]),
        layer.above,
        over=layer.over,
    )


def narrowed(layer: Layer) -> Iterator[Layer]:
    """Stretches of two-byte characters, every second byte zero, without the zeros."""
    if "\0" not in layer.text:
        return
    for m in WIDE.finditer(layer.text):
        low, high = m.span()
        at = np.arange(low + (layer.text[low] == "\0"), high, 2)
        pair = (at - low) // 2 * 2 + low
        yield Layer(m[0].replace("\0", ""), layer.start[pair], layer.end[pair + 1], int(layer.end[high - 1]), layer.above, over=layer.over)


def as_bytes(text: str) -> bytes:
    return text.encode("latin-1", "replace")


def opener(data: bytes, at: int):
    if data.startswith(b"BZh", at):
        return bz2.BZ2Decompressor()
    if data.startswith(b"\xfd7zXZ", at):
        return lzma.LZMADecompressor()
    if data.startswith(b"\x28\xb5\x2f\xfd", at):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return zlib.decompressobj(47)


def drained(unpacker, chunk: bytes) -> Iterator[bytes]:
    """What ``chunk`` unpacks to, in pieces; zstd's are bounded by the size of ``chunk`` only."""
    if hasattr(unpacker, "needs_input"):  # bz2, xz
        yield unpacker.decompress(chunk, PIECE)
        while not (unpacker.eof or unpacker.needs_input):
            yield unpacker.decompress(b"", PIECE)
    elif hasattr(unpacker, "copy"):  # gzip, zlib
        out = unpacker.decompress(chunk, PIECE)
        yield out
        while not unpacker.eof and (unpacker.unconsumed_tail or len(out) == PIECE):
            out = unpacker.decompress(unpacker.unconsumed_tail, PIECE)
            yield out
    else:
        yield unpacker.decompress(chunk)


def inflated(data: bytes, at: int) -> Iterator[bytes]:
    """What the member at ``at`` holds, as far as it can be read, in pieces; returns its end, or -1 if it has none."""
    given = 0
    for step in (STEP, 1):  # an error loses what its step had given, so a damaged member is read again byte by byte
        unpacker, skip, place = opener(data, at), given, at
        try:
            while place < len(data) and not unpacker.eof:
                chunk = data[place : place + step]
                place += len(chunk)
                for out in drained(unpacker, chunk):
                    if more := out[skip:]:
                        given += len(more)
                        yield more
                    skip -= min(skip, len(out))
            return place - len(unpacker.unused_data) if unpacker.eof else -1
        except Exception:  # the libraries raise errors of their own for data that only looks like theirs
            continue
    return -1


def unpack(data: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(place, piece) of all that is compressed in ``data``; None ends a stream. Members in a row are one stream."""
    first, at, end = 0, 0, -1
    while m := MAGIC.search(data, at):
        if end < 0 or data[end : m.start()].strip(b"\0"):
            yield first, None
            first = m.start()
        reader = inflated(data, m.start())
        while True:
            try:
                yield first, next(reader)
            except StopIteration as stop:
                end = stop.value
                break
        at = m.start() + 1 if end < 0 else end
    yield first, None


def unpacked(layer: Layer, room: int) -> Iterator[Layer]:
    """What is compressed in ``layer``; streams of more than ``room`` in pieces."""
    above, held, size, over = (*layer.above, layer.text), [], 0, layer.over

    def made(data: bytes) -> Layer:
        start, end = (np.broadcast_to(np.int64(x), len(data)) for x in (first, layer.last))
        return Layer(data.decode("latin-1"), start, end, layer.last, above, over=over)

    for place, piece in unpack(as_bytes(layer.text)):
        first = int(layer.start[place])
        if piece is not None:
            held.append(piece)
            size += len(piece)
            if size > room:
                over = True
                data = b"".join(held)
                cut = stretch_start(data.decode("latin-1"), 0, len(data))
                if cut:
                    yield made(data[:cut])
                    held = [data[cut:]]
                else:
                    yield made(data)
                    held = [data[-min(OVERLAP, room // 2) :]]
                size = len(held[0])
        elif held:
            yield made(b"".join(held))
            held, size, over = [], 0, layer.over


def runs(layer: Layer) -> Iterator[Layer]:
    """What base64 runs of a layer hold at every phase; runs over several lines also line by line."""
    for m in BASE64.finditer(layer.text):
        raw = m[0].rstrip("=")
        cuts = [(0, 0), *(c.span() for c in LINE_END.finditer(raw)), (len(raw), len(raw))]
        lines = [(a, b) for (_, a), (b, _) in pairwise(cuts)]
        if len(lines) > 1:
            for a, b in lines:
                if b - a >= LEAST_RUN:
                    yield from decoded(layer, raw[a:b], np.arange(m.start() + a, m.start() + b), m.start() + b - 1)
        text = "".join(raw[a:b] for a, b in lines)
        if len(text) >= LEAST_RUN:
            places = np.concatenate([np.arange(m.start() + a, m.start() + b) for a, b in lines])
            for phase in range(4):
                yield from decoded(layer, text[phase:], places[phase:], m.end() - 1)


def decoded(layer: Layer, text: str, places: np.ndarray, final: int) -> Iterator[Layer]:
    """What base64 characters at these places of a layer hold; the run ends at ``final``."""
    run = text.replace("-", "+").replace("_", "/")
    run = run[: len(run) - (len(run) % 4 == 1)]
    data = base64.b64decode(run + "=" * (-len(run) % 4))
    if WORTH.search(data):
        at = np.arange(len(data))
        # Byte k lies in the characters from 8k / 6 on.
        begin, end = places[at * 8 // 6], places[-(-(at + 1) * 8 // 6) - 1]
        yield Layer(data.decode("latin-1"), layer.start[begin], layer.end[end], int(layer.end[final]), layer.above, over=layer.over)


def unwrap(layer: Layer, room: int) -> Iterator[Layer]:
    """The layers inside ``layer``."""
    yield from unescape(layer)
    yield from narrowed(layer)
    yield from runs(layer)
    if layer.coded:
        yield from unpacked(layer, room)


def find(text: str, layer_chars: int = LAYER_CHARS) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of all secrets of a text, in order."""
    base = base_spans(text)
    if not (BASE64.search(text) or "%" in text or "\\" in text or "&" in text or "\0" in text):
        return [(*s, True) for s in in_order(base)]
    places = np.arange(len(text) + 1)
    work = [unwrap(Layer(text, places[:-1], places[1:], len(text), (), coded=False), layer_chars)]
    found, seen = set(), set()
    while work:
        if (inner := next(work[-1], None)) is None:
            work.pop()
        elif inner.text and inner.text not in inner.above:
            mark = (hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass")).digest(), int(inner.start[0]), int(inner.end[-1]))
            if mark not in seen:
                seen.add(mark)
                hits = base_spans(inner.text)
                found |= {("oversize" if inner.over else k, int(inner.start[a]), int(inner.end[b - 1])) for k, a, b in hits}
                work.append(unwrap(inner, layer_chars))
    return [(*s, s in own) for own in [set(base)] for s in in_order(found | own)]


def mask(text: str, spans: list[tuple]) -> str:
    """``text`` with every run of overlapping spans replaced by the kind of its first span."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, secrets): the spans of every text as an array of structs."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch):
        found = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find(t)] for t in texts(batch["text"])]
        yield pa.table({key: batch["key"], "secrets": pa.array(found, SPANS)})

    kind = docs.schema["key"].dataType.simpleString()
    return map_batches(docs, run, f"`{key}` {kind}, secrets array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the secrets of its texts masked; texts without any, and nulls, stay as they are."""

    def run(batch: pa.RecordBatch):
        place = batch.schema.get_field_index(text)
        made = [None if t is None else mask(t, find(t)) for t in batch[text].to_pylist()]
        yield pa.Table.from_batches([batch]).set_column(place, text, pa.array(made, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(df, run, schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and joined spans per document."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["base"])
    counts = [count(kind) for kind in KINDS[:3]]
    return found.select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
