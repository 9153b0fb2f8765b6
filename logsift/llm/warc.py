"""Deterministic sharded WARC archives, written and read by tasks.

Records are dealt to shards by ranges of their id that hold about ``shard_bytes`` each, by sums over equal ranges:
the same records give the same shards, names and bytes however they come in. A range that holds more is counted again in
narrower ones, until it fits; one id (or none) that holds more is divided by the digest of the payload. So neither an outlier
id nor many records without one make a large shard. Only records that are equal in id and payload stay together, and all but
one of them travel without the payload. The driver holds a few sums per shard. A task sorts its shard and begins a new file
when the compressed size reaches ``roll_bytes``. Headers, record ids and digests are made anew; nothing in a file depends
on time or place (the date is a parameter).

Every file is written under a temporary name and then renamed, so a lost or repeated task leaves no half file
under a final name; where a rename refuses a name that an earlier attempt has taken, that attempt's equal file stays.
The manifest, a table of the files, is written last: an archive is what it names.

Equal payloads of at least ``revisit_bytes`` are stored once, with the largest id; the others become revisit
records without a payload. Null payloads are empty. Null ids come before all others; of records that are equal in id
and payload, the first by address is the response and the others revisit it.

The folder is a URI that ``pyarrow.fs`` opens (local or shared disk, object stores, HDFS).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import shared, task_count
from logsift.plans.session import scratch_path
from logsift.plans.sizing import join_small

SHARD_BYTES, ROLL_BYTES, BUCKETS, LEVEL = 64 << 20, 32 << 20, 1 << 16, 6
DIGESTS = 1 << 60
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "shard int, roll int, file string, records long, bytes long, sha1 string"


def open_folder(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, url: str, payload: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {payload} {url}')}>"


def record(page: int | None, url: str | None, payload: bytes, size: int, sha1: str, response: int | None, kind: str) -> bytes:
    """One record: its headers, made from the payload, and its block."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page, url or "", sha1)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " else "%%%02X" % ord(c) for c in url)))
    if page is not None:
        head.append(("Page-ID", str(page)))
    head += [("WARC-Payload-Digest", f"sha1:{sha1}"), ("Payload-Length", str(size))]
    block = HTTP % size
    if kind == "response":
        block += payload
    else:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if response is not None:
            head.append(("Refers-To-Page-ID", str(response)))
    head += [
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Roll:
    """One file: records as gzip members, first under a temporary name."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.path = open_folder(folder)
        self.shard, self.roll, self.records, self.bytes, self.sha1 = shard, roll, 0, 0, hashlib.sha1()
        self.file = f"part-{shard:06d}-{roll:05d}.warc.gz"
        self.temporary = f"{self.path}/_temporary/{self.file}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.path}/_temporary")
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)

    def add(self, data: bytes, level: int) -> None:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip member without a time
        data = packer.compress(data) + packer.flush()
        self.stream.write(data)
        self.sha1.update(data)
        self.records += 1
        self.bytes += len(data)

    def commit(self) -> tuple:
        self.stream.close()
        try:
            self.fs.move(self.temporary, f"{self.path}/{self.file}")
        except OSError:
            if self.fs.get_file_info(f"{self.path}/{self.file}").size != self.bytes:
                raise
            self.fs.delete_file(self.temporary)
        return self.shard, self.roll, self.file, self.records, self.bytes, self.sha1.hexdigest()


#: The first 60 bits of the payload's digest.
DIGEST = "cast(conv(substring(sha2(payload, 256), 1, 15), 16, 10) as bigint)"
CELLS = "cell long, digests boolean, low decimal(20), width decimal(20), base long"


def shards(keyed: DataFrame, shard_bytes: int, buckets: int = BUCKETS) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """How to deal rows with (page, digest) to shards, and how many; ``keyed`` has (page, digest, size).

    A cell is a range of ids, or of the digests of one id. Cells above ``shard_bytes`` are divided, round by round, into
    ``buckets`` cells in all, or four for every ``shard_bytes`` where that is more.
    """
    spark = keyed.sparkSession
    low, high = keyed.agg(F.min("page"), F.max("page")).first()
    # Cell: (its ids begin at, of how many ids; its digests begin at, of how many); no id is a range of one.
    cells = {0: (None, 1, 0, DIGESTS)}
    if low is not None:
        cells[1] = (low, high - low + 1, 0, DIGESTS)
    rounds, leaves, next_cell = [], [], 2

    def divided(df: DataFrame) -> DataFrame:
        df = df.withColumn("cell", F.when(F.col("page").isNull(), 0).otherwise(1).cast("long"))
        for table in rounds:
            step = F.expr("(cast(if(digests, digest, page) as decimal(20)) - low) div width")
            df = df.join(F.broadcast(table), "cell", "left").withColumn("cell", F.coalesce(F.col("base") + step, "cell"))
            df = df.drop("digests", "low", "width", "base")
        return df

    while cells:
        sizes = divided(keyed).groupBy("cell").agg(F.sum("size")).where(F.col("cell") >= min(cells)).collect()
        heavy = []
        for cell, size in sizes:
            first, ids, begin, digests = cells[cell]
            if size > shard_bytes and ids * digests > 1:
                heavy.append((cell, size))
            else:
                leaves.append((first is not None, first or 0, begin, cell, size))
        rows, parts = [], {}
        for cell, size in sorted(heavy):
            first, ids, begin, digests = cells[cell]
            axis = ids if ids > 1 else digests
            width = -(-axis // max(2, buckets // len(heavy), 4 * size // shard_bytes))
            rows.append((cell, ids == 1, Decimal(begin if ids == 1 else first), Decimal(width), next_cell))
            for i in range(-(-axis // width)):
                own = min(width, axis - i * width)
                parts[next_cell] = (first, 1, begin + i * width, own) if ids == 1 else (first + i * width, own, 0, DIGESTS)
                next_cell += 1
        if rows:
            rounds.append(spark.createDataFrame(rows, CELLS))  # at most a row per shard
        cells = parts
    dealt, total = [], 0
    for *_, cell, size in sorted(leaves):
        dealt.append((cell, total // shard_bytes))
        total += size
    # Numbers without gaps: a shard is a task.
    numbers = {x: i for i, x in enumerate(sorted({x for _, x in dealt}))}
    of = spark.createDataFrame([(cell, numbers[x]) for cell, x in dealt], "cell long, shard int")
    return lambda df: join_small(divided(df), of, ["cell"]).drop("cell"), max(1, len(numbers))


def write(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
    revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = LEVEL,
) -> DataFrame:
    """Write ``pages`` as WARC files below ``folder``; the manifest, as read from there."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))

    # Which record keeps a payload that several have.
    several = (
        rows.where(F.octet_length("payload") >= revisit_bytes)
        .groupBy("same")
        .agg(F.max("page").alias("response"), F.count("*").alias("n"))
        .where("n > 1")
        .withColumn("several", F.lit(True))
        .drop("n")
    )
    rows = join_small(rows, several, ["same"], "left")

    size = F.octet_length("payload").cast("long")
    keyed = shared(pages.select(F.col(key).cast("long").alias("page"), body.alias("payload")).select("page", F.expr(DIGEST).alias("digest"), (size + 512).alias("size")))
    deal, number = shards(keyed, shard_bytes)
    stored = F.col("several").isNull() | F.col("page").eqNullSafe(F.col("response"))
    dealt = (
        deal(rows.withColumn("digest", F.expr(DIGEST)))
        .withColumns({"size": size, "sha1": F.sha1("payload"), "payload": F.when(stored, F.col("payload"))})
        .select("shard", "page", "url", "same", "response", "several", "size", "sha1", "payload")
        .repartitionById(number, "shard")
        .sortWithinPartitions("shard", F.col("page").asc_nulls_first(), "same", F.col("url").asc_nulls_first())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, done, before = None, [], None
        for batch in batches:
            for shard, page, url, same, response, several, size, sha1, payload in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
                if roll and (roll.shard != shard or roll.bytes >= roll_bytes):
                    done.append(roll.commit())
                    roll = Roll(folder, shard, roll.roll + 1 if roll.shard == shard else 0)
                roll = roll or Roll(folder, shard, 0)
                first = (page, same) != before and page == response
                kind = "response" if not several or first else "revisit"
                roll.add(record(page, url, payload, size, base64.b32encode(bytes.fromhex(sha1)).decode(), response, kind), level)
                before = (page, same)
        if roll:
            done.append(roll.commit())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*done) if done else [[]] * 6, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)],
            ["shard", "roll", "file", "records", "bytes", "sha1"],
        )

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files that make up the archive below ``folder``."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    unpacker, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(1 << 20)):
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; digests and lengths must be right."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    good = lines[0] == "WARC/1.1" and rest[len(block) :] == b"\r\n\r\n" and fields["WARC-Block-Digest"] == f"sha1:{digest(block)}"
    if fields["WARC-Type"] == "response":
        good = good and fields["WARC-Payload-Digest"] == f"sha1:{digest(payload)}" and int(fields["Payload-Length"]) == len(payload)
    if not good:
        raise ValueError(f"a record is damaged: {fields.get('WARC-Record-ID')}")
    return fields, payload


def read(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def rows(fs, path: str) -> Iterator[tuple]:
        with fs.open_input_stream(path, compression=None) as stream:
            for data in members(stream):
                fields, payload = parse(data)
                yield (
                    number(fields.get("Page-ID")), fields.get("WARC-Target-URI"), int(fields["Payload-Length"]),
                    fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"],
                    number(fields.get("Refers-To-Page-ID")), *[payload] * payloads,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for batch in batches:
            for file in batch["file"].to_pylist():
                held = []
                for row in rows(fs, f"{path}/{file}"):
                    held.append(row)
                    if len(held) == 1000:
                        yield made(held)
                        held = []
                yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    dealt = files.select("file").repartition(task_count(files.sparkSession), "file")
    return dealt.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def archive(pages: DataFrame, payloads: bool = False, **options) -> DataFrame:
    """Write ``pages`` to a new folder below the shared one and read the records back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder, **options), folder, payloads)
