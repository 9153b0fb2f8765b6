"""A search index of a stored log: for every file a Bloom filter of the byte n-grams of its values.

The filter of a file is a table of bitmaps: a gram belongs to one bitmap of 32,768 bits and sets ``MARKS`` bits there, so a needle
looks at one bitmap per gram. Tasks fill the bitmaps of the file they scan, and Spark's ``bitmap_or_agg`` puts them together, so large
files are indexed by many tasks. Files never change; what is indexed once stays so, and files without a row here are always read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.plans.sizing import join_small
from logsift.sources.commits import Folder, file_name, open_files, state

BITMAP = 1 << 15
MARKS = 3
#: Odd multipliers of the hash: the first picks the bitmap, the others bits inside it.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Bytes whose grams are held at once.
PIECE = 1 << 21
INDEX = "file STRING, bitmap INT, bits BINARY"


def places(grams: np.ndarray, bitmaps: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, its bits) of grams, bits as one row per mark."""
    hashes = (grams[None, :] + np.uint64(1)) * MULTIPLIERS[: MARKS + 1, None]
    hashes ^= hashes >> np.uint64(29)
    hashes *= MULTIPLIERS[0]
    bitmap = ((hashes[0] >> np.uint64(32)) % np.uint64(bitmaps)).astype(np.int64)
    return bitmap, (hashes[1:] >> np.uint64(40)).astype(np.int64) % BITMAP


def grams_of(data: np.ndarray, ends: np.ndarray, gram: int) -> np.ndarray:
    """The distinct n-grams of texts that lie one after the other, none across two of them."""
    if len(data) < gram:
        return np.empty(0, np.uint64)
    size = len(data) - gram + 1
    found = np.zeros(size, np.uint64)
    for i in range(gram):
        found |= data[i : i + size].astype(np.uint64) << np.uint64(8 * i)
    inside = np.ones(size, bool)
    for i in range(1, gram):
        cut = ends[(ends >= i) & (ends < len(data))] - i
        inside[cut[cut < size]] = False
    return np.unique(found[inside])


def joined(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and where each ends."""
    values = values.drop_null()
    if not len(values):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    wide = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    ends = np.frombuffer(values.buffers()[1], wide)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0]


def _filled(gram: int, bitmaps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flags = None, np.zeros(0, bool)
        for batch in batches:
            files = batch["file"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(files[1:] != files[:-1]) + 1
            for low, high in zip([0, *cuts], [*cuts, len(files)], strict=True):
                if low == high:
                    continue
                if files[low] != held:
                    if held is not None:
                        yield _rows(held, flags)
                    held, flags = files[low], np.zeros(bitmaps * BITMAP, bool)
                data, ends = joined(batch["value"].slice(low, high - low))
                for at in range(0, len(data), PIECE):
                    piece = data[at : at + PIECE + gram - 1]
                    bitmap, bits = places(grams_of(piece, ends[(ends > at) & (ends < at + len(piece))] - at, gram), bitmaps)
                    flags[(bitmap * BITMAP + bits).ravel()] = True
        if held is not None:
            yield _rows(held, flags)

    return run


def _rows(file: str, flags: np.ndarray) -> pa.RecordBatch:
    """The bitmaps with a bit, and -1 for "indexed"."""
    table = np.packbits(flags.reshape(-1, BITMAP), axis=1, bitorder="little")
    used = np.flatnonzero(table.any(axis=1))
    bits = [bytes(BITMAP // 8), *(table[i].tobytes() for i in used)]
    columns = [pa.array([file] * len(bits)), pa.array([-1, *used.tolist()], pa.int32()), pa.array(bits, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["file", "bitmap", "bits"])


def index_log(spark: SparkSession, path: str, gram: int = 4, bits: int = 1 << 22) -> int:
    """Index the values of the files of a log that are not indexed yet; returns their number.

    ``bits`` is the size of a file's filter. More distinct grams than about a tenth of it let absent needles through; results stay right.
    The index is complete or not there: it is written under another name first.
    """
    if not 1 <= gram <= 8 or bits % BITMAP or bits < BITMAP:
        raise ValueError(f"gram must be 1 to 8 and bits a multiple of {BITMAP}")
    now = state(spark, path)
    if now is None:
        raise ValueError(f"{path!r} has no manifest: store the log with write_log")
    folder, files = Folder(spark, path), now.files.select("file")
    known = parts(folder)
    if known:
        files = files.join(indexed(folder, known), "file", "left_anti")
    names = [row["file"] for row in files.toLocalIterator()]
    if not names:
        return 0
    values = open_files(folder, "topic STRING, partition INT, value BINARY", names)
    rows = values.select(file_name(folder).alias("file"), "value").mapInArrow(_filled(gram, bits // BITMAP), INDEX)
    merged = rows.groupBy("file", "bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))
    draft, final = f"_draft-{uuid.uuid4().hex}", f"_index/g{gram}-b{bits // BITMAP}-{uuid.uuid4().hex}"
    merged.repartitionByRange("bitmap").sortWithinPartitions("bitmap", "file").write.parquet(f"{path}/{draft}")
    folder.files.mkdirs(folder.at("_index"))
    folder.rename(draft, final)
    return len(names)


def parts(folder: Folder) -> list[tuple[str, int, int]]:
    """(name, gram, number of bitmaps) of the parts of the index."""
    names = [name for name in folder.names("_index") if name.startswith("g")]
    return [(name, int(name.split("-")[0][1:]), int(name.split("-")[1][1:])) for name in names]


def _part(folder: Folder, name: str) -> DataFrame:
    return folder.spark.read.schema(INDEX).parquet(f"{folder.pattern}/_index/{name}")


def indexed(folder: Folder, known: list[tuple[str, int, int]]) -> DataFrame:
    """(file) of all indexed files."""
    tables = [_part(folder, name).where("bitmap = -1").select("file") for name, _, _ in known]
    table = tables[0]
    for other in tables[1:]:
        table = table.union(other)
    return table.distinct()


def candidates(folder: Folder, files: DataFrame, needle: bytes) -> DataFrame | None:
    """``files`` without those that cannot contain ``needle``; None where no part of the index can tell.

    A needle that is shorter than the grams of a part is not looked up there.
    """
    without = None
    for name, gram, bitmaps in parts(folder):
        if len(needle) < gram:
            continue
        data = np.frombuffer(needle, np.uint8)
        bitmap, bits = places(grams_of(data, np.array([len(data)]), gram), bitmaps)
        wanted: dict[int, set[int]] = {}
        for at, marks in zip(bitmap.tolist(), bits.T.tolist(), strict=True):
            wanted.setdefault(at, set()).update(marks)
        rows = _part(folder, name).where(F.col("bitmap").isin([-1, *sorted(wanted)]))
        hit = F.col("bitmap") == -1
        for at, marks in wanted.items():
            octets = [F.conv(F.hex(F.substring("bits", bit // 8 + 1, 1)), 16, 10).cast("int") for bit in sorted(marks)]
            tests = [F.getbit(octet, F.lit(bit % 8)) == 1 for octet, bit in zip(octets, sorted(marks), strict=True)]
            every = tests[0]
            for test in tests[1:]:
                every = every & test
            hit = hit | ((F.col("bitmap") == at) & every)
        hits = rows.groupBy("file").agg(F.count_distinct(F.when(hit, F.col("bitmap"))).alias("_hits"))
        lacking = hits.where(F.col("_hits") < len(wanted) + 1).select("file")
        without = lacking if without is None else without.union(lacking)
    if without is None:
        return None
    missing = without.distinct().withColumn("_lacks", F.lit(True))
    return join_small(files, missing, ["file"], "left").where("_lacks is null").drop("_lacks")
