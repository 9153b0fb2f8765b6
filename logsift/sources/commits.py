"""Versions of a stored log: which files belong to it, agreed on by writers and readers.

Below the folder of a log, ``_log`` holds one small file per version. It names a table of all files of that version, with
their offsets, record counts and sizes; names are relative, so a log can be moved. A version is published by creating its file, which
fails when another writer was first: an append then adds its files to the version of the other and tries again, an overwrite
fails whole. A writer leaves a mark while it writes; its files do not count before its version is there.

Files are never removed by a write. Those of an overwritten version stay, marked as not live, for readers of earlier
versions, until ``vacuum_log``. Files that others put into the folder count as soon as they are there, and files that others removed
do not count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from logsift.operators.balance import by_bytes
from logsift.plans.sizing import join_small, pin

KEYS = ["topic", "partition"]
MANIFEST = "topic STRING, partition INT, file STRING, start BIGINT, end BIGINT, n BIGINT, bytes BIGINT, live BOOLEAN"
FILE = ["topic", "partition", "file", "start", "end", "n", "bytes"]
#: Renames that run at once when a write takes its place.
RENAMES = 16
PLACE = "topic STRING, partition INT, offset BIGINT"


class LogConflict(RuntimeError):
    """Another writer published a version in the meantime."""


@dataclass(frozen=True)
class Folder:
    """The folder of a log, through the file system that Spark reads it with."""

    spark: SparkSession
    path: str

    @cached_property
    def _hadoop(self):
        return self.spark._jvm.org.apache.hadoop.fs

    @cached_property
    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def at(self, *names: str):
        return self._hadoop.Path("/".join([self.path, *names]))

    @cached_property
    def files(self):
        return self.at().getFileSystem(self._conf)

    @cached_property
    def root(self) -> str:
        """The path as listings have it."""
        return self.files.makeQualified(self.at()).toString().rstrip("/")

    @property
    def pattern(self) -> str:
        """The path as readers take it: without a character that has a meaning in patterns."""
        return escaped(self.path)

    def names(self, folder: str) -> list[str]:
        place = self.at(folder)
        return sorted(status.getPath().getName() for status in self.files.listStatus(place)) if self.files.exists(place) else []

    def read(self, *names: str) -> str:
        stream = self.files.open(self.at(*names))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, text: str, *names: str) -> None:
        stream = self.files.create(self.at(*names), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, *names: str) -> bool:
        return self.files.delete(self.at(*names), True)

    def rename(self, old: str, new: str) -> None:
        if not self.files.rename(self.at(old), self.at(new)):
            raise OSError(f"cannot rename {old!r} in {self.path!r}")

    def put_if_absent(self, text: str, *names: str) -> bool:
        """Create a whole file, or tell that it is there already.

        A link on local file systems, which is atomic there, else a rename that does not replace, which is on HDFS.
        """
        draft, final = self.at(f"_log/draft-{uuid.uuid4().hex}"), self.at(*names)
        stream = self.files.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm
        try:
            if self.files.getScheme() == "file":
                old, new = (jvm.java.io.File(self.files.makeQualified(p).toUri().getPath()).toPath() for p in (draft, final))
                jvm.java.nio.file.Files.createLink(new, old)
            else:
                context = self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf)
                plain = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
                context.rename(draft, final, plain)
            return True
        except Py4JJavaError as error:
            if not error.java_exception.getClass().getSimpleName().startswith("FileAlreadyExists"):
                raise
            return False
        finally:
            self.files.delete(draft, False)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions of a log, oldest first."""
    return [int(name.removesuffix(".json")) for name in Folder(spark, path).names("_log") if name.endswith(".json")]


def manifest_of(folder: Folder, version: int) -> DataFrame:
    """All files known at a version, live or not."""
    if not version:
        return folder.spark.createDataFrame([], MANIFEST)
    table = json.loads(folder.read("_log", f"{version:020d}.json"))["manifest"]
    return folder.spark.read.schema(MANIFEST).parquet(f"{folder.pattern}/_log/{table}")


def listed(folder: Folder, glob: str = "*.parquet") -> DataFrame:
    """(file, bytes) of the data files in the folder now; no file is opened."""
    found = folder.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    inside = F.expr(f"substring(path, {len(folder.root) + 2})")
    return found.load(folder.pattern).select(inside.alias("file"), F.col("length").alias("bytes"))


def file_name(folder: Folder) -> Column:
    """The relative file of a row; the hidden column has it as a URL."""
    whole = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return F.substring(whole, F.lit(len(folder.root) + 2), F.length(whole))


def ranges(folder: Folder, rows: DataFrame) -> DataFrame:
    """Manifest rows of the files that ``rows`` are read from."""
    file = rows.groupBy(*KEYS, file_name(folder).alias("file"), F.col("_metadata.file_size").alias("bytes"))
    spans = file.agg(F.min("offset").alias("start"), (F.max("offset") + 1).alias("end"), F.count("*").alias("n"))
    return spans.select(*FILE, F.lit(True).alias("live"))


def open_files(folder: Folder, schema, names: list[str]) -> DataFrame:
    """The rows of some files, by relative name."""
    if not names:
        return folder.spark.createDataFrame([], schema)
    return folder.spark.read.schema(schema).option("basePath", folder.path).parquet(*[f"{folder.pattern}/{escaped(name)}" for name in names])


def escaped(name: str) -> str:
    """A path that the reader does not take for a pattern."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in name)


@dataclass(frozen=True)
class State:
    """What a log is at one moment."""

    version: int
    files: DataFrame
    #: Whether the files of the state are all files in the folder.
    whole: bool


def state(spark: SparkSession, path: str, version: int | None = None) -> State | None:
    """Files of a version, or of the log as it is now; None for a folder without versions.

    A version is taken as published. The present is the newest version, less the files that are not there
    any more, and the files of others, whose offsets are read now.
    """
    folder = Folder(spark, path)
    known = versions(spark, path)
    if not known:
        return None
    if version is not None:
        if version not in known:
            raise ValueError(f"{path!r} has no version {version}; it has {known[0]} to {known[-1]}")
        return State(version, manifest_of(folder, version).where("live").select(*FILE), False)
    while True:
        # Files first, marks of writers next: a write that ends in between shows in the versions.
        there = pin(listed(folder))
        marks = [name.removeprefix("writing-") for name in folder.names("_log") if name.startswith("writing-")]
        if versions(spark, path)[-1] == known[-1]:
            break
        known = versions(spark, path)
    table = manifest_of(folder, known[-1])
    both = there.withColumn("there", F.lit(True)).join(table.drop("bytes").withColumn("known", F.lit(True)), "file", "full")
    both = pin(both.select("file", "bytes", "there", "known", "live", *KEYS, "start", "end", "n"))
    unfinished = F.element_at(F.split("file", "/"), -1).rlike("^log\\.(" + "|".join(["-", *marks]) + ")-")
    others = [row["file"] for row in both.where("known is null").where(~unfinished).select("file").toLocalIterator()]
    files = both.where("live and there").select(*FILE)
    if others:
        files = files.unionByName(ranges(folder, open_files(folder, PLACE, others)).drop("live"))
    whole = both.where("there and (known and not live)").isEmpty() and both.where("known is null").where(unfinished).isEmpty()
    return State(known[-1], pin(files), whole)


def publish(folder: Folder, change: Callable[[DataFrame], DataFrame], what: str, base: int | None = None) -> int:
    """Make ``change`` of the newest manifest the next version; with ``base``, only if that is the newest still."""
    while True:
        newest = max(versions(folder.spark, folder.path), default=0)
        if base not in (None, newest):
            raise LogConflict(f"version {newest} of {folder.path!r} came before this {what}")
        table = f"m-{uuid.uuid4().hex}"
        change(manifest_of(folder, newest)).select(*FILE, "live").write.parquet(f"{folder.path}/_log/{table}")
        if folder.put_if_absent(json.dumps({"manifest": table, "what": what}), "_log", f"{newest + 1:020d}.json"):
            return newest + 1
        folder.delete("_log", table)


def write_log(
    log: DataFrame, path: str, mode: str = "append", tasks: int | None = None, records_per_file: int | None = None,
    range_bytes: int | None = None,
) -> int | None:
    """Store a log as its next version: one folder per partition, files in offset order, and the offsets of every file.

    Range partitioning splits a hot partition into several files, and the order inside them gives
    row groups with narrow offset statistics, so a later offset range skips the rest. ``tasks`` is the number of
    those ranges (default: the session's shuffle partitions; give bytes / 1 GB or so for a large log),
    ``records_per_file`` ends a file early. ``range_bytes`` makes ranges of about as many bytes instead, for values of very
    different sizes, at the price of a pass over the sizes. ``mode`` is one of Spark's: ``append``, ``overwrite`` (of the partitions that ``log`` has
    where the session overwrites dynamically), ``error``, ``ignore``. Columns of VARIANT are stored in pieces. Returns the version, None where nothing was to be written.
    """
    spark = log.sparkSession
    folder = Folder(spark, path)
    base = max(versions(spark, path), default=0)
    if mode in ("error", "errorifexists", "ignore") and folder.files.exists(folder.at()):
        if mode == "ignore":
            return None
        raise FileExistsError(f"{path!r} is there already")
    if mode not in ("append", "overwrite", "error", "errorifexists", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    mark = uuid.uuid4().hex
    folder.write("", "_log", f"writing-{mark}")
    try:
        address = [*KEYS, "offset"]
        if range_bytes is None:
            ordered = log.repartitionByRange(*([] if tasks is None else [tasks]), *address).sortWithinPartitions(*address)
        else:
            ordered = by_bytes(log, range_bytes)
        writer = ordered.write.mode("append")
        if records_per_file:
            writer = writer.option("maxRecordsPerFile", records_per_file)
        staged = Folder(spark, f"{path}/_log/stage-{mark}")  # writes of two jobs into one folder would remove each other's files
        with _in_pieces(spark) if any(isinstance(f.dataType, VariantType) for f in log.schema) else nullcontext():
            writer.option("mapreduce.output.basename", f"log.{mark}").partitionBy(*KEYS).parquet(staged.path)
        new = pin(ranges(staged, spark.read.schema(PLACE).parquet(staged.pattern)))
        moved(staged, folder)
        if mode == "append":
            version = publish(folder, lambda known: known.unionByName(new), mode)
        else:
            within = spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "dynamic" and mode == "overwrite"
            version = publish(folder, lambda known: _replaced(folder, known, new, mark, within), mode, base)
    except BaseException:
        _discard(folder, mark)
        raise
    folder.delete("_log", f"writing-{mark}")
    return version


#: VARIANT columns are stored with the fields that most values have as columns of their own.
PIECES = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true"}


@contextmanager
def _in_pieces(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in PIECES}
    try:
        for name, value in PIECES.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def moved(staged: Folder, folder: Folder) -> None:
    """Rename the files of ``staged`` to their places below ``folder``."""
    names = [row["file"] for row in listed(staged).toLocalIterator()]
    for parent in {name.rpartition("/")[0] for name in names}:
        folder.files.mkdirs(folder.at(parent))
    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(lambda name: folder.rename(f"{staged.path[len(folder.path) + 1:]}/{name}", name), names))
    staged.delete()


def _replaced(folder: Folder, known: DataFrame, new: DataFrame, mark: str, within: bool) -> DataFrame:
    """``new`` in place of all files, or ``within`` its partitions, those of others included."""
    there = listed(folder).where(~F.contains("file", F.lit(f"/log.{mark}-")))
    others = [row["file"] for row in there.join(known.select("file"), "file", "left_anti").toLocalIterator()]
    old = known.unionByName(ranges(folder, open_files(folder, PLACE, others))) if others else known
    if within:
        old = join_small(old, new.select(*KEYS).distinct().withColumn("again", F.lit(True)), KEYS, "left")
        old = old.withColumn("live", F.col("live") & F.col("again").isNull()).drop("again")
    else:
        old = old.withColumn("live", F.lit(False))
    return old.select(*FILE, "live").unionByName(new)


def _discard(folder: Folder, mark: str) -> None:
    """Remove the files of a write that was not published, then its mark."""
    folder.delete("_log", f"stage-{mark}")
    for row in listed(folder, f"log.{mark}-*").toLocalIterator():
        folder.files.delete(folder.at(row["file"]), False)
    folder.delete("_log", f"writing-{mark}")


def adopt_files(spark: SparkSession, path: str) -> int:
    """Publish the log as it is now, so that the files of others are known and need not be read for their offsets again."""
    folder = Folder(spark, path)
    base = max(versions(spark, path), default=0)
    if base:
        now = state(spark, path).files
    else:
        now = ranges(folder, open_files(folder, PLACE, [row["file"] for row in listed(folder).toLocalIterator()]))
    now = now.select(*FILE, F.lit(True).alias("live"))
    return publish(folder, lambda known: now.unionByName(known.where("not live")), "adopt", base)


def vacuum_log(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all but the last ``keep`` versions, files that none of them has, and what unfinished writes left.

    No write may be going on. Returns the number of data files removed.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1")
    folder = Folder(spark, path)
    for name in folder.names("_log"):
        if name.startswith("writing-"):
            _discard(folder, name.removeprefix("writing-"))
        elif name.startswith("draft-"):
            folder.delete("_log", name)
    known = versions(spark, path)
    kept, old = known[-keep:], known[:-keep]
    if not kept:
        return 0
    live = manifest_of(folder, kept[0]).where("live").select("file")
    for version in kept[1:]:
        live = live.union(manifest_of(folder, version).where("live").select("file"))
    dead = manifest_of(folder, kept[-1]).where("not live").select("file").join(live, "file", "left_anti")
    gone = [row["file"] for row in dead.toLocalIterator()]
    if gone:
        table = pin(dead)
        publish(folder, lambda rows: rows.join(table, "file", "left_anti"), "vacuum", kept[-1])
    for file in gone:
        folder.files.delete(folder.at(file), False)
    tables = {json.loads(folder.read("_log", f"{v:020d}.json"))["manifest"] for v in versions(spark, path) if v not in old}
    for version in old:
        folder.delete("_log", f"{version:020d}.json")
    for name in folder.names("_log"):
        if name.startswith("m-") and name not in tables:
            folder.delete("_log", name)
    return len(gone)
