"""A stored log that is read by its manifest: by offset ranges, by addresses, by rank, and by what may contain a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.plans.sizing import join_small, pin
from logsift.sources.commits import FILE, KEYS, Folder, open_files
from logsift.sources.index import candidates

#: Scans of a read by ranges, and distinct ranges that each of them looks for inside its files.
SCANS, RANGES = 64, 16


class StoredLog:
    """A function of cursors that opens only the files with wanted offsets.

    Files are chosen by the manifest, for any number of partitions and whether or not they share an offset space. ``files`` has the
    rows of the manifest that are meant.
    """

    def __init__(self, folder: Folder, schema: str | T.StructType, files: DataFrame):
        self.folder, self.schema, self.files = folder, schema, files

    def __call__(self, cursors: DataFrame) -> DataFrame:
        """Messages of the files with wanted offsets.

        Files with neighbouring ranges are read by one scan, which looks for up to ``RANGES`` ranges inside them; with
        more than ``SCANS`` times as many, neighbouring ranges are looked for as one.
        """
        spans = cursors.select(*KEYS, F.col("offset").alias("_cursor"), F.col("end").alias("_end")).where("_cursor < _end")
        spans = spans.groupBy(*KEYS).agg(F.min("_cursor").alias("_cursor"), F.max("_end").alias("_end"))
        wanted = join_small(self.files, spans, KEYS).where("start < _end and end > _cursor")
        rows = wanted.select("file", "_cursor", "_end").orderBy("_cursor", "_end", "file").collect()
        ranges = list(dict.fromkeys((row["_cursor"], row["_end"]) for row in rows))
        size = max(RANGES, -(-len(ranges) // SCANS))
        place = {span: i // size for i, span in enumerate(ranges)}
        groups: dict[int, list] = {}
        for row in rows:
            groups.setdefault(place[row["_cursor"], row["_end"]], []).append(row)
        scans = [
            self.opened([row["file"] for row in group]).where(
                F.expr(" or ".join(f"(offset >= {a} and offset < {b})" for a, b in _closed(group)))
            )
            for group in groups.values()
        ]
        return reduce(DataFrame.unionAll, scans) if scans else self.opened([])

    def opened(self, names: list[str]) -> DataFrame:
        return open_files(self.folder, self.schema, names)

    def offsets(self) -> DataFrame:
        """Cursor table, every cursor at the first offset."""
        ranges = self.files.groupBy(*KEYS).agg(F.min("start").alias("start"), F.max("end").alias("end"))
        return ranges.withColumn("offset", F.col("start"))

    def at(self, requests: DataFrame) -> DataFrame:
        """Messages of the files that may hold a requested address: of a run of files, those with a wanted offset."""
        placed = located(runs(self.files), requests.select(*KEYS, "offset"))
        wanted = join_small(runs(self.files), placed.select(*KEYS, "run", F.col("offset").alias("_at")), [*KEYS, "run"])
        wanted = wanted.where("start <= _at and _at < end")
        return self.opened([row["file"] for row in wanted.select("file").distinct().toLocalIterator()])

    def containing(self, needle: str | bytes) -> StoredLog:
        """The log without files that the index knows not to contain ``needle``."""
        files = candidates(self.folder, self.files, needle.encode() if isinstance(needle, str) else needle)
        return self if files is None else StoredLog(self.folder, self.schema, pin(files))

    def containing_any(self, needles: list[str]) -> StoredLog:
        """The log without files that the index knows to contain none of the needles."""
        logs = [self.containing(needle) for needle in needles]
        if any(log is self for log in logs):
            return self
        return StoredLog(self.folder, self.schema, pin(reduce(DataFrame.unionAll, [log.files for log in logs]).distinct()))

    def ranked(self, cursors: DataFrame, n: int) -> DataFrame:
        """(topic, partition, low, high, skip): where the ``n``-th message (from 0) at or after every cursor is.

        It is the one with ``skip`` messages before it among those in ``[low, high)``, a run of files, usually one. The counts
        of the manifest tell which; only runs that a cursor cuts in two are read, to count the messages below the cursor. Partitions with fewer
        messages are not in the result.
        """
        table = sizes(self.files)
        wanted = cursors.select(*KEYS, F.col("offset").alias("_cursor"))
        cut = join_small(table, wanted, KEYS).where("low < _cursor and _cursor < high")
        cut = pin(cut.select(*KEYS, F.col("low").alias("offset"), F.col("_cursor").alias("end")))
        below = join_small(self(cut).select(*KEYS, "offset"), cut.select(*KEYS, F.col("end").alias("_end")), KEYS).where("offset < _end")
        counts = below.groupBy(*KEYS).agg(F.count("*").alias("_cut"))
        whole = join_small(table, wanted, KEYS).groupBy(*KEYS)
        earlier = whole.agg(F.sum(F.when(F.col("high") <= F.col("_cursor"), F.col("n")).otherwise(0)).alias("_earlier"))
        rank = earlier.join(counts, KEYS, "left").select(*KEYS, (F.col("_earlier") + F.coalesce("_cut", F.lit(0)) + n).alias("_rank"))
        found = join_small(table, rank, KEYS).where("before <= _rank and _rank < before + n")
        return found.select(*KEYS, "low", "high", (F.col("_rank") - F.col("before")).alias("skip"))

    def enough(self, cursors: DataFrame, n: int) -> DataFrame:
        """The cursors, with their ends brought down to where at least ``n`` messages follow the cursor, by the manifest's counts."""
        table = join_small(sizes(self.files), cursors.select(*KEYS, F.col("offset").alias("_cursor")), KEYS).where("low >= _cursor")
        upto = Window.partitionBy(*KEYS).orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
        stops = table.withColumn("_upto", F.sum("n").over(upto)).where(F.col("_upto") >= n)
        stops = stops.groupBy(*KEYS).agg(F.min("high").alias("_stop"))
        return cursors.join(stops, KEYS, "left").withColumn("end", F.least("end", "_stop")).drop("_stop")


def runs(files: DataFrame) -> DataFrame:
    """Files with the number of their run: files of a partition whose ranges overlap are one run, most runs are one file."""
    before = Window.partitionBy(*KEYS).orderBy("start", "file").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col("start") >= F.max("end").over(before)).cast("int"), F.lit(1))
    upto = Window.partitionBy(*KEYS).orderBy("start", "file").rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("_opens", opens).withColumn("run", F.sum("_opens").over(upto)).select(*FILE, "run")


def sizes(files: DataFrame) -> DataFrame:
    """(topic, partition, run, low, high, n, before): offsets of each run, its messages, and those of the runs before it."""
    table = runs(files).groupBy(*KEYS, "run").agg(F.min("start").alias("low"), F.max("end").alias("high"), F.sum("n").alias("n"))
    earlier = Window.partitionBy(*KEYS).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def located(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(topic, partition, offset, run): the run of files that has the offset of each distinct request, by one ordered pass over both."""
    table = files.groupBy(*KEYS, "run").agg(F.min("start").alias("offset"), F.max("end").alias("_end"))
    marks = table.select(*KEYS, "offset", F.struct("run", "_end").alias("_run"))
    asked = requests.distinct().withColumn("_run", F.lit(None).cast(marks.schema["_run"].dataType))
    upto = Window.partitionBy(*KEYS).orderBy("offset", F.col("_run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_run", ignorenulls=True).over(upto)
    found = marks.unionByName(asked).withColumn("_last", last).where("_run is null and offset < _last._end")
    return found.select(*KEYS, "offset", F.col("_last.run").alias("run"))


def _closed(rows: list) -> list[tuple[int, int]]:
    """The ranges of a scan, runs of neighbours as one where there are more than ``RANGES``."""
    spans = sorted({(row["_cursor"], row["_end"]) for row in rows})
    step = -(-len(spans) // RANGES)
    return [(spans[i][0], max(end for _, end in spans[i : i + step])) for i in range(0, len(spans), step)]
