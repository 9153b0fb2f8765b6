"""Substring search over every partition of a log at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import as_text, body_lines, has, in_first_line, length_in
from logsift.operators.catalog import partition_offsets
from logsift.operators.ranges import at_addresses, in_range, whole
from logsift.operators.waves import match_ranges
from logsift.plans.sizing import pin
from logsift.sources.log import ADDRESS, KEYS, Log
from logsift.sources.stored import StoredLog

CURSOR = [*KEYS, "start", "end", "offset"]
#: Offsets whose messages a chained search gathers in one list.
BLOCK_BITS = 16


def search_partition(
    log: Log,
    needle: str,
    cursors: DataFrame | None = None,
    column: str = "value",
    step: int | None = None,
) -> DataFrame:
    """First matching message of every partition at or after its cursor.

    The offsets are found first, by minima with a map-side combine, and then looked up. ``step``
    reads growing offset ranges as in ``search_topic``.
    """
    log = _may_contain(log, needle, column)
    found = has(log, needle, column)
    ranges = _waves(log, cursors, found, step)
    if ranges is not None:
        first = ranges.select(*KEYS, F.col("first").alias("offset"))
    else:
        first = in_range(log, cursors).where(found).groupBy(*KEYS).agg(F.min("offset").alias("offset"))
    matching = (lambda spans: log(spans).where(found)) if callable(log) else log.where(found)
    return at_addresses(matching, first).select(*ADDRESS, "value")


def search_topic(
    log: Log,
    needle: str,
    cursors: DataFrame | None = None,
    column: str = "value",
    step: int | None = None,
) -> DataFrame:
    """Partitions with a match, their cursors moved to the first match.

    Without ``cursors`` the ranges and the first matches come from one pass over the log with a
    map-side combine. With ``cursors`` only their ranges are read, and with ``step`` in growing
    waves that leave out partitions already matched. ``column`` may name a decoded value.
    """
    log = _may_contain(log, needle, column)
    found = has(log, needle, column)
    ranges = _waves(log, cursors, found, step)
    if ranges is not None:
        return ranges.select(*KEYS, "start", "end", F.col("first").alias("offset")).orderBy(*KEYS)
    if cursors is None:
        return (
            whole(log).groupBy(*KEYS)
            .agg(
                F.min("offset").alias("start"),
                (F.max("offset") + 1).alias("end"),
                F.min(F.when(found, F.col("offset"))).alias("offset"),
            )
            .where(F.col("offset").isNotNull())
            .orderBy(*KEYS)
        )
    cursors = pin(cursors)
    first = in_range(log, cursors).where(found).groupBy(*KEYS).agg(F.min("offset").alias("_first"))
    return _narrow(cursors, first).orderBy(*KEYS)


def first_result(found: DataFrame) -> DataFrame:
    """One matching partition per topic: the lowest partition id."""
    best = F.min(F.struct("partition", "offset"))
    return found.groupBy("topic").agg(best.alias("_best")).select("topic", "_best.partition", "_best.offset")


def search_first(log: Log, needle: str, cursors: DataFrame, step: int, column: str = "value") -> DataFrame:
    """``first_result`` of a search that stops: as soon as a partition has a match, the partitions of its
    topic above it are not read further."""
    log = _may_contain(log, needle, column)
    ranges = match_ranges(log, cursors, has(log, needle, column), 1, step, lowest=True)
    return first_result(ranges.select(*KEYS, F.col("first").alias("offset")))


def match_count(found: DataFrame) -> DataFrame:
    """Number of matching partitions per topic."""
    return found.groupBy("topic").agg(F.count("*").alias("n_partitions"))


def search_chained(
    log: Log, needles: list[str], cursors: DataFrame | None = None, step: int | None = None
) -> DataFrame:
    """Each search runs on the partitions and from the cursors the one before it left.

    ``first_match`` lists the offset found by each needle; the same message may serve several. All needles are looked for in
    one scan: see ``_chains``. ``step`` instead searches one needle after the other, in growing offset ranges as in ``search_topic``;
    a search keeps one row per partition, so what lies between the searches is a cursor table.
    """
    if cursors is None:
        cursors = partition_offsets(whole(log))
    if step is None and needles:
        return _chains(log, needles, cursors)
    now = pin(cursors.select(*CURSOR).withColumn("first_match", F.array().cast("array<bigint>")))
    for needle in needles:
        some = _may_contain(log, needle, "value")
        first = _waves(some, now, has(some, needle), step).select(*KEYS, F.col("first").alias("_first"))
        moved = now.join(first, KEYS).withColumn("first_match", F.array_append("first_match", F.col("_first")))
        now = pin(moved.withColumn("offset", F.col("_first")).select(*CURSOR, "first_match"))
    return now.select(*KEYS, "first_match")


def _chains(log: Log, needles: list[str], cursors: DataFrame) -> DataFrame:
    """The whole chain of every partition from one scan.

    What is left to find is a number of needles, and messages that hold any are gathered per block of offsets, a bounded list. A block
    is summed up by what it does to each such number: how far the chain gets inside it, and at which offsets. These summaries
    are put together in the order of the blocks, again one row per block and not per message.
    """
    if isinstance(log, StoredLog):
        log = log.containing_any(needles)
    hits = F.array(*[has(log, needle) for needle in needles])
    rows = in_range(log, cursors).select(*KEYS, "offset", hits.alias("hits")).where(F.exists("hits", lambda hit: hit))
    block = rows.groupBy(*KEYS, F.shiftright("offset", BLOCK_BITS).alias("block"))
    block = block.agg(F.sort_array(F.collect_list(F.struct("offset", "hits"))).alias("hits"))

    def state(found: Column, offsets: Column) -> Column:
        return F.struct(found.alias("found"), offsets.alias("offsets"))

    def from_state(start: int) -> Column:
        def message(so_far: Column, hit: Column) -> Column:
            return F.aggregate(
                F.sequence(F.lit(start), F.lit(len(needles) - 1)),
                so_far,
                lambda now, i: F.when(
                    (now["found"] == i) & F.get(hit["hits"], i), state(i + 1, F.array_append(now["offsets"], hit["offset"]))
                ).otherwise(now),
            )

        return F.aggregate("hits", state(F.lit(start), F.array().cast("array<bigint>")), message)

    summaries = block.select(*KEYS, "block", F.array(*[from_state(i) for i in range(len(needles))]).alias("steps"))
    ordered = F.sort_array(F.collect_list(F.struct("block", "steps")))
    whole_chain = F.aggregate(
        ordered,
        state(F.lit(0), F.array().cast("array<bigint>")),
        lambda now, part: F.when(now["found"] == len(needles), now).otherwise(
            state(F.get(part["steps"], now["found"])["found"], F.concat(now["offsets"], F.get(part["steps"], now["found"])["offsets"]))
        ),
    )
    chains = summaries.groupBy(*KEYS).agg(whole_chain.alias("chain")).where(F.col("chain.found") == len(needles))
    return chains.select(*KEYS, F.col("chain.offsets").alias("first_match"))


def search_body(log: DataFrame, needle: str, unit: str = "char") -> DataFrame:
    """First line of every message that contains ``needle``, with line number and column from 0.

    Row-local, nothing is exploded or shuffled. A needle without line ends sits inside one line, so
    the text before its first match tells both numbers; only other needles need the lines.
    """
    rows = log.where(has(log, needle)).select(*ADDRESS, as_text("value").alias("_text"))
    if needle == "" or "\n" in needle or "\r" in needle:
        lines = rows.select(*ADDRESS, body_lines("_text").alias("_lines"))
        places = lines.select(*ADDRESS, in_first_line(F.col("_lines"), needle, unit).alias("_at"))
        return places.where("_at is not null").select(*ADDRESS, "_at.*")
    before = F.left("_text", F.instr("_text", F.lit(needle)) - 1)
    rows = rows.select(*ADDRESS, before.alias("_before"))
    breaks = F.length("_before") - F.length(F.replace("_before", F.lit("\n"), F.lit("")))
    column = length_in(F.substring_index("_before", "\n", -1), unit)
    return rows.select(*ADDRESS, breaks.alias("line_no"), column.alias("col"))


def match_context(
    log: DataFrame, needle: str, after: int | None = None, width: int | None = None
) -> DataFrame:
    """Text before, at and after the first match of every matching message.

    ``after`` limits the text behind the match; ``width`` cuts the whole value at that many
    characters.
    """
    rows = log.where(has(log, needle)).select(*ADDRESS, as_text("value").alias("_text"))
    rows = rows.withColumn("_at", F.instr("_text", F.lit(needle)))
    behind = F.col("_at") + len(needle)
    room = F.length("_text") if after is None else F.lit(after)
    if width is not None:
        room = F.least(room, F.greatest(F.lit(width + 1) - behind, F.lit(0)))
    return rows.select(
        *ADDRESS,
        F.left("_text", F.col("_at") - 1).alias("before"),
        F.lit(needle).alias("match"),
        F.substring("_text", behind, room).alias("after"),
    )


def _narrow(cursors: DataFrame, first: DataFrame) -> DataFrame:
    moved = cursors.select(*KEYS, "start", "end").join(first, KEYS)
    return moved.withColumnRenamed("_first", "offset").select(*CURSOR)


def _may_contain(log: Log, needle: str, column: str) -> Log:
    """A stored log without the files that its index rules out; any other log as it is."""
    return log.containing(needle) if isinstance(log, StoredLog) and column == "value" else log


def _waves(log: Log, cursors: DataFrame | None, found: Column, step: int | None) -> DataFrame | None:
    if step is None:
        return None
    if cursors is None:
        raise ValueError("step needs cursors")
    return match_ranges(log, cursors, found, 1, step)
