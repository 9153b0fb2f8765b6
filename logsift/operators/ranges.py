"""Restriction of a log to the range of its cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.plans.sizing import held_rows, small_side
from logsift.sources.log import ADDRESS, KEYS, Log
from logsift.sources.stored import StoredLog

LISTED_OFFSETS = 500
LISTED_RANGES = 16
#: Partitions named in a filter. The driver lists the folders of as many for any scan.
NAMED_PARTITIONS = 1_000_000


def in_range(log: Log, cursors: DataFrame | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages with ``cursor <= offset < end`` of their partition.

    Without cursors the whole log is meant: a batch read is its own snapshot. ``keep`` names cursor
    columns to carry along. The cursors are measured before they are broadcast. Their partitions go to
    the scan as an exact list, which prunes folders, and the union of their ranges as a few
    bounds, which prune row groups and pages where partitions share an offset space; a log read by
    ``stored_log`` is pruned by the offsets of every file as well.
    """
    if cursors is None:
        return whole(log)
    if callable(log):
        log = log(cursors)
    spans = cursors.select(*KEYS, F.col("offset").alias("_cursor"), F.col("end").alias("_end"), *keep)
    spans = spans.where("_cursor < _end")
    spans, rows = small_side(spans)
    log = log.where(_bounds(spans, rows))
    inside = (F.col("offset") >= F.col("_cursor")) & (F.col("offset") < F.col("_end"))
    return log.join(spans, KEYS).where(inside).select(*log.columns, *keep)


def whole(log: Log) -> DataFrame:
    """A log that needs no cursors."""
    if callable(log):
        raise ValueError("a log that is read by ranges needs cursors")
    return log


def at_addresses(log: Log, requests: DataFrame) -> DataFrame:
    """Messages at the requested (topic, partition, offset), once per request."""
    wanted, rows = small_side(requests.select(*ADDRESS))
    spans = wanted.groupBy(*KEYS).agg(F.min("offset").alias("_cursor"), (F.max("offset") + 1).alias("_end"))
    if isinstance(log, StoredLog):
        log = log.at(wanted)
    elif callable(log):
        log = log(spans.select(*KEYS, F.col("_cursor").alias("offset"), F.col("_end").alias("end")))
    if rows is None:
        bounds = _bounds(spans, None)
    else:
        offsets = {row["offset"] for row in rows}
        bounds = in_partitions(rows) & within([(offset, offset + 1) for offset in offsets])
        if len(offsets) <= LISTED_OFFSETS:
            bounds = bounds & F.col("offset").isin(sorted(offsets))
    return log.where(bounds).join(wanted, ADDRESS).select(*log.columns)


def merged(ranges: list[tuple[int, int]], most: int = LISTED_RANGES) -> list[tuple[int, int]]:
    """Union of half-open ranges as at most ``most`` ranges; the smallest gaps are closed first."""
    joined: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if joined and first <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(joined[-1][1], end))
        else:
            joined.append((first, end))
    gaps = [joined[i + 1][0] - joined[i][1] for i in range(len(joined) - 1)]
    kept = set(sorted(range(len(gaps)), key=lambda i: -gaps[i])[: most - 1])
    result: list[tuple[int, int]] = []
    for i, (first, end) in enumerate(joined):
        if i and i - 1 not in kept:
            result[-1] = (result[-1][0], end)
        else:
            result.append((first, end))
    return result


def within(ranges: list[tuple[int, int]]) -> Column:
    """Bounds that hold every range; a hint for the scan."""
    inside = [f"(offset >= {first} and offset < {end})" for first, end in merged(ranges)]
    return F.expr(" or ".join(inside) or "false")


def in_partitions(rows: list[dict]) -> Column:
    """Exactly the (topic, partition) pairs of the rows.

    Topics with the same partitions share a term, so a log whose topics are read whole needs one.
    """
    numbers: dict[str, set[int]] = {}
    for row in rows:
        numbers.setdefault(row["topic"], set()).add(row["partition"])
    topics: dict[frozenset[int], list[str]] = {}
    for topic, partitions in numbers.items():
        topics.setdefault(frozenset(partitions), []).append(topic)
    terms = [
        F.col("topic").isin(sorted(names)) & F.expr(f"partition in ({', '.join(map(str, sorted(partitions)))})")
        for partitions, names in topics.items()
    ]
    return _any(terms)


def _any(terms: list[Column]) -> Column:
    """OR as a balanced tree: thousands of terms stay shallow."""
    if not terms:
        return F.lit(False)
    while len(terms) > 1:
        terms = [a | b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2 :]
    return terms[0]


def _bounds(spans: DataFrame, rows: list[dict] | None) -> Column:
    if rows is None:
        rows = held_rows(spans.select(*KEYS, "_cursor", "_end"), NAMED_PARTITIONS)
    if rows is None:
        low, high = spans.agg(F.min("_cursor"), F.max("_end")).first()
        return within([(low, high)])
    return in_partitions(rows) & within([(row["_cursor"], row["_end"]) for row in rows])
