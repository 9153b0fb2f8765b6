"""Early end of a first-match search.

``min(offset)`` reads a whole range even when the first message matches. Here the ranges are read
in waves of growing size, and a partition that has what it needs is left out of the next wave.
Waves of a partition do not overlap, and their partitions and offsets go to the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.ranges import in_range
from logsift.plans.sizing import materialise, pin
from logsift.sources.log import ADDRESS, KEYS, Log

GROWTH = 4


def match_ranges(
    log: Log, cursors: DataFrame, predicate: Column, n: int, step: int, lowest: bool = False
) -> DataFrame:
    """For every partition with a match, the part ``[first, stop)`` of its range that holds its
    first ``n`` matches, or all it has.

    With ``lowest`` only the lowest matching partition of each topic is of interest: partitions above one
    with a match are not read further, and only the lowest is returned.
    """
    state = _waves(log, cursors, n, step, lowest, lambda part: part.where(predicate))
    return state.where("seen > 0").select(*KEYS, "start", "end", "first", "stop")


def first_addresses(
    log: Log, cursors: DataFrame, predicate: Column, n: int, step: int, first: Callable[[DataFrame, int], DataFrame]
) -> DataFrame:
    """Addresses of the first ``n`` matches of every partition. ``first`` takes them from a wave; they are kept as it is read,
    so no message is looked at twice."""
    kept: list[DataFrame] = []

    def hits(part: DataFrame) -> DataFrame:
        kept.append(materialise(first(part.where(predicate).select(*ADDRESS), n)))
        return kept[-1]

    _waves(log, cursors, n, step, False, hits)
    if not kept:
        return cursors.select(*ADDRESS).limit(0)
    return first(reduce(DataFrame.unionAll, kept), n)


def _waves(
    log: Log, cursors: DataFrame, n: int, step: int, lowest: bool, hits: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Read until every partition has ``n`` hits or is at its end.

    Per wave every open partition gives one row: count, first and last match. The state between waves is
    a pinned table: a local relation for some ten thousand partitions, a written table beyond.
    """
    if n < 1 or step < 1:
        raise ValueError("n and step must be at least 1")
    unknown = F.lit(None).cast("bigint")
    state = pin(
        cursors.select(
            *KEYS, "start", "end", "offset", F.lit(0).cast("bigint").alias("seen"),
            unknown.alias("first"), unknown.alias("stop"),
        )
    )
    open_ = (F.col("seen") < n) & (F.col("offset") < F.col("end"))
    while not (waiting := state.where(open_)).isEmpty():
        wave = waiting.withColumn("end", F.least(F.col("offset") + step, "end"))
        matches = hits(in_range(log, wave)).groupBy(*KEYS).agg(
            F.count("*").alias("_n"), F.min("offset").alias("_first"), F.max("offset").alias("_last")
        )
        moved = waiting.join(matches, KEYS, "left").select(
            *KEYS, "start", "end", F.least(F.col("offset") + step, "end").alias("offset"),
            (F.col("seen") + F.coalesce("_n", F.lit(0))).alias("seen"), F.coalesce("first", "_first").alias("first"),
            F.coalesce(F.col("_last") + 1, "stop").alias("stop"),
        )
        state = state.where(~open_).unionByName(moved)
        if lowest:
            state = _without_higher(pin(state))
        state = pin(state)
        step *= GROWTH
    return state


def _without_higher(state: DataFrame) -> DataFrame:
    best = state.where("seen > 0").groupBy("topic").agg(F.min("partition").alias("_best"))
    return state.join(best, "topic", "left").where("_best is null or partition <= _best").drop("_best")
