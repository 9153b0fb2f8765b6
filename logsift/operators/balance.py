"""Ranges of a log that hold equally many bytes, whatever the sizes of its messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.plans.sizing import join_small, materialise

#: Sizes are added up per block of 2 ** 16 offsets, in heavy blocks per 2 ** 8, in heavy ones of those per message.
BITS = (16, 8, 0)
#: A block of more than this part of a range is heavy, so ranges are off by as much at most, or by one message.
HEAVY = 8
KEYS = ["topic", "partition"]


def message_bytes(rows: DataFrame) -> Column:
    """Bytes of the value, and some for the rest of the message."""
    return F.coalesce(F.octet_length("value"), F.lit(0)).cast("bigint") + 24


def by_bytes(rows: DataFrame, range_bytes: int) -> DataFrame:
    """``rows`` in tasks of consecutive offsets with about ``range_bytes`` each, in order inside them.

    A task may hold the end of one partition and the beginning of the next. The bounds are weighted quantiles: running sums over
    blocks, of which there are far fewer than messages. A message is the least that a task can hold.
    """
    if range_bytes < 1:
        raise ValueError("range_bytes must be at least 1")
    blocks = materialise(_blocks(rows, range_bytes))
    totals = blocks.groupBy(*KEYS).agg(F.sum("bytes").alias("total"))
    before = Window.orderBy(*KEYS).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    earlier = Window.partitionBy(*KEYS).orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("inside", F.coalesce(F.sum("bytes").over(earlier), F.lit(0))).join(totals, KEYS)
    # The middle of a block decides, so that a range ends at the nearer side of it. A message of several ranges leaves numbers out.
    place = F.expr(f"(base + inside + bytes div 2) div {range_bytes}").alias("place")
    placed = materialise(placed.select(*KEYS, F.shiftright("low", BITS[0]).alias("_block"), "low", place))
    tasks = placed.select("place").distinct().withColumn("task", F.row_number().over(Window.orderBy("place")) - 1)
    cuts = join_small(placed, tasks, ["place"]).groupBy(*KEYS, "_block", "task").agg(F.min("low").alias("low"))
    cuts = materialise(cuts.groupBy(*KEYS, "_block").agg(F.sort_array(F.collect_list(F.struct("low", "task"))).alias("_cuts")))
    last = cuts.agg(F.max(F.element_at("_cuts", -1)["task"])).first()[0]
    own = F.element_at(F.filter("_cuts", lambda cut: cut["low"] <= F.col("offset")), -1)["task"]
    found = join_small(rows.withColumn("_block", F.shiftright("offset", BITS[0])), cuts, [*KEYS, "_block"])
    dealt = found.withColumn("_task", own).repartitionById((last or 0) + 1, "_task")
    return dealt.sortWithinPartitions(*KEYS, "offset").select(*rows.columns)


def _blocks(rows: DataFrame, range_bytes: int) -> DataFrame:
    """(topic, partition, low, bytes) of blocks that are not heavy, each of one of the sizes."""
    sizes = rows.select(*KEYS, "offset", message_bytes(rows).alias("bytes"))
    done, heavy = [], None
    for bits in BITS:
        low = F.shiftleft(F.shiftright("offset", bits), bits)
        part = sizes if heavy is None else join_small(sizes.withColumn("_parent", F.shiftleft(F.shiftright("offset", above), above)), heavy, [*KEYS, "_parent"])
        counts = part.groupBy(*KEYS, low.alias("low")).agg(F.sum("bytes").alias("bytes"))
        if not bits:
            done.append(counts)
            break
        counts = materialise(counts)
        done.append(counts.where(F.col("bytes") * HEAVY <= range_bytes))
        heavy, above = counts.where(F.col("bytes") * HEAVY > range_bytes).select(*KEYS, F.col("low").alias("_parent")), bits
    return reduce(DataFrame.unionByName, done)
