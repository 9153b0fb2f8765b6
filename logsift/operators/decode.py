"""The decode stage: a decoder per topic and three ways to treat undecodable messages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.decoders import Decoder, plain
from logsift.plans.sizing import join_small, materialise
from logsift.sources.log import KEYS

POLICIES = ("fail", "stop", "passthrough")


def decoded(decoders: Mapping[str, Decoder]) -> Column:
    """One expression that decodes each value by its topic; ``*`` names the decoder of the rest.

    A decoder sees only the values of its own topic: a Python decoder runs on every row of the
    batch, whatever condition stands around it, so the other values are blanked before it.
    """
    value = F.col("value")
    text = decoders.get("*", plain)(value)
    for topic, decoder in decoders.items():
        if topic != "*":
            mine = F.col("topic") == topic
            text = F.when(mine, decoder(F.when(mine, value))).otherwise(text)
    return text


def decode(log: DataFrame, decoders: Mapping[str, Decoder], policy: str = "passthrough") -> DataFrame:
    """Replace ``value`` by its decoded text.

    ``fail``: the first undecodable message fails the query. ``stop``: every partition yields the
    messages before its first undecodable one; every message is decoded once, into a table below the
    checkpoint folder. ``passthrough``: the raw text stays, and ``is_decoded`` says so. A message
    without a value stays without one and counts as decoded.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, not {policy!r}")
    others = [c for c in log.columns if c != "value"]
    raw = F.col("value")
    text = F.when(raw.isNotNull(), F.col("_text"))
    rows = log.withColumn("_text", decoded(decoders))
    bad = raw.isNotNull() & text.isNull()
    if policy == "passthrough":
        return rows.select(*others, F.coalesce(text, plain(raw)).alias("value"), (~bad).alias("is_decoded"))
    if policy == "fail":
        where = F.format_string("cannot decode topic: %s partition: %d offset: %d", *KEYS, "offset")
        failed = F.when(bad, F.raise_error(where).cast("string")).otherwise(text)
        return rows.select(*others, failed.alias("value"))
    table = materialise(rows.select(*others, text.alias("value"), bad.alias("_is_bad")))
    first_bad = table.where("_is_bad").groupBy(*KEYS).agg(F.min("offset").alias("_bad"))
    kept = join_small(table, first_bad, KEYS, "left").where("_bad is null or offset < _bad")
    return kept.select(*others, "value")
