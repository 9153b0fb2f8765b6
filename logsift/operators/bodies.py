"""Operators on message bodies: lines, canonical JSON, JSON children, sums over a field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, VariantType

from logsift.functions.jsontext import NUMBER, canonical_json, json_at, json_kind, json_node, json_number, json_value, numeral
from logsift.functions.text import as_text, body_lines
from logsift.operators.ranges import in_range
from logsift.plans.sizing import materialise
from logsift.sources.log import ADDRESS, KEYS, Log


def body_line_rows(log: DataFrame) -> DataFrame:
    """One row per line of every body, numbered from 0."""
    return log.select(*ADDRESS, F.posexplode(body_lines("value")).alias("line_no", "line"))


def canonical_bodies(log: DataFrame) -> DataFrame:
    """Bodies as compact JSON with ordered keys; a body that is not JSON stays as it is."""
    rows = log.select(*ADDRESS, as_text("value").alias("_text"), canonical_json("value").alias("_json"))
    return rows.select(
        *ADDRESS, F.coalesce("_json", "_text").alias("json"), F.col("_json").isNotNull().alias("is_json")
    )


#: Levels that a pass opens when all are wanted.
LEVELS = 8


def json_children(log: DataFrame, depth: int | None = 1) -> DataFrame:
    """Children of every JSON body with their kind; one NULL row for a body without children.

    With ``depth`` above 1 objects and arrays are opened further, down to that level; scalars and
    empty containers stay where they end. Every level is a row-local expansion. Without ``depth`` all levels are opened:
    some at a time, and what can be opened further is written and goes into the next pass, until nothing is left.
    """
    rows = log.select(*ADDRESS, json_value("value").alias("_node"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("_key"))
    if depth is not None:
        for level in range(depth):
            rows = _opened(rows, level == 0)
        return _described(rows)
    done, top = [], True
    while True:
        for level in range(LEVELS):
            rows = _opened(rows, top and level == 0)
        rows, top = materialise(rows.withColumn("_more", _has_children(F.col("_node")))), False
        done.append(_described(rows.where("not _more")))
        rows = rows.where("_more").drop("_more")
        if rows.isEmpty():
            return reduce(DataFrame.unionAll, done)


def _opened(rows: DataFrame, top: bool) -> DataFrame:
    """``rows`` with the children of their nodes in place of them; nodes without children stay, but for a body's own (``top``)."""
    rows = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_node").outer()))
    step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(
        F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    )
    opened = F.col("pos").isNotNull()
    return rows.select(
        *ADDRESS,
        F.when(opened, F.col("value")).otherwise(F.lit(None) if top else F.col("_node")).alias("_node"),
        F.when(opened, F.concat("path", step)).otherwise(F.col("path")).alias("path"),
        F.when(opened, F.col("key")).otherwise(F.col("_key")).alias("_key"),
    )


def _has_children(node: Column) -> Column:
    kind = json_kind(node)
    member = (kind == "object") & (F.schema_of_variant(node) != "OBJECT<>")
    element = (kind == "array") & F.try_variant_get(node, "$[0]", "variant").isNotNull()
    return F.coalesce(member | element, F.lit(False))


def _described(rows: DataFrame) -> DataFrame:
    found, kind = F.col("_node").isNotNull(), json_kind(F.col("_node"))
    text = F.to_json("_node")
    return rows.select(
        *ADDRESS,
        F.when(found, F.col("path")).alias("path"),
        F.col("_key").alias("key"),
        F.when((kind == "number") & text.rlike("[.E]"), numeral(text)).otherwise(text).alias("value"),
        kind.alias("type"),
    )


def field_sum(log: Log, path: str, cursors: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Exact sum of the number at a JSON path over the messages from every cursor on, per partition.

    ``by=["topic"]`` gives the sum per topic. Anything but a number counts as nothing. A sum that
    DECIMAL cannot hold, or with a number that it cannot hold, is NULL. Of a log with parsed bodies (``with_bodies``) only the path is read.
    """
    if _has_bodies(log):
        nodes = in_range(_pieces(log, path), cursors).select(*KEYS, "_node")
    else:
        nodes = in_range(log, cursors).select(*KEYS, json_node("value", path).alias("_node"))
    numbers = nodes.select(*KEYS, json_kind(F.col("_node")).alias("_kind"), json_number(F.col("_node")).alias("_number"))
    lost = F.count_if((F.col("_kind") == "number") & F.col("_number").isNull())
    counted = F.count("_number")
    total = F.when(lost == 0, F.when(counted == 0, F.lit(0).cast(NUMBER)).otherwise(F.try_sum("_number")))
    return numbers.groupBy(*(by or KEYS)).agg(total.cast(NUMBER).alias("total"))


def with_bodies(log: DataFrame) -> DataFrame:
    """``log`` with its bodies parsed, as VARIANT in the column ``body``; NULL where the body is not one JSON value.

    ``write_log`` stores such a column in pieces, a field to a column of the file, so bodies are parsed once and reads of
    a path open only its piece.
    """
    return log.withColumn("body", json_value("value"))


def _has_bodies(log: Log) -> bool:
    schema = getattr(log, "schema", None) or "value STRING"
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return any(f.name == "body" and isinstance(f.dataType, VariantType) for f in schema)


def _pieces(log: Log, path: str) -> Log:
    """Addresses with what the parsed bodies have at ``path``, next to the scan, so that it reads no more."""
    if callable(log):
        return lambda cursors: _pieces(log(cursors), path)
    return log.select(*ADDRESS, json_at(F.col("body"), path).alias("_node"))
