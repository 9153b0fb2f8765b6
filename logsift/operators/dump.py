"""Dumps of messages and of the catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from logsift.functions.decoders import Decoder
from logsift.operators.balance import by_bytes
from logsift.operators.catalog import partition_json, partition_table
from logsift.operators.decode import decode
from logsift.operators.ranges import in_range
from logsift.sources.log import ADDRESS, KEYS


def dump(
    log: DataFrame,
    cursors: DataFrame | None = None,
    decoders: Mapping[str, Decoder] | None = None,
    policy: str = "stop",
) -> DataFrame:
    """Every decoded value from its cursor to the end. The order is made by ``write_dump``."""
    rows = decode(in_range(log, cursors), decoders or {}, policy)
    return rows.select(*ADDRESS, "value")


def write_dump(
    rows: DataFrame, path: str, mode: str = "errorifexists", tasks: int | None = None, range_bytes: int | None = None
) -> None:
    """One value per line, a folder per partition, files and lines in offset order.

    Range partitioning cuts a hot partition into several ordered files, ``tasks`` in all (default: the
    session's shuffle partitions). ``range_bytes`` makes ranges of about as many bytes instead, for values of very different sizes.
    """
    if range_bytes is None:
        ordered = rows.repartitionByRange(*([] if tasks is None else [tasks]), *ADDRESS).sortWithinPartitions(*ADDRESS)
    else:
        ordered = by_bytes(rows, range_bytes)
    ordered.select(*KEYS, "value").write.mode(mode).partitionBy(*KEYS).text(path)


def write_catalog(cursors: DataFrame, path: str, form: str = "table", mode: str = "errorifexists") -> None:
    """The partition table as CSV with a header (``table``) or as one JSON object per line."""
    if form == "table":
        partition_table(cursors).write.mode(mode).option("header", "true").csv(path)
    elif form == "json":
        partition_json(cursors).write.mode(mode).text(path)
    else:
        raise ValueError(f"form must be 'table' or 'json', not {form!r}")
