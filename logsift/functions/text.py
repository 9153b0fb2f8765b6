"""Column expressions over message bodies. All are row-local: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.sources.log import Log


def has(log: Log, needle: str, column: str = "value") -> Column:
    """Byte-wise, case-sensitive substring test; the empty needle matches every message.

    A STRING column keeps the test as a string filter, which the scan can use.
    """
    if needle == "":
        return F.lit(True)
    if callable(log) or isinstance(log.schema[column].dataType, T.BinaryType):
        return F.contains(F.col(column), F.lit(needle.encode()))
    return F.contains(F.col(column), F.lit(needle))


def as_text(column: Column | str) -> Column:
    """Message bytes as a string, without a check."""
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def byte_cut(column: Column | str, width: int) -> Column:
    """The first ``width`` bytes as valid text; a split character becomes U+FFFD."""
    raw = as_text(column).cast("binary")
    return F.make_valid_utf8(F.substring(raw, 1, width).cast("string"))


def char_cut(column: Column | str, width: int) -> Column:
    return F.substring(as_text(column), 1, width)


def string_cut(column: Column | str, longest: int) -> Column:
    """Cut with ``...`` from ``longest`` characters on; 0 leaves the text alone."""
    text = as_text(column)
    if longest == 0:
        return text
    dotted = F.concat(F.substring(text, 1, longest), F.lit("..."))
    return F.when(F.length(text) >= longest, dotted).otherwise(text)


def body_lines(column: Column | str) -> Column:
    """Array of the lines of a body: LF or CRLF ends a line, the last line needs no end."""
    text = as_text(column)
    ended = F.endswith(text, F.lit("\n")) | (text == "")
    plain = F.when(ended, _without_last(F.split(text, "\n"))).otherwise(F.split(text, "\n"))
    closed = F.regexp_replace(text, r"\r\z", "")
    mixed = F.when(ended, _without_last(F.split(text, "\r?\n"))).otherwise(F.split(closed, "\r?\n"))
    return F.when(F.contains(text, F.lit("\r")), mixed).otherwise(plain)


def _without_last(items: Column) -> Column:
    return F.slice(items, F.lit(1), F.size(items) - 1)


def length_in(text: Column, unit: str) -> Column:
    if unit == "char":
        return F.length(text)
    if unit == "byte":
        return F.octet_length(text)
    raise ValueError(f"unit must be 'char' or 'byte', not {unit!r}")


def in_first_line(lines: Column, needle: str, unit: str) -> Column:
    """STRUCT<line_no, col> of the first of ``lines`` that contains ``needle``; NULL without one."""
    line_no = F.array_position(F.transform(lines, lambda line: F.contains(line, F.lit(needle))), True) - 1
    line = F.get(lines, line_no.cast("int"))
    before = F.left(line, F.instr(line, F.lit(needle)) - 1)
    return F.when(
        line_no >= 0, F.struct(line_no.cast("int").alias("line_no"), length_in(before, unit).alias("col"))
    )
