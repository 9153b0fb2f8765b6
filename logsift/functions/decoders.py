"""Ready decoders. A decoder maps a value column to text, NULL meaning "cannot be decoded"."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift.functions.jsontext import canonical_json
from logsift.functions.text import as_text

Decoder = Callable[[Column], Column]


def plain(value: Column) -> Column:
    """The default: the bytes themselves."""
    return as_text(value)


def json_body(value: Column) -> Column:
    return canonical_json(value)


def delimited(fields: dict[str, str], sep: str = ",") -> Decoder:
    """Delimited text such as ``first,last,age`` to a JSON object with typed fields.

    Text without all the fields, the empty text too, is undecodable; no value gives no text.
    """
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    malformed = "_malformed"
    while malformed in {name.lower() for name in fields}:
        malformed += "_"

    def decoder(value: Column) -> Column:
        text = as_text(value)
        row = F.from_csv(text, f"{schema}, `{malformed}` STRING", {"sep": sep, "columnNameOfCorruptRecord": malformed})

        def typed(row: Column) -> Column:
            good = (text != "") & row.getField(malformed).isNull()
            return F.when(good, F.to_json(F.struct(*[row.getField(f).alias(f) for f in fields])))

        return F.get(F.transform(F.array(row), typed), F.lit(0))

    return decoder


def labelled(fields: dict[str, str], sep: str = ", ", label_end: str = ": ") -> Decoder:
    """Text such as ``first_name: A, last_name: B, age: 7`` to a JSON object with typed fields.

    The text is split once, at the separators that stand before a label, and every part must begin
    with the label of its place. A value may hold separators and line ends.
    """
    names = list(fields)
    ahead = "|".join(_quote(name + label_end) for name in names)

    def decoder(value: Column) -> Column:
        parts = F.split(as_text(value), f"{_quote(sep)}(?={ahead})", len(names))

        def typed(parts: Column) -> Column:
            good = F.size(parts) == len(names)
            values = []
            for i, (name, kind) in enumerate(fields.items()):
                label = name + label_end
                part = F.get(parts, F.lit(i))
                values.append(F.substring(part, F.lit(len(label) + 1), F.length(part)).try_cast(kind).alias(name))
                good = good & F.startswith(part, F.lit(label)) & values[-1].isNotNull()
            return F.when(good, F.to_json(F.struct(*values)))

        return F.get(F.transform(F.array(parts), typed), F.lit(0))

    return decoder


def _quote(text: str) -> str:
    return rf"\Q{text}\E"
