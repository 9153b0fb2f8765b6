"""The write side: placement of keyed records, dense offsets, templated test records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions.hashing import key_partition
from logsift.functions.protobuf import encode_person
from logsift.plans.sizing import join_small, materialise
from logsift.sources.log import KEYS

# Topics of the development log with their partition counts and value templates.
TOPIC_PARTITIONS = {
    "items": 5,
    "stuff": 10,
    "things": 20,
    "whatnot": 50,
    "other": 500,
    "miscellany": 1,
    "proto": 10,
}
JSON_TEMPLATE = '{"first_name": "%s", "last_name": "%s", "age": %d}'
TOPIC_TEMPLATES = {
    "stuff": JSON_TEMPLATE,
    "things": "first_name: %s, last_name: %s, age: %d",
    "whatnot": JSON_TEMPLATE,
    "items": "%s,%s,%d",
    "other": JSON_TEMPLATE,
}
YOUNGEST, AGES = 5, 80
ITEMS_PER_ARRAY = 400

# Ten beginnings and ten ends make the hundred first and the hundred last names.
FIRST_PARTS = (
    ["Al", "Be", "Ca", "Do", "El", "Fa", "Gi", "Ha", "Io", "Ju"],
    ["ba", "den", "fia", "gor", "lan", "mir", "na", "rik", "sa", "von"],
)
LAST_PARTS = (
    ["Ash", "Brook", "Clay", "Dale", "East", "Field", "Glen", "Hill", "Iron", "Lake"],
    ["berg", "by", "croft", "ford", "ham", "land", "ley", "man", "ton", "well"],
)


def assign_offsets(
    records: DataFrame,
    order_by: list[str] | None = None,
    base: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Give the records of every (topic, partition) the next dense offsets.

    With ``order_by``, which must make the order unique, offsets follow that order: the records are
    range-partitioned by it, so a hot partition spreads over many tasks. Without it they are taken
    as they arrive and nothing is shuffled. Either way they are written once below the checkpoint
    folder, sorted inside each task; a second pass counts the run of every partition in every task,
    and the offset is the place in the run plus the runs before it. ``base`` is the cursor table of
    the log appended to: offsets go on from its ends. ``tasks`` is the number of ordered ranges (default: the
    session's shuffle partitions).
    """
    if order_by:
        order = [*KEYS, *order_by]
        placed = records.repartitionByRange(*([] if tasks is None else [tasks]), *order).sortWithinPartitions(*order)
    else:
        placed = records.sortWithinPartitions(*KEYS)
    ordered = materialise(placed.withColumn("_row", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_task", F.shiftright("_row", 33))
    run = [*KEYS, "_task"]
    runs = ordered.groupBy(*run).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(*KEYS).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    if base is not None:
        runs = runs.join(base.select(*KEYS, F.col("end").alias("_end")), KEYS, "left")
        before = before + F.coalesce(F.col("_end"), F.lit(0))
    shifts = runs.select(*run, (before - F.col("_first")).alias("_shift"))
    numbered = join_small(ordered, shifts, run)
    return numbered.withColumn("offset", F.col("_row") + F.col("_shift")).drop("_row", "_task", "_shift")


def append_to_log(
    records: DataFrame,
    partitions: int | Column,
    order_by: list[str] | None = None,
    base: DataFrame | None = None,
    method: str = "spark",
) -> DataFrame:
    """Keyed records (topic, key, value) as log rows: partition by key, then dense offsets."""
    placed = records.withColumn("partition", key_partition(F.col("key"), partitions, method))
    return assign_offsets(placed, order_by, base)


def templated_records(source: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """Person records in the formats of the development log, one per topic and source row.

    Everything follows from the id and the seed by integer arithmetic, so a lost task gives the
    same rows again. ``miscellany`` holds JSON arrays of ``ITEMS_PER_ARRAY`` items each; ``id`` is
    the order of the records inside their topic. ``protobuf_records`` makes the binary topic.
    """
    ids = source.select(F.col(id_column).cast("bigint").alias("id"))
    topics = [
        F.struct(F.lit(topic).alias("topic"), F.lit(number).cast("bigint").alias("number"))
        for number, topic in enumerate(TOPIC_TEMPLATES)
    ]
    drawn = _person(ids.select("id", F.inline(F.array(*topics))), "number", seed)
    value = F.lit(None).cast("string")
    for topic, template in TOPIC_TEMPLATES.items():
        text = _filled(template, "first", "last", "age")
        value = F.when(F.col("topic") == topic, text).otherwise(value)
    keyed = drawn.select("topic", "id", F.col("last").alias("key"), value.alias("value"))
    return keyed.unionByName(_item_arrays(ids, seed))


def protobuf_records(source: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """The persons of ``miscellany`` as protobuf messages, one per source row, keyed by first name."""
    persons = _numbered_person(source.select(F.col(id_column).cast("bigint").alias("id")), seed)
    value = encode_person(F.col("first"), F.col("last"), F.col("age"))
    topic, key = F.lit("proto").alias("topic"), F.col("first").alias("key")
    return persons.select(topic, "id", key, value.alias("value"))


def sample_records(source: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """Small JSON records with a name and an age from 1 to 100, one per source row."""
    ids = source.select(F.col(id_column).cast("bigint").alias("id"))
    drawn = _numbered_person(ids, seed, youngest=1, ages=100)
    return drawn.select("id", _filled('{"name": "%s", "age": %d}', "first", "age").alias("value"))


def _numbered_person(ids: DataFrame, seed: int, **ages: int) -> DataFrame:
    number = F.lit(len(TOPIC_TEMPLATES)).cast("bigint")
    return _person(ids.withColumn("_number", number), "_number", seed, **ages)


def _person(rows: DataFrame, number: str, seed: int, youngest: int = YOUNGEST, ages: int = AGES) -> DataFrame:
    # One step of the Park-Miller generator from a state that differs for every id and topic.
    # Remainders are taken early, so that no id overflows.
    modulus = F.lit(2147483647)
    state = F.pmod(F.pmod(F.pmod("id", modulus) * 7 + F.col(number) + seed, modulus) * 48271, modulus)
    first, last, age = state % 100, F.floor(state / 100) % 100, F.floor(state / 10000) % ages
    return rows.withColumns(
        {
            "first": _name(first, FIRST_PARTS),
            "last": _name(last, LAST_PARTS),
            "age": (age + youngest).cast("int"),
        }
    )


def _filled(template: str, *columns: str) -> Column:
    """A template as a concatenation, which generated code handles better than a formatter call."""
    texts = [F.lit(text) for text in re.split("%[sd]", template)]
    values = [F.col(c).cast("string") for c in columns]
    return F.concat(*[piece for pair in zip(texts, values) for piece in pair], texts[-1])


def _name(number: Column, parts: tuple[list[str], list[str]]) -> Column:
    begin, end = (F.array(*[F.lit(p) for p in side]) for side in parts)
    return F.concat(
        F.get(begin, F.floor(number / 10).cast("int")), F.get(end, (number % 10).cast("int"))
    )


def _item_arrays(ids: DataFrame, seed: int) -> DataFrame:
    item = _filled('{"first":"%s","last":"%s","name":%d}', "first", "last", "age")
    items = _numbered_person(ids, seed).select(
        F.floor(F.col("id") / ITEMS_PER_ARRAY).alias("id"), F.struct("id", item.alias("text")).alias("item")
    )
    arrays = items.groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    text = F.concat(F.lit("["), F.array_join("items.text", ","), F.lit("]"))
    return arrays.select(
        F.lit("miscellany").alias("topic"), "id", F.lit("item").alias("key"), text.alias("value")
    )
