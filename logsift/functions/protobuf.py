"""Protobuf person records.

``from_protobuf`` needs a connector package that may be missing, so the message class is built here
from its field list and applied to Arrow batches. The protobuf runtime has to be on the executors.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of the person message with their numbers and wire types.
PERSON_FIELDS = [("first", 1, "string"), ("last", 2, "string"), ("age", 3, "int32")]
PERSON_SCHEMA = "first STRING, last STRING, age INT"


def decode_person(value: Column) -> Column:
    """Bytes to STRUCT<first, last, age>; NULL when they are not a person message."""
    make_class = _class_maker()

    @F.pandas_udf(PERSON_SCHEMA)
    def parse(values: pd.Series) -> pd.DataFrame:
        from google.protobuf.message import DecodeError

        person = make_class()
        rows = []
        for data in values:
            try:
                message = None if data is None else person.FromString(bytes(data))
            except DecodeError:
                message = None
            rows.append((None,) * 3 if message is None else (message.first, message.last, message.age))
        frame = pd.DataFrame(rows, columns=["first", "last", "age"])
        return frame.astype({"age": "Int32"})

    row = parse(value)
    return F.when(row["first"].isNotNull(), row)


def person_body(value: Column) -> Column:
    """Decoder for person messages: JSON text, NULL when undecodable."""
    return F.to_json(decode_person(value))


def encode_person(first: Column, last: Column, age: Column) -> Column:
    """Columns to message bytes; a missing value is the field's default."""
    make_class = _class_maker()

    @F.pandas_udf("binary")
    def serialise(firsts: pd.Series, lasts: pd.Series, ages: pd.Series) -> pd.Series:
        person = make_class()
        rows = zip(firsts, lasts, ages.fillna(0).astype("int64"), strict=True)
        return pd.Series([person(first=f, last=s, age=a).SerializeToString() for f, s, a in rows])

    return serialise(first, last, age)


def _class_maker():
    """A function that builds the message class; self-contained, so that tasks need no import of
    this package."""
    fields = list(PERSON_FIELDS)

    def make():
        from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

        file = descriptor_pb2.FileDescriptorProto(name="person.proto", package="person", syntax="proto3")
        message = file.message_type.add(name="Person")
        for name, number, kind in fields:
            kinds = {"string": descriptor_pb2.FieldDescriptorProto.TYPE_STRING,
                     "int32": descriptor_pb2.FieldDescriptorProto.TYPE_INT32}
            message.field.add(
                name=name, number=number, type=kinds[kind],
                label=descriptor_pb2.FieldDescriptorProto.LABEL_OPTIONAL,
            )
        pool = descriptor_pool.DescriptorPool()
        pool.Add(file)
        return message_factory.GetMessageClass(pool.FindMessageTypeByName("person.Person"))

    return make
