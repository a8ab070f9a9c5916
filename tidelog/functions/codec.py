"""Payloads and metadata as JSON, encoded and decoded by Spark's own functions."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"


class Codec(Protocol):
    """How payloads are written and read; ``JsonCodec`` is the one that comes with the engine."""

    content_type: str

    def encode(self, *columns: Column | str) -> Column: ...

    def decode(self, payload: Column, schema: StructType, mode: str = "failfast") -> Column: ...


class JsonCodec:
    """failfast raises on a payload that is not the schema's JSON; permissive gives null and, in ``with_corrupt``, the text."""

    content_type = "application/json"

    def __init__(self, **options: str):
        self.options = options

    def encode(self, *columns: Column | str) -> Column:
        return F.to_json(F.struct(*columns), self.options)

    def decode(self, payload: Column, schema: StructType, mode: str = "failfast") -> Column:
        if mode == "failfast":
            empty = payload.isNull() | (F.trim(payload) == "")
            parsed = F.from_json(payload, schema, self.options | {"mode": "FAILFAST"})
            return F.when(empty, F.raise_error(F.lit("an empty payload can't be decoded"))).otherwise(parsed)
        kept = self.with_corrupt(payload, schema)
        return F.when(kept[CORRUPT].isNull(), F.struct(*[kept[f.name].alias(f.name) for f in schema.fields]))

    def with_corrupt(self, payload: Column, schema: StructType) -> Column:
        """The schema's fields and ``_corrupt_record``: the payload where it can't be decoded."""
        wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
        parsed = F.from_json(payload, wide, self.options | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        bad = F.coalesce(parsed[CORRUPT], F.when(payload.isNull() | (F.trim(payload) == "") | (F.trim(payload) == "null"), F.coalesce(payload, F.lit(""))))
        return F.struct(*[parsed[f.name].alias(f.name) for f in schema.fields], bad.alias(CORRUPT))


def is_corrupt(payload: Column, schema: StructType) -> Column:
    return JsonCodec().with_corrupt(payload, schema)[CORRUPT].isNotNull()


def decode_metadata(raw: Column) -> Column:
    """A map; null and empty payloads are the empty map."""
    return F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))
