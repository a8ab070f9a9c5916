"""The tables of the engine: one event log, and what is derived from it."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, LongType, MapType, StringType, StructField, StructType

METADATA = MapType(StringType(), StringType())

#: Key (stream_name, stream_position); global_position is unique and orders the whole log.
EVENT_LOG = StructType([
    StructField("stream_name", StringType(), False),
    StructField("stream_position", LongType(), False),
    StructField("global_position", LongType(), False),
    StructField("name", StringType(), False),
    StructField("payload", StringType()),
    StructField("metadata", METADATA),
])

#: What a writer hands over; the store adds the positions.
WRITABLE_EVENT = StructType([
    StructField("name", StringType(), False),
    StructField("payload", StringType()),
    StructField("metadata", METADATA),
])

#: One append of a batch of events to a stream.
APPEND_REQUEST = StructType([
    StructField("request_id", LongType(), False),
    StructField("stream_name", StringType(), False),
    StructField("expected_kind", StringType(), False),
    StructField("expected_version", LongType()),
    StructField("events", ArrayType(WRITABLE_EVENT), False),
])

#: The last position of each stream.
HEADS = StructType([StructField("stream_name", StringType(), False), StructField("version", LongType())])

CHECKPOINTS = StructType([StructField("name", StringType(), False), StructField("position", LongType())])

DEAD_LETTERS = StructType([*EVENT_LOG.fields, StructField("error", StringType())])
