"""Appends under optimistic concurrency, for any number of streams at once.

``decide_appends`` is a pure plan: each request is checked against its stream's head
as the accepted requests before it have left it.  ``place_events`` gives the events of
accepted requests their positions.  Committing them is the store's part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import running_total
from ..session import ship


def conflict_message(stream: Column, kind: Column, version: Column, actual: Column | None = None) -> Column:
    head = F.concat(F.lit("Append failed due to wrong expected version. Stream: "), stream)
    what = F.when(kind == "version", F.concat(F.lit(", Expected Version: "), version.cast("string"))).otherwise(F.concat(F.lit(", Expected State: "), F.when(kind == "no_stream", F.lit("NoStream")).otherwise(F.lit("Any"))))
    told = F.lit("") if actual is None else F.when(actual.isNull(), F.lit("")).otherwise(F.concat(F.lit(", Actual Version: "), actual.cast("string")))
    return F.concat(head, what, told)


_OUTCOME = "request_id long, stream_name string, expected_kind string, expected_version long, n long, accepted boolean, actual long, first_position long, new_version long"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream, head = None, -1
    for b in batches:
        accepted, actual, first, new = [], [], [], []
        for name, kind, version, n, known in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4, 5)), strict=True):
            if name != stream:
                stream, head = name, -1 if known is None else known
            holds = not n or kind == "any" or head == (-1 if kind == "no_stream" else version)
            accepted.append(holds)
            actual.append(head if head >= 0 else None)
            first.append(head + 1 if holds and n else None)
            if holds and n:
                head += n
            new.append(head if holds and n else None)
        longs = (pa.array(x, pa.int64()) for x in (actual, first, new))
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(accepted, pa.bool_()), *longs], ["request_id", "stream_name", "expected_kind", "expected_version", "n", "accepted", "actual", "first_position", "new_version"])


def decide_appends(requests: DataFrame, heads: DataFrame) -> DataFrame:
    """The outcome of each request.

    requests: request_id, stream_name, expected_kind (any, no_stream, version),
    expected_version, n (events).  heads: stream_name, version.

    Result: the request with ``accepted``, ``actual`` (the head that it met, null
    without a stream), ``first_position`` and ``new_version`` (null if rejected or
    empty) and ``message`` (of a rejected one).  An empty batch is accepted without a
    look at its expectation.  Requests of a stream take effect in request_id order.
    """
    ship(requests.sparkSession)
    asked = requests.select(F.col("request_id").cast("long").alias("request_id"), "stream_name", "expected_kind", F.col("expected_version").cast("long").alias("expected_version"), F.col("n").cast("long").alias("n"))
    met = asked.join(heads.select("stream_name", F.col("version").cast("long").alias("_head")), "stream_name", "left").select(*asked.columns, "_head")
    # Each head depends on the one before: rows pass once in order, and a task holds one head, however many requests a stream has.
    decided = met.repartition("stream_name").sortWithinPartitions("stream_name", "request_id").mapInArrow(_decide, _OUTCOME)
    message = F.when(~F.col("accepted"), conflict_message(F.col("stream_name"), F.col("expected_kind"), F.col("expected_version"), F.col("actual")))
    return decided.select("request_id", "stream_name", "expected_kind", "expected_version", "n", "accepted", "actual", "first_position", "new_version", message.alias("message"))


def place_events(requests: DataFrame, outcomes: DataFrame, next_global: int) -> DataFrame:
    """The log rows of accepted requests; ``requests`` has request_id and the ``events`` array.

    Global positions follow request_id and place in the batch, from ``next_global`` on,
    without gaps.
    """
    kept = outcomes.where(F.col("accepted") & F.col("first_position").isNotNull()).select("request_id", "stream_name", "first_position", "n")
    # One row a request: its first global position, from the counts of those before.
    offsets = running_total(kept.select("request_id", "n"), "request_id", "n", "_before")
    events = requests.select("request_id", F.posexplode("events").alias("_k", "_e")).join(kept.drop("n"), "request_id").join(offsets.select("request_id", "_before"), "request_id")
    return events.select(
        "stream_name", (F.col("first_position") + F.col("_k")).cast("long").alias("stream_position"), (F.lit(next_global) + F.col("_before") + F.col("_k")).cast("long").alias("global_position"),
        F.col("_e.name").alias("name"), F.col("_e.payload").alias("payload"), F.col("_e.metadata").alias("metadata"),
    )
