"""Reads of single streams and of the whole log.

All are filters on columns of the log, so they reach the scan: a log that lies in
``global_position`` order skips row groups by their statistics.  A log that is a view of
a table makes stream names from a key of its own; where a read is given that key as
``native`` (a predicate on it), the read reaches the table's scan below the view's window.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

FORWARDS, BACKWARDS = "forwards", "backwards"


def _own(log: DataFrame, stream: str, native: Column | None) -> DataFrame:
    return (log if native is None else log.where(native)).where(F.col("stream_name") == stream)


def read_stream(log: DataFrame, stream: str, position: int = 0, direction: str = FORWARDS, ordered: bool = True, native: Column | None = None) -> DataFrame:
    """A stream from a position on, that position included, upwards or downwards."""
    if position < 0:
        raise ValueError(f"negative position: {position}")
    own = _own(log, stream, native)
    at = F.col("stream_position")
    if direction == FORWARDS:
        kept, order = own.where(at >= position), at.asc()
    elif direction == BACKWARDS:
        kept, order = own.where(at <= position), at.desc()
    else:
        raise ValueError(f"no such direction: {direction}")
    return kept.orderBy(order) if ordered else kept


def read_from(log: DataFrame, stream: str, origin: str = "default", direction: str = FORWARDS, ordered: bool = True, native: Column | None = None) -> DataFrame:
    """A stream from its start or end; default is the start forwards and the end backwards.

    Forwards from the end there is nothing to read; backwards from the start there
    is the first event.
    """
    if origin not in ("default", "start", "end"):
        raise ValueError(f"no such origin: {origin}")
    if origin == "default":
        origin = "start" if direction == FORWARDS else "end"
    if direction == FORWARDS:
        found = read_stream(log, stream, 0, direction, ordered, native)
        return found.where(F.lit(False)) if origin == "end" else found
    return read_stream(log, stream, 0 if origin == "start" else 2**63 - 1, direction, ordered, native)


def stream_exists(log: DataFrame, stream: str) -> bool:
    return not log.where(F.col("stream_name") == stream).limit(1).isEmpty()


def missing_streams(log: DataFrame, requested: DataFrame) -> DataFrame:
    """The requested stream names that the log doesn't have."""
    return requested.select("stream_name").join(log.select("stream_name"), "stream_name", "left_anti")


def pages(log: DataFrame, stream: str, size: int = 600) -> Iterator[list[Row]]:
    """A stream on the driver, page by page; holds one page at a time."""
    page: list[Row] = []
    for row in read_stream(log, stream).toLocalIterator():
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def page_numbers(log: DataFrame, size: int = 600) -> DataFrame:
    """log with ``page``: of each stream's pages of ``size`` events the one that an event is on, from 0."""
    return log.withColumn("page", F.floor(F.col("stream_position") / F.lit(size)).cast("long"))


def after_position(log: DataFrame, position: int | None) -> DataFrame:
    """All events behind a global position, that position excluded; null reads all."""
    return log if position is None else log.where(F.col("global_position") > position)


def exclude_system(log: DataFrame, prefix: str = "$") -> DataFrame:
    return log.where(~F.col("name").startswith(prefix))


def head_versions(log: DataFrame, key: str = "stream_name") -> DataFrame:
    """The last position and the number of events of each stream."""
    return log.groupBy(key).agg(F.max("stream_position").alias("version"), F.count("*").alias("events"))


def subscribe_stream(log: DataFrame, stream: str, after: int | None = None, native: Column | None = None) -> DataFrame:
    """[extension] The events of one stream behind a stream position; batch or streaming."""
    own = _own(log, stream, native)
    return own if after is None else own.where(F.col("stream_position") > after)
