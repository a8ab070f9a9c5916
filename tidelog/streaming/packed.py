"""Rows on their way to the driver, in order: executors pack them by columns, the driver makes rows of a pack at a time.

Rows as Spark sends them take some 100 bytes of an event, most of it lengths and zeros, and
positions and names that are next to each other in an ordered log say little anew.  As
Parquet (differences of integers, dictionaries, Zstandard) an event takes some 10 bytes, and
what the driver gets for a log stays far below its limit for results.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row
from pyspark.sql.conversion import ArrowTableToRowsConversion

from ..session import ship

#: A pack is closed when it has so many rows, or so many bytes before it is packed.
ROWS, BYTES = 65_536, 16 << 20
#: So few rows go as they are: a live batch doesn't wait for Python on an executor.
FEW = 1000


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as rows that hold a Parquet file each; the order of rows stays."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS or sum(b.nbytes for b in held) >= BYTES:
            yield _packed(held)
            held = []
    if held:
        yield _packed(held)


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    whole = {f.name: "DELTA_BINARY_PACKED" for f in table.schema if f.type in (pa.int32(), pa.int64())}
    out = io.BytesIO()
    pq.write_table(table, out, compression="zstd", use_dictionary=[n for n in table.column_names if n not in whole], column_encoding=whole, write_statistics=False)
    return pa.RecordBatch.from_pydict({"pack": pa.array([out.getvalue()], pa.binary())})


def unpack(pack: bytes) -> pa.Table:
    return pq.ParquetFile(pa.BufferReader(pack)).read(use_threads=False)


def packs(df: DataFrame, order: str) -> Iterator[bytes]:
    """The packs of df in an order; the driver holds those of a partition, and of the next."""
    ship(df.sparkSession)
    for row in df.orderBy(order).mapInArrow(pack, "pack binary").toLocalIterator(prefetchPartitions=True):
        yield row[0]


def rows_in_order(df: DataFrame, order: str, n: int) -> Iterator[Row]:
    """As ``df.orderBy(order).toLocalIterator()`` of n rows, with less to send."""
    if n <= FEW:
        yield from df.orderBy(order).toLocalIterator()
        return
    for each in packs(df, order):
        yield from ArrowTableToRowsConversion.convert(unpack(each), df.schema)
