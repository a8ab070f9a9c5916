"""Helpers that several operators share: scratch tables, files, text readers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, NullType

from ..scratch import materialise, scratch_path, scratch_root
from ..session import ship

__all__ = ["GOLDEN", "AtomicFile", "Memo", "filesystem", "filter_rows", "in_arrow", "map_arrow", "materialise", "mix", "powers", "prefix_sums", "ragged", "run_hashes", "scratch_path", "scratch_root", "table", "text_batches", "whole_id", "word_shingles"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_id(df: DataFrame, column: str) -> Column:
    """An id column as a long; a column that doesn't hold whole numbers is an error."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (IntegralType, NullType)) and not (isinstance(kind, DecimalType) and kind.scale == 0):
        raise TypeError(f"ids have to be whole numbers, but {column} is {kind.simpleString()}; number the rows, for instance with xxhash64")
    return F.col(column).cast("long")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it of a folder that executors share."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), os.path.abspath(uri)


class AtomicFile:
    """A file that appears under its name only when it is whole.

    Attempts of a task write under names of their own; the content does not
    depend on the attempt, so whichever renames last leaves the same file.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.temp = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.temp, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.final)


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes, to bound what Python holds at once."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        step = min(rows, max(1, int(n * size / max(1, b.nbytes))))
        for at in range(0, n, step):
            yield b.slice(at, step)


def release() -> None:
    """Give memory that a task has freed back to the system, as Python workers live on for tasks of other operators."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` on executors that are known to have this package, in batches of bounded size (``session.NEEDED``)."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 512) -> DataFrame:
    """Apply ``make()(batch)``; make runs once in each task, for what it needs to load."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in text_batches(batches, rows):
            f = f or make()
            yield f(b)

    return in_arrow(df, run, schema)


def filter_rows(df: DataFrame, make: Callable[[], Callable[[list[str | None]], list[bool]]], text_col: str = "text", rows: int = 512) -> DataFrame:
    """The rows of df, all columns as they are, whose text ``make()(texts)`` keeps; make runs once in each task."""
    from pyspark.sql.types import StructField, StructType

    names, at = df.columns, df.columns.index(text_col)
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])
    schema = StructType([StructField(f.name, f.dataType) for f in plain.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None
        for b in text_batches(batches, rows):
            keep = keep or make()
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))

    return in_arrow(plain, run, schema).toDF(*names)


#: Fixed: the multiplier of word and shingle hashes.
GOLDEN = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(5)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """GOLDEN^i and its inverse, for i below n."""
    up, down = np.full(n, GOLDEN, np.uint64), np.full(n, pow(GOLDEN, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def run_hashes(raw: bytes, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each run of bytes that aren't in ``gap`` (a flag for each byte value).

    The hash is a polynomial over the run's bytes, by differences of running sums.
    """
    b = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[True], gap[b], [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.zeros(0, np.uint64), begin, end
    up, down = powers(1 << max(17, len(b).bit_length()))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin, end


def word_shingles(w: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` word hashes, in order; of fewer words, one of all."""
    if not len(w):
        return w
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(GOLDEN) + w[k : len(w) - n + 1 + k])
    return h


def ragged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The parts end to end, and the offsets of each."""
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return (np.concatenate(parts) if parts else np.zeros(0)), ends


def prefix_sums(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows of smaller ``key``.

    Only for tables with a row for each partition or file, which are tiny:
    their running sum is taken in one task.
    """
    from pyspark.sql import Window

    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))


class Memo:
    """What ``learn`` gives for each word, remembered for the first ``most`` words.

    ``learn(words)`` yields the values of a list of words.  Words beyond ``most`` are
    learned again each time; when they come to more than a fifth of the words since
    then, the text has changed and remembering starts anew.  So memory is bounded, and
    what is remembered is mostly what is frequent.
    """

    def __init__(self, learn: Callable[[list[str]], Iterator[bytes]], most: int):
        self.learn, self.most = learn, most
        self.known: dict[str, bytes] = {}
        self.beyond, self.seen = 0, 0

    def values(self, words: list[str], seen: int) -> list[bytes]:
        """The values of different words, which stand for ``seen`` words of text."""
        known = self.known
        todo = [w for w in words if w not in known]
        room = max(0, self.most - len(known))
        known.update(zip(todo, self.learn(todo), strict=True))
        out = list(map(known.__getitem__, words))
        self.seen += seen
        if len(todo) > room:
            for w in todo[room:]:
                del known[w]
            self.beyond += len(todo) - room
            if self.beyond > max(self.most, self.seen // 5):
                self.known, self.beyond, self.seen = {}, 0, 0
        return out

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """For each list of words their values, end to end."""
        words = list(set(chain.from_iterable(texts)))
        value = dict(zip(words, self.values(words, sum(map(len, texts))), strict=True)).__getitem__
        return [b"".join(map(value, t)) for t in texts]

    def gather(self, texts: pa.ListArray, code: str) -> list[bytes]:
        """As ``join`` for an array of lists of words whose values are numbers of type code."""
        words = texts.flatten().dictionary_encode()
        values = self.values(words.dictionary.to_pylist(), len(words))
        pool = np.frombuffer(b"".join(values), code)
        size = np.array(list(map(len, values)), np.int64) // pool.itemsize
        start, index = np.cumsum(size) - size, words.indices.to_numpy()
        lengths = size[index]
        ends = np.cumsum(lengths)
        # Number k of the result is number k - (its word's begin there) of the word's value.
        at = np.repeat((start[index] - (ends - lengths)).astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        flat = memoryview(pool[at].tobytes())
        cut = (np.concatenate([[0], ends])[texts.offsets.to_numpy() - texts.offsets[0].as_py()] * pool.itemsize).tolist()
        return [bytes(flat[a:b]) for a, b in pairwise(cut)]
