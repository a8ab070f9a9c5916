"""Tables in the folder that driver and executors share: how lineage is cut."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidState
from .files import Files

#: Where tests and single machines write when the session names no folder.
_LOCAL_SCRATCH: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset on a local master (tests, one machine) a temporary folder
    stands in; on a cluster it is an error, as executors don't see each other's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise InvalidState("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="tidelog-"))
    return _LOCAL_SCRATCH[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


#: Tables of a thread's open scopes, innermost last.
_OPEN = threading.local()


def _scopes() -> list[list[tuple[SparkSession, str]]]:
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


@contextmanager
def scratch_scope(keep: Callable[[], Iterable[DataFrame]] = tuple) -> Iterator[None]:
    """What is materialised inside is removed at the end, but for the tables that ``keep()`` reads.

    Only for work that has run by then: a plan that still reads a removed table fails.
    """
    made: list[tuple[SparkSession, str]] = []
    _scopes().append(made)
    try:
        yield
    finally:
        _scopes().pop()
        held = {f for df in keep() for f in map(_plain, df.inputFiles())}
        for spark, path in made:
            if not any(f.startswith(_plain(path) + "/") for f in held):
                Files(spark, path).remove(path)


def _plain(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage: after it a lost executor costs one reread, and what
    depends on the order or sampling of a run (range bounds, row ids) is fixed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    if scopes := _scopes():
        scopes[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
