"""A streaming source whose offset is the global position of the log.

The built-in file source deals files out in the order they appeared; a fold that minds
the order needs events dealt out by position.  Offsets are ``{"position": p}``; a batch
holds the events in (start, end], cut into ranges that are read in parallel.

Two kinds of places can be followed:

* A store (``sources.store.EventStore``).  Its commit files say what is in the log: the
  last one gives the head, so a trigger lists one folder and opens one small file.  A
  batch that isn't committed is never seen, and since positions stay when a log is
  compacted, a range read from the compacted batch has the same events as before.
* A plain folder of Parquet files that only grows.  Each file's footer is read once; a
  range opens only the files that overlap it.  The ``data`` folder of a store is refused,
  as it also holds what is replaced or not committed.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME, COMMITS = "tidelog", "_commits"


class Range(InputPartition):
    """Events in (low, high], and the files or folders that can hold them."""

    def __init__(self, low: int, high: int, places: list[str]):
        super().__init__((low, high))
        self.low, self.high, self.places = low, high, places


def _store_of(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def _names(fs: pafs.FileSystem, folder: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(x.base_name for x in found if x.is_file and x.base_name.endswith(".json") and x.base_name[0] not in "._")


class LogReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.schema, self.path = schema, options["path"].rstrip("/")
        self.most = int(options.get("maxEventsPerBatch", 0))
        self.slices = int(options.get("slices", 8))
        self.slice_events = int(options.get("eventsPerSlice", 1_000_000))
        self.start = int(options.get("startAfter", -1))
        self.seen = self.start
        fs, root = _store_of(self.path)
        has_commits = lambda at: fs.get_file_info(at).type == pafs.FileType.Directory
        self.store = options.get("store", "").lower() == "true" or has_commits(f"{root}/{COMMITS}")
        if not self.store and has_commits(f"{root.rpartition('/')[0]}/{COMMITS}"):
            raise ValueError(f"{self.path} is a part of a store; follow the store's own folder")
        #: What has been read: commits by name, or of files by path the least and greatest position and the rows.
        self.commits: dict[str, dict] = {}
        self.files: dict[str, tuple[int, int, int]] = {}

    def initialOffset(self) -> dict:
        return {"position": self.start}

    def _commit(self, name: str) -> dict:
        if name not in self.commits:
            fs, root = _store_of(self.path)
            with fs.open_input_stream(f"{root}/{COMMITS}/{name}", compression=None) as f:
                self.commits[name] = json.loads(f.read())
        return self.commits[name]

    def _live(self) -> list[dict]:
        """The commits that make up the log: the last compaction and those after it."""
        fs, root = _store_of(self.path)
        out = []
        for name in reversed(_names(fs, f"{root}/{COMMITS}")):
            out.append(self._commit(name))
            if out[-1].get("replaces"):
                break
        return out[::-1]

    def _look(self) -> dict[str, tuple[int, int, int]]:
        """The range and rows of each file, from its statistics; only new files are opened."""
        fs, root = _store_of(self.path)
        for fragment in ds.dataset(root, format="parquet", filesystem=fs, ignore_prefixes=[".", "_"]).get_fragments():
            if fragment.path in self.files:
                continue
            low, high, rows = None, None, 0
            for group in fragment.row_groups:
                stats = (group.statistics or {}).get("global_position")
                if stats is None:
                    raise ValueError(f"{fragment.path} has no statistics of global_position")
                low = stats["min"] if low is None else min(low, stats["min"])
                high = stats["max"] if high is None else max(high, stats["max"])
                rows += group.num_rows
            if low is not None:
                self.files[fragment.path] = low, high, rows
        return self.files

    def _head(self) -> int:
        """The greatest position."""
        if not self.store:
            return max([self.start, *(high for _, high, _ in self._look().values())])
        fs, root = _store_of(self.path)
        last = _names(fs, f"{root}/{COMMITS}")[-1:]
        return max([self.start, *(self._commit(n)["next_global"] - 1 for n in last)])

    def _places(self) -> list[tuple[str, int, int, int]]:
        """Each file or folder with its least and greatest position and its rows."""
        if not self.store:
            return [(p, *x) for p, x in (self.files or self._look()).items()]
        _, root = _store_of(self.path)
        return [(f"{root}/{c['dir']}", c["first_global"], c["next_global"] - 1, c["rows"]) for c in self._live() if c.get("dir")]

    def latestOffset(self) -> dict:
        head = self._head()
        if self.most:
            # Positions have no gaps in a store; with gaps a batch has fewer events.
            head = min(head, self.seen + self.most)
        self.seen = max(self.seen, head)
        return {"position": head}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = start["position"], end["position"]
        self.seen = max(self.seen, high)
        places = [x for x in self._places() if x[1] <= high and x[2] > low] if high > low else []
        if not places:
            return []
        # Positions below the least or above the greatest that is there take no part in the cut.
        low, high = max(low, min(x[1] for x in places) - 1), min(high, max(x[2] for x in places))
        # As many cuts as there are rows for (positions may have gaps).
        cut = max(self.slices, -(-sum(x[3] for x in places) // self.slice_events))
        step = -(-(high - low) // cut)
        cuts = [(a, min(a + step, high)) for a in range(low, high, step)]
        return [Range(a, b, own) for a, b in cuts if (own := [p for p, x, y, _ in places if x <= b and y > a])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _store_of(self.path)
        at = ds.field("global_position")
        for place in partition.places:  # each is read in passing; what is held is one batch
            found = ds.dataset(place, format="parquet", filesystem=fs, ignore_prefixes=[".", "_"])
            yield from found.to_batches(columns=self.columns, filter=(at > partition.low) & (at <= partition.high), batch_size=10_000, fragment_readahead=1, batch_readahead=2)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """``spark.readStream.format("tidelog")``; options path, schema, store, maxEventsPerBatch, startAfter, slices, eventsPerSlice."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(schema, self.options)


def read_log_stream(spark: SparkSession, path: str, schema: StructType | str, start_after: int | None = None, most: int | None = None, store: bool = False) -> DataFrame:
    """The log under a path as a stream, behind a position; ``most`` events a batch.

    store: the path is a store's, which need not have a commit yet (one that has is recognised).
    Rows of a batch come in no order; what minds it sorts by position.
    """
    # Sources are planned in a Python process that gets no shipped files, so the class goes by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LogSource)
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    reader = spark.readStream.format(NAME).option("path", path).option("schema", ddl).option("store", str(store).lower())
    if start_after is not None:
        reader = reader.option("startAfter", str(start_after))
    if most:
        reader = reader.option("maxEventsPerBatch", str(most))
    return reader.load()
