"""An event store in a folder: Parquet batches, and one commit file for each.

A batch is written to a folder of its own and becomes part of the log when its commit
file appears.  Commit files are numbered and are created only where none is, so of two
writers that have read the same head one loses, reads again and meets its conflict.
On local disks and HDFS creation is exclusive; on stores without exclusive creation
there must be one writer.

Readers list commits, so they never see half a batch.  Each commit names its batch (in
global order), the range of its positions, and a table of the heads of its streams, so an
append reads heads and not the log.  ``compact`` rewrites all batches as one in global
order and as a copy in buckets of streams, in which a stream's read opens one bucket; what
it replaces is left for readers that have it open, until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..errors import WrongExpectedVersion
from ..files import CommitTaken, Files
from ..functions.positions import Expected
from ..operators.append import decide_appends, place_events
from ..operators.reads import head_versions, read_stream
from ..schema import APPEND_REQUEST, CHECKPOINTS, EVENT_LOG, HEADS
from ..scratch import materialise
from ..session import union
from ..streaming.source import read_log_stream

#: Buckets of the copy by stream, and stream names that are looked up by name; more are joined.
BUCKETS, NAMED = 256, 1000


class EventStore:
    """``buckets`` streams' copies of a compaction are cut into (by a hash of the name)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.files, self.buckets = spark, path.rstrip("/"), Files(spark, path), buckets
        self._read_commits: dict[str, dict] = {}

    # -- commits ---------------------------------------------------------------------------------

    def _commit_names(self) -> list[str]:
        return [n for n in self.files.names(f"{self.path}/_commits") if n.endswith(".json") and not n.startswith(".")]

    def commits(self) -> list[dict]:
        """The commits from the last compaction on; each is read once."""
        out = []
        for name in reversed(self._commit_names()):
            if name not in self._read_commits:
                self._read_commits[name] = json.loads(self.files.read(f"{self.path}/_commits/{name}"))
            out.append(self._read_commits[name] | {"number": int(name.split(".")[0])})
            if out[-1].get("replaces"):
                break
        return out[::-1]

    def _commit(self, number: int, what: dict) -> None:
        self.files.create(f"{self.path}/_commits/{number:012d}.json", json.dumps(what))

    @staticmethod
    def _live(commits: list[dict]) -> list[str]:
        """The batches that make up the log: those after the last compaction, and its own."""
        last = max((k for k, c in enumerate(commits) if c.get("replaces")), default=0)
        return [c["dir"] for c in commits[last:] if c.get("dir")]

    @staticmethod
    def _following(commits: list[dict]) -> int:
        return commits[-1]["number"] + 1 if commits else 0

    def log(self) -> DataFrame:
        return self._read(self.commits())

    def _read(self, commits: list[dict]) -> DataFrame:
        dirs = self._live(commits)
        if not dirs:
            return self.spark.createDataFrame([], EVENT_LOG)
        return self.spark.read.schema(EVENT_LOG).parquet(*[f"{self.path}/{d}" for d in dirs])

    @staticmethod
    def _next(commits: list[dict]) -> int:
        return commits[-1]["next_global"] if commits else 0

    def head(self) -> int | None:
        """The last global position; null for an empty log."""
        return self._next(self.commits()) - 1 if self.commits() else None

    def stream(self, start_after: int | None = None, most: int | None = None) -> DataFrame:
        """The log as a streaming DataFrame behind a position, ``most`` events a batch."""
        return read_log_stream(self.spark, self.path, EVENT_LOG, start_after, most, store=True)

    # -- heads -----------------------------------------------------------------------------------

    def _bucket(self, name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def _heads(self, commits: list[dict], asked: DataFrame | None = None) -> DataFrame:
        """The head of each stream (of the asked ones): from the commits' tables of heads, not from the log."""
        dirs = [c["heads"] for c in commits if c.get("heads")]
        if not dirs:
            return self.spark.createDataFrame([], HEADS)
        heads = self.spark.read.schema(HEADS).parquet(*[f"{self.path}/{d}" for d in dirs])
        if asked is not None:
            few = [r[0] for r in asked.select("stream_name").distinct().limit(NAMED + 1).collect()]
            # A few names reach the files' statistics and Bloom filters.
            heads = heads.where(F.col("stream_name").isin(few)) if len(few) <= NAMED else heads.join(asked.select("stream_name").distinct(), "stream_name", "left_semi")
        return heads.groupBy("stream_name").agg(F.max("version").alias("version"))

    def heads(self) -> DataFrame:
        return self._heads(self.commits())

    def _write(self, df: DataFrame, folder: str, *order: str, partition: str | None = None) -> str:
        """Write df in an order, with a Bloom filter of stream names in each file; returns the place below the store."""
        place = f"{folder}/{uuid.uuid4().hex}"
        laid = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
        out = laid.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#stream_name", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        (out.partitionBy(partition) if partition else out).parquet(f"{self.path}/{place}")
        return place

    # -- writes ----------------------------------------------------------------------------------

    def append_batch(self, requests: DataFrame, retries: int = 5) -> DataFrame:
        """Append many batches in one commit; returns the outcome of each (see ``decide_appends``).

        Accepted requests are written, rejected ones are told; if another writer commits
        in between, everything is decided again.
        """
        asked = materialise(requests.select(*APPEND_REQUEST.names), "requests")
        shaped = asked.withColumn("n", F.size("events").cast("long"))
        for _ in range(retries):
            commits = self.commits()
            outcomes = materialise(decide_appends(shaped.drop("events"), self._heads(commits, asked)), "outcomes")
            written = outcomes.where("accepted").agg(F.sum("n")).first()[0] or 0
            if not written:
                return outcomes
            base = self._next(commits)
            place = self._write(place_events(asked, outcomes, base), "data", "global_position")
            heads = self._write(outcomes.where("accepted").groupBy("stream_name").agg(F.max("new_version").alias("version")).where("version is not null"), "heads", "stream_name")
            try:
                self._commit(self._following(commits), {"dir": place, "heads": heads, "events": written, "rows": written, "first_global": base, "next_global": base + written})
                return outcomes
            except CommitTaken:
                continue
        raise WrongExpectedVersion("other writers committed first, again and again")

    def append(self, stream: str, events: list[tuple], expected: Expected) -> int | None:
        """Append (name, payload, metadata) tuples to one stream; its new last position, or null for no events."""
        if not events:
            from ..operators.entities import warn_empty

            warn_empty(stream)
            return None
        request = self.spark.createDataFrame([(0, stream, expected.kind, expected.version, events)], APPEND_REQUEST)
        out = self.append_batch(request).first()
        if not out["accepted"]:
            raise WrongExpectedVersion(out["message"])
        return out["new_version"]

    def import_log(self, log: DataFrame) -> int:
        """Add rows that have their positions already (behind the log's head) in one commit; the number of rows.

        For what comes from another log.  Positions are taken as they are; those at or
        before the head are an error.
        """
        commits = self.commits()
        base = self._next(commits)
        place = self._write(log.select(*EVENT_LOG.names), "data", "global_position")
        rows = self.spark.read.schema(EVENT_LOG).parquet(f"{self.path}/{place}")
        n, low, high = rows.agg(F.count("*"), F.min("global_position"), F.max("global_position")).first()
        if not n:
            return 0
        if low < base:
            raise ValueError(f"position {low} is not behind the head {base - 1}")
        heads = self._write(head_versions(rows).select("stream_name", "version"), "heads", "stream_name")
        self._commit(self._following(commits), {"dir": place, "heads": heads, "events": n, "rows": n, "first_global": low, "next_global": high + 1})
        return n

    def compact(self) -> None:
        """Rewrite the log as one batch in global order, with a copy by stream and one table of heads."""
        commits = self.commits()
        if len(self._live(commits)) < 2:
            return
        whole = self._read(commits)
        place = self._write(whole, "data", "global_position")
        # A long stream lies in several files, as its positions take part in the ranges.
        by_stream = self._write(whole.withColumn("_bucket", self._bucket(F.col("stream_name"))), "streams", "_bucket", "stream_name", "stream_position", partition="_bucket")
        heads = self._write(self._heads(commits), "heads", "stream_name")
        live = [c for c in commits if c.get("dir")]
        self._commit(self._following(commits), {"dir": place, "streams": by_stream, "buckets": self.buckets, "heads": heads, "replaces": True, "events": 0, "rows": sum(c["rows"] for c in live), "first_global": min(c["first_global"] for c in live), "next_global": self._next(commits)})

    def vacuum(self, older_than: float = 86_400) -> list[str]:
        """Remove folders that no live commit names and that nothing has written to for some seconds; returns them.

        The time is for readers that have replaced folders open, and for writers that are to commit.
        """
        used = {c[k] for c in self.commits() for k in ("dir", "streams", "heads") if c.get(k)}
        gone = []
        for kind in ("data", "streams", "heads"):
            for name in self.files.names(f"{self.path}/{kind}"):
                place = f"{kind}/{name}"
                if place not in used and self.files.age(f"{self.path}/{place}") >= older_than:
                    self.files.remove(f"{self.path}/{place}")
                    gone.append(place)
        return gone

    # -- reads -----------------------------------------------------------------------------------

    def stream_log(self, stream: str) -> DataFrame:
        """The rows of one stream: of what is compacted, from its bucket; of later batches, from files whose Bloom filter has it."""
        commits = self.commits()
        own = F.col("stream_name") == stream
        copied = commits[0] if commits and commits[0].get("streams") else None
        later = self._read(commits[1:] if copied else commits).where(own)
        if not copied:
            return later
        bucket = F.pmod(F.xxhash64(F.lit(stream)), F.lit(copied["buckets"])).cast("int")
        base = self.spark.read.schema(StructType([*EVENT_LOG.fields, StructField("_bucket", IntegerType())])).parquet(f"{self.path}/{copied['streams']}")
        base = base.where(own & (F.col("_bucket") == bucket)).drop("_bucket")
        return union(base, later) if len(commits) > 1 else base

    def read_stream(self, stream: str, position: int = 0, direction: str = "forwards") -> Iterator[Row]:
        return read_stream(self.stream_log(stream), stream, position, direction).toLocalIterator()

    # -- checkpoints -----------------------------------------------------------------------------

    def save_checkpoint(self, name: str, position: int) -> None:
        """The last position that a consumer has handled; it replaces what was saved before."""
        folder = f"{self.path}/_checkpoints/{name}"
        before = self.files.names(folder)
        self.files.create(f"{folder}/{int(before[-1].split('.')[0]) + 1 if before else 0:012d}.json", json.dumps({"position": position}))
        for old in before:
            self.files.remove(f"{folder}/{old}")

    def checkpoint(self, name: str) -> int | None:
        folder = f"{self.path}/_checkpoints/{name}"
        kept = self.files.names(folder)
        return json.loads(self.files.read(f"{folder}/{kept[-1]}"))["position"] if kept else None

    def checkpoints(self) -> DataFrame:
        names = self.files.names(f"{self.path}/_checkpoints")
        return self.spark.createDataFrame([(n, self.checkpoint(n)) for n in names], CHECKPOINTS)
