"""Subscriptions: consumers that follow the log, all in one streaming query.

The query starts behind the least of the consumers' positions; a batch is scanned once,
and each consumer gets what lies behind its own position.  A consumer that fails is
suspended with its error and the event it failed at, while the others go on; resumed, it
handles that event again (at least once).

Where a consumer stands is known by the position of its own checkpoint alone
(``on_restore``), so each run begins with fresh offsets: what was handled after the last
checkpoint of a process that was lost is handled again.

A run first handles what there is (catching up), then follows live.  With ``head`` (the
last position of the log) a live subscription that falls behind is told so, and when it
has caught up.  A watching thread keeps time-based checkpoints and notices a query that
has died: its consumers are dropped with ``ServerError``.

Batches reach a consumer as DataFrames (``on_batch``; see ``ModelConsumer``), whose work
is spread over executors, or, for per-event handlers, one event after the other in global
order; then the driver holds one partition and the next at a time, packed (see ``packed``).
"""

from __future__ import annotations

import contextlib
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidState
from ..files import Files
from ..functions.positions import compare
from .packed import rows_in_order

UNINITIALIZED, STOPPED, RUNNING, SUSPENDED = "Uninitialized", "Stopped", "Running", "Suspended"
UNSUBSCRIBED, CATCHING_UP, LIVE = "Unsubscribed", "CatchingUp", "Live"
ABORT, RETRY, SKIP = "abort", "retry", "skip"
PROCESSED, IGNORED = "processed", "ignored"
DISPOSED, SUBSCRIBER_ERROR, SERVER_ERROR = "Disposed", "SubscriberError", "ServerError"
#: Seconds between two looks of the watching thread.
WATCH = 0.25


@dataclass(frozen=True)
class CheckpointFrequency:
    """Checkpoint after so many processed events, or so many seconds with any, or both."""

    events: int | None = None
    seconds: float | None = None


def on(*names: str) -> Callable:
    """Marks a method ``(self, event)`` as the handler of events of some names."""

    def mark(f: Callable) -> Callable:
        f._handles = names
        return f

    return mark


@lru_cache(256)
def _marked(kind: type) -> dict[str, str]:
    """The attribute of each event name; kept, as it is asked for with every event."""
    return {n: k for k in dir(kind) for n in getattr(getattr(kind, k), "_handles", ())}


class Consumer:
    """Override what is needed.  ``event`` is a Row of the log; handlers run before a checkpoint passes it."""

    name: str | None = None
    catch_up = CheckpointFrequency(events=1)
    live = CheckpointFrequency(events=1)
    max_retries: int | None = None

    def handlers(self) -> dict[str, Callable[[Row], object]]:
        """Marked methods by event name; an overriding method replaces what it overrides, with its names."""
        return {n: getattr(self, k) for n, k in _marked(type(self)).items()}

    def on_initializing(self) -> None: ...

    def on_restore(self) -> int | None:
        """The position to start behind; null: from the start."""
        return None

    def on_starting(self) -> None: ...

    def on_catching_up(self) -> None: ...

    def on_event(self, event: Row) -> str:
        handler = self.handlers().get(event["name"])
        if handler is None:
            return IGNORED
        handler(event)
        return PROCESSED

    def on_batch(self, batch: DataFrame, number: int) -> bool:
        """Handle a batch as a DataFrame; true if it did, else its events come one by one."""
        return False

    def on_checkpoint(self, position: int) -> None: ...

    def on_live(self) -> None: ...

    def on_fell_behind(self) -> None:
        """Live, but the log has gone on: the catch-up frequency holds until ``on_caught_up``."""

    def on_caught_up(self) -> None: ...

    def on_error(self, event: Row, error: Exception) -> str:
        """abort (suspend), retry the event, or skip it."""
        return ABORT

    def on_dropped(self, reason: str, error: Exception | None) -> None: ...


class Interceptor(Consumer):
    """Around-advice: overrides call ``self.inner``'s method where they want it to go on."""

    def __init__(self) -> None:
        self.inner: Consumer = Consumer()

    def on_starting(self) -> None:
        self.inner.on_starting()

    def on_catching_up(self) -> None:
        self.inner.on_catching_up()

    def on_event(self, event: Row) -> str:
        return self.inner.on_event(event)

    def on_checkpoint(self, position: int) -> None:
        self.inner.on_checkpoint(position)

    def on_live(self) -> None:
        self.inner.on_live()


class _Passing(Consumer):
    """What interceptors don't see goes to the consumer itself."""

    def __init__(self, consumer: Consumer, interceptors: Iterable[Interceptor]):
        self.consumer, around = consumer, consumer
        for i in reversed(list(interceptors)):
            i.inner, around = around, i
        self.around = around
        self.catch_up, self.live, self.max_retries = consumer.catch_up, consumer.live, consumer.max_retries
        self.name = consumer.name or type(consumer).__name__
        for n in ("handlers", "on_initializing", "on_restore", "on_batch", "on_error", "on_dropped", "on_fell_behind", "on_caught_up"):
            setattr(self, n, getattr(consumer, n))
        for n in ("on_starting", "on_catching_up", "on_event", "on_checkpoint", "on_live"):
            setattr(self, n, getattr(around, n))


def intercepted(consumer: Consumer, *interceptors: Interceptor) -> Consumer:
    """The first interceptor is the outermost."""
    return _Passing(consumer, interceptors)


class Session:
    """One consumer's progress: status, position, error and the event it stands at."""

    def __init__(self, consumer: Consumer):
        self.consumer = consumer
        self.name = consumer.name or type(consumer).__name__
        self.status, self.error, self.faulted = UNINITIALIZED, None, None
        self.start: int | None = None
        self.last: int | None = None
        self.processed_at: int | None = None
        self.pending, self.since = 0, time.monotonic()
        self.frequency = consumer.catch_up
        #: Held while the consumer is called, as the watching thread makes checkpoints too.
        self.lock = threading.RLock()

    def _expect(self, *statuses: str) -> None:
        if self.status not in statuses:
            raise InvalidState(f"Expected status {' or '.join(statuses)}, but it is {self.status}")

    def initialize(self) -> None:
        self._expect(UNINITIALIZED)
        self.consumer.on_initializing()
        self.status = STOPPED

    def begin(self) -> None:
        self._expect(STOPPED)
        self.start = self.last = self.consumer.on_restore()
        self.consumer.on_starting()
        self.status = RUNNING

    def suspend(self, error: Exception, event: Row | None) -> None:
        self.status, self.error, self.faulted = SUSPENDED, error, event

    def resume(self) -> None:
        self._expect(SUSPENDED)
        self.status, self.error, self.faulted = RUNNING, None, None

    def stop(self) -> None:
        self._expect(RUNNING, SUSPENDED)
        self.status = STOPPED

    def checkpoint(self) -> None:
        with self.lock:
            if self.pending and self.processed_at is not None:
                self.consumer.on_checkpoint(self.processed_at)
            self.pending, self.since = 0, time.monotonic()

    def tick(self) -> None:
        """A checkpoint that time alone makes due; skipped while the consumer is at work, which looks itself."""
        if self.status == RUNNING and self.lock.acquire(blocking=False):
            try:
                if self._due():
                    self.checkpoint()
            except Exception as e:  # a checkpoint that fails
                self.suspend(e, None)
            finally:
                self.lock.release()

    def _due(self) -> bool:
        f = self.frequency
        return bool(self.pending) and (f.events is not None and self.pending >= f.events or f.seconds is not None and time.monotonic() - self.since >= f.seconds)

    def go_live(self) -> None:
        """Checkpoint what is pending, tell the consumer, and go by the live frequency."""
        self.checkpoint()
        self.consumer.on_live()
        self.frequency = self.consumer.live

    def fall_behind(self) -> None:
        self.frequency = self.consumer.catch_up
        self.consumer.on_fell_behind()

    def catch_up(self) -> None:
        self.checkpoint()
        self.consumer.on_caught_up()
        self.frequency = self.consumer.live

    def handle(self, event: Row) -> None:
        at = event["global_position"]
        if self.last is not None and at <= self.last:
            return
        tries = 0
        while True:
            try:
                result = self.consumer.on_event(event)
                break
            except Exception as e:
                what = self.consumer.on_error(event, e)
                if what == SKIP:
                    result = IGNORED
                    break
                tries += 1
                if what != RETRY or self.consumer.max_retries is not None and tries > self.consumer.max_retries:
                    self.suspend(e, event)
                    raise
        self.last = at
        if result == PROCESSED:
            self.pending, self.processed_at = self.pending + 1, at
        if self._due():
            self.checkpoint()

    def batch(self, frame: DataFrame, number: int) -> None:
        """Handle what a batch has for this consumer; an error suspends it and is raised."""
        if self.last is not None:
            frame = frame.where(F.col("global_position") > self.last)
        names = list(self.consumer.handlers())
        if names:
            frame = frame.where(F.col("name").isin(names))
        with self.lock:
            try:
                n, last = frame.agg(F.count("*"), F.max("global_position")).first()
                if not n:
                    return
                if self.consumer.on_batch(frame, number):
                    self.pending, self.processed_at, self.last = self.pending + n, last, last
                    self.checkpoint()
                    return
                for event in rows_in_order(frame, "global_position", n):
                    self.handle(event)
                if self._due():
                    self.checkpoint()
            except Exception as e:
                if self.status != SUSPENDED:
                    self.suspend(e, None)
                raise


def least_start(starts: Iterable[int | None]) -> int | None:
    """The position that one scan for all starts behind: the least, null being less than all."""
    starts = list(starts)
    if not starts:
        raise ValueError("a subscription needs a consumer")
    best = starts[0]
    for s in starts[1:]:
        best = s if compare(s, best) < 0 else best
    return best


class Subscription:
    """Runs consumers over a stream.

    ``stream(start_after)`` makes the streaming DataFrame behind a position;
    ``checkpoints`` is a folder for the offsets of runs, each of which is removed when
    its run ends; ``head()`` is the last position of the log, if that is known.
    """

    def __init__(self, spark: SparkSession, stream: Callable[[int | None], DataFrame], consumers: Iterable[Consumer], checkpoints: str, head: Callable[[], int | None] | None = None):
        self.spark, self.stream, self.checkpoints, self.head = spark, stream, checkpoints.rstrip("/"), head
        self.sessions = {s.name: s for s in map(Session, consumers)}
        if not self.sessions:
            raise ValueError("a subscription needs a consumer")
        self.phase, self.query, self.fault = UNSUBSCRIBED, None, None
        self._following = self._behind = False
        #: Resumed consumers that catch up in a query of their own.
        self._apart: set[str] = set()
        #: Held while queries are begun and ended.
        self._lock = threading.RLock()
        self._ended = threading.Event()

    # -- the query -------------------------------------------------------------------------------

    def _running(self, only: str | None = None) -> list[Session]:
        return [s for s in self.sessions.values() if s.status == RUNNING and (s.name == only if only else s.name not in self._apart)]

    def _batch(self, only: str | None = None) -> Callable[[DataFrame, int], None]:
        def handle(frame: DataFrame, number: int) -> None:
            sessions = self._running(only)
            if not sessions:
                return
            # What no consumer handles is not kept; the others share one scan.
            handled = [set(s.consumer.handlers()) for s in sessions]
            frame = frame if not all(handled) else frame.where(F.col("name").isin(sorted(set().union(*handled))))
            kept = frame.persist()
            try:
                for s in sessions:
                    with contextlib.suppress(Exception):  # it is suspended; the others go on
                        s.batch(kept, number)
            finally:
                kept.unpersist()

        return handle

    def _begin(self, live: bool, only: str | None = None):
        """A query for the running consumers (or one of them), behind the least of their positions."""
        run = uuid.uuid4().hex
        place = f"{self.checkpoints}/{run}"
        source = self.stream(least_start(s.last for s in self._running(only)))
        writer = source.writeStream.foreachBatch(self._batch(only)).option("checkpointLocation", place).queryName(f"subscription-{run[:8]}")
        query = (writer.trigger(processingTime="1 second") if live else writer).start()
        query._place = place
        return query

    def _end(self, query) -> None:
        with contextlib.suppress(Exception):
            query.stop()
        Files(self.spark, self.checkpoints).remove(query._place)

    def _wait(self, query) -> None:
        """Until all that is there is handled; if the query fails, its consumers are dropped."""
        try:
            query.processAllAvailable()
        except Exception:
            if query.exception() is not None:
                self._drop(query.exception())
            elif query.isActive:
                raise

    def _drop(self, error: Exception) -> None:
        """The source or the engine failed: no consumer is to blame, and none goes on."""
        with self._lock:
            if self.phase == UNSUBSCRIBED:
                return
            self.phase, self.fault, query, self.query = UNSUBSCRIBED, error, self.query, None
        for s in self._running():
            s.stop()
            s.consumer.on_dropped(SERVER_ERROR, error)
        if query is not None:
            self._end(query)

    def _watch(self) -> None:
        while not self._ended.wait(WATCH):
            for s in self._running():
                s.tick()
            query = self.query
            if query is None or self.phase == UNSUBSCRIBED:
                continue
            with contextlib.suppress(Exception):
                error = query.exception()
                if error is not None:
                    self._drop(error)
                elif self._following and self.head is not None:
                    self._compare()

    def _compare(self) -> None:
        """Live or behind, by the end of the last batch and the log's head."""
        progress = self.query.lastProgress
        if not progress or not progress["sources"]:
            return
        found = re.search(r"-?\d+", str(progress["sources"][0]["endOffset"]))  # {"position": p}
        at = int(found[0]) if found else None
        head = self.head()
        behind = head is not None and (at is None or at < head)
        if behind == self._behind:
            return
        self._behind, self.phase = behind, CATCHING_UP if behind else LIVE
        for s in self._running():
            with s.lock:
                (s.fall_behind if behind else s.catch_up)()

    # -- what users call -------------------------------------------------------------------------

    def start(self) -> None:
        for s in self.sessions.values():
            if s.status == UNINITIALIZED:
                s.initialize()
            s.begin()
        self.phase, self.fault = CATCHING_UP, None
        for s in self.sessions.values():
            s.consumer.on_catching_up()
        self.query = self._begin(live=False)
        self._ended.clear()
        threading.Thread(target=self._watch, daemon=True).start()

    def catch_up(self) -> None:
        """Wait until all have handled what there is, or are suspended; then those that run are live."""
        if self.query is None:
            raise self.fault if self.fault is not None else InvalidState("the subscription isn't started")
        self._wait(self.query)
        with self._lock:
            if self.query is None:
                return
            self._end(self.query)
            self.phase = LIVE
            for s in self._running():
                s.go_live()

    def follow(self) -> None:
        """Go on with new events until ``stop``."""
        with self._lock:
            if self._running():
                self.query, self._following, self._behind = self._begin(live=True), True, False

    def flush(self) -> None:
        """Wait until all that has arrived is handled."""
        query = self.query
        if query is not None and query.isActive:
            self._wait(query)

    def resume(self, name: str) -> None:
        """A suspended consumer handles the event it stands at again, and goes on.

        It catches up in a query of its own, while the others follow theirs; then all
        share one again, which begins behind the least of their positions.
        """
        s = self.sessions[name]
        self._apart.add(name)
        s.resume()
        own = self._begin(live=False, only=name)
        try:
            self._wait(own)
        finally:
            self._end(own)
        if s.status == RUNNING and self.phase == LIVE:
            s.go_live()
        with self._lock:
            shared = self.query is not None and self.query.isActive
            if shared:
                self._end(self.query)
            self._apart.discard(name)
            if shared and self._running():
                self.query = self._begin(live=self._following)

    def stop(self) -> None:
        self._ended.set()
        with self._lock:
            query, self.query, self.phase, self._following = self.query, None, UNSUBSCRIBED, False
        if query is not None:
            self._end(query)
        for s in self.sessions.values():
            if s.status in (RUNNING, SUSPENDED):
                s.consumer.on_dropped(SUBSCRIBER_ERROR if s.status == SUSPENDED else DISPOSED, s.error)
                s.stop()

    def status(self) -> DataFrame:
        """A row for each consumer: status, position, error, and the position of the event it failed at."""
        rows = [(s.name, s.status, self.phase, s.last, None if (e := s.error or self.fault) is None else str(e), None if s.faulted is None else s.faulted["global_position"]) for s in self.sessions.values()]
        return self.spark.createDataFrame(rows, "consumer string, status string, phase string, position long, error string, faulted_position long")
