"""Projections in batch: routing, read-model tables, checkpoints, fan-out.

The consumers of a log are configuration (a few rows), so routing is a lookup in a
literal map and an explode: one scan serves them all and nothing is joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import union
from .fold import Fold
from .numbering import running_number


def route(log: DataFrame, handled: Mapping[str, Iterable[str]]) -> DataFrame:
    """A row for each event and consumer that handles its name, with ``consumer``; other events are dropped undecoded."""
    by_name: dict[str, list[str]] = {}
    for consumer, names in handled.items():
        for n in names:
            by_name.setdefault(n, []).append(consumer)
    if not by_name:
        return log.withColumn("consumer", F.lit("")).where(F.lit(False))
    table = F.create_map(*[x for n, cs in by_name.items() for x in (F.lit(n), F.array(*map(F.lit, cs)))])
    return log.where(F.col("name").isin(list(by_name))).withColumn("consumer", F.explode(F.element_at(table, F.col("name"))))


def consumer_events(log: DataFrame, handled: Mapping[str, Iterable[str]], starts: Mapping[str, int | None]) -> DataFrame:
    """As ``route``, without what a consumer has behind it: events up to its own start position.

    The scan begins behind the least start, which reaches the files' statistics.
    """
    least = None if any(starts.get(c) is None for c in handled) else min((starts[c] for c in handled), default=None)
    scanned = log if least is None else log.where(F.col("global_position") > least)
    known = {c: p for c, p in starts.items() if p is not None}
    routed = route(scanned, handled)
    if not known:
        return routed
    start = F.element_at(F.create_map(*[x for c, p in known.items() for x in (F.lit(c), F.lit(p).cast("long"))]), F.col("consumer"))
    return routed.where(start.isNull() | (F.col("global_position") > start))


def checkpoint_positions(handled: DataFrame, every: int, position: str = "global_position") -> DataFrame:
    """The positions at which a consumer of these events checkpoints: each ``every`` events, and the last one when it goes live."""
    numbered = running_number(handled.select(position), position)
    last = handled.agg(F.max(position).alias("_last"))
    at = numbered.join(F.broadcast(last), F.col(position) == F.col("_last"), "left")  # one row
    return at.where((F.col("number") % every == 0) | F.col("_last").isNotNull()).select(F.col(position).alias("position"))


def checkpoint_positions_live(handled: DataFrame, every: int, live_from: int, live_every: int, position: str = "global_position") -> DataFrame:
    """As ``checkpoint_positions`` for events up to ``live_from``; those behind are handled live, and counted anew by ``live_every``."""
    caught_up = checkpoint_positions(handled.where(F.col(position) <= live_from), every, position)
    numbered = running_number(handled.where(F.col(position) > live_from).select(position), position)
    return union(caught_up, numbered.where(F.col("number") % live_every == 0).select(F.col(position).alias("position")))


def checkpoint_times(handled: DataFrame, at: str, seconds: int, position: str = "global_position") -> DataFrame:
    """The positions at which a timer of some seconds checkpoints: the last event before each tick, where there was one since the last."""
    tick = F.floor(F.unix_timestamp(at) / F.lit(seconds))
    return handled.groupBy(tick.alias("_tick")).agg(F.max(position).alias("position")).select("position")


def per_checkpoint(handled: DataFrame, every: int, fold: Fold) -> DataFrame:
    """The fold of each stream in each checkpoint interval: state that lives from one checkpoint to the next.

    ``interval`` counts from 0; the key is (interval, stream).
    """
    numbered = running_number(handled, "global_position", "_number").withColumn("interval", F.floor((F.col("_number") - 1) / F.lit(every)).cast("long"))
    composite = numbered.withColumn("_key", F.struct("interval", fold.key))
    own = Fold(fold.rules, fold.guard, fold.started, "_key", fold.order, fold.extra)
    out = own.apply(composite)
    return out.select("_key.interval", f"_key.{fold.key}", *own.state(), "version", "events")


@dataclass
class Projection:
    """A read-model table: rows by key, written by upserts and deletes, the last operation of a key wins.

    ``upsert`` and ``delete`` name an event and give the key columns (and values) as
    expressions over the event.
    """

    keys: tuple[str, ...]
    values: tuple[str, ...] = ()
    position: str = "global_position"
    ops: dict[str, tuple[bool, dict[str, Column]]] = field(default_factory=dict)

    def upsert(self, name: str, **columns: Column) -> Projection:
        self._check(columns, (*self.keys, *self.values))
        self.ops[name] = (True, columns)
        return self

    def delete(self, name: str, **columns: Column) -> Projection:
        self._check(columns, self.keys)
        self.ops[name] = (False, columns)
        return self

    @staticmethod
    def _check(columns: Mapping[str, Column], wanted: Iterable[str]) -> None:
        if missing := set(wanted) - columns.keys():
            raise ValueError(f"no expression for {sorted(missing)}")

    @property
    def names(self) -> list[str]:
        return list(self.ops)

    def operations(self, log: DataFrame) -> DataFrame:
        """Key, values, ``_at`` and ``_in`` of each event that the projection handles."""

        def pick(column: str) -> Column:
            out = None
            for name, (_, columns) in self.ops.items():
                value = columns.get(column, F.lit(None))
                out = F.when(F.col("name") == name, value) if out is None else out.when(F.col("name") == name, value)
            return out.alias(column)

        puts = [n for n, (put, _) in self.ops.items() if put]
        return log.where(F.col("name").isin(self.names)).select(*[pick(c) for c in (*self.keys, *self.values)], F.col(self.position).alias("_at"), F.col("name").isin(puts).alias("_in"))

    def latest(self, operations: DataFrame) -> DataFrame:
        """The last operation of each key, deletions included: what a later batch merges with."""
        kept = operations.groupBy(*self.keys).agg(F.max_by(F.struct("_in", "_at", *self.values), "_at").alias("_last"))
        return kept.select(*self.keys, *[f"_last.{c}" for c in (*self.values, "_at", "_in")])

    def rows(self, latest: DataFrame) -> DataFrame:
        return latest.where("_in").select(*self.keys, *self.values)

    def apply(self, log: DataFrame) -> DataFrame:
        """The table after all events."""
        return self.rows(self.latest(self.operations(log)))

    def merge(self, kept: DataFrame, log: DataFrame) -> DataFrame:
        """The latest operations after more events; handling an event again changes nothing."""
        return self.latest(union(kept, self.operations(log)))


def first_of_each(df: DataFrame, key: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")
