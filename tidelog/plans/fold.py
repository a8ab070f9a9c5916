"""The fold compiler: the state of every stream at once, by the cheapest exact plan.

A fold names a rule for each field of the state.  The rules and their plans:

* ``Total``, ``Count``, ``Least``, ``Greatest`` (F1): conditional aggregates, with
  partial aggregation before the shuffle.
* ``LastValue`` (F2): ``max_by`` over the position.
* ``KeyedSet`` (F3): last operation of each element, then the elements that stay.
* a ``guard`` (F4): events count only behind the first guard event; its position is
  a window over the same key, so the shuffle is shared with the aggregate.
* ``Steps`` (F5): any sequence of column expressions over the ordered events of a
  stream (``aggregate`` over a sorted array, so a stream has to fit in memory).
* ``Reducer`` (F6): a Python function for each event.  Rows are sorted by stream and
  position and pass through once; a task holds one state, whatever a stream's length.

A fold can start from earlier states (snapshots): these are unioned with the log and
meet their tail in the same shuffle.

Cases: a stream with no event that any rule reads has the rules' initial values; null
amounts count as 0 and null values are values; an empty log gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, union


def _case(values: Mapping[str, Column], live: Column, otherwise: Column | None = None) -> Column:
    out = None
    for name, value in values.items():
        test = live & (F.col("name") == name)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if otherwise is None else out.otherwise(otherwise)


def _columns(values: Mapping[str, object]) -> dict[str, Column]:
    return {n: v if isinstance(v, Column) else F.lit(v) for n, v in values.items()}


@dataclass(frozen=True)
class Total:
    """The sum of an amount for each event name."""

    amounts: Mapping[str, object]
    kind: str = "long"
    level = 1

    def agg(self, live: Column, order: str) -> Column:
        return F.coalesce(F.sum(_case(_columns(self.amounts), live)), F.lit(0)).cast(self.kind)

    def combine(self, part: Column) -> Column:
        return F.sum(part).cast(self.kind)

    def merge(self, seed: Column, got: Column) -> Column:
        return (F.coalesce(seed, F.lit(0)) + got).cast(self.kind)


def Count(*names: str) -> Total:
    """The number of events of some names."""
    return Total(dict.fromkeys(names, 1))


@dataclass(frozen=True)
class Least:
    values: Mapping[str, object]
    level = 1

    def agg(self, live: Column, order: str) -> Column:
        return F.min(_case(_columns(self.values), live))

    def combine(self, part: Column) -> Column:
        return F.min(part)

    def merge(self, seed: Column, got: Column) -> Column:
        return F.least(seed, got)


@dataclass(frozen=True)
class Greatest:
    values: Mapping[str, object]
    level = 1

    def agg(self, live: Column, order: str) -> Column:
        return F.max(_case(_columns(self.values), live))

    def combine(self, part: Column) -> Column:
        return F.max(part)

    def merge(self, seed: Column, got: Column) -> Column:
        return F.greatest(seed, got)


@dataclass(frozen=True)
class LastValue:
    """A value of the last event of some names."""

    values: Mapping[str, object]
    level = 2

    def agg(self, live: Column, order: str) -> Column:
        there = live & F.col("name").isin(list(self.values))
        return F.max(F.when(there, F.struct(F.col(order).alias("at"), _case(_columns(self.values), live).alias("value"))))

    def combine(self, part: Column) -> Column:
        return F.max(part)

    def merge(self, seed: Column, got: Column) -> Column:
        return F.when(got.isNotNull(), got["value"]).otherwise(seed)


@dataclass(frozen=True)
class KeyedSet:
    """The elements whose last operation is an add, sorted; null is no element of the field, but a row of ``rows``."""

    element: Column
    add: tuple[str, ...]
    remove: tuple[str, ...] = ()
    level = 3

    def rows(self, log: DataFrame, key: str = "stream_name", order: str = "stream_position", out: str = "element") -> DataFrame:
        """A row for each key and element that is in the set: the read model's rows."""
        ops = log.where(F.col("name").isin([*self.add, *self.remove])).select(key, self.element.alias(out), F.col(order).alias("_at"), F.col("name").isin(list(self.add)).alias("_in"))
        return ops.groupBy(key, out).agg(F.max_by("_in", "_at").alias("_in")).where("_in").drop("_in")


@dataclass(frozen=True)
class Steps:
    """init, then ``step[name](state, event)`` for each event in order; ``reads`` are the columns a step sees."""

    init: Column
    step: Mapping[str, Callable[[Column, Column], Column]]
    reads: tuple[str, ...]
    finish: Callable[[Column], Column] | None = None
    level = 5

    def agg(self, live: Column, order: str) -> Column:
        there = live & F.col("name").isin(list(self.step))
        return F.collect_list(F.when(there, F.struct(F.col(order).alias("at"), F.col("name").alias("name"), *[F.col(c).alias(c) for c in self.reads])))

    def combine(self, part: Column) -> Column:
        return F.flatten(F.collect_list(part))

    def merge(self, seed: Column, got: Column) -> Column:
        def one(state: Column, event: Column) -> Column:
            out = None
            for name, f in self.step.items():
                test = event["name"] == name
                out = F.when(test, f(state, event)) if out is None else out.when(test, f(state, event))
            return out.otherwise(state)

        state = F.aggregate(F.array_sort(got), F.coalesce(seed, self.init), one)
        return self.finish(state) if self.finish else state


@dataclass(frozen=True)
class Reducer:
    """A Python state: ``step(state, event)`` with the event as a dict; ``row(state)`` is the result."""

    init: Callable[[], object]
    step: Callable[[object, dict], object]
    row: Callable[[object], dict]
    schema: T.StructType
    reads: tuple[str, ...]


@dataclass(frozen=True)
class Fold:
    """Rules by field.  ``guard``: events count only behind a stream's first event of that name."""

    rules: Mapping[str, object]
    guard: str | None = None
    started: str | None = None
    key: str = "stream_name"
    order: str = "stream_position"
    extra: Mapping[str, Column] = field(default_factory=dict)
    #: For streams too long for one task: the guard's position comes from a partial aggregate and a join, whose skewed keys AQE splits, so the events of a stream meet in no task.
    long_streams: bool = False

    @property
    def strategy(self) -> str:
        """F1 to F5: the most general rule in use."""
        level = max([r.level for r in self.rules.values()], default=1)
        return f"F{max(level, 4) if self.guard and level < 5 else level}"

    @property
    def names(self) -> list[str]:
        """The event names that some rule reads."""
        found = [self.guard] if self.guard else []
        for r in self.rules.values():
            for x in (getattr(r, a, ()) for a in ("amounts", "values", "step", "add", "remove")):
                found += list(x)
        return list(dict.fromkeys(found))

    def apply(self, log: DataFrame, seeds: DataFrame | None = None, seeded_only: bool = False) -> DataFrame:
        """key, the fields, ``version`` (last position) and ``events`` (loaded, seeds not counted) of each stream.

        seeds has key, ``version`` and a struct ``state`` of the fields; of several of a
        stream the latest counts, and its version is told as ``snapshot_version``.
        seeded_only: leave streams without a seed out.
        """
        key, order = self.key, self.order
        sets = [n for n, r in self.rules.items() if isinstance(r, KeyedSet)]
        if sets and (seeds is not None or self.guard):
            raise ValueError("a KeyedSet can't be seeded or guarded; use Steps")
        if len(sets) == 1 and not self.extra:
            return self._nested(log, sets[0])
        inline = {n: r for n, r in self.rules.items() if not isinstance(r, KeyedSet)}
        events = log
        seed, is_event = None, F.lit(True)
        if seeds is not None:
            marked = seeds.select(key, F.col("version").alias(order), F.col("state").alias("_seed"), F.lit(True).alias("_is_seed"))
            events = union(log.withColumn("_is_seed", F.lit(False)), marked, missing=True)
            from_ = F.max(F.when(F.col("_is_seed"), F.col(order))).over(Window.partitionBy(key))
            events = events.withColumn("_from", from_ if seeded_only else F.coalesce(from_, F.lit(-1))).where(F.col("_is_seed") | (F.col(order) > F.col("_from")))
            seed, is_event = F.max_by("_seed", F.when(F.col("_is_seed"), F.col(order))), ~F.col("_is_seed")
        live = is_event
        if self.guard:
            first = F.min(F.when(is_event & (F.col("name") == self.guard), F.col(order)))
            if self.long_streams and seeds is None:
                starts = log.where(F.col("name") == self.guard).groupBy(key).agg(F.min(order).alias("_start"))
                events = events.join(starts, key, "left")
            else:
                events = events.withColumn("_start", first.over(Window.partitionBy(key)))
            if seeds is not None and self.started:
                events = events.withColumn("_start", F.when(F.max(F.when(F.col("_is_seed"), F.col("_seed")[self.started])).over(Window.partitionBy(key)), F.lit(-1)).otherwise(F.col("_start")))
            live = is_event & (F.col(order) > F.col("_start"))
        aggs = [r.agg(live, order).alias(f"_{n}") for n, r in inline.items()]
        if self.guard and self.started:
            aggs.append(F.coalesce(F.max(F.col("_start").isNotNull()), F.lit(False)).alias(f"_{self.started}"))
        aggs += [c.alias(n) for n, c in self.extra.items()]
        aggs += [F.max(order).alias("version"), F.count(F.when(is_event, 1)).alias("events")]
        if seed is not None:
            aggs += [seed.alias("_seed"), F.max(F.when(F.col("_is_seed"), F.col(order))).alias("snapshot_version")]
        out = events.groupBy(key).agg(*aggs)

        def seeded(n: str) -> Column:
            return F.col("_seed")[n] if seeds is not None else F.lit(None)

        fields = []
        for n, r in inline.items():
            fields.append(r.merge(seeded(n), F.col(f"_{n}")).alias(n))
        if self.guard and self.started:
            fields.append(F.col(f"_{self.started}").alias(self.started))
        out = out.select(key, *fields, *self.extra, "version", "events", *["snapshot_version"] * (seeds is not None))
        for n in sets:  # several sets have elements of their own, so each takes a pass
            held = self.rules[n].rows(log, key, order).groupBy(key).agg(F.array_sort(F.collect_list("element")).alias(n))
            empty = F.array().cast(held.schema[n].dataType)
            out = out.join(held, key, "left").withColumn(n, F.coalesce(F.col(n), empty))
        return out

    def _nested(self, log: DataFrame, name: str) -> DataFrame:
        """One pass for a fold with one set: by key and element (with partial aggregation), then by key."""
        key, order, held = self.key, self.order, self.rules[name]
        inline = {n: r for n, r in self.rules.items() if n != name}
        ops = F.col("name").isin([*held.add, *held.remove])
        last = F.max(F.when(F.col("_op"), F.struct(F.col(order).alias("at"), F.col("name").isin(list(held.add)).alias("put"))))
        told = log.withColumn("_op", ops).withColumn("_element", F.when(ops, held.element))
        parts = told.groupBy(key, "_element").agg(last.alias("_last"), F.max(order).alias("_version"), F.count("*").alias("_events"), *[r.agg(F.lit(True), order).alias(f"_{n}") for n, r in inline.items()])
        there = F.collect_list(F.when(F.col("_last.put"), F.col("_element")))
        out = parts.groupBy(key).agg(there.alias(f"_{name}"), F.max("_version").alias("version"), F.sum("_events").alias("events"), *[r.combine(F.col(f"_{n}")).alias(f"__{n}") for n, r in inline.items()])
        fields = [F.array_sort(f"_{name}").alias(name) if n == name else r.merge(F.lit(None), F.col(f"__{n}")).alias(n) for n, r in self.rules.items()]
        return out.select(key, *fields, "version", "events")

    def state(self) -> list[str]:
        return [*self.rules, *([self.started] if self.guard and self.started else [])]


def reduce_streams(log: DataFrame, reducer: Reducer, key: str = "stream_name", order: str = "stream_position") -> DataFrame:
    """key, the reducer's row, ``version`` and ``events`` of each stream.

    The rows of a task pass through in order; the state of one stream at a time is held.
    """
    ship(log.sparkSession)
    result = [f.name for f in reducer.schema.fields]
    schema = T.StructType([log.schema[key], *reducer.schema.fields, T.StructField("version", T.LongType()), T.StructField("events", T.LongType())])
    narrow = log.select(F.col(key), F.col(order).alias("_at"), *[c for c in reducer.reads if c not in (key, order)])
    arrow_key = key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, at, n, out = None, None, None, 0, []

        def done() -> None:
            out.append({arrow_key: now} | reducer.row(state) | {"version": at, "events": n})

        types = None
        for b in batches:
            if types is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                types = to_arrow_schema(schema)
            for row in b.to_pylist():
                if n == 0 or row[arrow_key] != now:
                    if n:
                        done()
                    now, state, n = row[arrow_key], reducer.init(), 0
                at = row["_at"]
                state, n = reducer.step(state, row), n + 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=types)
                out = []
        if n:
            done()
            yield pa.RecordBatch.from_pylist(out, schema=types)

    ordered = narrow.repartition(F.col(key)).sortWithinPartitions(key, "_at")
    return ordered.mapInArrow(run, schema).select(key, *result, "version", "events")


def reduce_rows(events: list[dict], fold_step: Callable[[object, dict], object], init: object) -> object:
    """The plain fold of a list of events: what every strategy has to equal."""
    return reduce(fold_step, events, init)
