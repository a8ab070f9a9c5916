"""More named queries: entities and aggregates in Python, other codecs and sources, and what consumers are told.

Registered in ``catalog.QUERIES`` like those of ``catalog``, whose tables and roles they share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Generic, TypeVar

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions import EventTypes
from ..functions.naming import id_selector
from ..operators.aggregates import MATERIALIZE_FIRST, NEVER, WHILE_ENUMERATING, AggregateType, Model, applies
from ..operators.entities import AdapterRegistry
from ..operators.snapshots import load_with_strategy, take_snapshots
from ..scratch import scratch_path
from ..sources.connectors import log_from_files
from ..sources.store import EventStore
from ..streaming.runner import IGNORED, RETRY, SKIP, CheckpointFrequency, Consumer, Interceptor, Subscription, intercepted, on
from ..streaming.state_projection import EventError, HandlerProjection, StateProjection
from ..streaming.stateful import run_available
from .catalog import ITEMS_SQL, SNAPSHOTS_SQL, _broken, _named, _snapshots, _store, item, log_of, query, snapshot_fold
from .fold import Reducer, reduce_streams

# -- aggregates and entities ---------------------------------------------------------------------


@query("snapshot_where", f"WITH {SNAPSHOTS_SQL} SELECT l.stream_name, max(stream_position) AS version, count(*) FILTER (name = 'purchase') AS purchases FROM {{LOG}} l LEFT JOIN latest ON l.stream_name = latest.stream_name GROUP BY l.stream_name HAVING count(*) FILTER (stream_position > coalesce(snapshot_version, -1)) >= 40")
def snapshot_where(spark: SparkSession, sf: str) -> DataFrame:
    """Loaded from the latest snapshots, another one is taken of the streams that had many events behind theirs."""
    log = log_of(spark, sf)
    loaded = load_with_strategy(log, snapshot_fold(), _snapshots(log))
    return _named(take_snapshots(loaded, snapshot_fold(), F.col("events_loaded") >= 40), "version", F.col("state.purchases").alias("purchases"))


@dataclass
class Tally:
    n: int = 0


@dataclass(frozen=True)
class Counted:
    """Tells how many were counted when it was made."""

    at: int


def _count(tally: Tally, event: Counted) -> None:
    tally.n += 1


def _twice(tally: Tally) -> Iterator[Counted]:
    yield Counted(tally.n)
    yield Counted(tally.n)


@query("apply_modes", "SELECT stream_name, 0 AS never, 0 AS never_seen, 2 * p AS first, 2 * p * (p - 1) AS first_seen, 2 * p AS enumerating, p * (2 * p - 1) AS enumerating_seen FROM (SELECT stream_name, count(*) FILTER (name = 'purchase') AS p FROM {LOG} GROUP BY 1)")
def apply_modes(spark: SparkSession, sf: str) -> DataFrame:
    """A command raises two events for each purchase; when they are applied decides what the second one sees."""
    modes = {"never": NEVER, "first": MATERIALIZE_FIRST, "enumerating": WHILE_ENUMERATING}
    kinds = {n: AggregateType(Tally, mutable=True, id_of=id, appliers={Counted: _count}, apply_events=m) for n, m in modes.items()}

    def step(state: dict, event: dict) -> dict:
        if event["name"] == "purchase":
            for n, kind in kinds.items():
                tally, seen = state[n]
                tally, raised = kind.execute(tally, _twice)
                state[n] = tally, seen + sum(e.at for e in raised)
        return state

    names = [x for n in modes for x in (n, f"{n}_seen")]
    row = lambda s: {k: v for n in modes for k, v in ((n, s[n][0].n), (f"{n}_seen", s[n][1]))}
    reducer = Reducer(lambda: {n: (k.new(), 0) for n, k in kinds.items()}, step, row, StructType([StructField(n, LongType()) for n in names]), ("name",))
    return _named(reduce_streams(log_of(spark, sf), reducer, "user_id"), *names)


@dataclass(frozen=True)
class CartEvent:
    k: int


@dataclass(frozen=True)
class Begun(CartEvent): ...


@dataclass(frozen=True)
class Added(CartEvent): ...


@dataclass(frozen=True)
class Removed(CartEvent): ...


@dataclass(frozen=True)
class Cart:
    started: bool = False
    items: frozenset = field(default_factory=frozenset)

    def apply_begun(self, event: Begun) -> Cart:
        raise AssertionError("what is configured comes before what is found")

    def apply_added(self, event: Added) -> Cart:
        return replace(self, items=self.items | {event.k})

    @applies(Removed)
    def drop(self, event: object) -> Cart:
        return replace(self, items=self.items - {event.k})


@query("discovered_appliers", f"SELECT stream_name, bool_or(name = 'signup') AS started, coalesce(max(n), 0) AS items FROM {{LOG}} l LEFT JOIN (SELECT user_id, count(*) AS n FROM ({ITEMS_SQL}) GROUP BY 1) i ON l.user_id = i.user_id GROUP BY stream_name")
def discovered_appliers(spark: SparkSession, sf: str) -> DataFrame:
    """Events by their base, former names, appliers by name, by mark, and one that is configured instead."""
    types = EventTypes().map_all(CartEvent).map(Begun, "SessionStarted", ["signup"]).map(Added, "ItemAdded", ["purchase"]).map(Removed, "ItemRemoved", ["error"])
    kind = Model(types).add(AggregateType(Cart, id_of=id, appliers={Begun: lambda s, e: replace(s, started=True)}).discover()).of(Cart)
    known = {n for t in types.types for n in t.names}

    def step(state: Cart, event: dict) -> Cart:
        return kind.apply(state, types.to_object(event["name"], event["payload"])) if event["name"] in known else state

    schema = StructType([StructField("started", BooleanType()), StructField("items", LongType())])
    reducer = Reducer(kind.new, step, lambda s: {"started": s.started, "items": len(s.items)}, schema, ("name", "payload"))
    return _named(reduce_streams(log_of(spark, sf), reducer, "user_id"), "started", "items")


S = TypeVar("S")


class Entity(Generic[S]):
    def __init__(self, state: S):
        self.state = state


@dataclass
class BasketState:
    basket_id: int | None = None
    items: int = 0


class Basket(Entity[BasketState]):
    @property
    def basket_id(self) -> int | None:
        return self.state.basket_id


class GenericAdapter:
    """For any entity: the state is what the base is given, the id what the entity's own selector reads."""

    def __init__(self, kind: type, state: type):
        self.kind, self.state, self.select = kind, state, id_selector(kind)

    def create_state(self) -> object:
        return self.state()

    def fold(self, state: BasketState, event: dict) -> BasketState:
        return replace(state, basket_id=event["user_id"], items=state.items + (event["name"] == "purchase"))

    def create(self, state: object) -> Entity:
        return self.kind(state)

    def current_state(self, entity: Entity) -> object:
        return entity.state

    def id_of(self, entity: Entity) -> object:
        return self.select(entity)

    def raised(self, entity: Entity) -> Iterable[object]:
        return ()


@query("generic_entities", "SELECT stream_name, any_value(user_id) AS entity_id, count(*) FILTER (name = 'purchase') AS items FROM {LOG} GROUP BY 1")
def generic_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of a type without an adapter of its own: it is made from that of the base, with the base's argument."""
    adapter = AdapterRegistry().add_generic(Entity, GenericAdapter).find(Basket)

    def row(state: BasketState) -> dict:
        entity = adapter.create(state)
        return {"entity_id": adapter.id_of(entity), "items": adapter.current_state(entity).items}

    reducer = Reducer(adapter.create_state, adapter.fold, row, StructType([StructField("entity_id", LongType()), StructField("items", LongType())]), ("name",))
    return _named(reduce_streams(log_of(spark, sf), reducer, "user_id"), "entity_id", "items")


# -- payloads and sources ------------------------------------------------------------------------


class LineCodec:
    """Payloads as fields between bars, in the schema's order."""

    content_type = "text/csv"

    def encode(self, *columns: Column | str) -> Column:
        return F.to_csv(F.struct(*columns), {"sep": "|"})

    def decode(self, payload: Column, schema: StructType, mode: str = "failfast") -> Column:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        return F.from_csv(payload, ddl, {"sep": "|", "mode": mode.upper()})


@query("other_codec", "SELECT global_position, stream_name || '|' || k AS payload, k, stream_name AS owner FROM {LOG} WHERE name = 'purchase'")
def other_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Written and read with a codec that is no JSON."""
    types = EventTypes(LineCodec()).map("owner string, k long", "ItemAdded", ["purchase"])
    log = log_of(spark, sf).where(F.col("name") == "purchase").withColumn("k", item())
    name, payload = types.encode("ItemAdded", F.col("stream_name").alias("owner"), F.col("k"))
    written = log.select("global_position", name.alias("name"), payload.alias("payload"))
    return types.decode(written, "ItemAdded").select("global_position", "payload", "event.k", "event.owner")


@query("log_of_files", "SELECT stream_name, stream_position, global_position, name, payload, stream_name AS by_stream FROM {LOG}")
def log_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """A log kept as JSON lines under other column names, with its metadata as text."""
    path = scratch_path(spark, "lines")
    log = log_of(spark, sf).select(F.col("stream_name").alias("StreamId"), F.col("stream_position").alias("Version"), F.col("global_position").alias("Position"), F.col("name").alias("Type"), F.col("payload").alias("Data"), F.to_json(F.create_map(F.lit("stream"), F.col("stream_name"))).alias("Meta"))
    log.write.json(path)
    names = {"stream_name": "StreamId", "stream_position": "Version", "global_position": "Position", "name": "Type", "payload": "Data", "metadata": "Meta"}
    return log_from_files(spark, path, "json", names).select("stream_name", "stream_position", "global_position", "name", "payload", F.element_at("metadata", "stream").alias("by_stream"))


# -- consumers -----------------------------------------------------------------------------------

TOLD_EVERY = 250


@query(
    "projection_callbacks",
    f"""WITH h AS (SELECT global_position, k, (row_number() OVER (ORDER BY global_position) - 1) // {TOLD_EVERY} AS i FROM {{LOG}} WHERE name = 'signup')
 SELECT 'checkpoint' AS hook, CAST(i + 1 AS BIGINT) AS state, max(global_position) AS position, count(*) AS events, CAST(sum(k) AS BIGINT) AS items, 'catching_up' AS status FROM h GROUP BY i
 UNION ALL SELECT hook, NULL, NULL, NULL, NULL, status FROM (VALUES ('starting', NULL), ('catching_up', NULL), ('dropped', 'Disposed')) t(hook, status)""",
)
def projection_callbacks(spark: SparkSession, sf: str) -> DataFrame:
    """A state from one checkpoint to the next, made of a resource and the status; no event is left when it goes live, so that isn't told."""
    told: list[tuple] = []
    made: list[int] = []

    class State:
        def __init__(self, number: int, status: str):
            self.number, self.status, self.events, self.items = number, status, 0, 0

    def resource() -> int:
        made.append(len(made) + 1)
        return made[-1]

    def signed_up(state: State, event: dict) -> None:
        state.events, state.items = state.events + 1, state.items + event["k"]

    types = EventTypes().map("k long", "SessionStarted", ["signup"])
    projection = StateProjection("starts", types, State, resource=resource, every=CheckpointFrequency(events=TOLD_EVERY)).when("SessionStarted", signed_up)
    projection.on("starting", lambda: told.append(("starting", None, None, None, None, None)))
    projection.on("catching_up", lambda: told.append(("catching_up", None, None, None, None, None)))
    projection.on("checkpoint", lambda s, position: told.append(("checkpoint", s.number, position, s.events, s.items, s.status)))
    projection.on("live", lambda s: told.append(("live", s.number, None, s.events, s.items, s.status)))
    projection.on("dropped", lambda reason, error: told.append(("dropped", None, None, None, None, reason)))
    _run(spark, _store(spark, sf), projection)
    return spark.createDataFrame(told, "hook string, state long, position long, events long, items long, status string")


def _run(spark: SparkSession, store: EventStore, *consumers: Consumer) -> None:
    sub = Subscription(spark, store.stream, consumers, scratch_path(spark, "offsets"))
    sub.start()
    sub.catch_up()
    sub.stop()


@query(
    "projection_errors",
    """WITH h AS (SELECT global_position AS position, k, global_position % 97 = 0 AS broken FROM {LOG} WHERE name = 'signup')
 SELECT position, NOT broken AS decoded, CASE WHEN broken THEN 'payload of ''signup'' can''t be decoded' ELSE 'refused' END AS error, CASE WHEN broken THEN 'skip' ELSE 'retry' END AS answer FROM h WHERE broken OR k = 13
 UNION ALL SELECT max(position), true, NULL, CAST(count(*) AS VARCHAR) FROM h WHERE NOT broken""",
)
def projection_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads that can't be decoded are skipped, events that are refused once are tried again; the last row has what was handled."""
    told: list[tuple] = []
    seen = {"handled": 0, "checkpoint": None, "refused": False}

    def signed_up(event: dict) -> None:
        seen["refused"] = event["k"] == 13 and not seen["refused"]
        if seen["refused"]:
            raise ValueError("refused")
        seen["handled"] += 1

    def failed(what: EventError) -> str:
        answer = RETRY if what.event is not None else SKIP
        told.append((what.position, what.event is not None, str(what.error), answer))
        return answer

    types = EventTypes().map("k long", "SessionStarted", ["signup"])
    projection = HandlerProjection("errors", types, every=CheckpointFrequency(events=1000)).when("SessionStarted", signed_up).on("error", failed)
    projection.on("checkpoint", lambda position: seen.update(checkpoint=position))
    store = EventStore(spark, scratch_path(spark, "store"))
    store.import_log(_broken(log_of(spark, sf)))
    _run(spark, store, projection)
    return spark.createDataFrame([*told, (seen["checkpoint"], True, None, str(seen["handled"]))], "position long, decoded boolean, error string, answer string")


@query(
    "consumer_lifecycle",
    """WITH p AS (SELECT max(global_position) FILTER (name = 'purchase') AS last, min(global_position) FILTER (name = 'error') AS bad FROM {LOG})
 SELECT step, consumer, status, phase, CASE WHEN consumer = 'whole' AND step <> 'made' THEN last END AS position, CASE WHEN consumer = 'broken' AND step <> 'made' THEN 'it is broken' END AS error, CASE WHEN consumer = 'broken' AND step <> 'made' THEN bad END AS faulted_position
 FROM p, (VALUES ('made', 'whole', 'Uninitialized', 'Unsubscribed'), ('made', 'broken', 'Uninitialized', 'Unsubscribed'), ('live', 'whole', 'Running', 'Live'), ('live', 'broken', 'Suspended', 'Live'),
  ('stopped', 'whole', 'Stopped', 'Unsubscribed'), ('stopped', 'broken', 'Stopped', 'Unsubscribed')) t(step, consumer, status, phase)
 UNION ALL SELECT 'dropped', consumer, reason, NULL, NULL, error, NULL FROM (VALUES ('whole', 'Disposed', NULL), ('broken', 'SubscriberError', 'it is broken')) d(consumer, reason, error)""",
)
def consumer_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Status, phase and position of a consumer that goes through and of one that fails, and why each is dropped."""
    store = _store(spark, sf)
    dropped: list[tuple] = []

    class Told(Consumer):
        def on_dropped(self, reason: str, error: Exception | None) -> None:
            dropped.append(("dropped", self.name, reason, None, None, str(error) if error else None, None))

    class Whole(Told):
        name = "whole"

        def handlers(self) -> dict:
            return {"purchase": self.on_event}

        def on_batch(self, batch: DataFrame, number: int) -> bool:
            return True

    class Broken(Told):
        name = "broken"

        @on("error")
        def fails(self, event: Row) -> None:
            raise RuntimeError("it is broken")

    sub = Subscription(spark, store.stream, [Whole(), Broken()], scratch_path(spark, "offsets"))
    rows: list[tuple] = []
    see = lambda step: rows.extend((step, *r) for r in sub.status().select("consumer", "status", "phase", "position", "error", "faulted_position").collect())
    see("made")
    sub.start()
    sub.catch_up()
    see("live")
    sub.stop()
    see("stopped")
    return spark.createDataFrame(rows + dropped, "step string, consumer string, status string, phase string, position long, error string, faulted_position long")


@query("interceptors", "SELECT 'outer' AS layer, name, count(*) AS n FROM {LOG} WHERE name IN ('signup', 'error') GROUP BY name UNION ALL SELECT 'consumer', name, count(*) FROM {LOG} WHERE name = 'signup' OR name = 'error' AND k >= 50 GROUP BY name")
def interceptors(spark: SparkSession, sf: str) -> DataFrame:
    """One around the other: the outer sees all that is handled, the inner lets some pass to the consumer."""
    seen: Counter = Counter()

    class Outer(Interceptor):
        def on_event(self, event: Row) -> str:
            seen["outer", event["name"]] += 1
            return super().on_event(event)

    class Inner(Interceptor):
        def on_event(self, event: Row) -> str:
            if event["name"] == "error" and types.to_object(event["name"], event["payload"])["k"] < 50:
                return IGNORED
            return super().on_event(event)

    class Counts(Consumer):
        catch_up = CheckpointFrequency(events=1000)

        @on("signup", "error")
        def count(self, event: Row) -> None:
            seen["consumer", event["name"]] += 1

    types = EventTypes().map("k long", "ItemRemoved", ["error"])
    _run(spark, _store(spark, sf), intercepted(Counts(), Outer(), Inner()))
    return spark.createDataFrame([(layer, name, n) for (layer, name), n in seen.items()], "layer string, name string, n long")


@query("bounded_batches", "SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events, (SELECT (max(event_id) + 4) // 4 AS most FROM events) GROUP BY event_id // most")
def bounded_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A stream that takes a quarter of the log at a time."""
    store, folder = _store(spark, sf), scratch_path(spark, "batches")
    told = lambda batch, n: batch.agg(F.count("*").alias("n"), F.min("global_position").alias("first"), F.max("global_position").alias("last")).write.mode("overwrite").parquet(f"{folder}/v/batch={n}")
    run_available(store.stream(most=((store.head() or 0) + 4) // 4), told, f"{folder}/_offsets")
    return spark.read.parquet(f"{folder}/v").select("n", "first", "last")
