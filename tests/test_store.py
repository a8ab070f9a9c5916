"""The store, entities and aggregates: appends, conflicts, loads, snapshots."""

import weakref
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from tidelog.errors import InvalidState, SerializationError, SnapshotDoesNotExist, StreamNotFound, WrongExpectedVersion
from tidelog.functions import EventTypes, Expected, MetadataContext, StreamNaming
from tidelog.operators.aggregates import MATERIALIZE_FIRST, NEVER, WHILE_ENUMERATING, AggregateRepository, AggregateType, applies
from tidelog.operators.append import decide_appends
from tidelog.operators.entities import AdapterRegistry, EntityStore
from tidelog.operators.reads import after_position, pages, read_from, read_stream, stream_exists
from tidelog.operators.snapshots import PREFER_SNAPSHOT, USE_EVENT_STREAM, USE_SNAPSHOT
from tidelog.schema import APPEND_REQUEST, EVENT_LOG
from tidelog.sources.store import CommitTaken, EventStore


@dataclass
class Started:
    session_id: str


@dataclass
class ItemAdded:
    session_id: str
    item: str


@dataclass
class Numbered:
    number: int


TYPES = EventTypes().map(Started, "ShoppingSessionStarted").map(ItemAdded, "ItemAddedToShoppingCart").map(Numbered, "TestEvent")


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, str(tmp_path / "log"))


def events(n, start=1):
    return [("TestEvent", f'{{"number":{k}}}', None) for k in range(start, start + n)]


@pytest.mark.parametrize("n", [2, 5000])
def test_append_and_read(store, n):
    assert store.append("s", events(n), Expected.no_stream()) == n - 1
    rows = list(store.read_stream("s"))
    assert [r["stream_position"] for r in rows] == list(range(n))
    assert [r["global_position"] for r in rows] == list(range(n))


def test_expectations(store):
    store.append("s", events(2), Expected.any())
    assert store.append("s", events(1), Expected.at(1)) == 2
    with pytest.raises(WrongExpectedVersion, match="^Append failed due to wrong expected version. Stream: s, Expected Version: 1, Actual Version: 2$"):
        store.append("s", events(1), Expected.at(1))
    with pytest.raises(WrongExpectedVersion, match="Stream: s, Expected State: NoStream, Actual Version: 2"):
        store.append("s", events(1), Expected.no_stream())
    with pytest.raises(WrongExpectedVersion, match="Stream: t, Expected Version: 0$"):
        store.append("t", events(1), Expected.at(0))
    with pytest.warns(UserWarning):
        assert store.append("s", [], Expected.at(77)) is None
    assert store.log().count() == 3


def test_batch_in_request_order(spark, store):
    one = [("TestEvent", "{}", None)]
    asked = spark.createDataFrame([(1, "a", "no_stream", None, one), (2, "a", "no_stream", None, one), (3, "a", "version", 0, one * 2), (4, "b", "any", None, one), (5, "b", "any", None, [])], APPEND_REQUEST)
    out = {r["request_id"]: r for r in store.append_batch(asked).collect()}
    assert [(out[k]["accepted"], out[k]["new_version"]) for k in range(1, 6)] == [(True, 0), (False, None), (True, 2), (True, 0), (True, None)]
    assert sorted(r["global_position"] for r in store.log().collect()) == [0, 1, 2, 3]


def test_no_requests(spark, store):
    assert store.append_batch(spark.createDataFrame([], APPEND_REQUEST)).count() == 0
    heads = spark.createDataFrame([], "stream_name string, version long")
    shaped = spark.createDataFrame([], APPEND_REQUEST).withColumn("n", F.size("events"))
    assert decide_appends(shaped, heads).count() == 0


def test_second_writer_meets_the_conflict(spark, store, monkeypatch):
    """Another writer commits between the decision and the commit."""
    other, real, done = EventStore(spark, store.path), store._commit, []

    def late(number, what):
        if not done:
            done.append(other.append("s", events(1), Expected.no_stream()))
        real(number, what)

    monkeypatch.setattr(store, "_commit", late)
    with pytest.raises(WrongExpectedVersion):
        store.append("s", events(1), Expected.no_stream())
    assert store.log().count() == 1
    with pytest.raises(CommitTaken):
        other._commit(0, {})


def test_compaction_and_checkpoints(store):
    for _ in range(3):
        store.append("s", events(2), Expected.any())
    before = sorted(store.log().collect())
    store.compact()
    assert sorted(store.log().collect()) == before and len(store._live(store.commits())) == 1
    assert store.append("s", events(1), Expected.at(5)) == 6
    assert store.checkpoint("c") is None
    store.save_checkpoint("c", 3)
    store.save_checkpoint("c", 4)
    assert [tuple(r) for r in store.checkpoints().collect()] == [("c", 4)]


def test_reads(spark, store):
    store.append("s", events(5), Expected.any())
    log = store.log()
    at = lambda df: [r["stream_position"] for r in df.collect()]
    assert at(read_stream(log, "s", 2)) == [2, 3, 4] and at(read_stream(log, "s", 2, "backwards")) == [2, 1, 0]
    assert at(read_from(log, "s")) == [0, 1, 2, 3, 4] and at(read_from(log, "s", "default", "backwards")) == [4, 3, 2, 1, 0]
    assert at(read_from(log, "s", "end")) == [] and at(read_from(log, "s", "start", "backwards")) == [0]
    with pytest.raises(ValueError):
        read_from(log, "s", "middle")
    with pytest.raises(ValueError):
        read_stream(log, "s", -1)
    assert [len(p) for p in pages(log, "s", 2)] == [2, 2, 1]
    assert stream_exists(log, "s") and not stream_exists(log, "t")
    assert after_position(log, None).count() == 5 and after_position(log, 3).count() == 1
    assert spark.createDataFrame([], EVENT_LOG).count() == 0


class Cart:
    def __init__(self, state):
        self.state, self.raised = state, []

    def add(self, item):
        if item not in self.state["items"]:
            self.raised.append(ItemAdded(self.state["id"], item))


class CartAdapter:
    def create_state(self):
        return {"id": "", "items": []}

    def fold(self, state, event):
        if isinstance(event, Started):
            return state | {"id": event.session_id}
        return state | {"items": [*state["items"], event.item]}

    def create(self, state):
        return Cart(state)

    def current_state(self, entity):
        return entity.state

    def id_of(self, entity):
        return entity.state["id"]

    def raised(self, entity):
        return entity.raised


def test_entities(store):
    entities = EntityStore(store, TYPES, AdapterRegistry().add(Cart, CartAdapter()), {Cart: StreamNaming("shoppingCart")})
    with pytest.raises(StreamNotFound, match="^'?\"?Stream 'shoppingCart-cart-1' could not be found."):
        entities.load(Cart, "cart-1")
    cart = entities.load_or_create(Cart, "1")
    cart.state["id"] = "1"
    cart.raised += [Started("1"), ItemAdded("1", "a")]
    assert entities.save(cart) == 1
    with pytest.raises(InvalidState):
        entities.save(cart)
    first, second = entities.load(Cart, "1"), entities.load(Cart, "1")
    assert first.state == {"id": "1", "items": ["a"]} and entities.version_of(first) == 1
    assert entities.save(first) is None
    first.add("a")
    first.add("b")
    second.add("c")
    assert entities.save(first) == 2
    with pytest.raises(WrongExpectedVersion):
        entities.save(second)
    fresh = Cart({"id": "1", "items": []})
    fresh.add("z")
    with pytest.raises(WrongExpectedVersion, match="NoStream"):
        entities.save(fresh)
    ref = weakref.ref(first)
    del first
    assert ref() is None
    store.append("shoppingCart-9", [("TestEvent", "This is not JSON. It should fail on deserialize", None)], Expected.any())
    with pytest.raises(SerializationError):
        entities.load(Cart, "9")


def test_registry():
    class Sub(Cart):
        pass

    registry = AdapterRegistry().add_generic(Cart, lambda kind: CartAdapter())
    assert registry.find(Sub) is registry.find(Sub)
    with pytest.raises(LookupError):
        registry.find(int)
    with pytest.raises(ValueError):
        registry.add(Cart, object())


@dataclass
class Total:
    id: str = ""
    total: int = 0

    @applies(Numbered)
    def on_number(self, e):
        return Total(self.id, self.total + e.number)


def test_aggregates_and_snapshots(store):
    kind = AggregateType(Total).discover()
    repo = AggregateRepository(store, TYPES, metadata=MetadataContext({"who": "me"}))
    with pytest.raises(SnapshotDoesNotExist):
        repo.load(kind, "1", USE_SNAPSHOT)
    new = repo.load(kind, "1")
    assert (new.version, new.snapshot_version, new.events_loaded) == (-1, None, 0)
    new.execute(lambda s: [Numbered(1)] * 100)
    assert new.state.total == 100 and repo.save(new) == 99
    with pytest.raises(ValueError):
        repo.save(new)
    repo.save_snapshot(repo.load(kind, "1"))
    got = repo.load(kind, "1", USE_SNAPSHOT)
    assert (got.state.total, got.version, got.snapshot_version, got.events_loaded) == (100, 99, 99, 0)
    got.execute(lambda s: [Numbered(1)] * 10)
    # The snapshot that the predicate asks for has the new version, so nothing is applied twice.
    repo.save(got, snapshot_if=lambda a: True)
    again = repo.load(kind, "1", PREFER_SNAPSHOT)
    assert (again.state.total, again.snapshot_version, again.events_loaded) == (110, 109, 0)
    full = repo.load(kind, "1", USE_EVENT_STREAM)
    assert (full.state.total, full.snapshot_version, full.events_loaded) == (110, None, 110)
    assert store.log().where("stream_name = 'total-1'").first()["metadata"] == {"who": "me"}


@dataclass
class Changed:
    value: str


@dataclass
class Watch:
    id: str = ""
    value: str = ""
    seen: list = field(default_factory=list)
    raised: list = field(default_factory=list)

    def apply(self, e: Changed):
        self.value = e.value
        self.seen.append(e.value)

    def command(self):
        for k in (1, 2, 3):
            yield Changed(f"{self.value} {k}".strip() if self.value else f"value {k}")


@pytest.mark.parametrize(("how", "values", "state"), [(NEVER, ["value 1", "value 2", "value 3"], ""), (MATERIALIZE_FIRST, ["value 1", "value 2", "value 3"], "value 3"), (WHILE_ENUMERATING, ["value 1", "value 1 2", "value 1 2 3"], "value 1 2 3")])
def test_when_events_are_applied(how, values, state):
    kind = AggregateType(Watch, mutable=True, apply_events=how).discover()
    after, got = kind.execute(kind.new(), lambda s: s.command())
    assert [e.value for e in got] == values and after.value == state


def test_commands():
    kind = AggregateType(Watch, mutable=True, raised=lambda s: s.raised, clear_raised=lambda s: s.raised.clear()).discover()
    state = kind.new()
    _, got = kind.execute(state, lambda s: s.raised.append(Changed("x")))
    assert got == [Changed("x")] and state.raised == []
    with pytest.raises(InvalidState):
        AggregateType(Watch, mutable=True).execute(Watch(), lambda s: None)
    with pytest.raises(InvalidState):
        AggregateType(Total).execute(Total(), lambda s: None)
    with pytest.raises(InvalidState, match="no applier for Changed"):
        AggregateType(Total).discover().apply(Total(), Changed("x"))
    with pytest.raises(ValueError):
        AggregateType(Changed).discover()
    runs = []

    def command(s):
        runs.append(1)
        yield Numbered(2)

    state, _ = AggregateType(Total).discover().execute(Total(), command)
    assert state.total == 2 and runs == [1]
    picked = AggregateType(Total, events_of=lambda r: r[1], state_of=lambda r: r[0])
    assert picked.execute(Total(), lambda s: (Total("x", 9), [Numbered(1)])) == (Total("x", 9), [Numbered(1)])
    any_ = AggregateType(Total, apply_any=lambda s, e: Total(s.id, -1))
    assert any_.apply(Total(), Changed("x")).total == -1
    with pytest.raises(InvalidState):
        AggregateType(Changed).new()


def files_read(df):
    """Files that the scans of a plan open, and its plan."""
    df.collect()
    plan, todo, n = df._jdf.queryExecution().executedPlan(), [], 0
    todo.append(plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan)
    while todo:
        node = todo.pop()
        if "Stage" in node.getClass().getSimpleName() and "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            n += metrics.apply("numFiles").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return n


def many(spark, low, high):
    at = F.col("id")
    return spark.range(low, high).select(F.concat(F.lit("s"), at % 40).alias("stream_name"), F.floor(at / 40).alias("stream_position"), at.alias("global_position"), F.lit("n").alias("name"), F.lit("{}").alias("payload"), F.lit(None).cast("map<string,string>").alias("metadata"))


def test_one_stream_opens_few_files(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "log"), buckets=16)
    store.import_log(many(spark, 0, 4000))
    store.import_log(many(spark, 4000, 8000))
    assert store.head() == 7999
    store.compact()
    own = store.stream_log("s7")
    assert own.count() == 200 and files_read(own) <= 4
    assert len(own.inputFiles()) == len([f for f in own.inputFiles() if "/streams/" in f])
    store.append("s7", events(1), Expected.at(199))
    assert [r["stream_position"] for r in store.read_stream("s7", 198)] == [198, 199, 200]
    assert {r["stream_name"]: r["version"] for r in store.heads().collect()} == {f"s{k}": 199 + (k == 7) for k in range(40)}
    with pytest.raises(ValueError, match="not behind the head"):
        store.import_log(many(spark, 8000, 8001))
    assert store.import_log(many(spark, 0, 0)) == 0


def test_an_append_reads_heads_and_not_the_log(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "log"))
    store.import_log(many(spark, 0, 400))
    asked = spark.createDataFrame([("s3",)], "stream_name string")
    heads = store._heads(store.commits(), asked)
    assert [tuple(r) for r in heads.collect()] == [("s3", 9)] and all("/heads/" in f for f in heads.inputFiles())


def test_vacuum_and_replaced_checkpoints(store):
    for _ in range(3):
        store.append("s", events(2), Expected.any())
    store.compact()
    assert store.vacuum() == []  # too young
    assert len(store.vacuum(older_than=-1)) == 6  # a batch and a table of heads of each append
    assert store.log().count() == 6 and store.append("s", events(1), Expected.at(5)) == 6
    for k in range(4):
        store.save_checkpoint("c", k)
    assert store.checkpoint("c") == 3 and len(store.files.names(f"{store.path}/_checkpoints/c")) == 1


def test_many_requests_of_one_stream(spark):
    """Each meets the head that the ones before have left; a task holds one head."""
    asked = spark.range(3000).select(F.col("id").alias("request_id"), F.lit("s").alias("stream_name"), F.when(F.col("id") % 3 == 0, "version").otherwise("any").alias("expected_kind"), (F.col("id") - 1).alias("expected_version"), F.lit(1).cast("long").alias("n"))
    out = decide_appends(asked, spark.createDataFrame([("s", -1)], "stream_name string, version long"))
    assert out.where("accepted").count() == 3000 and out.agg(F.max("new_version")).first()[0] == 2999
