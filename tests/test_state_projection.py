"""Projections with Python state, connectors, models."""

from dataclasses import dataclass

import pytest
from pyspark.sql import Row

from tidelog.functions import EventTypes
from tidelog.operators.aggregates import AggregateType, Model, applies
from tidelog.sources import as_log, log_from_files
from tidelog.streaming.runner import RETRY, SKIP, CheckpointFrequency, Session
from tidelog.streaming.state_projection import PER_CHECKPOINT, SINGLETON, HandlerProjection, StateProjection


@dataclass
class Started:
    id: str


@dataclass
class Added:
    id: str
    item: str


TYPES = EventTypes().map(Started).map(Added, "ItemAdded", ["item_added"])


def event(at, name, payload, metadata=None):
    return Row(stream_name="s", stream_position=at, global_position=at, name=name, payload=payload, metadata=metadata)


def running(p):
    s = Session(p)
    s.initialize()
    s.begin()
    p.on_catching_up()
    return s


def test_one_failure_then_a_checkpoint():
    """Start and add, a checkpoint every 2 events, the first call fails once and is tried again."""
    state, calls, checkpoints = {}, [], []

    def add(s, e):
        calls.append(e.item)
        if len(calls) == 1:
            raise RuntimeError("once")
        s[e.id].append(e.item)

    p = StateProjection("carts", TYPES, lambda: state, SINGLETON, every=CheckpointFrequency(events=2))
    p.when(Started, lambda s, e: s.setdefault(e.id, [])).when("ItemAdded", add)
    p.on("error", lambda failed, s: RETRY).on("checkpoint", lambda s, at: checkpoints.append((dict(s), at)))
    session = running(p)
    session.handle(event(0, "Started", '{"id":"1"}'))
    session.handle(event(1, "item_added", '{"id":"1","item":"Item 1"}'))
    assert state == {"1": ["Item 1"]} and calls == ["Item 1", "Item 1"] and checkpoints == [({"1": ["Item 1"]}, 1)]


def test_lifetimes():
    made, closed = [], []

    class State:
        def __init__(self, resource, status):
            self.status = status
            made.append((resource, status))

        def close(self):
            closed.append(self.status)

    for lifetime, wanted in ((PER_CHECKPOINT, [("r", "catching_up"), ("r", "catching_up"), ("r", "live")]), (SINGLETON, [("r", "catching_up")])):
        made.clear()
        closed.clear()
        seen = []
        p = StateProjection("p", TYPES, State, lifetime, lambda: "r", every=CheckpointFrequency(events=2)).when(Started, lambda s, e: None)
        p.on("live", seen.append).on("checkpoint", lambda s, at: seen.append(at))
        session = running(p)
        for k in range(3):
            session.handle(event(k, "Started", '{"id":"1"}'))
        session.go_live()
        session.go_live()
        session.handle(event(3, "Started", '{"id":"1"}'))
        assert made == wanted and seen[:2] == [1, 2]
        assert closed == (["catching_up"] * 2 if lifetime == PER_CHECKPOINT else [])


def test_errors_show_what_was_decoded():
    errors = []
    p = HandlerProjection("p", TYPES).when(Added, lambda e, m: 1 / 0)
    p.on("error", lambda failed: errors.append(failed) or SKIP)
    session = running(p)
    session.handle(event(0, "ItemAdded", '{"id":"1","item":"a"}', {"k": "v"}))
    session.handle(event(1, "ItemAdded", "nonsense"))
    session.handle(event(2, "Unmapped", "nonsense"))
    assert [(x.position, x.event, x.metadata) for x in errors] == [(0, Added("1", "a"), {"k": "v"}), (1, None, None)]
    assert p.on_event(event(3, "Started", "{}")) == "ignored"
    with pytest.raises(ValueError):
        p.on("nothing", print)
    with pytest.raises(ValueError):
        StateProjection("p", TYPES, dict, "forever")


def test_connectors(spark, tmp_path):
    rows = [("s", 0, 0, "a", bytearray(b'{"x":1}'), '{"k":"v"}'), ("s", 1, 1, "a", None, "")]
    df = spark.createDataFrame(rows, "stream string, version int, position int, type string, data binary, meta string")
    names = {"stream_name": "stream", "stream_position": "version", "global_position": "position", "name": "type", "payload": "data", "metadata": "meta"}
    df.write.parquet(str(tmp_path / "p"))
    got = log_from_files(spark, str(tmp_path / "p"), columns=names).orderBy("global_position").collect()
    assert [tuple(r) for r in got] == [("s", 0, 0, "a", '{"x":1}', {"k": "v"}), ("s", 1, 1, "a", None, {})]
    log = as_log(df, names)
    log.write.json(str(tmp_path / "j"))
    again = as_log(spark.read.schema(log.schema).json(str(tmp_path / "j")))
    assert sorted(r["global_position"] for r in again.collect()) == [0, 1]
    with pytest.raises(ValueError):
        as_log(df)
    with pytest.raises(Exception, match="negative global_position"):
        as_log(spark.createDataFrame([("s", 0, -1, "a", "{}")], "stream_name string, stream_position long, global_position long, name string, payload string")).collect()
    assert as_log(spark.createDataFrame([("s", 0, 1, "a", "{}")], "stream_name string, stream_position long, global_position long, name string, payload string")).first()["metadata"] is None


def test_model():
    @dataclass
    class Cart:
        id: str = ""

        @applies(Started)
        def started(self, e):
            return Cart(e.id)

    model = Model().add(AggregateType(Cart).discover())
    assert model.types.by_kind(Started).name == "Started" and model.of(Cart).apply(Cart(), Started("7")).id == "7"
    with pytest.raises(LookupError):
        model.of(Started)


def test_overrides():
    assert TYPES.to_object("Snapshot", '{"id":"3"}', Started) == Started("3")
    assert TYPES.to_record(Started("3"), "Snapshot") == ("Snapshot", '{"id":"3"}')
