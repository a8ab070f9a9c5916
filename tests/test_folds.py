"""Every strategy equals the plain fold, and a snapshot with its tail equals the full replay."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.snapshots import PREFER_SNAPSHOT, USE_EVENT_STREAM, USE_SNAPSHOT, load_with_strategy, missing_snapshots, require_snapshots, take_snapshots
from tidelog.errors import SnapshotDoesNotExist
from tidelog.plans.fold import Count, Fold, Greatest, KeyedSet, LastValue, Least, Reducer, Steps, Total, reduce_rows, reduce_streams
from tidelog.plans.numbering import running_number, running_total

SCHEMA = "stream_name string, stream_position long, global_position long, name string, amount long"
EVENTS = st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["start", "add", "remove", "other"]), st.one_of(st.none(), st.integers(-3, 3))), max_size=25)
FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, events):
    at, rows = {}, []
    for g, (stream, name, amount) in enumerate(events):
        k = at[stream] = at.get(stream, -1) + 1
        rows.append((stream, k, g, name, amount))
    return spark.createDataFrame(rows, SCHEMA), rows


def plain(rows, step, init):
    by = {}
    for s, p, g, n, a in rows:
        by.setdefault(s, []).append({"stream_position": p, "name": n, "amount": a})
    return {s: reduce_rows(sorted(es, key=lambda e: e["stream_position"]), step, init) for s, es in by.items()}


@FEW
@given(EVENTS)
def test_algebraic_and_last(spark, events):
    log, rows = frame(spark, events)
    fold = Fold({"total": Total({"add": F.col("amount"), "remove": -F.col("amount")}), "adds": Count("add"), "low": Least({"add": F.col("amount")}), "high": Greatest({"add": F.col("amount")}), "last": LastValue({"add": F.col("amount"), "remove": F.col("amount")})})
    assert fold.strategy == "F2"

    def step(s, e):
        total, adds, low, high, last = s
        a = e["amount"]
        if e["name"] == "add":
            known = [x for x in (low, a) if x is not None]
            tops = [x for x in (high, a) if x is not None]
            return total + (a or 0), adds + 1, min(known, default=None), max(tops, default=None), a
        return (total - (a or 0), adds, low, high, a) if e["name"] == "remove" else s

    wanted = plain(rows, step, (0, 0, None, None, None))
    assert {r[0]: tuple(r[1:6]) for r in fold.apply(log).collect()} == wanted


@FEW
@given(EVENTS)
def test_guarded(spark, events):
    log, rows = frame(spark, events)
    guarded = Fold({"n": Total({"add": 1, "remove": -1})}, guard="start", started="started")
    steps = Fold({"s": Steps(F.struct(F.lit(False).alias("on"), F.lit(0).cast("long").alias("n")), {
        "start": lambda s, e: F.struct(F.lit(True).alias("on"), s["n"].alias("n")),
        "add": lambda s, e: F.struct(s["on"].alias("on"), (s["n"] + F.when(s["on"], 1).otherwise(0)).cast("long").alias("n")),
        "remove": lambda s, e: F.struct(s["on"].alias("on"), (s["n"] - F.when(s["on"], 1).otherwise(0)).cast("long").alias("n")),
    }, ())})
    assert (guarded.strategy, steps.strategy) == ("F4", "F5")

    def step(s, e):
        on, n = s
        if e["name"] == "start":
            return True, n
        return on, n + on * ((e["name"] == "add") - (e["name"] == "remove"))

    wanted = plain(rows, step, (False, 0))
    assert {r["stream_name"]: (r["started"], r["n"]) for r in guarded.apply(log).collect()} == wanted
    assert {r["stream_name"]: (r["s"]["on"], r["s"]["n"]) for r in steps.apply(log).collect()} == wanted
    reducer = Reducer(lambda: (False, 0), step, lambda s: {"on": s[0], "n": s[1]}, T.StructType.fromDDL("on boolean, n long"), ("name",))
    assert {r["stream_name"]: (r["on"], r["n"]) for r in reduce_streams(log, reducer).collect()} == wanted


@FEW
@given(EVENTS)
def test_keyed_set(spark, events):
    log, rows = frame(spark, events)
    fold = Fold({"held": KeyedSet(F.col("amount"), ("add",), ("remove",))})
    wanted = plain(rows, lambda s, e: s | {e["amount"]} if e["name"] == "add" else s - {e["amount"]} if e["name"] == "remove" else s, frozenset())
    wanted = {k: v - {None} for k, v in wanted.items()}  # null is no element
    assert {r["stream_name"]: frozenset(r["held"]) for r in fold.apply(log).collect()} == wanted


@FEW
@given(EVENTS, st.integers(0, 12), st.sampled_from(["plain", "guard", "steps"]))
def test_snapshot_and_tail_is_full_replay(spark, events, k, how):
    log, _ = frame(spark, events)
    fold = {
        "plain": Fold({"total": Total({"add": F.col("amount")}), "last": LastValue({"add": F.col("amount")}), "high": Greatest({"add": F.col("amount")})}),
        "guard": Fold({"n": Count("add")}, guard="start", started="started"),
        "steps": Fold({"seen": Steps(F.array().cast("array<long>"), {"add": lambda s, e: F.array_append(s, e["amount"])}, ("amount",))}),
    }[how]
    taken = take_snapshots(fold.apply(log.where(F.col("stream_position") <= k)), fold)
    full = {r[0]: r.asDict() for r in load_with_strategy(log, fold, None, USE_EVENT_STREAM).drop("snapshot_version", "events_loaded").collect()}
    seeded = load_with_strategy(log, fold, taken, PREFER_SNAPSHOT)
    assert {r[0]: r.asDict() for r in seeded.drop("snapshot_version", "events_loaded").collect()} == full
    for r in seeded.collect():
        assert r["version"] == r["snapshot_version"] + r["events_loaded"]


def test_snapshot_arithmetic(spark):
    """100 events, a snapshot, 10 more, a snapshot."""
    rows = [("s", p, p, "add", 1) for p in range(110)]
    log = spark.createDataFrame(rows, SCHEMA)
    fold = Fold({"total": Total({"add": F.col("amount")})})
    early = log.where("stream_position < 100")
    first = take_snapshots(fold.apply(early), fold)
    got = load_with_strategy(early, fold, first, USE_SNAPSHOT).first()
    assert (got["total"], got["snapshot_version"], got["events_loaded"]) == (100, 99, 0)
    got = load_with_strategy(log, fold, first, USE_SNAPSHOT).first()
    assert (got["total"], got["snapshot_version"], got["events_loaded"]) == (110, 99, 10)
    second = first.unionByName(take_snapshots(fold.apply(log), fold))
    got = load_with_strategy(log, fold, second).first()
    assert (got["total"], got["snapshot_version"], got["events_loaded"]) == (110, 109, 0)
    asked = spark.createDataFrame([("s",), ("t",)], "stream_name string")
    assert [r[0] for r in missing_snapshots(asked, second).collect()] == ["t"]
    with pytest.raises(SnapshotDoesNotExist):
        require_snapshots(asked, second)


def test_empty_log(spark):
    log = spark.createDataFrame([], SCHEMA)
    assert Fold({"n": Count("add")}, guard="start").apply(log).count() == 0
    assert running_number(log).count() == 0


@FEW
@given(st.sets(st.integers(-50, 10_000), max_size=30))
def test_running_number(spark, positions):
    df = spark.createDataFrame([(p,) for p in positions], "global_position long")
    got = {r[0]: r["number"] for r in running_number(df, buckets=7).collect()}
    assert got == {p: k for k, p in enumerate(sorted(positions), 1)}


def test_guard_of_long_streams(spark):
    """The guard's position by a join is that by a window."""
    rng = random.Random(4)
    rows = [(f"s{s}", k, 100 * s + k, rng.choice("gab"), "{}") for s in range(8) for k in range(30)]
    log = spark.createDataFrame(rows, "stream_name string, stream_position long, global_position long, name string, payload string")
    for guard in ("g", "none"):
        one, other = (Fold({"n": Total({"a": 1, "b": -1})}, guard=guard, started="started", long_streams=how).apply(log) for how in (False, True))
        assert sorted(one.collect()) == sorted(other.collect())
    plan = Fold({"n": Total({"a": 1})}, guard="g", long_streams=True).apply(log)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_running_total_with_an_outlier(spark):
    df = spark.createDataFrame([(k, k % 5) for k in [*range(50), 2**62]], "id long, n long")
    got = {r["id"]: r["before"] for r in running_total(df, "id", "n", "before", 7).collect()}
    assert got == {k: sum(j % 5 for j in range(k)) for k in range(50)} | {2**62: 100}


def test_scratch_tables_of_a_scope_go(spark):
    from tidelog.scratch import materialise, scratch_scope

    kept = []
    with scratch_scope(lambda: kept):
        first = materialise(spark.range(3), "one")
        kept.append(materialise(first.where("id > 0"), "two"))
    assert kept[0].count() == 2
    with pytest.raises(Exception, match="does not exist|NOT_EXIST|PATH_NOT_FOUND"):
        first.count()
