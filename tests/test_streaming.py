"""Subscriptions over real streams, and sessions by themselves."""

import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidelog.errors import InvalidState
from tidelog.functions import Expected
from tidelog.plans.projection import Projection, consumer_events, route
from tidelog.sources.store import EventStore
from tidelog.streaming import ModelConsumer, ReadModel
from tidelog.streaming import model as model_module
from tidelog.streaming.runner import ABORT, CATCHING_UP, LIVE, RETRY, RUNNING, SERVER_ERROR, SKIP, STOPPED, SUSPENDED, UNSUBSCRIBED, CheckpointFrequency, Consumer, Interceptor, Session, Subscription, intercepted, least_start, on
from tidelog.streaming.source import read_log_stream
from tidelog.streaming.stateful import run_available

SCHEMA = "stream_name string, stream_position long, global_position long, name string, payload string"


def event(at, name="a"):
    return Row(stream_name="s", stream_position=at, global_position=at, name=name, payload="{}")


class Seen(Consumer):
    name = "seen"

    def __init__(self, start=None):
        self.start, self.got, self.checkpoints, self.calls = start, [], [], []

    def on_restore(self):
        return self.start

    @on("a", "b")
    def on_letter(self, e):
        self.got.append(e["global_position"])

    def on_checkpoint(self, position):
        self.checkpoints.append(position)

    def on_live(self):
        self.calls.append("live")


def running(consumer):
    s = Session(consumer)
    s.initialize()
    s.begin()
    return s


def test_positions_up_to_the_start_are_skipped():
    c = Seen(start=1)
    s = running(c)
    for k in range(3):
        s.handle(event(k))
    assert c.got == [2] and c.checkpoints == [2]


def test_status_rules():
    s = Session(Seen())
    with pytest.raises(InvalidState, match="Expected status Stopped"):
        s.begin()
    s.initialize()
    assert s.status == STOPPED
    with pytest.raises(InvalidState):
        s.resume()


def test_checkpoints_by_count_and_when_live():
    c = Seen()
    c.catch_up, c.live = CheckpointFrequency(events=2), CheckpointFrequency(events=1)
    s = running(c)
    for k, name in enumerate("aabxab"):
        s.handle(event(k, name))
    assert c.checkpoints == [1, 4]  # what isn't handled doesn't count
    s.go_live()
    assert c.checkpoints == [1, 4, 5] and c.calls == ["live"]
    s.handle(event(6))
    assert c.checkpoints == [1, 4, 5, 6]
    s.go_live()
    assert c.checkpoints == [1, 4, 5, 6]  # nothing pending


def test_checkpoint_by_time(monkeypatch):
    now = [0.0]
    monkeypatch.setattr("tidelog.streaming.runner.time.monotonic", lambda: now[0])
    c = Seen()
    c.catch_up = CheckpointFrequency(seconds=5)
    s = running(c)
    s.handle(event(0))
    now[0] = 6
    s.handle(event(1))
    assert c.checkpoints == [1]


@pytest.mark.parametrize("what", [ABORT, RETRY, SKIP])
def test_errors(what):
    class Fails(Seen):
        fail = 1

        @on("a")
        def on_letter(self, e):
            if self.fail:
                self.fail -= 1
                raise RuntimeError("no")
            self.got.append(e["global_position"])

        def on_error(self, e, error):
            return what

    c = Fails()
    s = running(c)
    if what == ABORT:
        with pytest.raises(RuntimeError):
            s.handle(event(0))
        assert s.status == SUSPENDED and s.faulted["global_position"] == 0 and str(s.error) == "no"
        s.resume()
        s.handle(event(0))
        assert c.got == [0] and s.status == RUNNING
    elif what == RETRY:
        s.handle(event(0))
        assert c.got == [0] and c.checkpoints == [0]
    else:
        s.handle(event(0))
        assert c.got == [] and c.checkpoints == []


def test_retries_end():
    class Fails(Consumer):
        max_retries = 3
        tries = 0

        @on("a")
        def on_letter(self, e):
            self.tries += 1
            raise RuntimeError("no")

        def on_error(self, e, error):
            return RETRY

    c = Fails()
    with pytest.raises(RuntimeError):
        running(c).handle(event(0))
    assert c.tries == 4


def test_random_failures_handle_each_event_once():
    rng, errors = random.Random(3), 0

    class Shaky(Seen):
        @on("a")
        def on_letter(self, e):
            if rng.random() < 0.5:
                raise RuntimeError("again")
            self.got.append(e["global_position"])

    c = Shaky()
    s, at = running(c), 0
    while at < 1000:
        try:
            s.handle(event(at))
            at += 1
        except RuntimeError:
            errors += 1
            s.resume()
    assert c.got == list(range(1000)) and errors > 1


def test_interceptors_are_nested():
    log = []

    class Tell(Interceptor):
        def __init__(self, n):
            super().__init__()
            self.n = n

        def on_event(self, e):
            log.append(f">{self.n}")
            out = self.inner.on_event(e)
            log.append(f"<{self.n}")
            return out

    c = Seen()
    s = running(intercepted(c, Tell(1), Tell(2)))
    s.handle(event(0))
    assert log == [">1", ">2", "<2", "<1"] and c.got == [0] and s.name == "seen"


def test_least_start():
    assert least_start([5, 2, None]) is None and least_start([7, 3, -1]) == 3
    with pytest.raises(ValueError):
        least_start([])


def test_routes(spark):
    log = spark.createDataFrame([event(k, n) for k, n in enumerate("abcab")], SCHEMA)
    got = consumer_events(log, {"x": ["a", "b"], "y": ["a"]}, {"x": 1, "y": None})
    assert sorted((r["consumer"], r["global_position"]) for r in got.collect()) == [("x", 3), ("x", 4), ("y", 0), ("y", 3)]
    assert route(log, {}).count() == 0


def test_projection_handles_events_again(spark):
    log = spark.createDataFrame([event(0, "put"), event(1, "put"), event(2, "drop")], SCHEMA)
    p = Projection(("k",), ("at",)).upsert("put", k=F.col("stream_name"), at=F.col("global_position")).delete("drop", k=F.col("stream_name"))
    first = p.latest(p.operations(log.where("global_position < 2")))
    assert [tuple(r) for r in p.rows(first).collect()] == [("s", 1)]
    twice = p.merge(p.merge(first, log), log)
    assert p.rows(twice).count() == 0 and p.apply(log).count() == 0
    with pytest.raises(ValueError):
        p.upsert("more", k=F.col("stream_name"))


def write(spark, path, low, high):
    rows = [event(k, "abx"[k % 3]) for k in range(low, high)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_subscription(spark, tmp_path):
    """One consumer fails and is resumed, the other goes on; then both follow new events."""
    path = str(tmp_path / "log")
    write(spark, path, 0, 30)

    class Broken(Seen):
        name = "broken"
        fail = True

        @on("a")
        def on_letter(self, e):
            if self.fail and e["global_position"] == 15:
                raise RuntimeError("broken at 15")
            self.got.append(e["global_position"])

    fine, broken = Seen(start=4), Broken()
    sub = Subscription(spark, lambda after: read_log_stream(spark, path, SCHEMA, after, most=10), [fine, broken], str(tmp_path / "offsets"))
    with pytest.raises(InvalidState):
        sub.catch_up()
    assert sub.phase == UNSUBSCRIBED
    sub.start()
    assert sub.phase == CATCHING_UP
    sub.catch_up()
    assert sub.phase == LIVE and fine.calls == ["live"] and broken.calls == []
    assert fine.got == [k for k in range(5, 30) if k % 3 != 2]
    got = {r["consumer"]: r for r in sub.status().collect()}
    assert (got["broken"]["status"], got["broken"]["faulted_position"]) == (SUSPENDED, 15) and "broken at 15" in got["broken"]["error"]
    broken.fail = False
    sub.resume("broken")
    assert broken.got == list(range(0, 30, 3)) and broken.calls == ["live"]
    write(spark, path, 30, 36)
    sub.follow()
    sub.flush()
    assert fine.got[-4:] == [30, 31, 33, 34] and broken.got[-2:] == [30, 33]
    sub.stop()
    assert {s.status for s in sub.sessions.values()} == {STOPPED} and sub.phase == UNSUBSCRIBED


def test_no_consumers(spark, tmp_path):
    with pytest.raises(ValueError):
        Subscription(spark, lambda after: None, [], str(tmp_path))


class Slow(Consumer):
    """Checkpoints far apart, in a table of its own."""

    name = "slow"
    catch_up = CheckpointFrequency(events=1000)

    def __init__(self, saved):
        self.saved, self.got = saved, []

    def on_restore(self):
        return self.saved.get("at")

    def on_event(self, e):
        self.got.append(e["global_position"])
        return "processed"

    def on_checkpoint(self, position):
        self.saved["at"] = position


def test_restart_begins_behind_the_consumers_checkpoint(spark, tmp_path):
    """What was handled after the last checkpoint of a lost process is handled again."""
    path, saved = str(tmp_path / "log"), {}
    write(spark, path, 0, 20)
    made = lambda: Subscription(spark, lambda after: read_log_stream(spark, path, SCHEMA, after, most=7), [Slow(saved)], str(tmp_path / "offsets"))
    lost = made()
    lost.start()
    lost.flush()
    assert lost.sessions["slow"].consumer.got == list(range(20)) and saved == {}
    lost._ended.set()
    lost.query.stop()  # the process ends here: no checkpoint, no word to the consumer
    again = made()
    again.start()
    again.catch_up()
    assert again.sessions["slow"].consumer.got == list(range(20)) and saved == {"at": 19}
    again.stop()
    third = made()
    write(spark, path, 20, 22)
    third.start()
    third.catch_up()
    assert third.sessions["slow"].consumer.got == [20, 21]
    third.stop()


def store_of(spark, path, n):
    store = EventStore(spark, str(path))
    for _ in range(n):
        store.append("s", [("a", "{}", None)] * 10, Expected.any())
    return store


def test_source_follows_commits(spark, tmp_path):
    """Compaction between two batches repeats nothing, and what isn't committed isn't seen."""
    store = store_of(spark, tmp_path / "store", 3)
    folder, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    run = lambda: run_available(store.stream(most=8), lambda b, n: b.select("global_position").write.mode("append").parquet(folder), offsets)
    seen = lambda: sorted(r[0] for r in spark.read.parquet(folder).collect())
    run()
    assert seen() == list(range(30))
    store.compact()
    spark.createDataFrame([event(99)], SCHEMA).write.parquet(f"{store.path}/data/uncommitted")
    run()
    assert seen() == list(range(30))
    store.append("s", [("a", "{}", None)] * 5, Expected.any())
    run()
    assert seen() == list(range(35))
    with pytest.raises(Exception, match="a part of a store"):
        run_available(read_log_stream(spark, f"{store.path}/data", SCHEMA), lambda b, n: None, str(tmp_path / "other"))


def test_stream_over_a_store_without_commits(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    assert store.head() is None
    seen = []
    run_available(store.stream(), lambda b, n: seen.append(b.count()), str(tmp_path / "offsets"))
    assert sum(seen) == 0


def test_one_scan_for_all_consumers(spark, tmp_path):
    store, starts = store_of(spark, tmp_path / "store", 2), []

    def stream(after):
        starts.append(after)
        return store.stream(after)

    class Other(Seen):
        name = "other"

    one, two = Seen(start=11), Other(start=4)
    sub = Subscription(spark, stream, [one, two], str(tmp_path / "offsets"), store.head)
    sub.start()
    sub.catch_up()
    assert starts == [4] and one.got == list(range(12, 20)) and two.got == list(range(5, 20))
    sub.stop()


def test_falls_behind_and_catches_up(spark, tmp_path):
    store = store_of(spark, tmp_path / "store", 1)
    head = [None]
    c = Seen()
    c.on_fell_behind, c.on_caught_up = lambda: c.calls.append("behind"), lambda: c.calls.append("caught up")
    sub = Subscription(spark, store.stream, [c], str(tmp_path / "offsets"), lambda: head[0] or store.head())
    sub.start()
    sub.catch_up()
    sub.follow()
    store.append("s", [("a", "{}", None)] * 3, Expected.any())
    sub.flush()
    head[0] = 50  # the log goes on faster than the subscription
    wait(lambda: sub.phase == CATCHING_UP)
    head[0] = None
    wait(lambda: sub.phase == LIVE)
    assert c.got == list(range(13)) and c.calls[-2:] == ["behind", "caught up"]
    sub.stop()


def wait(holds, seconds=30):
    end = time.monotonic() + seconds
    while not holds():
        assert time.monotonic() < end
        time.sleep(0.1)


def test_checkpoint_by_time_without_more_events(spark, tmp_path):
    store, c = store_of(spark, tmp_path / "store", 1), Seen()
    c.catch_up = c.live = CheckpointFrequency(seconds=1.5)
    sub = Subscription(spark, store.stream, [c], str(tmp_path / "offsets"))
    sub.start()
    wait(lambda: c.checkpoints == [9])
    sub.stop()


def test_a_broken_source_drops_its_consumers(spark, tmp_path):
    store, c, told = store_of(spark, tmp_path / "store", 1), Seen(), []
    c.on_dropped = lambda reason, error: told.append((reason, str(error)))
    sub = Subscription(spark, store.stream, [c], str(tmp_path / "offsets"))
    sub.start()
    sub.catch_up()
    sub.follow()
    store.files.create(f"{store.path}/_commits/000000000001.json", "no JSON")
    wait(lambda: told)
    assert told[0][0] == SERVER_ERROR and sub.phase == UNSUBSCRIBED and sub.sessions["seen"].status == STOPPED
    assert sub.status().first()["error"] == told[0][1]
    sub.stop()


def test_resumed_consumer_joins_the_others_again(spark, tmp_path):
    store = store_of(spark, tmp_path / "store", 1)

    class Broken(Seen):
        name = "broken"
        fail = True

        @on("a")
        def on_letter(self, e):
            if self.fail and e["global_position"] == 4:
                raise RuntimeError("at 4")
            self.got.append(e["global_position"])

    fine, broken = Seen(), Broken()
    sub = Subscription(spark, store.stream, [fine, broken], str(tmp_path / "offsets"), store.head)
    sub.start()
    sub.catch_up()
    sub.follow()
    store.append("s", [("a", "{}", None)] * 5, Expected.any())
    sub.flush()
    assert fine.got == list(range(15)) and broken.got == list(range(4))
    broken.fail = False
    sub.resume("broken")
    store.append("s", [("a", "{}", None)] * 5, Expected.any())
    sub.flush()
    assert fine.got == broken.got == list(range(20))
    sub.stop()


def cart(spark):
    return Projection(("k",), ("at",)).upsert("put", k=F.col("stream_name"), at=F.col("global_position")).delete("drop", k=F.col("stream_name"))


def test_model_moves_with_its_position(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(model_module, "MERGE", 3)
    model = ReadModel(spark, cart(spark), str(tmp_path / "model"))
    rows = [Row(stream_name=f"s{k % 5}", stream_position=k, global_position=k, name="drop" if k % 7 == 3 else "put", payload="{}") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError):
        model.rows()
    for k in range(0, 60, 4):
        assert model.apply(df.where(F.col("global_position").between(k, k + 3)))
        assert not model.apply(df.where(F.col("global_position").between(k, k + 3)))  # comes again
    assert not model.apply(df.where("name = 'other'"))
    assert model.position() == 59 and sorted(model.rows().collect()) == sorted(cart(spark).apply(df).collect())
    assert len(model._state()["parts"]) <= 6 and len(model.files.names(f"{model.folder}/parts")) < 15


def test_model_consumer(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    for k in range(3):
        store.append(f"s{k}", [("put", "{}", None), ("drop" if k == 1 else "x", "{}", None)], Expected.any())
    model = ReadModel(spark, cart(spark), str(tmp_path / "model"))
    for _ in range(2):  # a second run goes on where the model stands
        sub = Subscription(spark, lambda after: store.stream(after, most=2), [ModelConsumer(model)], str(tmp_path / "offsets"))
        sub.start()
        sub.catch_up()
        sub.stop()
        assert sorted(tuple(r) for r in model.rows().collect()) == [("s0", 0), ("s2", 4)] and model.position() == 4


def test_events_come_to_the_driver_packed(spark, tmp_path, monkeypatch):
    """Each batch's events go through ``packed``, and a consumer gets them in order."""
    from tidelog.streaming import packed

    monkeypatch.setattr(packed, "FEW", 1)
    asked, packs = [], packed.packs
    monkeypatch.setattr(packed, "packs", lambda df, order: asked.append(order) or packs(df, order))
    store, c = store_of(spark, tmp_path / "store", 1), Seen()
    sub = Subscription(spark, store.stream, [c], str(tmp_path / "offsets"))
    sub.start()
    sub.catch_up()
    sub.stop()
    assert asked == ["global_position"] and c.got == sorted(c.got) and len(c.got) > 1


def test_marked_handlers_are_looked_up_once(monkeypatch):
    from tidelog.streaming import runner

    class Over(Seen):
        @on("c")
        def on_letter(self, e):
            self.got.append(-e["global_position"])

    looked = []
    monkeypatch.setattr(runner, "dir", lambda kind: looked.append(kind) or dir(kind), raising=False)
    base, over = Seen(), Over()
    for k in range(3):
        base.on_event(event(k)), over.on_event(event(k, "c"))
    assert base.got == [0, 1, 2] and over.got == [0, -1, -2] and set(over.handlers()) == {"c"}
    assert looked.count(Over) == 1
