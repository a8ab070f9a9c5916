"""A counter that begins behind its guard event, kept batch by batch in a read model."""

import random

from tidelog.sources.store import EventStore
from tidelog.streaming import GatedCounter, ReadModel, stream_table
from tidelog.streaming import model as model_module

SCHEMA = "stream_name string, stream_position long, global_position long, name string"
COUNTER = GatedCounter("begin", "plus", "minus")


def events(seed, n=400, streams=12):
    """Streams with no guard, with one at the start, late, and again and again."""
    rng, heads, out = random.Random(seed), {}, []
    for g in range(n):
        s = rng.randrange(streams)
        at = heads[s] = heads.get(s, -1) + 1
        names = ["plus", "plus", "minus", "other"] + ["begin"] * (s % 3 if s % 4 else at > 20)
        out.append((f"s{s}", at, g, rng.choice(names)))
    return out


def counted(rows):
    state = {}
    for s, at, _, name in rows:
        started, n, _ = state.get(s, (False, 0, -1))
        state[s] = (True, n + (name == "plus") - (name == "minus"), at) if started else (name == "begin", n, at)
    return {(s, *v) for s, v in state.items()}


def rows_of(df):
    found = [tuple(r[c] for c in ("stream_name", "started", "item_count", "version")) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_batches_of_any_cut_give_the_loop_s_counts(spark, tmp_path, monkeypatch):
    """Parts are merged twice over, and a batch that comes again changes nothing."""
    monkeypatch.setattr(model_module, "MERGE", 2)
    rng = random.Random(1)
    for seed in range(2):
        rows, model = events(seed), ReadModel(spark, COUNTER, str(tmp_path / f"m{seed}"))
        cuts = [0, *sorted(rng.sample(range(1, len(rows)), 4)), len(rows)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            batch = rows[low:high]
            rng.shuffle(batch)
            assert model.apply(spark.createDataFrame(batch, SCHEMA))
            assert not model.apply(spark.createDataFrame(batch, SCHEMA))
        assert rows_of(model.rows()) == counted(rows)


def test_a_guard_that_counts_itself_begins_and_isn_t_counted(spark, tmp_path):
    rows = [("s", k, k, n) for k, n in enumerate(["minus", "plus", "minus", "plus", "plus"])]
    model = ReadModel(spark, GatedCounter("plus", "plus", "minus"), str(tmp_path))
    for k in range(0, 5, 2):
        model.apply(spark.createDataFrame(rows[k:k + 2], SCHEMA))
    assert rows_of(model.rows()) == {("s", True, 1, 4)}


def test_a_stream_is_counted_without_python(spark, tmp_path):
    """The events of a batch meet by key in one shuffle, and no rows of a key go to Python."""
    store = EventStore(spark, str(tmp_path / "store"))
    log = spark.createDataFrame([(*r, None, None) for r in events(3)], f"{SCHEMA}, payload string, metadata map<string,string>")
    store.import_log(log)
    assert rows_of(stream_table(spark, store.stream(most=150), COUNTER, str(tmp_path / "m"))) == counted(events(3))
    plan = COUNTER.latest(COUNTER.operations(store.log()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Pandas" not in plan
