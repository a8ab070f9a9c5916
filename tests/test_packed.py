"""Rows that are packed on executors and come to the driver in order."""

from pyspark.sql import functions as F

from tidelog.schema import EVENT_LOG
from tidelog.streaming import packed


def a_log(spark, n):
    """As a store has it, in no order; with nulls, other letters and an empty map."""
    at = F.col("id")
    meta = F.when(at % 3 == 0, F.create_map(F.lit("k"), at.cast("string"))).when(at % 3 == 1, F.from_json(F.lit("{}"), "map<string,string>"))
    payload = F.when(at % 7 != 0, F.concat(F.lit('{"k": "ü'), (at % 100).cast("string"), F.lit('"}')))
    rows = spark.range(n, numPartitions=6).select(F.concat(F.lit("user-"), at % 150).alias("stream_name"), F.floor(at / 150).alias("stream_position"), (at * 5 % n).alias("global_position"), F.when(at % 2 == 0, "signup").otherwise("error").alias("name"), payload.alias("payload"), meta.alias("metadata"))
    return rows.select(*EVENT_LOG.names)


def test_rows_are_those_of_spark(spark):
    log = a_log(spark, 3001)
    found = list(packed.rows_in_order(log, "global_position", 3001))
    assert found == log.orderBy("global_position").collect()
    assert found[0].__fields__ == EVENT_LOG.names and found[0]["global_position"] == 0


def test_packs_are_bounded_and_keep_the_order(spark, monkeypatch):
    log = a_log(spark, 3001).toArrow().sort_by("global_position")
    monkeypatch.setattr(packed, "ROWS", 500)
    packs = [b["pack"][0].as_py() for b in packed.pack(iter(log.to_batches(max_chunksize=200)))]
    tables = [packed.unpack(p) for p in packs]
    assert [t.num_rows for t in tables] == [600] * 5 + [1]
    assert [p for t in tables for p in t["global_position"].to_pylist()] == list(range(3001))


def test_nothing_gives_nothing(spark):
    assert list(packed.packs(a_log(spark, 10).where("name = 'none'"), "global_position")) == []


def test_few_rows_go_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(packed, "packs", None)
    assert [r["global_position"] for r in packed.rows_in_order(a_log(spark, 11), "global_position", 11)] == list(range(11))


def test_an_event_takes_few_bytes(spark):
    """Of events as the test tables have them; as rows of Spark they take some 70 compressed."""
    n = 200_000
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**6))
    log = spark.range(0, 5 * n, 5, numPartitions=2).select(F.concat(F.lit("user-"), h(1) % 90_000).alias("stream_name"), (h(2) % 70).alias("stream_position"), F.col("id").alias("global_position"), F.when(h(3) % 2 == 0, "signup").otherwise("error").alias("name"), F.concat(F.lit('{"k": '), h(4) % 100, F.lit("}")).alias("payload"), F.lit(None).cast("map<string,string>").alias("metadata"))
    assert sum(map(len, packed.packs(log, "global_position"))) < 16 * n
