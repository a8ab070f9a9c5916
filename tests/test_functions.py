"""Names, positions, metadata, payloads."""

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from tidelog.errors import SerializationError, UnmappedEventName, UnmappedEventType
from tidelog.functions import EventTypes, Expected, JsonCodec, MetadataContext, NameMap, ProjectionTypes, StreamNaming, decode_metadata, least_position, order_key, schema_of
from tidelog.functions.naming import id_selector
from tidelog.functions.positions import ANY, NEW_STREAM, NO_STREAM, checked, compare, expected_kind


@dataclass
class Base:
    pass


@dataclass
class Added(Base):
    item: str
    n: int = 1


@dataclass
class Removed(Base):
    item: str


def test_naming():
    naming = StreamNaming.of("MyAggregate")
    assert (naming.stream(1), naming.snapshot(1)) == ("myAggregate-1", "myAggregateSnapshot-1")
    assert StreamNaming.of(Added, "myPrefix").snapshot("1") == "myPrefixSnapshot-1"
    assert StreamNaming("x", lambda i: f"s:{i}", lambda i: f"z:{i}").snapshot("1") == "z:1"
    for blank in (None, "", "  "):
        with pytest.raises(ValueError):
            naming.stream(blank)


def test_naming_column_rejects_blank(spark):
    df = spark.createDataFrame([(" ",)], "id string")
    with pytest.raises(Exception, match="blank"):
        df.select(StreamNaming("x").stream_column(F.col("id"))).collect()


def test_id_selector():
    class Cart:
        cart_id = 7

    class Named:
        id = 3

    class Nothing:
        pass

    assert (id_selector(Cart)(Cart()), id_selector(Named)(Named())) == (7, 3)
    with pytest.raises(TypeError):
        id_selector(Nothing)(Nothing())


@pytest.mark.parametrize(("given", "least"), [([3, None, 5], None), ([7, 3, -1], 3), ([-1, -1], -1), ([9, 4], 4)])
def test_least_position(spark, given, least):
    df = spark.createDataFrame([(p,) for p in given], "start long")
    assert least_position(df).first()[0] == least


def test_order(spark):
    df = spark.createDataFrame([(5,), (None,), (-1,), (0,)], "p long")
    assert [r[0] for r in df.orderBy(order_key(F.col("p"))).collect()] == [None, 0, 5, -1]
    assert compare(-1, -1) == 0 and compare(None, 0) == -1 and compare(-1, 10**12) == 1


def test_negative_position(spark):
    with pytest.raises(Exception, match="negative position"):
        spark.range(1).select(checked(F.lit(-2))).collect()


def test_sentinels(spark):
    assert [Expected.at(v).kind for v in (ANY, NEW_STREAM, NO_STREAM, 4)] == ["any", "no_stream", "no_stream", "version"]
    with pytest.raises(ValueError):
        Expected.at(-5)
    df = spark.createDataFrame([(ANY,), (NO_STREAM,), (3,)], "v long")
    assert [r[0] for r in df.select(expected_kind(F.col("v"))).collect()] == ["any", "no_stream", "version"]


def test_metadata_keys_that_come_twice():
    for static, lazy, more, fine in (({"a": "1"}, {"b": lambda: "2"}, {"c": "3"}, True), ({"a": "1"}, {"a": lambda: "2"}, {}, False), ({"a": "1"}, {}, {"a": "3"}, False), ({}, {"b": lambda: "2"}, {"b": "3"}, False)):
        if fine:
            assert MetadataContext(static, lazy).entries(more) == {"a": "1", "b": "2", "c": "3"}
        else:
            with pytest.raises(ValueError):
                MetadataContext(static, lazy).entries(more)
    assert len(MetadataContext.default().entries()) == 4
    with pytest.raises(ValueError):
        MetadataContext({"a": "1"}).adding({"a": "2"})


def test_metadata_column(spark):
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        spark.range(1).select(MetadataContext({"a": "1"}).column(F.create_map(F.lit("a"), F.lit("2")))).collect()
    df = spark.createDataFrame([(None,), ("",), ("{}",), ('{"k":"v"}',)], "m string")
    assert [r[0] for r in df.select(decode_metadata(F.col("m"))).collect()] == [{}, {}, {}, {"k": "v"}]


def test_schema_of():
    assert schema_of(Added).simpleString() == "struct<item:string,n:bigint>"


def test_event_types(spark):
    types = EventTypes().map_all(Base).map(Added, "ItemAdded", ["item_added"])
    assert sorted(t.name for t in types.types) == ["ItemAdded", "Removed"]
    assert types.names_of(Added) == ["ItemAdded", "item_added"]
    with pytest.raises(UnmappedEventName, match="Mapping not found for event name 'x'"):
        types.by_name("x")
    with pytest.raises(UnmappedEventType):
        types.by_kind(Base)
    with pytest.raises(ValueError):
        _ = EventTypes().map(Added, "x").map(Removed, "x").types
    with pytest.raises(ValueError):
        EventTypes().map_all(Removed)
    assert types.to_object("item_added", '{"item":"a","more":1}') == Added("a", None)
    assert types.to_record(Added("a", 2)) == ("ItemAdded", '{"item":"a","n":2}')
    for bad in (None, "", "null", "[1]", "This is not JSON. It should fail on deserialize"):
        with pytest.raises(SerializationError):
            types.to_object("Removed", bad)
    log = spark.createDataFrame([("item_added", '{"item":"a","n":2}'), ("Removed", '{"item":"b"}'), ("other", "x")], "name string, payload string")
    both = types.decode(log, Added, Removed).collect()
    assert [(r["ItemAdded"] and r["ItemAdded"]["n"], r["Removed"] and r["Removed"]["item"]) for r in both] == [(2, None), (None, "b")]
    assert types.unmapped(log).count() == 1
    with pytest.raises(Exception, match="Mapping not found for event name 'other'"):
        log.select(types.canonical(F.col("name"))).collect()


def test_codec_modes(spark):
    codec, schema = JsonCodec(), schema_of("a long")
    rows = [('{"a":1}',), ('{"b":1}',), ("nonsense",), ("null",), ("",), (None,)]
    df = spark.createDataFrame(rows, "p string")
    got = df.select(codec.with_corrupt(F.col("p"), schema)["_corrupt_record"].isNotNull(), codec.decode(F.col("p"), schema, "permissive")).collect()
    assert [r[0] for r in got] == [False, False, True, True, True, True]
    assert got[0][1]["a"] == 1 and got[2][1] is None
    for k in (2, 3, 4, 5):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame([rows[k]], "p string").select(codec.decode(F.col("p"), schema)).collect()


def test_name_map():
    m = NameMap().add("a", Added).add("a", Added)
    assert m.name_of(Added) == "a" and m.type_of("a") is Added
    for name, kind in (("a", Removed), ("b", Added)):
        with pytest.raises(ValueError):
            m.add(name, kind)
    with pytest.raises(UnmappedEventName):
        m.type_of("z")
    with pytest.raises(UnmappedEventType):
        m.name_of(Removed)
    p = ProjectionTypes().map("n", Added).map("n", Removed).with_handled([Base, Added])
    assert p.first("n") is Added and p.first("Base") is Base and p.first("?") is None
