"""Every query with an SQL equivalent gives DuckDB's rows; the entry works as the driver uses it."""

import pytest

import __spark_entry__ as entry
from tests.compare import duck, same
from tidelog.plans import Count, Fold, KeyedSet, catalog


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_duckdb(spark, sf, con, name):
    same(catalog.QUERIES[name](spark, sf), con, catalog.ORACLE_SQL[name])


def test_all_queries_have_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLE_SQL.keys()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["stream_name", "started", "item_count"]
    assert df.count() == 15


def test_native_key_takes_one_shuffle(spark, sf):
    plan = catalog.projection_cart_summary(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_name_filter_reaches_the_scan(spark, sf):
    plan = catalog.checkpoint_positions_(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["read_stream_forwards", "read_stream_backwards", "subscribe_stream"])
def test_native_key_of_a_stream_reaches_the_scan(spark, sf, name):
    assert "EqualTo(user_id," in planned(catalog.QUERIES[name](spark, sf))


def test_snapshots_are_met_in_one_pass(spark, sf):
    """A scan for the log and one for each fold that makes the snapshots; none of them is planned twice."""
    plan = planned(catalog.load_prefer_snapshot(spark, sf))
    assert plan.count("FileScan") == 3 and "Join" not in plan


def test_a_set_takes_one_scan(spark, sf):
    held = KeyedSet(catalog.item(), ("purchase",), ("error",))
    plan = planned(Fold({"items": held, "n": Count("purchase")}, key="user_id").apply(catalog.log_of(spark, sf)))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
