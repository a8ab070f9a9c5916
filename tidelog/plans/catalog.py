"""The named queries over the driver's tables, and the SQL that each has to equal.

Roles on ``events``: a user is a stream; signup starts a session, purchase adds the
item ``k`` to its cart, error removes it, click and view are not handled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import EventTypes, MetadataContext, StreamNaming, decode_metadata, least_position, order_key
from ..functions.positions import ANY, NEW_STREAM, NO_STREAM, expected_kind
from ..operators.append import decide_appends, place_events
from ..operators.entities import load_entities, load_or_create
from ..operators.reads import BACKWARDS, after_position, exclude_system, head_versions, missing_streams, page_numbers, read_from, read_stream, subscribe_stream
from ..operators.snapshots import USE_EVENT_STREAM, USE_SNAPSHOT, latest_snapshots, load_with_strategy, take_snapshots
from ..scratch import scratch_path
from ..session import union
from ..sources.logs import conversation_log, events_log, order_log
from ..sources.store import EventStore
from ..streaming.model import ModelConsumer, ReadModel
from ..streaming.runner import Subscription
from ..streaming.source import read_log_stream
from ..streaming.stateful import GatedCounter, run_available, stream_table
from .fold import Count, Fold, Greatest, KeyedSet, LastValue, Least, Reducer, Steps, Total, reduce_streams
from .projection import Projection, checkpoint_positions, checkpoint_positions_live, checkpoint_times, consumer_events, per_checkpoint, route

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The log of ``events`` in SQL.
LOG = """(SELECT 'user-' || user_id AS stream_name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS stream_position,
 event_id AS global_position, event_type AS name, props AS payload, value, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
#: The streams that are asked for: of every customer a user id.
ASKED = "(SELECT DISTINCT 'user-' || c_custkey AS stream_name FROM customer)"
#: Snapshots at stream position 29, and at 9 in the streams of even users.
SNAPSHOT_AT, EARLIER_AT = 29, 9
#: Fixed: what a payload that is no JSON looks like here.
BROKEN = "This is not JSON."


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql.replace("{LOG}", LOG).replace("{ASKED}", ASKED)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def log_of(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(table(spark, sf, "events"))


def asked_for(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(StreamNaming("user").stream_column(F.col("c_custkey")).alias("stream_name")).distinct()


def item() -> F.Column:
    return F.get_json_object("payload", "$.k").cast("long")


def cents(c: F.Column) -> F.Column:
    """Sums of money as exact decimals, so that the order of addition is no matter."""
    return c.cast("decimal(20,6)")


ITEM = StructType([StructField("k", LongType())])
CART_TYPES = EventTypes().map(ITEM, "SessionStarted", ["signup"]).map(ITEM, "ItemAdded", ["purchase"]).map(ITEM, "ItemRemoved", ["error"])
CART_SUMMARY = Fold({"item_count": Total({"purchase": 1, "error": -1})}, guard="signup", started="started", key="user_id")


# Columns need a session, so folds that hold some are made when they are asked for.


def activity(key: str) -> Fold:
    return Fold({"purchases": Count("purchase"), "spent": Total({"purchase": cents(F.col("value"))}, "decimal(38,6)"), "last_name": LastValue({n: F.lit(n) for n in ("signup", "purchase", "error", "click", "view")}), "last_item": LastValue({"purchase": item()}), "largest": Greatest({"purchase": F.col("value")}), "least_item": Least({"purchase": item()})}, key=key)


# -- reads -------------------------------------------------------------------------------------


@query("event_log", "SELECT stream_name, stream_position, global_position, name, payload FROM {LOG}")
def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return log_of(spark, sf).select("stream_name", "stream_position", "global_position", "name", "payload")


@query("read_stream_forwards", "SELECT stream_position, global_position, name FROM {LOG} WHERE stream_name = 'user-7' AND stream_position >= 10")
def read_stream_forwards(spark: SparkSession, sf: str) -> DataFrame:
    return read_stream(log_of(spark, sf), "user-7", 10, native=F.col("user_id") == 7).select("stream_position", "global_position", "name")


@query("read_stream_backwards", "SELECT stream_position, global_position, name FROM {LOG} WHERE stream_name = 'user-7' AND stream_position <= 20")
def read_stream_backwards(spark: SparkSession, sf: str) -> DataFrame:
    return read_stream(log_of(spark, sf), "user-7", 20, BACKWARDS, native=F.col("user_id") == 7).select("stream_position", "global_position", "name")


@query("read_from_origin", "SELECT 'all' AS what, stream_position, name FROM {LOG} WHERE stream_name = 'user-7' UNION ALL SELECT 'first', stream_position, name FROM {LOG} WHERE stream_name = 'user-7' AND stream_position = 0")
def read_from_origin(spark: SparkSession, sf: str) -> DataFrame:
    """Backwards from the default origin all events, backwards from the start the first, forwards from the end none."""
    log, own = log_of(spark, sf), F.col("user_id") == 7
    read = lambda what, *how: read_from(log, "user-7", *how, ordered=False, native=own).select(F.lit(what).alias("what"), "stream_position", "name")
    return union(read("all", "default", BACKWARDS), read("first", "start", BACKWARDS), read("none", "end"))


@query("read_pages", "SELECT stream_name, CAST(stream_position // 10 AS BIGINT) AS page, count(*) AS n, min(global_position) AS first FROM {LOG} GROUP BY 1, 2")
def read_pages(spark: SparkSession, sf: str) -> DataFrame:
    paged = page_numbers(log_of(spark, sf), 10).groupBy("user_id", "page").agg(F.count("*").alias("n"), F.min("global_position").alias("first"))
    return _named(paged, "page", "n", "first")


@query("all_after_position", "SELECT stream_name, global_position, name FROM {LOG} WHERE global_position > 500")
def all_after_position(spark: SparkSession, sf: str) -> DataFrame:
    return after_position(log_of(spark, sf), 500).select("stream_name", "global_position", "name")


@query("exclude_system_events", "SELECT global_position, name FROM (SELECT global_position, CASE WHEN name = 'view' THEN '$view' ELSE name END AS name FROM {LOG}) WHERE NOT starts_with(name, '$')")
def exclude_system_events(spark: SparkSession, sf: str) -> DataFrame:
    named = log_of(spark, sf).withColumn("name", F.when(F.col("name") == "view", F.lit("$view")).otherwise(F.col("name")))
    return exclude_system(named).select("global_position", "name")


@query("stream_not_found", "SELECT stream_name, 'Stream ''' || stream_name || ''' could not be found.' AS message FROM {ASKED} WHERE stream_name NOT IN (SELECT stream_name FROM {LOG})")
def stream_not_found(spark: SparkSession, sf: str) -> DataFrame:
    missing = missing_streams(log_of(spark, sf), asked_for(spark, sf))
    return missing.select("stream_name", F.concat(F.lit("Stream '"), "stream_name", F.lit("' could not be found.")).alias("message"))


@query(
    "order_log",
    """WITH u AS (SELECT o_orderkey AS key, 0 AS kind, 'OrderPlaced' AS name, o_totalprice AS amount, NULL AS n, NULL AS a, NULL AS b, NULL AS c, NULL AS d, NULL AS e, NULL AS f, NULL AS g, NULL AS h, NULL AS i FROM orders
    UNION ALL SELECT l_orderkey, 1, 'LineAdded', l_extendedprice, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem)
    SELECT 'order-' || key AS stream_name, row_number() OVER (PARTITION BY key ORDER BY kind, n, a, b, c, d, e, f, g, h, i) - 1 AS stream_position, name, amount FROM u""",
)
def order_log_(spark: SparkSession, sf: str) -> DataFrame:
    return order_log(table(spark, sf, "orders"), table(spark, sf, "lineitem")).select("stream_name", "stream_position", "name", "amount")


@query("conversation_log", "SELECT 'conversation-' || conv_id AS stream_name, turn AS stream_position, row_number() OVER (ORDER BY conv_id, turn) - 1 AS global_position, role AS name FROM conversations")
def conversation_log_(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_log(table(spark, sf, "conversations")).select("stream_name", "stream_position", "global_position", "name")


@query("subscribe_stream", "SELECT stream_position, name FROM {LOG} WHERE stream_name = 'user-3' AND stream_position > 5")
def subscribe_stream_(spark: SparkSession, sf: str) -> DataFrame:
    return subscribe_stream(log_of(spark, sf), "user-3", 5, F.col("user_id") == 3).select("stream_position", "name")


# -- mapping and payloads ------------------------------------------------------------------------


@query("canonical_names", "SELECT stream_name, CASE name WHEN 'signup' THEN 'SessionStarted' WHEN 'purchase' THEN 'ItemAdded' WHEN 'error' THEN 'ItemRemoved' END AS canonical, count(*) AS n FROM {LOG} GROUP BY ALL")
def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    named = log_of(spark, sf).withColumn("canonical", CART_TYPES.canonical(F.col("name"), "null"))
    counted = named.groupBy("user_id", "canonical").agg(F.count("*").alias("n"))
    return counted.select(StreamNaming("user").stream_column(F.col("user_id")).alias("stream_name"), "canonical", "n")


@query("decode_events", "SELECT global_position, name, k FROM {LOG} WHERE name = 'purchase'")
def decode_events(spark: SparkSession, sf: str) -> DataFrame:
    return CART_TYPES.decode(log_of(spark, sf), "ItemAdded").select("global_position", "name", F.col("event.k").alias("k"))


@query("encode_events", """SELECT global_position, 'ItemAdded' AS name, '{"session_id":"' || stream_name || '","item":"' || k || '"}' AS payload FROM {LOG} WHERE name = 'purchase'""")
def encode_events(spark: SparkSession, sf: str) -> DataFrame:
    own = CART_TYPES.decode(log_of(spark, sf), "ItemAdded")
    name, payload = CART_TYPES.encode("ItemAdded", F.col("stream_name").alias("session_id"), F.col("event.k").cast("string").alias("item"))
    return own.select("global_position", name.alias("name"), payload.alias("payload"))


RAW_META = """CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{}' ELSE '{"user":"' || user_id || '","source":"web"}' END"""


@query("decode_metadata", f"SELECT event_id AS global_position, CAST(CASE WHEN event_id % 4 = 3 THEN 2 ELSE 0 END AS INTEGER) AS entries, CASE WHEN event_id % 4 = 3 THEN CAST(user_id AS VARCHAR) END AS by_user FROM (SELECT *, {RAW_META} AS raw FROM events)")
def decode_metadata_(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("event_id").alias("global_position"), decode_metadata(F.expr(RAW_META)).alias("m"))
    return events.select("global_position", F.size("m").alias("entries"), F.element_at("m", "user").alias("by_user"))


@query("metadata_enrich", "SELECT event_id AS global_position, CAST(3 AS INTEGER) AS entries, 'billing' AS service, event_type AS cause FROM events")
def metadata_enrich(spark: SparkSession, sf: str) -> DataFrame:
    context = MetadataContext({"ServiceName": "billing"}, {"UtcDateTime": lambda: "2024-01-01T00:00:00Z"})
    whole = context.column(F.create_map(F.lit("cause"), F.col("event_type")))
    return table(spark, sf, "events").select(F.col("event_id").alias("global_position"), whole.alias("m")).select("global_position", F.size("m").alias("entries"), F.element_at("m", "ServiceName").alias("service"), F.element_at("m", "cause").alias("cause"))


@query("unmapped_events", "SELECT name, count(*) AS n FROM {LOG} WHERE name NOT IN ('signup', 'purchase', 'error') GROUP BY name")
def unmapped_events(spark: SparkSession, sf: str) -> DataFrame:
    return CART_TYPES.unmapped(log_of(spark, sf)).groupBy("name").agg(F.count("*").alias("n"))


def _broken(log: DataFrame) -> DataFrame:
    return log.withColumn("payload", F.when(F.col("global_position") % 97 == 0, F.lit(BROKEN)).otherwise(F.col("payload")))


@query("corrupt_events", f"SELECT global_position, name, '{BROKEN}' AS payload, 'payload can''t be decoded' AS error FROM {{LOG}} WHERE global_position % 97 = 0 AND name IN ('signup', 'purchase', 'error')")
def corrupt_events(spark: SparkSession, sf: str) -> DataFrame:
    return CART_TYPES.corrupt(_broken(log_of(spark, sf))).select("global_position", "name", "payload", "error")


@query("skip_bad_events", "SELECT name, count(*) AS n, CAST(sum(k) AS BIGINT) AS items FROM {LOG} WHERE global_position % 97 <> 0 AND name IN ('signup', 'purchase', 'error') GROUP BY name")
def skip_bad_events(spark: SparkSession, sf: str) -> DataFrame:
    return CART_TYPES.valid(_broken(log_of(spark, sf))).groupBy("name").agg(F.count("*").alias("n"), F.sum(item()).alias("items"))


HANDLED = {"cart": ["signup", "purchase", "error"], "traffic": ["click", "view"], "sales": ["purchase"]}
HANDLED_SQL = "(VALUES ('cart', 'signup'), ('cart', 'purchase'), ('cart', 'error'), ('traffic', 'click'), ('traffic', 'view'), ('sales', 'purchase')) h(consumer, name)"


@query("mapping_precedence", "SELECT global_position, CASE name WHEN 'signup' THEN 'Start' WHEN 'purchase' THEN 'Bought' ELSE name END AS canonical FROM {LOG} WHERE name IN ('signup', 'purchase', 'click', 'view')")
def mapping_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """A base's types go by their own names; a single mapping overrides its type's, and the last one counts."""
    event = type("Event", (), {"__annotations__": {}})
    kinds = {n: dataclass(type(n, (event,), {"__annotations__": {"k": int}})) for n in ("click", "view", "Begun", "Sold")}
    types = EventTypes().map(kinds["Begun"], "Begin", ["signup"]).map_all(event).map(kinds["Begun"], "Start", ["signup"]).map(kinds["Sold"], "Bought", ["purchase"])
    kept = log_of(spark, sf).where(F.col("name").isin(types.names_of(*kinds.values())))
    return kept.select("global_position", types.canonical(F.col("name")).alias("canonical"))


@query("event_overrides", """SELECT global_position, 'Seen' AS name, k, '{"k":' || k || '}' AS payload FROM {LOG} WHERE name = 'view'""")
def event_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded as a given type whatever the name is mapped to, and encoded under a given name."""
    codec = CART_TYPES.codec
    seen = log_of(spark, sf).where(F.col("name") == "view").select("global_position", F.lit("Seen").alias("name"), codec.decode(F.col("payload"), ITEM, "failfast").alias("event"))
    return seen.select("global_position", "name", F.col("event.k").alias("k"), codec.encode(F.col("event.k").alias("k")).alias("payload"))


@query("route_events", f"SELECT consumer, global_position, l.name FROM {{LOG}} l JOIN {HANDLED_SQL} ON l.name = h.name")
def route_events(spark: SparkSession, sf: str) -> DataFrame:
    return route(log_of(spark, sf), HANDLED).select("consumer", "global_position", "name")


# -- folds and loads -----------------------------------------------------------------------------


def _named(df: DataFrame, *columns: str) -> DataFrame:
    """Folds group by the native key; the stream's name is made last."""
    return df.select(StreamNaming("user").stream_column(F.col("user_id")).alias("stream_name"), *columns)


@query("head_version", "SELECT stream_name, max(stream_position) AS version, count(*) AS events FROM {LOG} GROUP BY stream_name")
def head_version(spark: SparkSession, sf: str) -> DataFrame:
    return _named(head_versions(log_of(spark, sf), "user_id"), "version", "events")


STATE_SQL = """SELECT stream_name, count(*) FILTER (name = 'purchase') AS purchases, CAST(coalesce(sum(CAST(value AS DECIMAL(20,6))) FILTER (name = 'purchase'), 0) AS DOUBLE) AS spent, arg_max(name, stream_position) AS last_name,
 arg_max(k, stream_position) FILTER (name = 'purchase') AS last_item, max(value) FILTER (name = 'purchase') AS largest, min(k) FILTER (name = 'purchase') AS least_item, max(stream_position) AS version"""


def state_columns() -> list:
    return ["purchases", F.col("spent").cast("double").alias("spent"), "last_name", "last_item", "largest", "least_item", "version"]


@query("rehydrate_state", STATE_SQL + ", count(*) AS events FROM {LOG} GROUP BY stream_name")
def rehydrate_state(spark: SparkSession, sf: str) -> DataFrame:
    return _named(activity("user_id").apply(log_of(spark, sf)), *state_columns(), "events")


@query("rehydrate_sequence", "SELECT stream_name, string_agg(k, ' ' ORDER BY stream_position) FILTER (name IN ('purchase', 'error')) AS observed FROM {LOG} GROUP BY stream_name")
def rehydrate_sequence(spark: SparkSession, sf: str) -> DataFrame:
    seen = Steps(F.array().cast("array<string>"), dict.fromkeys(("purchase", "error"), lambda s, e: F.array_append(s, e["k"])), ("k",), lambda s: F.when(F.size(s) > 0, F.array_join(s, " ")))
    log = log_of(spark, sf).withColumn("k", item().cast("string"))
    return _named(Fold({"observed": seen}, key="user_id").apply(log), "observed")


@query("rehydrate_python", "SELECT stream_name, string_agg(k, ' ' ORDER BY stream_position) FILTER (name IN ('purchase', 'error')) AS observed, max(stream_position) AS version, count(*) AS events FROM {LOG} GROUP BY stream_name")
def rehydrate_python(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.types import StringType

    def step(state: list, event: dict) -> list:
        return [*state, event["k"]] if event["name"] in ("purchase", "error") else state

    reducer = Reducer(list, step, lambda s: {"observed": " ".join(s) or None}, StructType([StructField("observed", StringType())]), ("name", "k"))
    return _named(reduce_streams(log_of(spark, sf).withColumn("k", item().cast("string")), reducer, "user_id"), "observed", "version", "events")


@query("load_entities", STATE_SQL + " FROM {LOG} WHERE stream_name IN (SELECT stream_name FROM {ASKED}) GROUP BY stream_name")
def load_entities_(spark: SparkSession, sf: str) -> DataFrame:
    return load_entities(asked_for(spark, sf), log_of(spark, sf), activity("stream_name")).select("stream_name", *state_columns())


@query("load_or_create", "SELECT stream_name, coalesce(n, 0) AS purchases, version, coalesce(events, 0) AS events FROM {ASKED} LEFT JOIN (SELECT stream_name, count(*) FILTER (name = 'purchase') AS n, max(stream_position) AS version, count(*) AS events FROM {LOG} GROUP BY stream_name) USING (stream_name)")
def load_or_create_(spark: SparkSession, sf: str) -> DataFrame:
    return load_or_create(asked_for(spark, sf), log_of(spark, sf), Fold({"purchases": Count("purchase")}), {"purchases": F.lit(0).cast("long")}).select("stream_name", "purchases", "version", "events")


@query("stream_naming", "SELECT c_custkey, 'shoppingCart-' || c_custkey AS stream_name, 'shoppingCartSnapshot-' || c_custkey AS snapshot_name FROM customer")
def stream_naming(spark: SparkSession, sf: str) -> DataFrame:
    naming = StreamNaming.of("ShoppingCart")
    return table(spark, sf, "customer").select("c_custkey", naming.stream_column(F.col("c_custkey")).alias("stream_name"), naming.snapshot_column(F.col("c_custkey")).alias("snapshot_name"))


#: Commands: every user is asked to add an item (its id modulo 100) and to remove the next one.
COMMANDS_SQL = """s AS (SELECT user_id, bool_or(name = 'signup') AS started FROM {LOG} GROUP BY user_id),
 c AS (SELECT user_id, 'add' AS command, user_id % 100 AS item FROM s UNION ALL SELECT user_id, 'remove', (user_id + 1) % 100 FROM s),
 held AS (SELECT user_id, k AS item FROM (SELECT user_id, k, arg_max(name, global_position) AS last FROM {LOG} WHERE name IN ('purchase', 'error') GROUP BY user_id, k) WHERE last = 'purchase')"""


@query("command_raise_events", f"WITH {COMMANDS_SQL} SELECT 'user-' || c.user_id AS stream_name, command, c.item, started, CASE WHEN NOT started THEN NULL WHEN command = 'add' AND h.item IS NULL THEN 'ItemAdded' WHEN command = 'remove' AND h.item IS NOT NULL THEN 'ItemRemoved' END AS raised FROM c JOIN s USING (user_id) LEFT JOIN held h ON c.user_id = h.user_id AND c.item = h.item")
def command_raise_events(spark: SparkSession, sf: str) -> DataFrame:
    log = log_of(spark, sf)
    held = KeyedSet(item(), ("purchase",), ("error",)).rows(log, "user_id", "global_position", "item").withColumn("held", F.lit(True))
    started = log.groupBy("user_id").agg(F.max(F.col("name") == "signup").alias("started"))
    both = F.array(F.struct(F.lit("add").alias("command"), (F.col("user_id") % 100).alias("item")), F.struct(F.lit("remove").alias("command"), ((F.col("user_id") + 1) % 100).alias("item")))
    asked = started.select("user_id", "started", F.inline(both)).join(held, ["user_id", "item"], "left")
    there = F.coalesce("held", F.lit(False))
    raised = F.when(~F.col("started"), None).when((F.col("command") == "add") & ~there, "ItemAdded").when((F.col("command") == "remove") & there, "ItemRemoved")
    return _named(asked, "command", "item", "started", raised.alias("raised"))


# -- snapshots -----------------------------------------------------------------------------------


def snapshot_fold() -> Fold:
    return Fold({"purchases": Count("purchase"), "spent": Total({"purchase": cents(F.col("value"))}, "decimal(38,6)"), "last_item": LastValue({"purchase": item()})}, key="user_id")


def _snapshots(log: DataFrame) -> DataFrame:
    """All streams have one at SNAPSHOT_AT but those of every third user; even users also have an earlier one."""
    late = take_snapshots(snapshot_fold().apply(log.where((F.col("stream_position") <= SNAPSHOT_AT) & (F.col("user_id") % 3 != 0))), snapshot_fold())
    early = take_snapshots(snapshot_fold().apply(log.where((F.col("stream_position") <= EARLIER_AT) & (F.col("user_id") % 2 == 0))), snapshot_fold())
    return union(late, early)


SNAPSHOTS_SQL = """snaps AS (SELECT stream_name, user_id, 29 AS version FROM {LOG} WHERE user_id % 3 <> 0 GROUP BY ALL UNION ALL SELECT stream_name, user_id, 9 FROM {LOG} WHERE user_id % 2 = 0 GROUP BY ALL),
 latest AS (SELECT stream_name, CAST(max(version) AS BIGINT) AS snapshot_version FROM snaps GROUP BY stream_name)"""
LOADED_SQL = "SELECT l.stream_name, count(*) FILTER (name = 'purchase') AS purchases, CAST(coalesce(sum(CAST(value AS DECIMAL(20,6))) FILTER (name = 'purchase'), 0) AS DOUBLE) AS spent, arg_max(k, stream_position) FILTER (name = 'purchase') AS last_item, max(stream_position) AS version"


@query("snapshot_create", "SELECT stream_name, max(stream_position) AS version, count(*) FILTER (name = 'purchase') AS purchases FROM {LOG} WHERE stream_position <= 29 GROUP BY stream_name")
def snapshot_create(spark: SparkSession, sf: str) -> DataFrame:
    taken = take_snapshots(snapshot_fold().apply(log_of(spark, sf).where(F.col("stream_position") <= SNAPSHOT_AT)), snapshot_fold())
    return _named(taken, "version", F.col("state.purchases").alias("purchases"))


@query("latest_snapshot", f"WITH {SNAPSHOTS_SQL} SELECT stream_name, snapshot_version AS version, (SELECT count(*) FROM {{LOG}} x WHERE x.stream_name = latest.stream_name AND x.stream_position <= snapshot_version AND x.name = 'purchase') AS purchases FROM latest")
def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return _named(latest_snapshots(_snapshots(log_of(spark, sf)), "user_id"), "version", F.col("state.purchases").alias("purchases"))


def _loaded(df: DataFrame) -> DataFrame:
    return _named(df, "purchases", F.col("spent").cast("double").alias("spent"), "last_item", "version", "snapshot_version", "events_loaded")


@query("load_use_event_stream", LOADED_SQL + ", CAST(NULL AS BIGINT) AS snapshot_version, count(*) AS events_loaded FROM {LOG} l GROUP BY stream_name")
def load_use_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    log = log_of(spark, sf)
    return _loaded(load_with_strategy(log, snapshot_fold(), _snapshots(log), USE_EVENT_STREAM))


@query("load_prefer_snapshot", f"WITH {SNAPSHOTS_SQL} {LOADED_SQL}, max(snapshot_version) AS snapshot_version, count(*) FILTER (stream_position > coalesce(snapshot_version, -1)) AS events_loaded FROM {{LOG}} l LEFT JOIN latest ON l.stream_name = latest.stream_name GROUP BY l.stream_name")
def load_prefer_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    log = log_of(spark, sf)
    return _loaded(load_with_strategy(log, snapshot_fold(), _snapshots(log)))


@query("load_use_snapshot", f"WITH {SNAPSHOTS_SQL} {LOADED_SQL}, max(snapshot_version) AS snapshot_version, count(*) FILTER (stream_position > snapshot_version) AS events_loaded FROM {{LOG}} l JOIN latest ON l.stream_name = latest.stream_name GROUP BY l.stream_name")
def load_use_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    log = log_of(spark, sf)
    return _loaded(load_with_strategy(log, snapshot_fold(), _snapshots(log), USE_SNAPSHOT))


# -- appends -------------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf: str, kind: str, version: F.Column) -> DataFrame:
    """A batch of 2 events to each customer's stream."""
    keyed = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("stream_name"))
    return keyed.select("request_id", "stream_name", F.lit(kind).alias("expected_kind"), version.cast("long").alias("expected_version"), F.lit(2).cast("long").alias("n"))


OUTCOME = ["request_id", "stream_name", "accepted", "new_version", "message"]
HEADS_SQL = "heads AS (SELECT stream_name, max(stream_position) AS v FROM {LOG} GROUP BY 1), r AS (SELECT c_custkey AS request_id, 'user-' || c_custkey AS stream_name FROM customer)"
FAILED = "'Append failed due to wrong expected version. Stream: ' || stream_name || ', Expected "


@query("append_expected_version", f"WITH {HEADS_SQL} SELECT request_id, stream_name, coalesce(v, -1) = 60 AS accepted, CASE WHEN v = 60 THEN CAST(62 AS BIGINT) END AS new_version, CASE WHEN coalesce(v, -1) <> 60 THEN {FAILED}Version: 60' || CASE WHEN v IS NULL THEN '' ELSE ', Actual Version: ' || v END END AS message FROM r LEFT JOIN heads USING (stream_name)")
def append_expected_version(spark: SparkSession, sf: str) -> DataFrame:
    return decide_appends(_requests(spark, sf, "version", F.lit(60)), head_versions(log_of(spark, sf))).select(*OUTCOME)


@query("append_no_stream", f"WITH {HEADS_SQL} SELECT request_id, stream_name, v IS NULL AS accepted, CASE WHEN v IS NULL THEN CAST(1 AS BIGINT) END AS new_version, CASE WHEN v IS NOT NULL THEN {FAILED}State: NoStream, Actual Version: ' || v END AS message FROM r LEFT JOIN heads USING (stream_name)")
def append_no_stream(spark: SparkSession, sf: str) -> DataFrame:
    return decide_appends(_requests(spark, sf, "no_stream", F.lit(None)), head_versions(log_of(spark, sf))).select(*OUTCOME)


@query("append_any", f"WITH {HEADS_SQL} SELECT request_id, stream_name, true AS accepted, coalesce(v, -1) + 2 AS new_version, CAST(NULL AS VARCHAR) AS message FROM r LEFT JOIN heads USING (stream_name)")
def append_any(spark: SparkSession, sf: str) -> DataFrame:
    return decide_appends(_requests(spark, sf, "any", F.lit(None)), head_versions(log_of(spark, sf))).select(*OUTCOME)


@query("append_conflicts", f"WITH {HEADS_SQL}, two AS (SELECT request_id * 2 + i AS request_id, stream_name, i, v FROM r LEFT JOIN heads USING (stream_name), (VALUES (0), (1)) t(i)) SELECT request_id, stream_name, coalesce(v + 2, 1) AS actual, {FAILED}Version: ' || coalesce(v, -1) || ', Actual Version: ' || coalesce(v + 2, 1) AS message FROM two WHERE i = 1")
def append_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Two writers that have read the same head: the second one meets the first one's events."""
    heads = head_versions(log_of(spark, sf))
    asked = _requests(spark, sf, "version", F.lit(0)).join(heads.select("stream_name", "version"), "stream_name", "left")
    twice = asked.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    two = twice.select((F.col("request_id") * 2 + F.col("i")).alias("request_id"), "stream_name", F.when((F.col("i") == 0) & F.col("version").isNull(), "no_stream").otherwise("version").alias("expected_kind"), F.coalesce("version", F.lit(-1)).cast("long").alias("expected_version"), "n")
    return decide_appends(two, heads).where(~F.col("accepted")).select("request_id", "stream_name", "actual", "message")


@query("append_empty_batch", "SELECT c_custkey AS request_id, true AS accepted, CAST(NULL AS BIGINT) AS new_version, CAST(NULL AS VARCHAR) AS message FROM customer")
def append_empty_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch without events is accepted, whatever it expects, and changes nothing."""
    asked = _requests(spark, sf, "version", F.lit(77)).withColumn("n", F.lit(0).cast("long"))
    return decide_appends(asked, head_versions(log_of(spark, sf))).select("request_id", "accepted", "new_version", "message")


@query("version_sentinels", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'no_stream' WHEN 2 THEN 'no_stream' ELSE 'version' END AS kind FROM customer")
def version_sentinels(spark: SparkSession, sf: str) -> DataFrame:
    cases = F.when(F.col("c_custkey") % 4 == 0, F.lit(ANY)).when(F.col("c_custkey") % 4 == 1, F.lit(NEW_STREAM)).when(F.col("c_custkey") % 4 == 2, F.lit(NO_STREAM)).otherwise(F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", expected_kind(cases.cast("long")).alias("kind"))


@query("append_place_events", f"WITH {HEADS_SQL}, e AS (SELECT request_id, stream_name, v, i FROM r LEFT JOIN heads USING (stream_name), (VALUES (0), (1)) t(i)) SELECT stream_name, coalesce(v, -1) + 1 + i AS stream_position, 1000000 + row_number() OVER (ORDER BY request_id, i) - 1 AS global_position, CASE i WHEN 0 THEN 'ItemAdded' ELSE 'ItemRemoved' END AS name FROM e")
def append_place_events(spark: SparkSession, sf: str) -> DataFrame:
    asked = _requests(spark, sf, "any", F.lit(None))
    event = lambda n: F.struct(F.lit(n).alias("name"), F.lit("{}").alias("payload"), F.lit(None).cast("map<string,string>").alias("metadata"))
    batches = asked.withColumn("events", F.array(event("ItemAdded"), event("ItemRemoved")))
    return place_events(batches, decide_appends(asked, head_versions(log_of(spark, sf))), 1_000_000).select("stream_name", "stream_position", "global_position", "name")


# -- projections ---------------------------------------------------------------------------------


def cart_table() -> Projection:
    return Projection(("user_id", "item")).upsert("purchase", user_id=F.col("user_id"), item=item()).delete("error", user_id=F.col("user_id"), item=item())


ITEMS_SQL = "SELECT user_id, k AS item FROM (SELECT user_id, k, arg_max(name, global_position) AS last FROM {LOG} WHERE name IN ('purchase', 'error') GROUP BY user_id, k) WHERE last = 'purchase'"
SUMMARY_SQL = """WITH s AS (SELECT stream_name, min(stream_position) AS p0 FROM {LOG} WHERE name = 'signup' GROUP BY 1)
 SELECT l.stream_name, s.p0 IS NOT NULL AS started, CAST(coalesce(sum(CASE WHEN l.stream_position > s.p0 AND name = 'purchase' THEN 1 WHEN l.stream_position > s.p0 AND name = 'error' THEN -1 ELSE 0 END), 0) AS BIGINT) AS item_count
 FROM {LOG} l LEFT JOIN s USING (stream_name) GROUP BY l.stream_name, s.p0"""


@query("projection_cart_summary", SUMMARY_SQL)
def projection_cart_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _named(CART_SUMMARY.apply(log_of(spark, sf)), "started", "item_count")


@query("projection_cart_items", ITEMS_SQL)
def projection_cart_items(spark: SparkSession, sf: str) -> DataFrame:
    return cart_table().apply(log_of(spark, sf))


@query("projection_item_list", "SELECT stream_name, string_agg(k, ' ' ORDER BY p) AS items FROM (SELECT stream_name, k, min(stream_position) AS p FROM {LOG} WHERE name = 'purchase' GROUP BY 1, 2) GROUP BY 1")
def projection_item_list(spark: SparkSession, sf: str) -> DataFrame:
    """A document for each stream, to which an item is added only if it isn't there."""
    add = Steps(F.array().cast("array<string>"), {"purchase": lambda s, e: F.when(F.array_contains(s, e["k"]), s).otherwise(F.array_append(s, e["k"]))}, ("k",), lambda s: F.array_join(s, " "))
    log = log_of(spark, sf).where(F.col("name") == "purchase").withColumn("k", item().cast("string"))
    return _named(Fold({"items": add}, key="user_id").apply(log), "items")


@query("per_checkpoint_state", "SELECT CAST((n - 1) // 100 AS BIGINT) AS interval, stream_name, count(*) AS purchases FROM (SELECT *, row_number() OVER (ORDER BY global_position) AS n FROM {LOG} WHERE name = 'purchase') GROUP BY 1, 2")
def per_checkpoint_state(spark: SparkSession, sf: str) -> DataFrame:
    handled = log_of(spark, sf).where(F.col("name") == "purchase")
    out = per_checkpoint(handled, 100, Fold({"purchases": Count("purchase")}, key="user_id"))
    return _named(out, "interval", "purchases")


@query("fanout_counts", f"SELECT consumer, l.name, count(*) AS n, max(global_position) AS last FROM {{LOG}} l JOIN {HANDLED_SQL} ON l.name = h.name GROUP BY 1, 2")
def fanout_counts(spark: SparkSession, sf: str) -> DataFrame:
    return route(log_of(spark, sf), HANDLED).groupBy("consumer", "name").agg(F.count("*").alias("n"), F.max("global_position").alias("last"))


# -- subscriptions -------------------------------------------------------------------------------

STARTS = {"cart": 500, "traffic": 200, "sales": None}


@query("consumer_offsets", f"SELECT consumer, count(*) AS n, min(global_position) AS first FROM {{LOG}} l JOIN {HANDLED_SQL} ON l.name = h.name WHERE global_position > CASE consumer WHEN 'cart' THEN 500 WHEN 'traffic' THEN 200 ELSE -1 END GROUP BY 1")
def consumer_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return consumer_events(log_of(spark, sf), HANDLED, STARTS).groupBy("consumer").agg(F.count("*").alias("n"), F.min("global_position").alias("first"))


@query("min_start_position", "SELECT min(CASE WHEN o_orderkey % 7 = 3 THEN 9223372036854775807 ELSE o_orderkey END) AS position FROM orders WHERE o_orderkey % 5 <> 0")
def min_start_position(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "orders").where(F.col("o_orderkey") % 5 != 0).select(F.when(F.col("o_orderkey") % 7 == 3, F.lit(-1).cast("long")).otherwise(F.col("o_orderkey")).alias("start"))
    return least_position(starts)


@query("position_order", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -9223372036854775808 WHEN o_orderkey % 7 = 3 THEN 9223372036854775807 ELSE o_orderkey END AS sort_key FROM orders")
def position_order(spark: SparkSession, sf: str) -> DataFrame:
    position = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 7 == 3, F.lit(-1)).otherwise(F.col("o_orderkey")).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", order_key(position).alias("sort_key"))


@query("checkpoint_positions", "WITH h AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type IN ('signup', 'purchase')) SELECT event_id AS position FROM h WHERE n % 100 = 0 OR n = (SELECT max(n) FROM h)")
def checkpoint_positions_(spark: SparkSession, sf: str) -> DataFrame:
    handled = table(spark, sf, "events").where(F.col("event_type").isin("signup", "purchase")).select(F.col("event_id").alias("global_position"))
    return checkpoint_positions(handled, 100)


@query("checkpoint_two_frequencies", "WITH h AS (SELECT event_id, row_number() OVER (PARTITION BY event_id > 500 ORDER BY event_id) AS n FROM events WHERE event_type IN ('signup', 'purchase')) SELECT event_id AS position FROM h WHERE CASE WHEN event_id <= 500 THEN n % 100 = 0 OR n = (SELECT max(n) FROM h WHERE event_id <= 500) ELSE n % 10 = 0 END")
def checkpoint_two_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    handled = table(spark, sf, "events").where(F.col("event_type").isin("signup", "purchase")).select(F.col("event_id").alias("global_position"))
    return checkpoint_positions_live(handled, 100, 500, 10)


@query("checkpoint_by_time", "SELECT max(event_id) AS position FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY CAST(floor(epoch(ts) / 3600) AS BIGINT)")
def checkpoint_by_time(spark: SparkSession, sf: str) -> DataFrame:
    handled = table(spark, sf, "events").where(F.col("event_type").isin("signup", "purchase")).select(F.col("event_id").alias("global_position"), "ts")
    return checkpoint_times(handled, "ts", 3600)


# -- read-model queries --------------------------------------------------------------------------


@query("rm_cart_ids", f"SELECT DISTINCT user_id FROM ({ITEMS_SQL})")
def rm_cart_ids(spark: SparkSession, sf: str) -> DataFrame:
    return cart_table().apply(log_of(spark, sf)).select("user_id").distinct()


@query("rm_cart_items", f"SELECT user_id, item FROM ({ITEMS_SQL}) WHERE user_id = 5")
def rm_cart_items(spark: SparkSession, sf: str) -> DataFrame:
    return cart_table().apply(log_of(spark, sf)).where(F.col("user_id") == 5)


@query("rm_cart_navigation", f"SELECT i.user_id, i.item, s.started, s.item_count FROM ({ITEMS_SQL}) i JOIN ({SUMMARY_SQL}) s ON s.stream_name = 'user-' || i.user_id WHERE s.started")
def rm_cart_navigation(spark: SparkSession, sf: str) -> DataFrame:
    log = log_of(spark, sf)
    return cart_table().apply(log).join(CART_SUMMARY.apply(log).where("started").select("user_id", "started", "item_count"), "user_id")


@query("rm_summaries", f"SELECT stream_name, item_count FROM ({SUMMARY_SQL}) WHERE started")
def rm_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _named(CART_SUMMARY.apply(log_of(spark, sf)).where("started"), "item_count")


# -- streams -------------------------------------------------------------------------------------


def _log_table(spark: SparkSession, sf: str) -> str:
    """The log as files in global order, which the streaming source reads."""
    path = scratch_path(spark, "log")
    log = log_of(spark, sf).select("stream_name", "stream_position", "global_position", "name", "payload", "user_id")
    log.repartitionByRange("global_position").sortWithinPartitions("global_position").write.parquet(path)
    return path


STREAM_SCHEMA = "stream_name string, stream_position long, global_position long, name string, payload string, user_id long"


@query("stream_cart_summary", SUMMARY_SQL)
def stream_cart_summary(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").count()
    stream = read_log_stream(spark, _log_table(spark, sf), STREAM_SCHEMA, most=-(-events // 3))
    counted = stream_table(spark, stream, GatedCounter("signup", "purchase", "error"), scratch_path(spark, "summary"))
    return counted.select("stream_name", "started", "item_count")


@query("stream_cart_items", ITEMS_SQL)
def stream_cart_items(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").count()
    stream = read_log_stream(spark, _log_table(spark, sf), STREAM_SCHEMA, most=-(-events // 3))
    return stream_table(spark, stream, cart_table(), scratch_path(spark, "items"))


# -- the store -----------------------------------------------------------------------------------


def _store(spark: SparkSession, sf: str, where: F.Column | None = None) -> EventStore:
    store = EventStore(spark, scratch_path(spark, "store"))
    store.import_log(log_of(spark, sf) if where is None else log_of(spark, sf).where(where))
    return store


def item_table() -> Projection:
    """The cart's items by stream name, for logs without a native key."""
    return Projection(("stream_name", "item")).upsert("purchase", stream_name=F.col("stream_name"), item=item()).delete("error", stream_name=F.col("stream_name"), item=item())


NAMED_ITEMS_SQL = f"SELECT 'user-' || user_id AS stream_name, item FROM ({ITEMS_SQL})"


@query("store_append_read", f"WITH {HEADS_SQL}, base AS (SELECT max(global_position) + 1 AS g FROM {{LOG}}), e AS (SELECT request_id, stream_name, v, i FROM r LEFT JOIN heads USING (stream_name), (VALUES (0), (1)) t(i)) SELECT stream_name, stream_position, global_position, name FROM {{LOG}} UNION ALL SELECT stream_name, coalesce(v, -1) + 1 + i, g + row_number() OVER (ORDER BY request_id, i) - 1, CASE i WHEN 0 THEN 'ItemAdded' ELSE 'ItemRemoved' END FROM e, base")
def store_append_read(spark: SparkSession, sf: str) -> DataFrame:
    """A log is imported, every customer's stream is appended to, all is compacted and read."""
    store = _store(spark, sf)
    event = lambda n: F.struct(F.lit(n).alias("name"), F.lit("{}").alias("payload"), F.lit(None).cast("map<string,string>").alias("metadata"))
    store.append_batch(_requests(spark, sf, "any", F.lit(None)).withColumn("events", F.array(event("ItemAdded"), event("ItemRemoved"))))
    store.compact()
    return store.log().select("stream_name", "stream_position", "global_position", "name")


@query("store_read_stream", "SELECT stream_position, global_position, name FROM {LOG} WHERE stream_name = 'user-7'")
def store_read_stream(spark: SparkSession, sf: str) -> DataFrame:
    """One stream from a compacted store (one bucket of its copy) and a later commit."""
    early = F.col("global_position") < 300
    store = _store(spark, sf, early)
    store.import_log(log_of(spark, sf).where((F.col("global_position") >= 300) & (F.col("global_position") < 600)))
    store.compact()
    store.import_log(log_of(spark, sf).where(F.col("global_position") >= 600))
    return read_stream(store.stream_log("user-7"), "user-7").select("stream_position", "global_position", "name")


@query("stream_store_compacted", "SELECT stream_name, count(*) AS n, CAST(sum(global_position) AS BIGINT) AS positions FROM {LOG} GROUP BY stream_name")
def stream_store_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over a store that is compacted and goes on between two of its batches: each event comes once."""
    store = _store(spark, sf, F.col("global_position") < 300)
    store.import_log(log_of(spark, sf).where((F.col("global_position") >= 300) & (F.col("global_position") < 700)))
    folder, offsets = scratch_path(spark, "seen"), scratch_path(spark, "offsets")
    run = lambda: run_available(store.stream(), lambda batch, n: batch.select("stream_name", "global_position").write.mode("append").parquet(folder), offsets)
    run()
    store.compact()
    store.import_log(log_of(spark, sf).where(F.col("global_position") >= 700))
    run()
    return spark.read.parquet(folder).groupBy("stream_name").agg(F.count("*").alias("n"), F.sum("global_position").alias("positions"))


@query("stream_restart", NAMED_ITEMS_SQL)
def stream_restart(spark: SparkSession, sf: str) -> DataFrame:
    """A subscription that is lost after its first batch, and another in its place: it begins behind the model's position."""
    store, folder, offsets = _store(spark, sf), scratch_path(spark, "model"), scratch_path(spark, "offsets")

    class Lost(ModelConsumer):
        def on_batch(self, batch: DataFrame, number: int) -> bool:
            if number:
                raise RuntimeError("the process is lost")
            return super().on_batch(batch, number)

    for kind in (Lost, ModelConsumer):
        most = -(-((store.head() or 0) + 1) // 2)
        sub = Subscription(spark, lambda after: store.stream(after, most), [kind(ReadModel(spark, item_table(), folder))], offsets)  # noqa: B023
        sub.start()
        sub.flush()
        sub.stop()
    return ReadModel(spark, item_table(), folder).rows()


@query("subscription_resume", f"SELECT 'cart' AS consumer, stream_name, item FROM ({NAMED_ITEMS_SQL}) UNION ALL SELECT DISTINCT 'sales', stream_name, k FROM {{LOG}} WHERE name = 'purchase' AND global_position > 400")
def subscription_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Two consumers on one scan, one of which starts later; the other fails, is suspended and resumed."""
    store = _store(spark, sf)
    models = {"cart": ReadModel(spark, item_table(), scratch_path(spark, "cart")), "sales": ReadModel(spark, Projection(("stream_name", "item")).upsert("purchase", stream_name=F.col("stream_name"), item=item()), scratch_path(spark, "sales"))}

    class Fails(ModelConsumer):
        broken = True

        def on_batch(self, batch: DataFrame, number: int) -> bool:
            if self.broken:
                raise RuntimeError("broken")
            return super().on_batch(batch, number)

    class Later(ModelConsumer):
        def on_restore(self) -> int | None:
            return max(super().on_restore() or 0, 400)

    cart = Fails(models["cart"], "cart")
    sub = Subscription(spark, store.stream, [cart, Later(models["sales"], "sales")], scratch_path(spark, "offsets"), store.head)
    sub.start()
    sub.catch_up()
    cart.broken = False
    sub.resume("cart")
    sub.stop()
    return union(*[m.rows().select(F.lit(n).alias("consumer"), "stream_name", "item") for n, m in models.items()])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return projection_cart_summary(spark, sf)
