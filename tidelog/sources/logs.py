"""Tables viewed as event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import union


def log_from(df: DataFrame, stream: Column, key: str, order: list[Column | str], global_position: Column, name: Column, payload: Column, metadata: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows as a log: positions of a stream follow ``order`` inside ``key``.

    The window and later grouping use the native key, and the stream's name is made
    from it after the window, so grouping by ``key`` takes no second shuffle.
    """
    w = Window.partitionBy(key).orderBy(*order)
    numbered = df.withColumn("_at", (F.row_number().over(w) - 1).cast("long"))
    meta = F.lit(None).cast("map<string,string>") if metadata is None else metadata
    return numbered.select(stream.alias("stream_name"), F.col("_at").alias("stream_position"), global_position.cast("long").alias("global_position"), name.alias("name"), payload.alias("payload"), meta.alias("metadata"), *[c for c in dict.fromkeys((key, *keep))])


def events_log(events: DataFrame) -> DataFrame:
    """``events``: a stream for each user; keeps user_id, value and the item ``k`` of the payload."""
    log = log_from(events, F.concat(F.lit("user-"), F.col("user_id").cast("string")), "user_id", ["event_id"], F.col("event_id"), F.col("event_type"), F.col("props"), keep=("value", "ts"))
    return log


def conversation_log(conversations: DataFrame) -> DataFrame:
    """``conversations``: a stream for each conversation; turns are positions already, so nothing is shuffled for them.

    The global position orders by (conv_id, turn): conversations before one's own are
    counted from one row each.
    """
    base = conversations.groupBy("conv_id").agg(F.count("*").alias("_n"))
    from ..plans.numbering import running_total

    offsets = running_total(base, "conv_id", "_n", "_before").select("conv_id", "_before")
    joined = conversations.join(offsets, "conv_id")
    return joined.select(F.concat(F.lit("conversation-"), F.col("conv_id").cast("string")).alias("stream_name"), F.col("turn").alias("stream_position"), (F.col("_before") + F.col("turn")).alias("global_position"), F.col("role").alias("name"), F.to_json(F.struct("text")).alias("payload"), F.lit(None).cast("map<string,string>").alias("metadata"), "conv_id")


def order_log(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """``orders`` and ``lineitem``: OrderPlaced at 0, then LineAdded in a total order of all line columns.

    (l_orderkey, l_linenumber) is not unique, so ties are broken by the other columns.
    Global positions are not made here; see ``running_number``.
    """
    placed = orders.select(F.col("o_orderkey").alias("order_key"), F.lit(0).alias("_kind"), F.lit("OrderPlaced").alias("name"), F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))).alias("payload"), F.col("o_totalprice").alias("amount"), F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in lineitem.schema.fields]).alias("_line"))
    lines = lineitem.select(F.col("l_orderkey").alias("order_key"), F.lit(1).alias("_kind"), F.lit("LineAdded").alias("name"), F.to_json(F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("line"))).alias("payload"), F.col("l_extendedprice").alias("amount"), F.struct(*lineitem.columns).alias("_line"))
    rest = [c for c in lineitem.columns if c not in ("l_orderkey", "l_linenumber")]
    w = Window.partitionBy("order_key").orderBy("_kind", "_line.l_linenumber", *[f"_line.{c}" for c in rest])
    numbered = union(placed, lines).withColumn("stream_position", (F.row_number().over(w) - 1).cast("long"))
    return numbered.select(F.concat(F.lit("order-"), F.col("order_key").cast("string")).alias("stream_name"), "stream_position", "name", "payload", "amount", "order_key")
