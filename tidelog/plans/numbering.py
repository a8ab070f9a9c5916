"""Running numbers and sums over a whole table without a single-task window.

Rows are range partitioned by the column (bounds come from a sample of it, so outliers
and gaps make no large partition, and the number of partitions is the session's), sorted
and written once: that fixes the sampled bounds, and the input is planned once.  What
lies before a partition is the sum over one small row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise

_SHIFT, _MASK = 33, (1 << 33) - 1


def _laid(df: DataFrame, order: str, buckets: int | None) -> DataFrame:
    """df as a table in order, with ``_part`` and ``_k`` (its place in the partition, from 0)."""
    ranged = df.repartitionByRange(buckets, F.col(order)) if buckets else df.repartitionByRange(F.col(order))
    laid = materialise(ranged.sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    return laid.withColumn("_part", F.shiftright("_at", _SHIFT)).withColumn("_k", F.col("_at").bitwiseAND(F.lit(_MASK))).drop("_at")


def _before(parts: DataFrame, amount: str) -> DataFrame:
    """_part and the sum of ``amount`` over the partitions before; a row for each partition, so its window is small."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select("_part", F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("long").alias("_sum_before")))


def running_number(df: DataFrame, position: str = "global_position", out: str = "number", buckets: int | None = None) -> DataFrame:
    """df with ``out``: 1, 2, 3, ... in the order of a column without ties; buckets: range partitions, else the session's."""
    laid = _laid(df, position, buckets)
    before = _before(laid.groupBy("_part").agg(F.count("*").alias("_n")), "_n")
    return laid.join(before, "_part").withColumn(out, (F.col("_sum_before") + F.col("_k") + 1).cast("long")).drop("_part", "_k", "_sum_before")


def running_total(df: DataFrame, order: str, amount: str, out: str, buckets: int | None = None) -> DataFrame:
    """df with ``out``: the sum of ``amount`` over all rows of a smaller ``order`` (without ties)."""
    laid = _laid(df, order, buckets)
    before = _before(laid.groupBy("_part").agg(F.sum(amount).alias("_s")), "_s")
    w = Window.partitionBy("_part").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(amount).over(w), F.lit(0))
    return laid.withColumn("_in", inside).join(before, "_part").withColumn(out, (F.col("_sum_before") + F.col("_in")).cast("long")).drop("_part", "_k", "_in", "_sum_before")
