"""Folds that run on streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.projection import Projection
from .model import ReadModel


@dataclass(frozen=True)
class GatedCounter:
    """A counter that begins behind its guard event, as what a ``ReadModel`` keeps: (key, started, item_count, version).

    A row stands for a stretch of a stream: its last position, that of its first guard, what
    it counts if the counter has begun before it (``_whole``) and if it begins at that guard
    (``_behind``).  An event is such a row, and rows of stretches that follow each other
    make one, so a batch costs what it changes and nothing runs in Python.
    """

    guard: str
    plus: str
    minus: str
    key: str = "stream_name"
    order: str = "stream_position"
    position: str = "global_position"
    #: Every stream has a row, so every event is handled.
    names: tuple[str, ...] = ()

    def operations(self, events: DataFrame) -> DataFrame:
        at, one = F.col(self.order), lambda name: F.when(F.col("name") == name, 1).otherwise(0)
        return events.select(self.key, F.col(self.position).alias("_at"), at.alias("_version"), F.when(F.col("name") == self.guard, at).alias("_guard"), (one(self.plus) - one(self.minus)).cast("long").alias("_whole"), F.lit(0).cast("long").alias("_behind"))

    def latest(self, operations: DataFrame) -> DataFrame:
        """One row of each key; stretches don't overlap, so one that ends behind the first guard, but doesn't hold it, lies behind it."""
        first = F.min("_guard").over(Window.partitionBy(self.key))
        counted = F.when(F.col("_guard") == F.col("_first"), F.col("_behind")).when(F.col("_version") > F.col("_first"), F.col("_whole")).otherwise(0)
        return operations.withColumn("_first", first).groupBy(self.key).agg(F.max("_at").alias("_at"), F.max("_version").alias("_version"), F.min("_guard").alias("_guard"), F.sum("_whole").alias("_whole"), F.sum(counted).alias("_behind"))

    def rows(self, latest: DataFrame) -> DataFrame:
        return latest.select(self.key, F.col("_guard").isNotNull().alias("started"), F.col("_behind").alias("item_count"), F.col("_version").alias("version"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Handle what there is, batch by batch, then stop.

    The trigger ``availableNow`` asks a Python source for its end once, and would stop
    after one batch of a source that bounds its batches.
    """
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def stream_table(spark: SparkSession, stream: DataFrame, projection: Projection | GatedCounter, folder: str) -> DataFrame:
    """Run a projection over what a stream has; the read model is in ``folder`` (see ``ReadModel``).

    On a folder that has a model already it goes on behind the model's position.
    """
    model = ReadModel(spark, projection, folder)
    run_available(stream, lambda batch, number: model.apply(batch), f"{folder}/_offsets")
    return model.rows()
