"""Snapshots of folded states, and loads that start from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SnapshotDoesNotExist
from ..plans.fold import Fold
from ..session import prepare

USE_SNAPSHOT, USE_EVENT_STREAM, PREFER_SNAPSHOT = "use_snapshot", "use_event_stream", "prefer_snapshot"


def take_snapshots(states: DataFrame, fold: Fold, where: Column | None = None) -> DataFrame:
    """key, ``version`` and struct ``state`` of each folded state (that the predicate picks).

    The version is that of the last event which the state contains, so a later load
    applies none of them twice.
    """
    picked = states if where is None else states.where(where)
    return picked.select(fold.key, "version", F.struct(*fold.state()).alias("state"))


def latest_snapshots(snapshots: DataFrame, key: str = "stream_name", order: str = "version") -> DataFrame:
    """Of all snapshots of a stream the last one; its version is ``version``."""
    prepare(snapshots.sparkSession)  # they are often a union
    return snapshots.groupBy(key).agg(F.max_by(F.struct("version", "state"), order).alias("_s")).select(key, "_s.version", "_s.state")


def load_with_strategy(log: DataFrame, fold: Fold, snapshots: DataFrame | None = None, strategy: str = PREFER_SNAPSHOT, requested: DataFrame | None = None) -> DataFrame:
    """The states of streams with ``version``, ``snapshot_version`` and ``events_loaded``.

    use_event_stream replays all events; prefer_snapshot starts from the latest
    snapshot where there is one; use_snapshot has rows for streams with a snapshot
    only (see ``missing_snapshots``, and ``require_snapshots`` for the error).
    A stream without events and snapshot has no row.
    """
    key = fold.key
    if requested is not None:
        log = log.join(requested.select(key), key, "left_semi")
    if strategy == USE_EVENT_STREAM or snapshots is None:
        out = fold.apply(log)
        return out.select(key, *fold.state(), "version", F.lit(None).cast("long").alias("snapshot_version"), F.col("events").alias("events_loaded"))
    if strategy not in (PREFER_SNAPSHOT, USE_SNAPSHOT):
        raise ValueError(f"no such strategy: {strategy}")
    seeds = snapshots
    if requested is not None:
        seeds = seeds.join(requested.select(key), key, "left_semi")
    # The fold starts from the latest of all seeds that it meets, in the shuffle that it takes anyway.
    out = fold.apply(log, seeds, seeded_only=strategy == USE_SNAPSHOT)
    return out.select(key, *fold.state(), "version", "snapshot_version", F.col("events").alias("events_loaded"))


def missing_snapshots(requested: DataFrame, snapshots: DataFrame, key: str = "stream_name") -> DataFrame:
    return requested.select(key).join(snapshots.select(key), key, "left_anti")


def require_snapshots(requested: DataFrame, snapshots: DataFrame, key: str = "stream_name") -> None:
    if first := missing_snapshots(requested, snapshots, key).first():
        raise SnapshotDoesNotExist(first[0])
