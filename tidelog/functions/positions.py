"""Positions and versions: their order, their checks, and what an append expects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels of a stream's version, and of a position behind the last event.
ANY = -(2**63) + 1
NEW_STREAM = -(2**63) + 2
NO_STREAM = -1
END = -1

_LEAST, _GREATEST = -(2**63), 2**63 - 1


def order_key(position: Column) -> Column:
    """Orders positions: null (no checkpoint) before all, END behind all; END equals END."""
    return F.when(position.isNull(), F.lit(_LEAST)).when(position == END, F.lit(_GREATEST)).otherwise(position.cast("long"))


def compare(a: int | None, b: int | None) -> int:
    """-1, 0 or 1, by the same order for plain values."""
    key = lambda p: _LEAST if p is None else _GREATEST if p == END else p
    return (key(a) > key(b)) - (key(a) < key(b))


def least_position(consumers: DataFrame, column: str = "start") -> DataFrame:
    """One row: the position that a subscription of all consumers starts after (null: from the start)."""
    return consumers.agg(F.min_by(F.col(column), order_key(F.col(column))).alias("position"))


def checked(position: Column, what: str = "position") -> Column:
    """The position, or an error where it is negative."""
    return F.when(position < 0, F.raise_error(F.concat(F.lit(f"negative {what}: "), position.cast("string")))).otherwise(position)


@dataclass(frozen=True)
class Expected:
    """What an append expects of its stream: ``any``, ``no_stream`` or a ``version``."""

    kind: str
    version: int | None = None

    @staticmethod
    def any() -> Expected:
        return Expected("any")

    @staticmethod
    def no_stream() -> Expected:
        return Expected("no_stream")

    @staticmethod
    def at(version: int) -> Expected:
        """A head position; the sentinels ANY, NEW_STREAM and NO_STREAM are taken too."""
        if version == ANY:
            return Expected("any")
        if version in (NEW_STREAM, NO_STREAM):
            return Expected("no_stream")
        if version < 0:
            raise ValueError(f"not a version: {version}")
        return Expected("version", version)


def expected_kind(version: Column) -> Column:
    """The kind of a version column with sentinels."""
    return F.when(version == ANY, F.lit("any")).when(version.isin(NEW_STREAM, NO_STREAM), F.lit("no_stream")).when(version >= 0, F.lit("version")).otherwise(F.raise_error(F.concat(F.lit("not a version: "), version.cast("string"))))
