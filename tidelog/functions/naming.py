"""Names of streams and snapshot streams, and ids of entities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def default_prefix(kind: type | str) -> str:
    """The type's name with its first letter in lower case."""
    name = kind if isinstance(kind, str) else kind.__name__
    return name[:1].lower() + name[1:]


@dataclass(frozen=True)
class StreamNaming:
    """``{prefix}-{id}`` and ``{prefix}Snapshot-{id}``, or what the selectors give."""

    prefix: str
    stream_key: Callable[[str], str] | None = None
    snapshot_key: Callable[[str], str] | None = None

    @staticmethod
    def of(kind: type | str, prefix: str | None = None) -> StreamNaming:
        return StreamNaming(prefix or default_prefix(kind))

    @staticmethod
    def _given(id_: object) -> str:
        if id_ is None or not str(id_).strip():
            raise ValueError("an id can't be null or blank")
        return str(id_)

    def stream(self, id_: object) -> str:
        key = self._given(id_)
        return self.stream_key(key) if self.stream_key else f"{self.prefix}-{key}"

    def snapshot(self, id_: object) -> str:
        key = self._given(id_)
        return self.snapshot_key(key) if self.snapshot_key else f"{self.prefix}Snapshot-{key}"

    def _column(self, id_: Column, infix: str) -> Column:
        text = id_.cast("string")
        blank = text.isNull() | (F.trim(text) == "")
        return F.when(blank, F.raise_error(F.lit("an id can't be null or blank"))).otherwise(F.concat(F.lit(f"{self.prefix}{infix}-"), text))

    def stream_column(self, id_: Column) -> Column:
        return self._column(id_, "")

    def snapshot_column(self, id_: Column) -> Column:
        return self._column(id_, "Snapshot")


def id_selector(kind: type) -> Callable[[object], object]:
    """Reads ``id``, else ``{type_name}_id`` (snake case); a type with neither fails when it is used."""
    snake = "".join(f"_{c.lower()}" if c.isupper() and k else c.lower() for k, c in enumerate(kind.__name__)) + "_id"
    fields = {*getattr(kind, "__annotations__", {}), *dir(kind)}
    name = next((n for n in ("id", snake) if n in fields), None)

    def select(entity: object) -> object:
        if name is None and not hasattr(entity, "id"):
            raise TypeError(f"{kind.__name__} has neither 'id' nor '{snake}'; name an id selector")
        return getattr(entity, name or "id")

    return select
