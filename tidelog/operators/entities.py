"""Entities: states of streams, loaded many at once, or one at a time in Python."""

from __future__ import annotations

import typing
import warnings
from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING, Protocol
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidState, StreamNotFound
from ..functions.mapping import EventTypes
from ..functions.naming import StreamNaming
from ..functions.positions import Expected
from ..plans.fold import Fold

if TYPE_CHECKING:
    from ..sources.store import EventStore


def load_entities(requested: DataFrame, log: DataFrame, fold: Fold) -> DataFrame:
    """The states of the requested streams that exist; the rest is in ``reads.missing_streams``."""
    wanted = requested.select(fold.key).distinct()
    return fold.apply(log.join(wanted, fold.key, "left_semi"))


def load_or_create(requested: DataFrame, log: DataFrame, fold: Fold, initial: dict[str, Column]) -> DataFrame:
    """As ``load_entities``; a stream that doesn't exist has the initial values, version null and 0 events."""
    wanted = requested.select(fold.key).distinct()
    loaded = fold.apply(log.join(wanted, fold.key, "left_semi"))
    out = wanted.join(loaded, fold.key, "left")
    made = F.col("version").isNull()
    return out.select(fold.key, *[F.when(made, initial[n]).otherwise(F.col(n)).alias(n) for n in fold.state()], "version", F.coalesce("events", F.lit(0)).alias("events"))


class EntityAdapter(Protocol):
    """How a Python type is folded from events and gives up what it has raised."""

    def create_state(self) -> object: ...

    def fold(self, state: object, event: object) -> object: ...

    def create(self, state: object) -> object: ...

    def current_state(self, entity: object) -> object: ...

    def id_of(self, entity: object) -> str: ...

    def raised(self, entity: object) -> Iterable[object]: ...


class AdapterRegistry:
    """The adapter of the exact type, else the first factory's that knows it, which is remembered."""

    def __init__(self) -> None:
        self._exact: dict[type, EntityAdapter] = {}
        self._factories: list[Callable[[type], EntityAdapter | None]] = []

    def add(self, kind: type, adapter: EntityAdapter) -> AdapterRegistry:
        missing = [n for n in ("create_state", "fold", "create", "id_of", "raised") if not callable(getattr(adapter, n, None))]
        if missing:
            raise ValueError(f"{type(adapter).__name__} is no entity adapter: it lacks {', '.join(missing)}")
        self._exact[kind] = adapter
        return self

    def add_generic(self, base: type, factory: Callable[..., EntityAdapter]) -> AdapterRegistry:
        """An adapter for all types derived from ``base``; the factory gets the type and the arguments of ``base[...]``."""

        def resolve(kind: type) -> EntityAdapter | None:
            if not issubclass(kind, base):
                return None
            for k in kind.__mro__:
                for origin in getattr(k, "__orig_bases__", ()):
                    if typing.get_origin(origin) is base:
                        return factory(kind, *typing.get_args(origin))
            return factory(kind)

        self._factories.append(resolve)
        return self

    def find(self, kind: type) -> EntityAdapter:
        if kind not in self._exact:
            found = next((a for f in self._factories if (a := f(kind))), None)
            if found is None:
                raise LookupError(f"no entity adapter for {kind.__name__}")
            self._exact[kind] = found
        return self._exact[kind]


class EntityStore:
    """Loads and saves single entities under optimistic concurrency."""

    def __init__(self, store: EventStore, types: EventTypes, adapters: AdapterRegistry, naming: dict[type, StreamNaming] | None = None):
        self.store, self.types, self.adapters, self.naming = store, types, adapters, naming or {}
        self._tracked: WeakKeyDictionary[object, int | None] = WeakKeyDictionary()
        self._saved: WeakKeyDictionary[object, bool] = WeakKeyDictionary()

    def stream_of(self, kind: type, id_: object) -> str:
        return self.naming.get(kind, StreamNaming.of(kind)).stream(id_)

    def _events(self, stream: str, seen: list[int]) -> Iterator[object]:
        for row in self.store.read_stream(stream):
            seen.append(row["stream_position"])
            yield self.types.to_object(row["name"], row["payload"])

    def load(self, kind: type, id_: object) -> object:
        stream = self.stream_of(kind, id_)
        adapter, seen = self.adapters.find(kind), []
        state = adapter.create_state()
        for event in self._events(stream, seen):
            state = adapter.fold(state, event)
        if not seen:
            raise StreamNotFound(stream)
        entity = adapter.create(state)
        self._tracked[entity] = seen[-1]
        return entity

    def load_or_create(self, kind: type, id_: object) -> object:
        try:
            return self.load(kind, id_)
        except StreamNotFound:
            adapter = self.adapters.find(kind)
            entity = adapter.create(adapter.create_state())
            self._tracked[entity] = None
            return entity

    def version_of(self, entity: object) -> int | None:
        return self._tracked.get(entity)

    def save(self, entity: object) -> int | None:
        """Append what the entity has raised; expects the version it was loaded at, or no stream.

        An entity can be saved once: what it raised is not cleared, so a second save
        would append it again.
        """
        if self._saved.get(entity):
            raise InvalidState("this entity is already saved; load it again")
        adapter = self.adapters.find(type(entity))
        records = [self.types.to_record(e) for e in adapter.raised(entity)]
        if not records:
            return None
        version = self._tracked.get(entity)
        expected = Expected.no_stream() if version is None else Expected.at(version)
        out = self.store.append(self.stream_of(type(entity), adapter.id_of(entity)), [(n, p, None) for n, p in records], expected)
        self._saved[entity] = True
        return out


def warn_empty(stream: str) -> None:
    warnings.warn(f"an empty batch was appended to '{stream}'", stacklevel=3)
