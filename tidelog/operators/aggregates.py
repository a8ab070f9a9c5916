"""Aggregates in Python: appliers, commands, repositories with snapshots.

A command runs on a state and gives events; whether the new state comes from the
command's result or from applying the events is the type's choice.  ``AggregateType``
holds what is needed for that; ``AggregateRepository`` loads by a strategy and saves
under the version that was loaded.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from ..errors import InvalidState, SnapshotDoesNotExist
from ..functions.mapping import EventTypes, subclasses
from ..functions.metadata import MetadataContext
from ..functions.naming import StreamNaming, id_selector
from ..functions.positions import Expected
from .snapshots import PREFER_SNAPSHOT, USE_EVENT_STREAM, USE_SNAPSHOT

if TYPE_CHECKING:
    from ..sources.store import EventStore

NEVER, MATERIALIZE_FIRST, WHILE_ENUMERATING = "never", "materialize_first", "while_enumerating"


def applies(event: type) -> Callable:
    """Marks a method ``(self, event)`` or a function ``(state, event)`` as the applier of an event type."""

    def mark(f: Callable) -> Callable:
        f._applies = event
        return f

    return mark


@dataclass
class AggregateType:
    """How states of one kind are made, folded, named and commanded.

    mutable: appliers change the state and return nothing; else they return the next one.
    """

    kind: type
    mutable: bool = False
    factory: Callable[[], object] | None = None
    naming: StreamNaming | None = None
    id_of: Callable[[object], object] | None = None
    appliers: dict[type, Callable] = field(default_factory=dict)
    apply_any: Callable | None = None
    raised: Callable[[object], list] | None = None
    clear_raised: Callable[[object], None] | None = None
    events_of: Callable[[object], Iterable] | None = None
    state_of: Callable[[object], object] | None = None
    apply_events: str = MATERIALIZE_FIRST

    def __post_init__(self) -> None:
        self.naming = self.naming or StreamNaming.of(self.kind)
        self.id_of = self.id_of or id_selector(self.kind)
        self.factory = self.factory or self.kind

    def discover(self, holder: type | None = None, method: str = "apply", private: bool = False) -> AggregateType:
        """Finds appliers: marked with ``applies``, or called ``method`` (or ``method_...``) with an annotated event.

        What is configured already is kept.  Nothing found is an error.
        """
        found: dict[type, Callable] = {}
        for name, f in inspect.getmembers(holder or self.kind, callable):
            marked = getattr(f, "_applies", None)
            plain = name.lstrip("_") if private else name
            if marked is None and (plain == method or plain.startswith(f"{method}_")):
                hints = [p.annotation for p in inspect.signature(f, eval_str=True).parameters.values()]
                marked = next((h for h in reversed(hints) if isinstance(h, type) and h is not inspect.Parameter.empty), None)
            if isinstance(marked, type):
                found[marked] = f
        if not found:
            raise ValueError(f"{(holder or self.kind).__name__} has no appliers named '{method}'")
        self.appliers = found | self.appliers
        return self

    def map_events(self, types: EventTypes, base: type, where: Callable[[type], bool] | None = None) -> AggregateType:
        for k in subclasses(base, where):
            types.map(k)
        return self

    def apply(self, state: object, event: object) -> object:
        f = self.appliers.get(type(event), self.apply_any)
        if f is None:
            raise InvalidState(f"{self.kind.__name__} has no applier for {type(event).__name__}")
        after = f(state, event)
        return state if self.mutable else after

    def new(self) -> object:
        try:
            return self.factory()
        except TypeError as e:
            raise InvalidState(f"{self.kind.__name__} can't be made without a factory") from e

    def execute(self, state: object, command: Callable[[object], object]) -> tuple[object, list]:
        """The state after a command, and its events."""
        return self._mutable(state, command) if self.mutable else self._immutable(state, command)

    def _immutable(self, state: object, command: Callable[[object], object]) -> tuple[object, list]:
        result = command(state)
        if result is None:
            raise InvalidState("a command on an immutable state has to return its events")
        events = list(self.events_of(result) if self.events_of else result)  # enumerated once
        if self.state_of:
            return self.state_of(result), events
        for e in events:
            state = self.apply(state, e)
        return state, events

    def _mutable(self, state: object, command: Callable[[object], object]) -> tuple[object, list]:
        result = command(state)
        if result is None or self.raised and not self.events_of:
            if not self.raised:
                raise InvalidState("a command without a result needs a selector of raised events")
            events = list(self.raised(state))
            if self.clear_raised:
                self.clear_raised(state)
            return state, events
        source = self.events_of(result) if self.events_of else result
        if self.apply_events == WHILE_ENUMERATING:
            return state, list(self._applying(state, source))
        events = list(source)
        if self.apply_events == MATERIALIZE_FIRST:
            for e in events:
                self.apply(state, e)
        return state, events

    def _applying(self, state: object, events: Iterable) -> Iterator:
        """Each event is applied before the next one is asked for, so later ones see earlier changes."""
        for e in events:
            self.apply(state, e)
            yield e


class Model:
    """Aggregate types by the class of their state, over one map of event names."""

    def __init__(self, types: EventTypes | None = None):
        self.types = types or EventTypes()
        self._kinds: dict[type, AggregateType] = {}

    def add(self, kind: AggregateType) -> Model:
        """Adds a type; events that it applies and that have no name yet go by their type's."""
        known = {t.kind for t in self.types.types}
        for event in kind.appliers:
            if event not in known:
                self.types.map(event)
        self._kinds[kind.kind] = kind
        return self

    def of(self, state: type) -> AggregateType:
        if state not in self._kinds:
            raise LookupError(f"the model has no aggregate type for {state.__name__}")
        return self._kinds[state]


@dataclass
class LoadedAggregate:
    state: object
    id: str
    kind: AggregateType
    version: int
    snapshot_version: int | None
    events_loaded: int
    to_persist: list = field(default_factory=list)
    saved: bool = False

    def execute(self, command: Callable[[object], object]) -> list:
        self.state, events = self.kind.execute(self.state, command)
        self.to_persist += events
        return events


class AggregateRepository:
    """encode_state and decode_state turn a state into what JSON can hold, for snapshots."""

    def __init__(self, store: EventStore, types: EventTypes, encode_state: Callable[[object], object] | None = None, decode_state: Callable[[AggregateType, object], object] | None = None, metadata: MetadataContext | None = None):
        self.store, self.types, self.metadata = store, types, metadata
        self.encode_state = encode_state or (lambda s: vars(s))
        self.decode_state = decode_state or (lambda t, v: t.kind(**v))

    def _snapshot(self, kind: AggregateType, id_: str) -> tuple[int, object] | None:
        last = next(iter(self.store.read_stream(kind.naming.snapshot(id_), 2**63 - 1, "backwards")), None)
        if last is None:
            return None
        return int(last["metadata"]["SnapshotVersion"]), self.decode_state(kind, json.loads(last["payload"]))

    def load(self, kind: AggregateType, id_: str, strategy: str = PREFER_SNAPSHOT) -> LoadedAggregate:
        if strategy not in (PREFER_SNAPSHOT, USE_SNAPSHOT, USE_EVENT_STREAM):
            raise ValueError(f"no such strategy: {strategy}")
        found = None if strategy == USE_EVENT_STREAM else self._snapshot(kind, id_)
        if found is None and strategy == USE_SNAPSHOT:
            raise SnapshotDoesNotExist(kind.naming.snapshot(id_))
        start, state = (found[0] + 1, found[1]) if found else (0, kind.new())
        n = 0
        for row in self.store.read_stream(kind.naming.stream(id_), start):
            state, n = kind.apply(state, self.types.to_object(row["name"], row["payload"])), n + 1
        return LoadedAggregate(state, id_, kind, start + n - 1, found[0] if found else None, n)

    def save(self, loaded: LoadedAggregate, snapshot_if: Callable[[LoadedAggregate], bool] | None = None) -> int:
        """The new version.  All events are encoded before one is written; an aggregate is saved once.

        A snapshot that the predicate asks for has the new version: it contains the
        events just saved.
        """
        if loaded.saved:
            raise ValueError("this aggregate is already saved; load it again")
        extra = self.metadata.entries() if self.metadata else None
        records = [(*self.types.to_record(e), extra) for e in loaded.to_persist]
        expected = Expected.at(loaded.version) if loaded.version >= 0 else Expected.no_stream()
        new = self.store.append(loaded.kind.naming.stream(loaded.id), records, expected) if records else loaded.version
        loaded.saved, loaded.version, loaded.to_persist = True, new, []
        if snapshot_if and snapshot_if(loaded):
            self.save_snapshot(loaded)
        return new

    def save_snapshot(self, loaded: LoadedAggregate) -> None:
        """Append the state to the snapshot stream; the last one counts."""
        if loaded.version < 0:
            raise ValueError("there is nothing to take a snapshot of")
        payload = json.dumps(self.encode_state(loaded.state))
        self.store.append(loaded.kind.naming.snapshot(loaded.id), [("Snapshot", payload, {"SnapshotVersion": str(loaded.version)})], Expected.any())
