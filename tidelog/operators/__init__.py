"""Operators over the event log: reads, appends, entities, snapshots, aggregates."""

from .append import decide_appends, place_events
from .entities import AdapterRegistry, EntityAdapter, EntityStore, load_entities, load_or_create
from .reads import after_position, exclude_system, head_versions, missing_streams, read_from, read_stream, subscribe_stream
from .snapshots import latest_snapshots, load_with_strategy, take_snapshots

__all__ = ["AdapterRegistry", "EntityAdapter", "EntityStore", "after_position", "decide_appends", "exclude_system", "head_versions", "latest_snapshots", "load_entities", "load_or_create", "load_with_strategy", "missing_streams", "place_events", "read_from", "read_stream", "subscribe_stream", "take_snapshots"]
