"""Exceptions of the engine, with the messages that callers rely on."""

from __future__ import annotations


class StreamNotFound(LookupError):
    def __init__(self, stream: str):
        super().__init__(f"Stream '{stream}' could not be found.")


class SnapshotDoesNotExist(LookupError):
    def __init__(self, key: str):
        super().__init__(f"Snapshot '{key}' does not exist.")


class WrongExpectedVersion(RuntimeError):
    """An append whose expectation of the stream did not hold."""


class UnmappedEventName(LookupError):
    def __init__(self, name: str):
        super().__init__(f"Mapping not found for event name '{name}'.")


class UnmappedEventType(LookupError):
    def __init__(self, kind: object):
        super().__init__(f"Mapping not found for event type '{getattr(kind, '__name__', kind)}'.")


class SerializationError(ValueError):
    """A payload that can't be encoded or decoded."""


class InvalidState(RuntimeError):
    """An operation that the present status does not allow."""
