"""Structured Streaming over the log: the source, stateful folds, subscriptions."""

from .model import ModelConsumer, ReadModel
from .runner import CheckpointFrequency, Consumer, Subscription, on
from .source import read_log_stream
from .state_projection import HandlerProjection, StateProjection
from .stateful import GatedCounter, stream_table

__all__ = ["CheckpointFrequency", "Consumer", "GatedCounter", "HandlerProjection", "ModelConsumer", "ReadModel", "StateProjection", "Subscription", "on", "read_log_stream", "stream_table"]
