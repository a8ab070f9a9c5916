"""Plans: the fold compiler, projections, running numbers."""

from .fold import Count, Fold, Greatest, KeyedSet, LastValue, Least, Reducer, Steps, Total
from .numbering import running_number
from .projection import Projection, checkpoint_positions, consumer_events, per_checkpoint

__all__ = ["Count", "Fold", "Greatest", "KeyedSet", "LastValue", "Least", "Projection", "Reducer", "Steps", "Total", "checkpoint_positions", "consumer_events", "per_checkpoint", "running_number"]
