"""Column functions: positions, names, payload codecs, metadata and type maps."""

from .codec import JsonCodec, decode_metadata
from .mapping import EventTypes, NameMap, ProjectionTypes, schema_of
from .metadata import MetadataContext
from .naming import StreamNaming, default_prefix
from .positions import Expected, least_position, order_key

__all__ = ["EventTypes", "Expected", "JsonCodec", "MetadataContext", "NameMap", "ProjectionTypes", "StreamNaming", "decode_metadata", "default_prefix", "least_position", "order_key", "schema_of"]
