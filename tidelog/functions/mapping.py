"""Names of events and the schemas behind them.

``EventTypes`` maps current and former names to one type, ``NameMap`` is a
bijection of names and types, ``ProjectionTypes`` lets a name stand for several
types of which the first is used.  A type is a dataclass or a ``StructType``.
"""

from __future__ import annotations

import dataclasses
import types
import typing
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnmappedEventName, UnmappedEventType
from .codec import Codec, JsonCodec

_ATOMS = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def type_of(hint: object) -> T.DataType:
    if hint in _ATOMS:
        return _ATOMS[hint]
    if isinstance(hint, T.DataType):
        return hint
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        return type_of(next(a for a in args if a is not type(None)))
    if origin in (list, tuple, set, frozenset):
        return T.ArrayType(type_of(args[0]))
    if origin is dict:
        return T.MapType(type_of(args[0]), type_of(args[1]))
    if dataclasses.is_dataclass(hint):
        return schema_of(hint)
    raise TypeError(f"no column type for {hint!r}")


def schema_of(kind: type | T.StructType | str) -> T.StructType:
    """The columns of a dataclass; a schema or DDL text is taken as it is."""
    if isinstance(kind, T.StructType):
        return kind
    if isinstance(kind, str):
        return T.StructType.fromDDL(kind)
    hints = typing.get_type_hints(kind)
    return T.StructType([T.StructField(f.name, type_of(hints[f.name])) for f in dataclasses.fields(kind)])


@dataclasses.dataclass(frozen=True)
class EventType:
    name: str
    kind: type | None
    schema: T.StructType
    deprecated: tuple[str, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return (self.name, *self.deprecated)


def subclasses(base: type, where: Callable[[type], bool] | None = None) -> list[type]:
    """All concrete subclasses of a base, in order of definition; none is an error."""
    found, todo = [], list(base.__subclasses__())
    while todo:
        k = todo.pop(0)
        todo += k.__subclasses__()
        if not getattr(k, "__abstractmethods__", None) and (where is None or where(k)):
            found.append(k)
    if not found:
        raise ValueError(f"no event types are derived from {base.__name__}")
    return list(dict.fromkeys(found))


class EventTypes:
    """Names to types, former names included.  Single mappings override those of a base; the last of a type wins."""

    def __init__(self, codec: Codec | None = None):
        self.codec = codec or JsonCodec()
        self._base: dict[object, EventType] = {}
        self._single: dict[object, EventType] = {}

    def map(self, kind: type | T.StructType | str, name: str | None = None, deprecated: Iterable[str] = ()) -> EventTypes:
        if not isinstance(kind, type) and name is None:
            raise ValueError("a schema needs a name")
        cls = kind if isinstance(kind, type) else None
        self._single[cls or name] = EventType(name or cls.__name__, cls, schema_of(kind), tuple(deprecated))
        return self

    def map_all(self, base: type, where: Callable[[type], bool] | None = None) -> EventTypes:
        for k in subclasses(base, where):
            self._base[k] = EventType(k.__name__, k, schema_of(k))
        return self

    @property
    def types(self) -> list[EventType]:
        found = list((self._base | self._single).values())
        names = [n for t in found for n in t.names]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"event names that are mapped twice: {sorted(twice)}")
        return found

    def by_name(self, name: str) -> EventType:
        for t in self.types:
            if name in t.names:
                return t
        raise UnmappedEventName(name)

    def by_kind(self, kind: type) -> EventType:
        for t in self.types:
            if t.kind is kind:
                return t
        raise UnmappedEventType(kind)

    def names_of(self, *kinds: type | str) -> list[str]:
        """All names, current and former, of some types: what a scan is filtered by before it decodes."""
        return [n for k in kinds for n in (self.by_kind(k) if isinstance(k, type) else self.by_name(k)).names]

    def canonical(self, name: Column, on_unmapped: str = "error") -> Column:
        """The current name; an unmapped one is an error, null (``null``) or itself (``keep``)."""
        pairs = [F.lit(x) for t in self.types for n in t.names for x in (n, t.name)]
        found = F.element_at(F.create_map(*pairs), name) if pairs else F.lit(None).cast("string")
        if on_unmapped == "null":
            return found
        if on_unmapped == "keep":
            return F.coalesce(found, name)
        return F.coalesce(found, F.raise_error(F.concat(F.lit("Mapping not found for event name '"), name, F.lit("'."))).cast("string"))

    def unmapped(self, log: DataFrame) -> DataFrame:
        """The events whose name has no mapping."""
        return log.where(~F.col("name").isin([n for t in self.types for n in t.names]))

    def decode(self, log: DataFrame, *kinds: type | str, mode: str = "failfast", out: str = "event") -> DataFrame:
        """The events of one or more types with their decoded payload.

        With one type ``out`` is its struct; with several there is a struct column
        for each, named by the type, and null in rows of other types.  The filter on
        names stands below the decoding and reaches the scan.
        """
        chosen = [self.by_kind(k) if isinstance(k, type) else self.by_name(k) for k in kinds] or self.types
        kept = log.where(F.col("name").isin([n for t in chosen for n in t.names]))
        if len(chosen) == 1:
            return kept.withColumn(out, self.codec.decode(F.col("payload"), chosen[0].schema, mode))
        return kept.withColumns({t.name: F.when(F.col("name").isin(list(t.names)), self.codec.decode(F.col("payload"), t.schema, mode)) for t in chosen})

    def corrupt(self, log: DataFrame) -> DataFrame:
        """The events of mapped names whose payload can't be decoded, with ``error``."""
        tests = [F.col("name").isin(list(t.names)) & self.codec.with_corrupt(F.col("payload"), t.schema)["_corrupt_record"].isNotNull() for t in self.types]
        return log.where(reduce(Column.__or__, tests)).withColumn("error", F.lit("payload can't be decoded"))

    def valid(self, log: DataFrame) -> DataFrame:
        """The events of mapped names whose payload can be decoded."""
        tests = [F.col("name").isin(list(t.names)) & self.codec.with_corrupt(F.col("payload"), t.schema)["_corrupt_record"].isNull() for t in self.types]
        return log.where(reduce(Column.__or__, tests))

    def encode(self, kind: type | str, *columns: Column | str) -> tuple[Column, Column]:
        """The current name and the payload of events of a type."""
        t = self.by_kind(kind) if isinstance(kind, type) else self.by_name(kind)
        return F.lit(t.name), self.codec.encode(*columns)

    def to_object(self, name: str, payload: str | None, kind: type | str | None = None) -> object:
        """One decoded event in Python: the dataclass of the name (or of ``kind``, whatever the name), or a dict."""
        import json

        from ..errors import SerializationError

        if kind is None:
            t = self.by_name(name)
        else:
            t = EventType(name, kind if isinstance(kind, type) else None, schema_of(kind))
        try:
            value = json.loads(payload or "")
        except ValueError as e:
            raise SerializationError(f"payload of '{name}' can't be decoded") from e
        if not isinstance(value, dict):
            raise SerializationError(f"payload of '{name}' is not an object")
        fields = {f.name: value.get(f.name) for f in t.schema.fields}
        return t.kind(**fields) if t.kind else fields

    def to_record(self, event: object, name: str | None = None) -> tuple[str, str]:
        """Name (or the given one, which needs no mapping) and payload of one event in Python."""
        import json

        return name or self.by_kind(type(event)).name, json.dumps(dataclasses.asdict(event), separators=(",", ":"))


class NameMap:
    """A bijection of names and types; a second name or type for either is an error."""

    def __init__(self) -> None:
        self._type: dict[str, object] = {}
        self._name: dict[object, str] = {}

    def add(self, name: str, kind: object) -> NameMap:
        if self._type.get(name, kind) is not kind:
            raise ValueError(f"event name '{name}' is already mapped to another type")
        if self._name.get(kind, name) != name:
            raise ValueError(f"event type '{getattr(kind, '__name__', kind)}' is already mapped to another name")
        self._type[name], self._name[kind] = kind, name
        return self

    def name_of(self, kind: object) -> str:
        if kind not in self._name:
            raise UnmappedEventType(kind)
        return self._name[kind]

    def type_of(self, name: str) -> object:
        if name not in self._type:
            raise UnmappedEventName(name)
        return self._type[name]

    def merge(self, other: NameMap) -> NameMap:
        for n, k in other._type.items():
            self.add(n, k)
        return self


class ProjectionTypes:
    """Names that a projection knows; the first type of a name is used, types without a name go by their own."""

    def __init__(self) -> None:
        self._types: dict[str, dict[type, None]] = {}

    def map(self, name: str, kind: type) -> ProjectionTypes:
        self._types.setdefault(name, {})[kind] = None
        return self

    def with_handled(self, kinds: Iterable[type]) -> ProjectionTypes:
        named = {k for ks in self._types.values() for k in ks}
        for k in kinds:
            if k not in named:
                self.map(k.__name__, k)
        return self

    def first(self, name: str) -> type | None:
        return next(iter(self._types.get(name, ())), None)
