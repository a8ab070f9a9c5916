"""Metadata that is added to every event that is written."""

from __future__ import annotations

import getpass
import platform
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys of the default entries.
USER, MACHINE, SERVICE, UTC = "LoggedInUserName", "MachineName", "ServiceName", "UtcDateTime"


class MetadataContext:
    """Static entries, then lazy ones (asked for at each write), then what the caller adds.

    A key that comes twice is an error, in Python as in the column.
    """

    def __init__(self, static: Mapping[str, str] | None = None, lazy: Mapping[str, Callable[[], str]] | None = None):
        self.static, self.lazy = dict(static or {}), dict(lazy or {})
        if twice := self.static.keys() & self.lazy.keys():
            raise ValueError(f"metadata keys that come twice: {sorted(twice)}")

    @staticmethod
    def default(service: str = "tidelog") -> MetadataContext:
        return MetadataContext({USER: getpass.getuser(), MACHINE: platform.node(), SERVICE: service}, {UTC: lambda: datetime.now(timezone.utc).isoformat(timespec="microseconds")})

    def adding(self, static: Mapping[str, str] | None = None, lazy: Mapping[str, Callable[[], str]] | None = None) -> MetadataContext:
        for given, own in ((static, self), (lazy, self)):
            if twice := (given or {}).keys() & {*own.static, *own.lazy}:
                raise ValueError(f"metadata keys that come twice: {sorted(twice)}")
        return MetadataContext(self.static | dict(static or {}), self.lazy | dict(lazy or {}))

    def entries(self, additional: Mapping[str, str] | None = None) -> dict[str, str]:
        own = self.static | {k: f() for k, f in self.lazy.items()}
        if twice := own.keys() & (additional or {}).keys():
            raise ValueError(f"metadata keys that come twice: {sorted(twice)}")
        return own | dict(additional or {})

    def column(self, additional: Column | None = None) -> Column:
        """A map column; ``map_concat`` rejects keys that come twice."""
        own = self.entries()
        pairs = [F.lit(x) for kv in own.items() for x in kv]
        base = F.create_map(*pairs).cast("map<string,string>")
        return base if additional is None else F.map_concat(base, additional)
