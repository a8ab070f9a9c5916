"""Read models in a folder, which move together with the position that they stand at.

A model is the last operation of each key of a ``Projection`` (or what another fold of rows
by key makes of them, as ``GatedCounter``).  A batch writes the keys
that it changes as one part, and a commit file with the list of parts and the position
makes it take effect; so a batch costs what it changes, and a model never has events
that its position doesn't have.  Events up to the position are left out, so a batch that
comes again changes nothing.  When ``MERGE`` parts of a level have gathered they become
one of the next level: a row is written anew once a level, and there are few parts to
read.  Parts that a merge has replaced are removed with the commit after it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Files
from ..plans.projection import Projection
from .runner import Consumer

#: Parts of a level that become one part of the next.
MERGE = 8


class ReadModel:
    def __init__(self, spark: SparkSession, projection: Projection, folder: str):
        self.spark, self.projection, self.folder = spark, projection, folder.rstrip("/")
        self.files = Files(spark, folder)

    def _commits(self) -> list[str]:
        return [n for n in self.files.names(f"{self.folder}/_model") if n.endswith(".json") and not n.startswith(".")]

    def _state(self) -> dict:
        names = self._commits()
        if not names:
            return {"number": -1, "position": None, "parts": [], "replaced": []}
        return json.loads(self.files.read(f"{self.folder}/_model/{names[-1]}")) | {"number": int(names[-1].split(".")[0])}

    def position(self) -> int | None:
        """The last handled position that the model has."""
        return self._state()["position"]

    def _read(self, parts: list[dict]) -> DataFrame:
        schema = parts[0]["schema"]
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p['place']}" for p in parts])

    def _write(self, latest: DataFrame, level: int) -> dict:
        place = f"parts/{uuid.uuid4().hex}"
        latest.write.option("compression", "zstd").parquet(f"{self.folder}/{place}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in latest.schema.fields)
        return {"place": place, "level": level, "schema": schema}

    def apply(self, batch: DataFrame) -> bool:
        """Add the events of a batch that the model doesn't have yet; whether there were any."""
        state, projection = self._state(), self.projection
        if state["position"] is not None:
            batch = batch.where(F.col(projection.position) > state["position"])
        part = self._write(projection.latest(projection.operations(batch)), 0)
        position = self._read([part]).agg(F.max("_at")).first()[0]
        if position is None:
            self.files.remove(f"{self.folder}/{part['place']}")
            return False
        parts, replaced, level = [*state["parts"], part], [], 0
        while len(same := [p for p in parts if p["level"] == level]) >= MERGE:
            merged = self._write(projection.latest(self._read(same)), level + 1)
            parts, replaced, level = [p for p in parts if p["level"] != level] + [merged], replaced + [p["place"] for p in same], level + 1
        number = state["number"] + 1
        # Exclusive, so of two writers one fails and has changed nothing.
        self.files.create(f"{self.folder}/_model/{number:012d}.json", json.dumps({"position": position, "parts": parts, "replaced": replaced}))
        for place in state["replaced"]:
            self.files.remove(f"{self.folder}/{place}")
        for old in self._commits()[:-2]:
            self.files.remove(f"{self.folder}/_model/{old}")
        return True

    def latest(self) -> DataFrame | None:
        """The last operation of each key; null for a model without any."""
        parts = self._state()["parts"]
        if not parts:
            return None
        return self._read(parts) if len(parts) == 1 else self.projection.latest(self._read(parts))

    def rows(self) -> DataFrame:
        """The model's table."""
        latest = self.latest()
        if latest is None:
            raise ValueError("the model has handled no event")
        return self.projection.rows(latest)


class ModelConsumer(Consumer):
    """Keeps a ``ReadModel`` as a subscription's consumer, batch by batch on executors; it restarts where the model stands."""

    def __init__(self, model: ReadModel, name: str = "model"):
        self.model, self.name = model, name

    def handlers(self) -> dict:
        return dict.fromkeys(self.model.projection.names, self.on_event)

    def on_restore(self) -> int | None:
        return self.model.position()

    def on_batch(self, batch: DataFrame, number: int) -> bool:
        self.model.apply(batch)
        return True
