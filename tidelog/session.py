"""Session helpers: settings for a scale, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Settings without which results or bounds don't hold, so ``prepare`` sets them where a session came without.
#: Unions: Spark 4.1 takes the partitioning that a union's sides have in common as the union's own; where AQE has
#: coalesced the sides differently that is wrong, and groups come out once from each side.
#: Batches: what goes to Python at once, as long texts, or one text repeated in many pairs, make large rows.
NEEDED = {
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}

#: Settings that the plans rely on; all are Spark's own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    **NEEDED,
}

_shipped: list[SparkContext] = []


def session(app: str = "tidelog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package's settings; pass Spark settings as ``**{"spark...": "..."}``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Check the settings that plans need, and set those that differ; ``session`` makes sessions that have them.

    Plans read them when they run, so they stay set.
    """
    for key, value in NEEDED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each context, and the session its settings.

    Python functions are pickled by reference, so workers have to import the
    package; a driver that found it through ``sys.path`` alone has not told them.
    """
    prepare(spark)
    sc = spark.sparkContext
    if any(x is sc for x in _shipped):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tidelog-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)
    _shipped[:] = [sc]


def union(first: DataFrame, *others: DataFrame, missing: bool = False) -> DataFrame:
    """``unionByName`` whose result can be grouped and joined safely (see ``NEEDED``)."""
    prepare(first.sparkSession)
    for other in others:
        first = first.unionByName(other, allowMissingColumns=missing)
    return first
