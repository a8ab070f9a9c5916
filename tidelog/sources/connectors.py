"""Logs that lie elsewhere: files of any format that Spark reads, and tables behind JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import decode_metadata
from ..functions.positions import checked
from ..schema import EVENT_LOG


def as_log(df: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Rows with the log's columns (or others, named by ``columns``: log column to own column), with the log's types.

    Metadata may be a map or JSON text; binary payloads are UTF-8; negative positions
    are an error; a missing metadata column is null.
    """
    own = dict(columns or {})
    kinds = dict(df.dtypes)
    out = []
    for field in EVENT_LOG.fields:
        name = own.get(field.name, field.name)
        if name not in kinds:
            if field.name != "metadata":
                raise ValueError(f"the log has no column {name}")
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif field.name == "metadata" and not kinds[name].startswith("map"):
            out.append(decode_metadata(F.col(name).cast("string")).alias(field.name))
        elif field.name.endswith("position"):
            out.append(checked(F.col(name).cast("long"), field.name).alias(field.name))
        else:
            out.append(F.col(name).cast(field.dataType).alias(field.name))
    return df.select(*out)


def log_from_files(spark: SparkSession, path: str, format_: str = "parquet", columns: Mapping[str, str] | None = None, **options: str) -> DataFrame:
    return as_log(spark.read.format(format_).options(**options).load(path), columns)


def log_from_jdbc(spark: SparkSession, url: str, table: str, columns: Mapping[str, str] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A stream store's message table.

    With several partitions the range of global positions is asked for first and read in
    parallel; filters on columns are pushed to the database.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partitions > 1:
        at = (columns or {}).get("global_position", "global_position")
        low, high = reader.option("query", f"SELECT min({at}) AS a, max({at}) AS b FROM {table}").load().first()
        reader = spark.read.format("jdbc").option("url", url).options(**options)
        reader = reader.option("partitionColumn", at).option("lowerBound", str(low or 0)).option("upperBound", str(high or 0)).option("numPartitions", str(partitions))
    return as_log(reader.option("dbtable", table).load(), columns)
