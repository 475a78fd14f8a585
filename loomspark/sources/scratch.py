"""Tables that cut lineage, in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """The rows of df from a table, in a folder for each value of the columns `parts`, by which it can be read without the rest."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Characters of a table (and what a row takes besides) that are still broadcast.
BROADCAST_CHARACTERS = 32_000_000


def by_size(table: DataFrame) -> DataFrame:
    """A stored table as one side of a join: broadcast where its texts fit, else merged.

    Files say little of what a table holds: ids shrink so well that few bytes may be more rows than a driver has room for.
    """
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in table.columns), F.lit(40))
    characters = table.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(table) if characters <= BROADCAST_CHARACTERS else table.hint("merge")
