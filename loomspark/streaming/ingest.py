"""Incremental ingestion: new files of a folder become chunks in a table, by a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.operators.chunks import fixed_chunks
from loomspark.operators.versions import last_of_each


def stream_chunks(spark: SparkSession, folder: str, target: str, checkpoint: str, schema: str = "path string, content string, seq long", size: int = 2000) -> StreamingQuery:
    """Reads files(path, content, seq) as they arrive and appends their chunks, once per batch even if it is retried; of several versions of a path in a batch the one with the highest seq counts."""
    files = spark.readStream.schema(schema).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        fixed_chunks(last_of_each(batch, "path", "seq"), size=size).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each file from the last batch that had it."""
    rows = spark.read.option("basePath", target).parquet(target)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"])


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums of a stream of events(ts, event_type, value) in tumbling windows; rows later than `late` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
