"""Streams of rows: tumbling counts with a watermark, and conversion of what has arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, ts: str, width: str, late: str, *keys: str | Column) -> DataFrame:
    """start, keys, n, value: counts and sums by window; works for streams and tables. Event time is cast to timestamp."""
    at = F.col(ts).cast("timestamp")
    timed = events.withColumn("at_", at).withWatermark("at_", late)
    out = timed.groupBy(F.window("at_", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "value")


def read(spark: SparkSession, folder: str, schema, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def convert(stream: DataFrame, out: str, checkpoint: str, change=lambda df: df) -> StreamingQuery:
    """What has arrived so far, changed and written as Parquet; ends when it is done, and later calls go on from there."""
    return change(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, callback, checkpoint: str):
    """Calls callback(batch, number) with each bounded batch of a stream, once what is there has been read it ends."""
    return stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
