"""Watches: what is new since the last run, and windowed counts of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str, per_trigger: int = 50) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def fresh(stream: DataFrame, keys: list[str], event_time: str, late: str) -> DataFrame:
    """Each key once; keys are remembered until the watermark, `late` behind the newest event, has passed them."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """day, event_type, n, total: tumbling windows of a stream or a table of events (ts, event_type, value)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("day"), "event_type", "n", "total")


def run_watch(spark: SparkSession, landing: str, schema: str, keys: list[str], event_time: str, out: str, checkpoint: str, late: str = "7 days") -> None:
    """One run over all that has landed: rows with keys not seen before are appended to `out`; state is in `checkpoint`."""
    found = fresh(arriving(spark, landing, schema), keys, event_time, late)
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
