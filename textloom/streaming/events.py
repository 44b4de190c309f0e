"""Structured Streaming over the events and over arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.session import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; their zone-less times are taken as UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums per window and type, with a watermark for late events."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of each user: events with gaps shorter than ``gap``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def first_seen(lines: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return lines.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if lines.isStreaming else lines.dropDuplicates([key])


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all there is; its result is a table in the shared folder.

    Each batch is written by the executors: in complete mode it replaces what was
    there, in append mode it is added (a repeated batch replaces its own part).
    """
    spark = stream.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/textloom-stream-{name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows" if mode == "complete" else f"{where}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).option("basePath", f"{where}/rows").parquet(f"{where}/rows")
