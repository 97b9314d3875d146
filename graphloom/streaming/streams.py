"""Structured Streaming forms of the change stream, over any streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """events as a stream; ts becomes a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def debounced(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """One row per user and burst of events without a pause of ``gap``."""
    session = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", session).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per type and tumbling window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, once each: stateful deduplication."""
    return events.select(*keys).dropDuplicates(keys)


def changes(events: DataFrame, deleted: Column, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, change, at): file changes to act on: a burst of writes counts once it is over, a deletion at once."""
    session = F.session_window("ts", gap)
    writes = events.filter(~deleted).withWatermark("ts", late).groupBy("user_id", session).agg(F.count("*").alias("n"))
    writes = writes.select("user_id", F.lit("reindex").alias("change"), F.col("session_window.end").alias("at"))
    return writes.unionByName(events.filter(deleted).select("user_id", F.lit("delete").alias("change"), F.col("ts").alias("at")))


def drain(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a stream over what is there now, into files of the shared folder, and return the rows.

    Files serve append mode; complete mode replaces the table batch by batch.
    With the folder ``base`` of an earlier run, the stream goes on from there:
    its state and watermark are kept, and only new input is read.
    """
    spark = stream.sparkSession
    base = base or scratch(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{base}/out")
    else:
        query = writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
