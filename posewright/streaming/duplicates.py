"""Counting duplicates as rows arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import new_path


def running_counts(rows: DataFrame, key: Column) -> DataFrame:
    """``key, n`` of a stream, or of a table, so far."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def count_folder(spark: SparkSession, folder: str, schema, key: Column, name: str) -> DataFrame:
    """Counts by key of all Parquet files that are in ``folder`` now, taken through a stream.

    The counts are kept by the state store under a checkpoint, and each batch's changed keys are written;
    the latest count of a key stands.
    """
    out, checkpoint = new_path(spark, f"{name}-counts"), new_path(spark, f"{name}-checkpoint")
    source = spark.readStream.schema(schema).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    query = (running_counts(source, key).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.schema("key string, n long, batch int").parquet(out)
    return rows.groupBy("key").agg(F.max_by("n", "batch").alias("n"))


def event_windows(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by event type and tumbling window; on a stream, rows later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), "event_type", "n")
