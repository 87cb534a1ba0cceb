"""Ingestion as a stream: the same results as the batch operators, from files as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, schema: str | T.StructType = EVENTS, files_at_once: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def once_each(events: DataFrame, key: str = "event_id", lateness: str = "1 hour") -> DataFrame:
    """Rows with new keys; a key is remembered as long as the watermark allows."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Works off all files there are and ends; the result as a table in memory."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def ingest(events: DataFrame, path: str, checkpoint: str) -> None:
    """Appends each micro-batch under its number, so a repeated batch writes the same folder again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def expired(jobs: DataFrame, now: str, lease: str = "1 hour") -> DataFrame:
    """Jobs (user_id, ts, event_type: latest state) of which the lease has run out at a time."""
    return jobs.filter(F.col("ts") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {lease}")).withColumn("status", F.lit("INTERRUPTED"))
