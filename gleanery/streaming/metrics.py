"""Structured Streaming forms of the roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from a folder of Parquet files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sliding_counts(events: DataFrame, late: str = "10 minutes", length: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """ST-1: requests by type in sliding windows, with a watermark for late rows."""
    w = F.window("ts", length, step)
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_error"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "n_error")


def flush(metrics: DataFrame, path: str, checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """ST-2: appended to Parquet once per trigger, exactly once by the checkpoint; without ``every`` all that is there."""
    w = metrics.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def upsert_batches(stream: DataFrame, key: str, order: str, target: str, checkpoint: str) -> StreamingQuery:
    """H-18 as a stream: each micro-batch's newest row per key is appended with its batch; readers take the newest."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r"))
        rows.select(key, "r.*", F.lit(epoch).alias("epoch")).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
