"""Votes over a stream: late samples are dropped by a watermark, as a straggler's shard is given up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, max_files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def windowed_votes(events: DataFrame, delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """window, qid, answer, n, first of (ts, qid, sample_idx, answer) events, for majority() downstream."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length), "qid", "answer").agg(F.count("*").alias("n"), F.min("sample_idx").alias("first"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, appended to `path`, exactly once by the file sink's log."""
    stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).start(path).awaitTermination()
