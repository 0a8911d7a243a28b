"""The feedback log as a stream, and snapshots as increments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import planning


def running_counts(events: DataFrame) -> DataFrame:
    """category, n of false positives: the same on a stream (update or complete mode) as on a table."""
    d = events.where(F.trim("reason") == "false_positive").select(F.lower(F.trim("category")).alias("category")).where("category <> ''")
    return d.groupBy("category").agg(F.count("*").alias("n"))


def apply_snapshots(stream: DataFrame, state_path: str, diff_path: str):
    """A writer that compares each batch of (path, sha256) with the last one and appends what changed, by batch id.

    A batch that is run again finds its own earlier state and writes the same rows to the same place.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "path string, sha256 string"
        old = spark.read.schema(schema).parquet(f"{state_path}/batch={number - 1}") if number else spark.createDataFrame([], schema)
        new = batch.select("path", "sha256").distinct()
        planning.fingerprint_diff(old, new).write.mode("overwrite").parquet(f"{diff_path}/batch={number}")
        new.write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return stream.writeStream.foreachBatch(each)
