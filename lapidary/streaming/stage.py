"""A stage directory as a stream: new files once, with duplicates dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of a stage directory as they arrive, under a declared schema."""
    return spark.readStream.schema(schema).parquet(path)


def with_time(rows: DataFrame, column: str, late: str = "10 minutes") -> DataFrame:
    """A watermark on an event time; a time without zone is read in the session's."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def once(rows: DataFrame, keys: list[str], column: str, late: str = "10 minutes") -> DataFrame:
    return with_time(rows, column, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(rows: DataFrame, column: str, width: str, key: str, late: str = "10 minutes") -> DataFrame:
    windowed = with_time(rows, column, late).groupBy(F.window(column, width), key).agg(F.count("*").alias("n"))
    return windowed.select(F.col("window.start").alias("start"), key, "n")


def run_available(rows: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Process what is there, write it, and stop; a restart goes on from the checkpoint."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).start().awaitTermination()
