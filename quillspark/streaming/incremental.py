"""Incremental ingestion: files that are new since the last run, and sums that stay up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.functions.labels import toxic


def new_files(spark: SparkSession, path: str, schema: StructType, files_a_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is new to a table and stops; a rerun without new files adds nothing."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """(key, n, n_toxic) so far; use with output mode update or complete."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(toxic(F.col("perspective"), F.col("detoxify"))).alias("n_toxic"))


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, by, n) over event time; rows later than the watermark are dropped. Beyond the reference."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return timed.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")


def latest_counts(spark: SparkSession, counts: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a counting stream over what there is and returns its result as a table."""
    writer = counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return spark.table(name)
