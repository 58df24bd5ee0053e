"""Streams: windowed counts with a watermark, and deduplication within it (section 2.12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.shared import scratch_path


def parquet_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parquet*")


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per window and key. Rows that come later than ``late`` after the newest are left out.

    In append mode a window comes out once, when it has ended that long before the newest row, and leaves the state.
    """
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def first_deliveries(events: DataFrame, at: str, keys: list[str], late: str = "48 hours") -> DataFrame:
    """Each key once, as long as its repeats come within ``late``; then the key leaves the state."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame) -> DataFrame:
    """Runs a stream in append mode over all that is there, and reads what it wrote; state and output lie in the shared folder."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    query = stream.writeStream.outputMode("append").option("checkpointLocation", state).option("path", out).format("parquet").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
