"""Statistics of runs and timelines: partial aggregates, sliding counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import rounded_half_up


def timeline_stats(entries: DataFrame) -> DataFrame:
    """Count, mean score and day range of all entries (category null) and of each category, in one pass."""
    grouped = entries.rollup("category").agg(
        F.count("*").alias("total"), rounded_half_up(F.avg("impact_score")).alias("average"), F.min("day").cast("string").alias("earliest"), F.max("day").cast("string").alias("latest"), F.grouping("category").alias("is_total")
    )
    return grouped.withColumn("category", F.when(F.col("is_total") == 1, "(all)").otherwise(F.coalesce("category", F.lit("(none)")))).drop("is_total")


def impact_labels(entries: DataFrame) -> DataFrame:
    """category and its impact label by the highest score: critical from 9, high from 7, else moderate."""
    top = F.max("impact_score")
    return entries.groupBy(F.coalesce("category", F.lit("(none)")).alias("category")).agg(F.when(top >= 9, "impact:critical").when(top >= 7, "impact:high").otherwise("impact:moderate").alias("label"))


def call_metrics(events: DataFrame, key: str, value: str) -> DataFrame:
    """Calls, failures (negative or missing values), and sum, mean, least and most of the rest, per key."""
    good = F.when(F.col(value) >= 0, F.col(value))
    return events.groupBy(key).agg(F.count("*").alias("calls"), F.count_if(good.isNull()).alias("failures"), F.round(F.sum(good), 4).alias("total"), F.round(F.avg(good), 4).alias("average"), F.min(good).alias("least"), F.max(good).alias("most"))


def selection_metrics(scores: DataFrame, column: str, threshold: float) -> DataFrame:
    """How many were analysed and selected; mean, highest and lowest positive score, 0 without any."""
    s = F.when((F.col(column) > 0) & ~F.isnan(column), F.col(column))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    chosen = F.count_if((F.col(column) >= threshold) & ~F.isnan(column))
    return scores.agg(F.count("*").alias("analysed"), chosen.alias("selected"), zero(rounded_half_up(F.avg(s), 2)).alias("average"), zero(F.max(s)).alias("highest"), zero(F.min(s)).alias("lowest"))


def sliding_failures(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Adds how many events of the same key lie within the last ``seconds``, itself and its peers included.

    Counted per key and slot of ``seconds``: each slot also sees the bare times of the slot before it, so a key that
    holds a third of all events is spread over its slots. Events without a time are counted among themselves.
    """
    width = seconds * 1_000_000
    us = F.unix_micros(F.col(at).cast("timestamp"))
    home = events.withColumn("_us", us).withColumn("_slot", F.floor(F.col("_us") / width)).withColumn("_home", F.lit(True))
    before = home.where("_us is not null").select(key, "_us", (F.col("_slot") + 1).alias("_slot"), F.lit(False).alias("_home"))
    span = Window.partitionBy(key, "_slot").orderBy("_us").rangeBetween(-width, 0)
    return home.unionByName(before, allowMissingColumns=True).withColumn("in_window", F.count("*").over(span)).where("_home").drop("_us", "_slot", "_home")


def last_by_key(rows: DataFrame, key: str, at: str, seq: str, value: str) -> DataFrame:
    """Count and last value per key."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.max_by(value, F.struct(at, seq)).alias("last"))


def source_metrics(items: DataFrame, key: str, item: str) -> DataFrame:
    """Per source: items collected, different items, and items without URL (A8, A16). A null source is one of its own."""
    blank = F.col("url").isNull() | (F.col("url") == "")
    return items.groupBy(key).agg(F.count("*").alias("collected"), F.count_distinct(item).alias("different"), F.count_if(blank).alias("without_url"))


def stage_counts(*totals: DataFrame) -> DataFrame:
    """One row per stage and its count, from one-row tables of totals."""
    out = None
    for rows in totals:
        rows = rows.unpivot([], rows.columns, "stage", "n")
        out = rows if out is None else out.unionByName(rows)
    return out
