"""From source rows to the events of a run: windows, caps per source, first per id, order and limit."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(rows: DataFrame, column: str, start: datetime | str, end: datetime | str) -> DataFrame:
    """Rows from ``start`` to ``end``, both inclusive; nulls drop. The bounds are literals, so they reach the scan."""
    return rows.where(F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def first_per_key(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a fixed order. Each task keeps one row per key before the exchange."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_key(rows: DataFrame, key: list[str], order: list[Column | str], n: int, rank: str = "pos") -> DataFrame:
    """The first ``n`` rows of each key with their rank; as above, cut in each task before the exchange."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= n)


def latest(rows: DataFrame, column: str, seq: str, limit: int) -> DataFrame:
    """The ``limit`` newest rows, ties by ``seq``: a top-k, never a global sort."""
    return rows.orderBy(F.col(column).desc_nulls_last(), F.col(seq)).limit(limit)


def content_or_title(summary: Column, title: Column) -> Column:
    """What stands for the content of an item: its trimmed summary, else its title."""
    return F.coalesce(F.nullif(F.trim(summary), F.lit("")), title)


def union_sources(**sources: DataFrame) -> DataFrame:
    """All sources under one another, columns by name, with the source's place in ``source_ordinal``."""
    out = None
    for n, (name, rows) in enumerate(sources.items()):
        rows = rows.withColumn("source_ordinal", F.lit(n)).withColumn("source_table", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
