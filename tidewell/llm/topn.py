"""The top N items within every group (problem 4), by statistics-guided skipping.

The valid items are parsed and made distinct once. A histogram of each group's scores cuts its rows into blocks by
falling score: block 0 holds the highest score bins until ``block_rows`` rows are reached, block 1 the next twice as
many, and so on; small groups are one block. The layout is written clustered by block number, group and falling score,
in files and row groups whose own statistics (least and greatest block, group and score) tell what they hold; it can
serve readers with other N.

Blocks are read in falling order of their highest score: the first block of every group, then only the blocks that may
still hold one of the best N, that is, whose highest score is not strictly below their group's current N-th score. The
block number, the range of the groups that are due and the least score that counts are pushed down to the scan, so row
groups of other blocks, groups and lower scores are skipped unread.

Nothing is gathered per group: duplicates are removed where a slice of a group's score bin lies, the layout is cut by
ranges that split a large group, and ranking keeps N rows per group in each task before any exchange. A group that
holds a third of all rows is spread over its score bins, and each bin over slices by event, so even equal scores all
over such a group stay no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import instants
from tidewell.shared import buckets, dropped, kept, scratch_path


def scored_events(events: DataFrame) -> DataFrame:
    """The rows that count: source_id, event_day (UTC, ``yyyy-MM-dd``), event_id, utc_us and score.

    Rows without source, id, valid date or a score from 0 to 10 (null, NaN and infinities are none) are left out.
    A date without zone is taken as UTC.
    """
    rows = events.where("source_id is not null and event_id is not null and impact_score >= 0 and impact_score <= 10")
    rows = rows.select("source_id", "event_id", F.col("impact_score").cast("double").alias("score"), "event_date")
    rows = instants.with_instant(rows, "event_date", F.lit("UTC"), F.lit(True)).select("source_id", "event_id", "score", "utc_us")
    day = F.date_from_unix_date(F.floor(F.col("utc_us") / 86_400_000_000).cast("int")).cast("string")
    return rows.where("utc_us is not null").withColumn("event_day", day)


_GROUP = ["source_id", "event_day"]
_ROW = "block int, source_id string, event_day string, event_id bigint, utc_us bigint, score double"


def clustered_layout(rows: DataFrame, block_rows: int, slices: int = 64, row_group: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """The distinct rows in blocks, and the highest score of every block but each group's first.

    Equal scores share a bin, so no tie is ever cut. ``slices``: over how many partitions a bin may spread.
    ``row_group``: bytes of a row group, the least that a reader can skip.
    """
    spark = rows.sparkSession
    binned = rows.withColumn("bin", F.floor(F.col("score") * 10).cast("int"))
    # One pass over the input and one exchange; all that follows reads this narrow table.
    binned = binned.withColumn("slice", F.pmod(F.xxhash64("event_id"), F.lit(slices)).cast("int"))
    binned = kept(binned.repartition(*_GROUP, "bin", "slice").groupBy(*_GROUP, "bin", "slice", "event_id", "utc_us", "score").agg(F.lit(1).alias("one")).drop("one", "slice"), "events")
    bins = binned.groupBy(*_GROUP, "bin").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy(*_GROUP).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    deep = kept(bins.withColumn("block", F.floor(F.log2(above / block_rows + 1)).cast("int")).where("block > 0"), "blocks")
    path = scratch_path(spark, "clustered")
    layout = binned.join(deep.select(*_GROUP, "bin", "block"), [*_GROUP, "bin"], "left").withColumn("block", F.coalesce("block", F.lit(0)))
    order = ["block", *_GROUP, F.desc("score")]
    layout = layout.select("block", *_GROUP, "event_id", "utc_us", "score").repartitionByRange(buckets(spark), *order).sortWithinPartitions(*order)
    layout.write.option("parquet.block.size", row_group).parquet(path)
    dropped(binned)
    out, blocks = spark.read.schema(_ROW).parquet(path), deep.groupBy(*_GROUP, "block").agg(F.max("top").alias("top"))
    out.kept_at, blocks.kept_at = path, deep.kept_at
    return out, blocks


def due_blocks(blocks: DataFrame, best: DataFrame, n: int, after: int) -> DataFrame:
    """The blocks beyond ``after`` that may hold one of the ``n`` best of their group, with the group's N-th score (null: none yet)."""
    nth = best.where(f"rnk = {n}").select(*_GROUP, F.col("score").alias("nth"))
    return blocks.where(F.col("block") > after).join(nth, _GROUP, "left").where("nth is null or top >= nth")


def read_block(layout: DataFrame, due: DataFrame, block: int, first: str, last: str, least: float) -> DataFrame:
    """The rows of one block that due groups hold; the conditions with literals reach the files' statistics."""
    rows = layout.where((F.col("block") == block) & F.col("source_id").between(first, last) & (F.col("score") >= least))
    rows = rows.join(due.where(F.col("block") == block).select(*_GROUP, "nth"), _GROUP)
    return rows.where("nth is null or score >= nth").select(*_GROUP, "event_id", "utc_us", "score")


def top_events(events: DataFrame, n: int = 3, block_rows: int = 16) -> DataFrame:
    """source_id, event_day, rnk (1 to ``n``) and event_id of the best scored events of each source and UTC day.

    By score, then the later instant, then the smaller event_id. The rows of one event_id count once.
    """
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("score"), F.desc("utc_us"), "event_id")
    layout, blocks = clustered_layout(scored_events(events), block_rows)
    ranked = lambda rows: rows.withColumn("rnk", F.row_number().over(order)).where(f"rnk <= {n}")
    best, block = kept(ranked(layout.where("block = 0").drop("block")), "best"), 0
    while True:
        due = due_blocks(blocks, best, n, block)
        at = due.groupBy("block").agg(F.min("source_id").alias("first"), F.max("source_id").alias("last"), F.min(F.coalesce("nth", F.lit(0.0))).alias("least")).orderBy("block").first()
        if at is None:
            dropped(layout, blocks)
            return best.select(*_GROUP, "rnk", "event_id")
        block, before = at["block"], best
        best = kept(ranked(best.drop("rnk").unionByName(read_block(layout, due, block, at["first"], at["last"], at["least"]))), "best")
        dropped(before)
