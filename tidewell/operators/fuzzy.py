"""Fuzzy deduplication of events: candidate pairs, pair score, leaders, merge.

Events with the same URL belong together whatever else they hold; they form classes and are never paired out. Of all
other pairs at most ``hours`` apart none is left out: ``near`` bounds the score of each from above, and those that may
reach the least score are scored in full.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text, urls
from tidewell.operators import near
from tidewell.shared import buckets, kept


def prepared_events(events: DataFrame) -> DataFrame:
    """event_seq, ts_us, url, domain, nt, nc: what pairs are compared by, one row per event_seq."""
    rows = events.where("event_seq is not null and event_date is not null").groupBy("event_seq").agg(F.first(F.struct("title", "event_date", "url", "content", "source")).alias("e")).select("event_seq", "e.*")
    return rows.select(
        "event_seq", "source", "url",
        F.unix_micros(F.col("event_date").cast("timestamp")).alias("ts_us"),
        urls.domain(F.col("url")).alias("domain"),
        text.normal_text(F.coalesce("title", F.lit(""))).alias("nt"),
        text.normal_text(F.substring(F.coalesce("content", F.lit("")), 1, 500)).alias("nc"),
        (F.length(F.coalesce("content", F.lit(""))) > 0).alias("has_content"),
    )


def rare_words(rows: DataFrame, keys: list[str], words: Column, share_tenths: int) -> DataFrame:
    """``keys`` and word: of each row's distinct words the rarest ones, as many as two rows that share ``share_tenths``
    tenths of all their words need to have one in common. Rarity is counted over all rows; ties go by the word.
    """
    exploded = rows.select(*keys, F.explode(F.array_distinct(words)).alias("word"))
    counts = exploded.groupBy("word").agg(F.count("*").alias("n"))
    ranked = exploded.join(counts, "word").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    need = F.size("w") - F.ceil(F.size("w") * share_tenths / 10).cast("int") + 1
    return ranked.select(*keys, F.explode(F.slice("w", F.lit(1), need)).alias("x")).select(*keys, "x.word")


def url_classes(prepared: DataFrame) -> DataFrame:
    """event_seq and first: of each event whose URL occurs more than once, the first event with it."""
    firsts = prepared.where("url is not null").groupBy("url").agg(F.min("event_seq").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return prepared.select("event_seq", "url").join(firsts, "url").select("event_seq", "first")


def candidate_pairs(prepared: DataFrame, hours: int = 48, least: float = 0.6, block: int = 2000) -> DataFrame:
    """(i, j) with i < j of all pairs at most ``hours`` apart, without those that cannot score ``least``.

    Each time slot meets itself and the later ones within ``hours``: one if that long a slot has at most about ``block``
    events, else four of a quarter of that. Where such a slot has more, both sides are shared out by hash and every part
    of the one meets every part of the other, so a task holds as many however dense the events lie. The work grows with
    the pairs.
    """
    spark, width = prepared.sparkSession, hours * 3_600_000
    columns = ["event_seq", "ms", "slot", "url", "domain", "nt", "nc", "has_content"]
    rows = prepared.withColumn("ms", F.floor(F.col("ts_us") / 1000)).withColumn("slot", F.floor(F.col("ms") * 4 / width)).withColumn("url", F.when(F.col("url").isNotNull(), F.xxhash64("url"))).select(*columns)
    top, squares = rows.groupBy("slot").count().agg(F.max("count"), F.sum(F.col("count") * F.col("count"))).first()
    later = 4 if 4 * (top or 0) > block else 1
    rows = rows.withColumn("slot", F.floor(F.col("slot") * later / 4))
    parts = -(-(top or 1) // block)
    tasks = min(max(buckets(spark), 5 * (squares or 0) // 4_000_000), 1000)
    part = F.pmod(F.xxhash64("event_seq"), F.lit(parts)).cast("int")
    every, at = F.sequence(F.lit(0), F.lit(parts - 1)), F.sequence(F.col("slot") - later, F.col("slot"))
    lefts = F.transform(every, lambda b: F.struct(F.col("slot").alias("at"), part.alias("a"), b.alias("b")))
    rights = F.flatten(F.transform(at, lambda s: F.transform(every, lambda a: F.struct(s.alias("at"), a.alias("a"), part.alias("b")))))
    keys = ["at", "a", "b"]
    sides = [rows.withColumn("place", F.explode(x)).select("place.*", *columns).repartition(tasks, *keys).groupBy(*keys) for x in (lefts, rights)]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = near.possible_pairs(left, right, width, least)
        return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64())})

    return sides[0].cogroup(sides[1]).applyInArrow(search, "i bigint, j bigint")


def duplicate_pairs(events: DataFrame, least: float = 0.6, hours: int = 48) -> DataFrame:
    """i, j, score of the candidates that score at least ``least`` (D1, I7), and of each event with an earlier one's URL
    and the first event with it; the other pairs of a URL follow from ``url_classes``.

    The score is 0.5 title + 0.3 content (if both have any) + 0.1 same domain + 0.1 nearness, and 1 for equal URLs.
    Contents are compared only where the rest of the score leaves a chance.
    """
    prepared = kept(prepared_events(events), "prepared")
    narrow, width = prepared.drop("nc", "source"), float(hours * 3_600_000)
    c = lambda side, name: F.col(f"{side}.{name}")
    by_url = url_classes(prepared).where("event_seq > first").select(F.col("first").alias("i"), F.col("event_seq").alias("j"))
    pairs = kept(candidate_pairs(prepared, hours, least).unionByName(by_url).distinct(), "candidates")
    # Texts are compared in as many tasks as their number asks for: the rows are small, but each takes long.
    tasks = min(max(buckets(prepared.sparkSession), pairs.count() // 10_000), 1000)
    met = lambda left, right, key, other: left.repartition(tasks, key).join(right.repartition(tasks, other).hint("shuffle_hash"), F.col(key) == F.col(other))
    pairs = met(met(pairs, narrow.alias("a"), "i", "a.event_seq"), narrow.alias("b"), "j", "b.event_seq")
    gap = F.abs(F.floor(c("a", "ts_us") / 1000) - F.floor(c("b", "ts_us") / 1000))
    same_url = F.coalesce(c("a", "url") == c("b", "url"), F.lit(False))
    rated = pairs.where(same_url | (gap <= width)).select(
        "i", "j", same_url.alias("same_url"),
        F.when(~same_url, c("a", "nt")).alias("ta"), F.when(~same_url, c("b", "nt")).alias("tb"),
        F.when(c("a", "domain") == c("b", "domain"), 0.1).otherwise(0.0).alias("domain"),
        ((1 - gap / width) * 0.1).alias("near"),
        (c("a", "has_content") & c("b", "has_content")).alias("both"),
    )
    rated = text.with_similarity(rated, "ta", "tb", "title").withColumn("title", F.when(F.col("same_url"), 1.0).otherwise(F.col("title")) * 0.5).drop("ta", "tb")
    rated = kept(rated.where(same_url_or(F.col("title") + F.col("domain") + F.col("near") + F.when(F.col("both"), 0.3).otherwise(0.0) >= least - 1e-6)), "rated")
    bodies = lambda name, key: prepared.select(F.col("event_seq").alias(key), F.col("nc").alias(name))
    open_ones = met(met(rated.where("both and not same_url"), bodies("ca", "x"), "i", "x"), bodies("cb", "y"), "j", "y")
    open_ones = text.with_similarity(open_ones, "ca", "cb", "content").withColumn("content", F.col("content") * 0.3)
    score = F.col("title") + F.col("content") + F.col("domain") + F.col("near")
    settled = rated.where("not both or same_url").withColumn("content", F.lit(0.0)).select("i", "j", F.when(F.col("same_url"), 1.0).otherwise(score).alias("score"))
    return open_ones.select("i", "j", score.alias("score")).unionByName(settled).where(F.col("score") >= least)


def same_url_or(condition: Column) -> Column:
    return F.col("same_url") | condition


def leaders(pairs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """member, leader of greedy clustering in event_seq order (D2): an event leads unless an earlier leader is its pair.

    ``classes``: event_seq, first; events of one class all are pairs of each other without being listed in ``pairs``.
    Rounds: an event whose undecided earlier partners are all gone leads, its partners become members; members join
    their earliest leader at the end. Of a class only the least undecided event counts as a partner, so a class may
    have any size. Events without any pair do not appear; empty tables give an empty result.
    """
    pairs = kept(pairs.select("i", "j"), "pairs")
    if classes is None:
        classes = pairs.sparkSession.createDataFrame([], "event_seq bigint, first bigint")
    classes = kept(classes.select(F.col("event_seq").alias("v"), F.col("first").alias("u")), "classes")
    nodes = pairs.select(F.col("i").alias("v")).unionByName(pairs.select(F.col("j").alias("v"))).unionByName(classes.select("v")).distinct()
    open_pairs, leading = pairs, None
    waiting = kept(nodes.join(classes, "v", "left"), "nodes")
    while True:
        # Those with no undecided earlier partner lead now.
        least = waiting.where("u is not null").groupBy("u").agg(F.min("v").alias("least"))
        fresh = waiting.join(open_pairs.select(F.col("j").alias("v")), "v", "left_anti").join(least, "u", "left")
        fresh = kept(fresh.where("least is null or v = least").select("v", "u"), "leaders")
        leading = fresh if leading is None else leading.unionByName(fresh)
        members = open_pairs.join(fresh.select(F.col("v").alias("i")), "i", "left_semi").select(F.col("j").alias("v"))
        rest = waiting.join(fresh.select("v").unionByName(members), "v", "left_anti").join(fresh.where("u is not null").select("u"), "u", "left_anti")
        waiting = kept(rest.select("v", "u"), "nodes")
        if waiting.isEmpty():
            break
        open_pairs = kept(open_pairs.join(waiting.select(F.col("v").alias("i")), "i", "left_semi").join(waiting.select(F.col("v").alias("j")), "j", "left_semi"), "pairs")
    by_pair = pairs.join(leading.select(F.col("v").alias("i")), "i", "left_semi").select(F.col("j").alias("member"), F.col("i").alias("leader"))
    # A class has one leader at most.
    by_class = classes.join(leading.where("u is not null").select("u", F.col("v").alias("leader")), "u").where("leader < v").select(F.col("v").alias("member"), "leader")
    led = by_pair.unionByName(by_class).join(leading.select(F.col("v").alias("member")), "member", "left_anti").groupBy("member").agg(F.min("leader").alias("leader"))
    return led.unionByName(leading.select(F.col("v").alias("member"), F.col("v").alias("leader")))


def duplicate_groups(events: DataFrame) -> DataFrame:
    """member, leader of all events that are a duplicate of another or have one (D3)."""
    return leaders(duplicate_pairs(events), url_classes(prepared_events(events)))


def merged_groups(events: DataFrame, groups: DataFrame, priorities: DataFrame) -> DataFrame:
    """One row per leader (A1, A2): primary_seq (highest priority, then earliest), content_seq (longest content, the
    primary's on ties), duplicate_count and n_sources. All are partial aggregates, so a group may have any size.
    """
    rows = events.groupBy("event_seq").agg(F.first(F.struct("source", F.length(F.coalesce("content", F.lit(""))).alias("chars"))).alias("e")).select("event_seq", "e.*")
    joined = groups.join(rows, groups.member == rows.event_seq).join(priorities, "source", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    best = F.struct("priority", -F.col("event_seq"))
    out = joined.groupBy("leader").agg(
        F.max_by("event_seq", best).alias("primary_seq"),
        F.max_by("chars", best).alias("primary_chars"),
        F.max("chars").alias("chars"),
        F.max_by("event_seq", F.struct("chars", -F.col("event_seq"))).alias("longest"),
        F.count("*").alias("duplicate_count"),
        F.count_distinct("source").alias("n_sources"),
    )
    return out.select("leader", "primary_seq", F.when(F.col("primary_chars") == F.col("chars"), F.col("primary_seq")).otherwise(F.col("longest")).alias("content_seq"), "duplicate_count", "n_sources")
