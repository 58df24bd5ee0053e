"""The timeline: what is new against it, conflicts, file rows, week partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text, urls
from tidewell.operators.fuzzy import rare_words
from tidewell.operators.ingest import first_per_key
from tidewell.shared import kept, moved, names, remove

#: Names of the months, as file rows write them.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def new_entries(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming entries whose id and month-title key the timeline lacks, the first of each key.

    Both need id, day, title; incoming also entry_seq, its order. Two anti joins, then one row per key: the timeline's
    side is reduced to its distinct ids and keys first.
    """
    keyed = incoming.withColumn("_key", text.month_key(F.col("day"), F.col("title")))
    fresh = keyed.join(existing.select("id").distinct(), "id", "left_anti")
    fresh = fresh.join(existing.select(text.month_key(F.col("day"), F.col("title")).alias("_key")).distinct(), "_key", "left_anti")
    return first_per_key(fresh, ["_key"], ["entry_seq"]).drop("_key")


def conflicts(incoming: DataFrame, existing: DataFrame, as_of: str) -> DataFrame:
    """entry_seq and kind of everything that speaks against an incoming entry (D6, F19): ``id``, ``key``, ``repeated``, ``future``."""
    keyed = incoming.select("entry_seq", "id", "day", text.month_key(F.col("day"), F.col("title")).alias("k"))
    ids = existing.select("id").distinct()
    keys = existing.select(text.month_key(F.col("day"), F.col("title")).alias("k")).distinct()
    firsts = keyed.groupBy("k").agg(F.min("entry_seq").alias("first"))
    found = [
        (keyed.join(ids, "id", "left_semi"), "id"),
        (keyed.join(keys, "k", "left_semi"), "key"),
        (keyed.join(firsts, "k").where("entry_seq > first"), "repeated"),
        (keyed.where(F.col("day") > F.lit(as_of).cast("date")), "future"),
    ]
    out = None
    for rows, kind in found:
        rows = rows.select("entry_seq", F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


def similar_existing(incoming: DataFrame, existing: DataFrame, least_tenths: int = 8) -> DataFrame:
    """entry_seq, similar_seq: the first existing entry of the same day and category whose title overlaps by more than
    ``least_tenths`` tenths (D7). Null days, categories and titles match nothing.

    Only distinct titles of a day and category are compared, and only those that share one of their rarest words,
    which titles that overlap so far must; a day that holds a third of all entries is not paired out.
    """
    key = ["day", "category", "t"]
    narrow = lambda rows: rows.where("day is not null and category is not null and title is not null").select("entry_seq", "day", "category", F.lower("title").alias("t"))
    fresh, old = narrow(incoming), narrow(existing).groupBy(*key).agg(F.min("entry_seq").alias("old_seq"))
    titles = kept(fresh.select(*key, F.lit(True).alias("is_new")).distinct().unionByName(old.select(*key, F.lit(False).alias("is_new"))), "titles")
    words = kept(rare_words(titles, [*key, "is_new"], F.split("t", r"\s+"), least_tenths), "title-words")
    olds = words.where("not is_new").select("day", "category", "word", F.col("t").alias("old_t"))
    met = words.where("is_new").drop("is_new").join(olds, ["day", "category", "word"]).drop("word").distinct()
    alike = met.where(text.title_overlap(F.col("t"), F.col("old_t")) > least_tenths / 10)
    first = alike.join(old.withColumnRenamed("t", "old_t"), ["day", "category", "old_t"]).groupBy(*key).agg(F.min("old_seq").alias("similar_seq"))
    return fresh.join(first, key).groupBy("entry_seq").agg(F.min("similar_seq").alias("similar_seq"))


def file_rows(entries: DataFrame) -> DataFrame:
    """entry_seq, year, month (English name), title, description, category, link (first source or '')."""
    return entries.select("entry_seq", F.year("day").alias("year"), F.date_format("day", "MMMM").alias("month"), "title", "description", "category", F.coalesce(F.try_element_at("sources", F.lit(1)), F.lit("")).alias("link"))


def month_day(year: Column, month: Column) -> Column:
    """The first day of a month given as number (clamped to 1..12) or English name; unknown names are January."""
    names = F.create_map(*[F.lit(x) for n, m in enumerate(MONTHS, 1) for x in (m.lower(), n)])
    number = F.when(month.try_cast("int").isNotNull(), F.least(F.lit(12), F.greatest(F.lit(1), month.try_cast("int"))))
    year = F.when(year.between(0, 99), year + 1900).otherwise(year)
    return F.make_date(year, F.coalesce(number, F.try_element_at(names, F.lower(F.trim(month))), F.lit(1)), F.lit(1))


def normalised_rows(rows: DataFrame) -> DataFrame:
    """Timeline file rows (year, month, title, description, category, link) as entries; unusable ones are left out."""
    day = month_day(F.col("year"), F.col("month").cast("string"))
    title = F.trim("title")
    out = rows.select(
        text.event_id(day, title).alias("id"), day.alias("day"), title.alias("title"), F.trim(F.coalesce("description", title)).alias("description"),
        text.mapped_category(F.col("category"), text.TIMELINE_CATEGORIES).alias("category"), F.filter(F.array(F.trim("link")), urls.is_valid).alias("sources"), F.lit(5.0).alias("impact_score"),
    )
    return out.where("length(title) between 1 and 200 and length(description) between 1 and 1000 and size(sources) > 0 and day is not null")


def week_of_year(day: Column) -> Column:
    """Weeks that begin on Sunday, week 1 holds January 1st; not the ISO week."""
    return F.ceil((F.dayofyear(day) - 1 + F.dayofweek(F.trunc(day, "year"))) / 7)


def week_name(day: Column) -> Column:
    """``auto-update/week-YYYY-WW``: the partition an update goes to."""
    return F.format_string("auto-update/week-%d-%02d", F.year(day), week_of_year(day))


def append_weeks(entries: DataFrame, path: str, day: Column) -> list[str]:
    """Writes entries to the partitions of their weeks; a week that is there already stays as it is.

    Returns the weeks written. They are drafted beside ``path`` first and put in place whole, by one rename each, so a
    week is never half there and of two writers one wins. Entries without a day are left out.
    """
    spark = entries.sparkSession
    draft = f"{path.rstrip('/')}.{uuid.uuid4().hex}.draft"
    entries.where(day.isNotNull()).withColumn("week", F.substring_index(week_name(day), "/", -1)).repartition("week").write.partitionBy("week").parquet(draft)
    written = [n.removeprefix("week=") for n in names(spark, draft) if n.startswith("week=") and moved(spark, f"{draft}/{n}", f"{path}/{n}")]
    remove(spark, draft)
    return written
