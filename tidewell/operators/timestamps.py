"""Mixed timestamp formats and time zones (problem 3).

Every value is matched against the known notations; each valid reading is a component of its source's format
mixture. Most notations have one reading; all-digit dates that end in the year have two (month first, day first). The
weights of each source's mixture are fitted by expectation-maximisation over all its values: a value counts for every
component under which it is a valid date, in proportion to the weights. A declared order is a prior of ``declared``
imagined values, so the data can speak against it; where the caller trusts declarations (the rule for these feeds), the
declared order nevertheless decides. Without one, the posterior chooses the reading or marks the value ``ambiguous``.

Nulls and texts that denote no instant give a null ``utc_us`` and the status ``none``. Repeated rows stay
separate. Empty tables give empty results. Values of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import instants
from tidewell.shared import broadcast_if_small, kept

#: The canonical notation; a value written exactly so (without a line end after it) needs no normalisation.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z"


_MONTH_FIRST, _DAY_FIRST = "month first", "day first"


def fit_mixture(readings: list[list[str]], counts: list[int], prior: dict[str, float], tolerance: float = 1e-9, most: int = 100_000) -> dict[str, float]:
    """The weights of a source's readings by expectation-maximisation.

    ``readings``: sets of readings under which values are valid, ``counts``: how many values each set has. ``prior``:
    imagined values per reading, besides one half for each that occurs. Iterates until no weight moves by more than
    ``tolerance``; raises if ``most`` rounds don't reach that.
    """
    names = sorted({x for some in readings for x in some} | set(prior))
    valid = np.array([[x in some for x in names] for some in readings], float).reshape(len(readings), len(names))
    number, imagined = np.array(counts, float), np.array([0.5 + prior.get(x, 0.0) for x in names])
    weights = np.full(len(names), 1 / max(len(names), 1))
    for _ in range(most):
        shares = valid * weights
        expected = (shares / shares.sum(axis=1, keepdims=True) * number[:, None]).sum(axis=0) + imagined
        moved, weights = np.abs(expected / expected.sum() - weights).max(initial=0), expected / expected.sum()
        if moved <= tolerance:
            return dict(zip(names, weights.tolist(), strict=True))
    raise RuntimeError(f"the mixture still moves by {moved} after {most} rounds")


def mixtures(rows: DataFrame, declared: float) -> DataFrame:
    """source_id, weights (a map of readings) and month_first_share of each source, from all its values.

    ``rows``: source_id, date_order, value. Counts per source and set of readings are partial sums, a few sets a source.
    """
    text = instants.tidy(F.col("value"))
    read = rows.where("value is not null").select("source_id", "date_order", text.alias("text")).withColumn("kind", instants.notation(F.col("text")))
    two = F.split(F.when(F.col("kind") == "digits_year_last", F.regexp_replace("text", r"^(\d+)[-/.](\d+).*$", "$1|$2")), r"\|")
    month, day = (F.try_element_at(two, F.lit(n)).try_cast("int") for n in (1, 2))
    orders = F.array_compact(F.array(F.when(month.between(1, 12) & day.between(1, 31), _MONTH_FIRST), F.when(day.between(1, 12) & month.between(1, 31), _DAY_FIRST)))
    readings = F.when(F.col("kind") == "digits_year_last", orders).otherwise(F.array("kind"))
    counts = read.where("kind is not null").groupBy("source_id", "date_order", readings.alias("readings")).agg(F.count("*").alias("n")).where("size(readings) > 0")
    counts = counts.groupBy("source_id", "date_order").agg(F.collect_list("readings").alias("readings"), F.collect_list("n").alias("n"))

    @F.pandas_udf("map<string, double>")
    def fitted(readings: pd.Series, n: pd.Series, order: pd.Series) -> pd.Series:
        prior = {"MDY": {_MONTH_FIRST: declared}, "DMY": {_DAY_FIRST: declared}}
        return pd.Series([fit_mixture(r, c, prior.get(o, {})) for r, c, o in zip(readings, n, order, strict=True)])

    out = counts.select("source_id", fitted("readings", "n", "date_order").alias("weights"))
    first, last = (F.coalesce(F.try_element_at("weights", F.lit(x)), F.lit(0.0)) for x in (_MONTH_FIRST, _DAY_FIRST))
    return out.withColumn("month_first_share", F.coalesce(F.try_divide(first, first + last), F.lit(0.5)))


def normalise_instants(values: DataFrame, sources: DataFrame, certainty: float = 0.95, declared: float = 20.0, trust_declared: bool = True) -> DataFrame:
    """One UTC instant per value.

    ``values``: rec_table, rec_id, field_name, value, source_id (null where the record has no source: UTC).
    ``sources``: source_id, default_tz, date_order. Returns rec_table, rec_id, field_name, value, notation,
    month_first_share (posterior of the month-first reading of a two-way value), status (``read``, ``ambiguous``,
    ``none``) and utc_us (set only for ``read``). A source that is not listed or whose zone is unknown counts as UTC.
    ``declared``: how many imagined values a declared order weighs in the mixture; with ``trust_declared`` it decides.
    """
    listed = sources.where("source_id is not null").groupBy("source_id").agg(F.min("default_tz").alias("default_tz"), F.min(F.upper("date_order")).alias("date_order"))
    rows = values.select("rec_table", "rec_id", "field_name", "value", "source_id").join(broadcast_if_small(listed), "source_id", "left")
    zone = F.coalesce(instants.known_zone(F.col("default_tz")), F.lit("UTC"))
    # One row per source: kept, counted and broadcast if few, so that no source's rows are gathered.
    fitted = broadcast_if_small(kept(mixtures(rows, declared).selectExpr("source_id as fitted_source", "month_first_share as fitted"), "mixtures"))
    rows = rows.join(fitted, F.col("source_id").eqNullSafe(F.col("fitted_source")), "left")

    month, day = (F.try_element_at("utc_us_parts", F.lit(n)).try_cast("int") for n in (3, 4))
    can_mdy, can_dmy = month.between(1, 12) & day.between(1, 31), day.between(1, 12) & month.between(1, 31)
    # Likelihood of a reading: 1 if it denotes a date, else 0.
    share = F.coalesce("fitted", F.lit(0.5))
    as_mdy, as_dmy = F.when(can_mdy, share).otherwise(0.0), F.when(can_dmy, 1 - share).otherwise(0.0)
    posterior = F.when(as_mdy + as_dmy > 0, as_mdy / (as_mdy + as_dmy))
    ruled = F.coalesce(F.col("date_order").isin("MDY", "DMY"), F.lit(False)) & F.lit(trust_declared)
    rows = instants.with_instant(rows, "value", zone, F.when(ruled, F.col("date_order") == "MDY").otherwise(F.coalesce(posterior, share) >= 0.5))
    two_way = F.col("utc_us_notation") == "digits_year_last"
    rows = rows.withColumn("notation", F.col("utc_us_notation")).withColumn("month_first_share", F.when(two_way, posterior))
    sure = F.coalesce(~two_way, F.lit(True)) | ruled | (F.col("month_first_share") >= certainty) | (F.col("month_first_share") <= 1 - certainty)
    status = F.when(F.col("utc_us").isNull(), "none").when(sure, "read").otherwise("ambiguous")
    return rows.withColumn("status", status).select("rec_table", "rec_id", "field_name", "value", "source_id", "notation", "month_first_share", "status", F.when(F.col("status") == "read", F.col("utc_us")).alias("utc_us"))


def hidden_orders(values: DataFrame, sources: DataFrame) -> DataFrame:
    """How well the mixture finds the order of sources whose declaration is hidden from it.

    date_order (declared), decided (``MDY``, ``DMY`` or ``ambiguous``) and values: of the all-digit dates that are
    valid in both orders, how many were read which way.
    """
    blind = normalise_instants(values, sources.withColumn("date_order", F.lit(None).cast("string")), trust_declared=False)
    two = F.split(F.regexp_replace(instants.tidy(F.col("value")), r"^(\d+)[-/.](\d+).*$", "$1|$2"), r"\|")
    both = (two[0].try_cast("int") <= 12) & (two[1].try_cast("int") <= 12) & (two[0] != two[1])
    declared = broadcast_if_small(sources.where("source_id is not null").groupBy("source_id").agg(F.min(F.upper("date_order")).alias("date_order")))
    decided = F.when(F.col("status") == "ambiguous", "ambiguous").when(F.col("month_first_share") >= 0.5, "MDY").otherwise("DMY")
    rows = blind.where("notation = 'digits_year_last' and status <> 'none'").where(both).join(declared, "source_id")
    return rows.groupBy("date_order", decided.alias("decided")).agg(F.count("*").alias("values"))


def timestamp_values(raw_items: DataFrame, rss_items: DataFrame, pwc_raw: DataFrame) -> DataFrame:
    """The timestamp fields of the three tables as rows for ``normalise_instants``; JSON numbers as digits."""
    doc = F.try_parse_json("payload")
    scalar = lambda name: F.when(F.schema_of_variant(F.try_variant_get("doc", f"$.{name}", "variant")).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get("doc", f"$.{name}", "string"))
    papers = pwc_raw.select(F.col("record_no").alias("rec_id"), doc.alias("doc")).select("rec_id", scalar("published_at").alias("published_at"), scalar("created_at").alias("created_at"))
    papers = papers.unpivot(["rec_id"], ["published_at", "created_at"], "field_name", "value")
    return (
        raw_items.select(F.lit("raw_items").alias("rec_table"), F.col("item_seq").alias("rec_id"), F.lit("published_at").alias("field_name"), F.col("published_at").alias("value"), F.col("source").alias("source_id"))
        .unionByName(rss_items.select(F.lit("rss_items").alias("rec_table"), F.col("rss_seq").alias("rec_id"), F.lit("iso_date").alias("field_name"), F.col("iso_date").alias("value"), "source_id"))
        .unionByName(papers.select(F.lit("pwc_raw").alias("rec_table"), "rec_id", "field_name", "value", F.lit(None).cast("string").alias("source_id")))
    )
