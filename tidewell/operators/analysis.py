"""Scoring and selecting events with plain expressions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text, urls

#: Weights of the four significance scores, in this order of summation.
WEIGHTS = {"technological_breakthrough": 0.35, "industry_impact": 0.30, "adoption_scale": 0.20, "novelty": 0.15}
#: Words by which the built-in analysis sorts a text, first match wins.
CATEGORY_WORDS = [("regulation", ["regulation", "compliance", "policy"]), ("product", ["release", "product", "launch"]), ("industry", ["deployment", "partnership", "adoption"])]
#: Words that are never keywords.
STOP_WORDS = ["https", "http", "httpswww", "introduction", "analysis", "development"]


def impact_score(significance: Column) -> Column:
    """The weighted sum of the four scores, half up to one decimal; null if one is missing."""
    parts = [significance[name] * weight for name, weight in WEIGHTS.items()]
    return text.rounded_half_up(parts[0] + parts[1] + parts[2] + parts[3])


def built_in_scores(body: Column) -> Column:
    """The four scores of the built-in analysis, from the text's length alone."""
    base = F.least(F.lit(9.3), F.greatest(F.lit(7.2), F.length(body) / 200 + 7))
    shift = {"technological_breakthrough": 0.3, "industry_impact": -0.2, "adoption_scale": -0.1, "novelty": 0.4}
    return F.struct(*[text.rounded_half_up(F.least(F.lit(10.0), F.greatest(F.lit(0.0), base + d))).alias(n) for n, d in shift.items()])


def built_in_category(body: Column) -> Column:
    """research, product, industry or regulation by the words a text contains."""
    plain = F.lower(body)
    out = None
    for name, words in CATEGORY_WORDS:
        hit = plain.contains(words[0]) | plain.contains(words[1]) | plain.contains(words[2])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("research")


def unit_vector(body: Column, dims: int = 12) -> Column:
    """Character codes summed by place modulo ``dims``, scaled to length one, six decimals."""
    codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.aggregate(F.filter(codes, lambda _, i: i % dims == k), F.lit(0.0), lambda a, x: a + x))
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(sums, lambda x: F.round(x / F.when(norm == 0, 1.0).otherwise(norm), 6))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("freq", T.LongType())])))
def _most_common(words: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([[{"word": w, "freq": k} for w, k in Counter(ws).most_common(m)] for ws, m in zip(words, n, strict=True)])


def top_keywords(rows: DataFrame, key: str, body: str, n: int = 4) -> DataFrame:
    """key, rnk, word, freq: the most frequent words of 4 to 17 characters of each text, ties by first place.

    Counted within the row, so nothing is exchanged; a null text has no words.
    """
    plain = F.split(F.regexp_replace(F.lower(F.coalesce(F.col(body), F.lit(""))), r"[^a-z0-9]+", " "), " ")
    words = F.filter(plain, lambda w: F.length(w).between(4, 17) & ~w.isin(*STOP_WORDS))
    best = rows.select(key, _most_common(words, F.lit(n)).alias("best")).select(key, F.posexplode("best").alias("at", "x"))
    return best.select(key, (F.col("at") + 1).alias("rnk"), "x.word", "x.freq")


def select_top(events: DataFrame, threshold: float, n: int) -> DataFrame:
    """The ``n`` best events of at least ``threshold``: by score, then the later date, then event_id.

    The comparison is a total order; one that calls near scores equal would not be transitive.
    """
    return events.where(F.col("impact_score") >= threshold).orderBy(F.desc("impact_score"), F.desc("event_ts"), "event_id").limit(n)


def prompt(title: Column, day: Column, source: Column, url: Column, content: Column) -> Column:
    """What a model is asked about an event; missing parts leave no line (P5)."""
    line = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(label), value))
    return F.concat_ws("\n", line("Title: ", title), line("Published on: ", day), line("Source: ", source), line("URL: ", url), line("Full content: ", content))


def analysed(events: DataFrame, ask: Callable[[], Callable[[list[str]], list[str | None]]], body: str = "prompt", out: str = "answer") -> DataFrame:
    """Adds a model's answer to each row (X1, U5). ``ask`` makes the client once per task; it gets a batch of prompts.

    A row whose prompt gets no answer keeps a null, so that later steps decide about it. Write the result before
    reading it twice: a call is not free of cost.
    """
    schema = T.StructType([*events.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = ask()
        for batch in batches:
            yield batch.assign(**{out: client(batch[body].tolist())})

    return events.mapInPandas(run, schema)


def within_budget(rows: DataFrame, key: str, order: str, body: str, budget: int, block: int = 1 << 16) -> DataFrame:
    """Rows of each key while the running estimate of tokens (a quarter of the characters, rounded up) stays within ``budget``.

    ``order``: an integer column. The estimates are summed per key and block of ``block`` order values first; only
    blocks that begin within the budget are then added up row by row, so no key is gathered in one task. A null key is
    a key of its own, a null order comes first, a null text has no tokens.
    """
    counted = rows.withColumn("tokens", F.ceil(F.length(F.coalesce(F.col(body), F.lit(""))) / 4)).withColumn("_block", F.floor(F.col(order) / block))
    sums = counted.groupBy(F.col(key).alias("_k"), F.col("_block").alias("_b")).agg(F.sum("tokens").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    begun = sums.withColumn("_before", F.coalesce(earlier, F.lit(0))).where(F.col("_before") <= budget).drop("_sum")
    inside = F.sum("tokens").over(Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    near = counted.join(begun, F.col(key).eqNullSafe(F.col("_k")) & F.col("_block").eqNullSafe(F.col("_b")))
    return near.withColumn("running", F.col("_before") + inside).where(F.col("running") <= budget).drop("_k", "_b", "_block", "_before")


def first_sentences(body: Column, k: int = 2, size: int = 160) -> Column:
    """The first ``k`` non-empty sentences, each cut to ``size`` characters (O8); null for a null text."""
    parts = F.filter(F.transform(F.split(body, "[.!?]"), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")
    return F.slice(F.transform(parts, lambda x: F.substring(x, 1, size)), 1, k)


def violations(day_text: Column | None = None) -> Column:
    """What speaks against an analysed event, as an array (F10); ``day_text`` is its date as written.

    A missing value counts like a wrong one, but for ``url``, which may be missing.
    """
    scores = F.col("significance")
    in_range = lambda x: x.between(0, 10) & ~F.isnan(x)
    rules = {
        "id": F.col("id").rlike(r"^\d{4}-\d{2}-\d{2}-[a-z0-9-]+$"),
        "title": F.length("title").between(1, 200),
        "date": (F.col("event_date") if day_text is None else day_text).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$"),
        "description": F.length("description").between(1, 1000),
        "category": F.col("category").isin("research", "product", "regulation", "industry"),
        "sources": F.col("sources").isNotNull() & F.forall("sources", lambda u: F.coalesce(urls.is_valid(u), F.lit(False))),
        "url": F.col("url").isNull() | urls.is_valid(F.col("url")),
        "impact_score": in_range(F.col("impact_score")),
        "significance": in_range(scores["technological_breakthrough"]) & in_range(scores["industry_impact"]) & in_range(scores["adoption_scale"]) & in_range(scores["novelty"]),
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]), lambda x: x.isNotNull())
