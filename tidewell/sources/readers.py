"""Source readers: feeds, pages of JSON, HTML pages, timeline files, and the registry by kind."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import instants, text, urls
from tidewell.shared import kept

ITEM = "source string, id string, title string, url string, published_us bigint, summary string, authors array<string>"


def _item_rows(rows: DataFrame, source: str) -> DataFrame:
    """Rows (title, url, published, summary, authors) as items; those without title or link are left out."""
    rows = instants.with_instant(rows, "published", F.lit("UTC"), F.lit(True), "published_us")
    day = F.coalesce(F.date_format(F.timestamp_micros("published_us"), "yyyy-MM-dd"), F.lit("undated"))
    rows = rows.where("length(trim(title)) > 0 and length(trim(url)) > 0")
    return rows.select(
        F.lit(source).alias("source"), F.concat_ws("-", day, F.lit(source), F.substring(F.sha1("url"), 1, 6)).alias("id"), text.squeezed(F.col("title")).alias("title"), "url", "published_us",
        F.nullif(text.squeezed(F.col("summary")), F.lit("")).alias("summary"), F.filter("authors", lambda a: F.length(F.trim(a)) > 0).alias("authors"),
    )


def read_feed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """An RSS file or folder of such (S3-S6): tracking parameters and fragments are cut from the links."""
    schema = "title string, link string, pubDate string, isoDate string, description string, creator string, author string"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    authors = F.array_compact(F.array(F.coalesce("creator", "author")))
    return _item_rows(items.select("title", urls.sanitised(F.col("link")).alias("url"), F.coalesce("isoDate", "pubDate").alias("published"), F.col("description").alias("summary"), authors.alias("authors")), source)


def read_json_pages(spark: SparkSession, path: str, source: str, base: str, max_items: int | None = None) -> DataFrame:
    """Pages of a JSON API (S7-S9): an object with ``results`` or a bare array per file; the first spelling that is there counts.

    ``max_items`` keeps the first items in page order (W3), for a run that needs no more.
    """
    pages = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("page"), F.try_parse_json("value").alias("doc"))
    entries = F.coalesce(F.try_variant_get("doc", "$.results", "array<variant>"), F.try_variant_get("doc", "$", "array<variant>"))
    rows = pages.select("page", F.posexplode(entries).alias("at", "e"))
    get = lambda *names: F.coalesce(*[F.try_variant_get("e", f"$.{n}", "string") for n in names])
    listed = F.coalesce(F.try_variant_get("e", "$.author_names", "array<string>"), F.try_variant_get("e", "$.authors", "array<string>"), text.comma_and_authors(get("authors")))
    rows = rows.select("page", "at", get("title", "paper_title").alias("title"), urls.absolute(get("url_abs", "url"), F.lit(base)).alias("url"), get("published_at", "created_at").alias("published"), get("summary", "description", "paper_abstract").alias("summary"), listed.alias("authors"))
    if max_items is not None:
        rows = rows.orderBy("page", "at").limit(max_items)
    return _item_rows(rows, source)


class _Page(HTMLParser):
    """The JSON-LD scripts and articles of an HTML page; a small helper for one page at a time."""

    def __init__(self) -> None:
        super().__init__()
        self.scripts: list[str] = []
        self.articles: list[dict] = []
        self.article: dict | None = None
        self.into: str | None = None
        self.tag = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "script" and a.get("type") == "application/ld+json":
            self.scripts.append("")
            self.into, self.tag = "script", tag
        elif tag == "article":
            self.article = {}
        elif self.article is not None:
            if tag == "a" and a.get("href"):
                self.article.setdefault("url", a["href"])
            name = {"h1": "title", "h2": "title", "h3": "title", "p": "summary", "time": "published"}.get(tag)
            if "author" in (a.get("class") or "").split() or a.get("itemprop") == "author":
                name = "author"
            if tag == "time" and a.get("datetime"):
                self.article.setdefault("published", a["datetime"])
            elif name and name not in self.article:
                self.article[name] = ""
                self.into, self.tag = name, tag

    def handle_data(self, data):
        if self.into == "script":
            self.scripts[-1] += data
        elif self.into and self.article is not None:
            self.article[self.into] += data

    def handle_endtag(self, tag):
        if tag == self.tag:
            self.into = None
        if tag == "article" and self.article is not None:
            self.articles.append(self.article)
            self.article = None


def _nodes(value) -> Iterator[dict]:
    """The nodes of a JSON-LD value, through lists and ``@graph``."""
    waiting = [value]
    while waiting:
        x = waiting.pop(0)
        if isinstance(x, list):
            waiting = x + waiting
        elif isinstance(x, dict):
            yield x
            waiting = [x["@graph"], *waiting] if "@graph" in x else waiting


def page_entries(html: str | None) -> list[dict]:
    """The posts of a page: those of its JSON-LD, then those of its articles (S11-S14, U2). Broken JSON is passed over."""
    page, out = _Page(), []
    page.feed(html or "")
    for script in page.scripts:
        try:
            value = json.loads(script)
        except ValueError:
            continue
        for node in _nodes(value):
            kinds = node.get("@type")
            if "BlogPosting" not in (kinds if isinstance(kinds, list) else [kinds]):
                continue
            people = node.get("author")
            people = people if isinstance(people, list) else [people]
            names = [p.get("name") if isinstance(p, dict) else p for p in people]
            out.append({"title": node.get("headline") or node.get("name"), "url": node.get("url") or node.get("mainEntityOfPage") or node.get("@id"), "published": node.get("datePublished") or node.get("dateCreated"), "summary": node.get("description"), "authors": [n for n in names if isinstance(n, str)]})
    out += [{"title": a.get("title"), "url": a.get("url"), "published": a.get("published"), "summary": a.get("summary"), "authors": [a["author"]] if a.get("author") else []} for a in page.articles]
    return out


def read_html_pages(pages: DataFrame, source: str, base: str, html: str = "html") -> DataFrame:
    """Items of HTML pages (S10), one row per id (W2): pages are parsed in Arrow batches, everything else is built in."""
    names = ["title", "url", "published", "summary"]
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("at", T.IntegerType())])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*[e[n] if isinstance(e[n], str) else None for n in names], e["authors"], at) for page in batch[html] for at, e in enumerate(page_entries(page))]
            yield pd.DataFrame(rows, columns=schema.names)

    entries = pages.select(html).mapInPandas(parse, schema)
    whole = F.flatten(F.transform("authors", text.comma_and_authors))
    entries = entries.withColumn("url", urls.absolute(F.col("url"), F.lit(base))).withColumn("authors", whole)
    items = _item_rows(entries, source)
    return items.groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in items.columns if c != "id"]).select(*items.columns)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """A timeline file (S15, S16): a JSON array of rows. A missing file is an empty timeline; anything but an array raises."""
    schema = "year int, month string, title string, description string, category string, link string"
    try:
        raw = spark.read.option("wholetext", "true").text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    rows = raw.select(F.try_variant_get(F.try_parse_json("value"), "$", f"array<struct<{schema.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>").alias("rows"))
    if not rows.where("rows is null").isEmpty():
        raise ValueError(f"{path} does not hold a JSON array of timeline rows")
    return rows.select(F.inline("rows"))


def read_html_files(spark: SparkSession, path: str, source: str, base: str) -> DataFrame:
    """The items of HTML files, a page per file."""
    return read_html_pages(spark.read.option("wholetext", "true").text(path).withColumnRenamed("value", "html"), source, base)


READERS: dict[str, Callable[..., DataFrame]] = {"rss": read_feed, "api": read_json_pages, "html": read_html_files}


def register(kind: str, reader: Callable[..., DataFrame]) -> None:
    """Adds a reader for a kind of source, or replaces it."""
    READERS[kind] = reader


def read_sources(spark: SparkSession, sources: list[dict]) -> tuple[DataFrame | None, dict[str, str]]:
    """All enabled sources under one another (S2, S20, F18): dicts with kind, source and the reader's arguments.

    Each source is read on its own and kept, so one that cannot be read, at once or in a task, is left out and named
    with its error; unknown kinds are named too.
    """
    out, failed = None, {}
    for options in sources:
        options = dict(options)
        kind, enabled = options.pop("kind"), options.pop("enabled", True)
        if not enabled:
            continue
        if kind not in READERS:
            failed[options["source"]] = f"unknown kind {kind}"
            continue
        try:
            rows = kept(READERS[kind](spark, **options), "source")  # read here, so that a bad file fails here
        except Exception as error:  # noqa: BLE001  # one source must not end the run
            failed[options["source"]] = str(error)
            continue
        out = rows if out is None else out.unionByName(rows)
    return out, failed
