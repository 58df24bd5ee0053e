import json
from datetime import datetime

import pytest

from tidewell.sources import readers, settings

FEED = """<rss><channel><item><title> Alpha  wins </title><link>https://e.org/a?utm_source=x&amp;b=1#top</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate><description>d</description><creator>Ann Lee</creator></item>
<item><title></title><link>https://e.org/b</link></item></channel></rss>"""
PAGE = """<html><script type="application/ld+json">{"@graph": [{"@type": ["BlogPosting"], "headline": "One", "url": "/one", "datePublished": "2025-09-16", "author": [{"name": "Ann"}, {"name": "Bo"}]}, {"@type": "Other"}]}</script>
<script type="application/ld+json">{broken</script>
<article><h2>Two</h2><a href="https://e.org/two">x</a><time>March 3, 2024</time><p>Sum  mary</p><span class="author">Uma Vane, Ike Tull</span></article></html>"""


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    rows = readers.read_feed(spark, str(tmp_path / "f.xml"), "blog").collect()
    assert [(r.title, r.url, r.authors, r.summary) for r in rows] == [("Alpha wins", "https://e.org/a?b=1", ["Ann Lee"], "d")]
    assert rows[0].id.startswith("2024-01-15-blog-") and rows[0].published_us == 1_705_312_800_000_000


def test_json_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"results": [{"title": "A", "url_abs": "/a", "published_at": "2025-09-18", "author_names": ["X"]}, {"title": "B", "url_abs": "/b", "created_at": "2025-09-19", "paper_abstract": "s", "authors": "X Y, Z"}]}))
    (tmp_path / "2.json").write_text(json.dumps([{"title": "C", "url_abs": "https://e.org/c"}, {"title": "no link"}]))
    rows = readers.read_json_pages(spark, str(tmp_path), "api", "https://p.org").orderBy("title").collect()
    assert [(r.title, r.url, r.authors, r.summary) for r in rows] == [("A", "https://p.org/a", ["X"], None), ("B", "https://p.org/b", ["X Y", "Z"], "s"), ("C", "https://e.org/c", None, None)]
    assert readers.read_json_pages(spark, str(tmp_path), "api", "https://p.org", max_items=1).count() == 1


def test_html_pages(spark):
    pages = spark.createDataFrame([(PAGE,), (PAGE,), (None,), ("",)], "html string")
    rows = readers.read_html_pages(pages, "lab", "https://lab.org").orderBy("title").collect()
    assert [(r.title, r.url, sorted(r.authors)) for r in rows] == [("One", "https://lab.org/one", ["Ann", "Bo"]), ("Two", "https://e.org/two", ["Ike Tull", "Uma Vane"])]
    assert rows[1].published_us == 1_709_424_000_000_000 and rows[1].summary == "Sum mary"


def test_timeline_file(spark, tmp_path):
    assert readers.read_timeline(spark, str(tmp_path / "none.json")).count() == 0
    good = tmp_path / "t.json"
    good.write_text(json.dumps([{"year": 2024, "month": "May", "title": "T", "description": "d", "category": "c", "link": "https://e.org", "more": 1}]))
    assert [(r.year, r.month, r.link) for r in readers.read_timeline(spark, str(good)).collect()] == [(2024, "May", "https://e.org")]
    bad = tmp_path / "bad.json"
    bad.write_text('{"year": 1}')
    with pytest.raises(ValueError):
        readers.read_timeline(spark, str(bad))


def test_registry_leaves_out_what_fails(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    rows, failed = readers.read_sources(spark, [{"kind": "rss", "source": "ok", "path": str(tmp_path / "f.xml")}, {"kind": "odd", "source": "odd"}, {"kind": "rss", "source": "off", "path": "x", "enabled": False}, {"kind": "rss", "source": "gone", "path": str(tmp_path / "no.xml")}])
    assert rows.count() == 1 and set(failed) == {"odd", "gone"}


def test_registry_reads_html_and_isolates_what_fails_in_a_task(spark, tmp_path):
    (tmp_path / "p.html").write_text(PAGE)

    def broken(spark, source):
        return spark.range(1).selectExpr("raise_error('bad row') as title")

    readers.register("broken", broken)
    try:
        rows, failed = readers.read_sources(spark, [{"kind": "broken", "source": "b"}, {"kind": "html", "source": "lab", "path": str(tmp_path / "p.html"), "base": "https://lab.org"}])
    finally:
        del readers.READERS["broken"]
    assert sorted(r.title for r in rows.collect()) == ["One", "Two"] and "bad row" in failed["b"]


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"window_days": -1, "sources": [{"id": "a", "kind": "rss", "url": "https://e.org"}]}')
    run = settings.run_settings(settings.load(str(tmp_path / "s.json")), datetime(2024, 1, 8))
    assert run.window() == (datetime(2024, 1, 8), datetime(2024, 1, 8)) and run.sources[0].enabled
    with pytest.raises(ValueError):
        settings.Source("a", "nope", "https://e.org")
