from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidewell.operators import timestamps

UTC = timezone.utc


def us(*parts, tz=UTC, micros=0):
    return int((datetime(*parts, tzinfo=tz) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) + micros


BERLIN, NY = ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York")
CASES = [
    ("2024-03-01T10:00:00.5Z", "dmy", us(2024, 3, 1, 10, micros=500_000)),
    ("2024-03-01t10:00:00.123456789z", "dmy", us(2024, 3, 1, 10, micros=123_456)),
    ("  2024-03-01 10:00:00,25 +0530 ", "dmy", us(2024, 3, 1, 4, 30, micros=250_000)),
    ("2024-03-01 10:00-08", "dmy", us(2024, 3, 1, 18)),
    ("2024-03-01T10:00:00-00:00", "dmy", us(2024, 3, 1, 10)),
    ("2024-06-09T14:46:09+05:30[Asia/Kolkata]", "dmy", us(2024, 6, 9, 9, 16, 9)),
    ("2024-03-01", "berlin", us(2024, 3, 1, tz=BERLIN)),
    ("2024-10-27 02:30:00", "berlin", us(2024, 10, 27, 0, 30)),  # occurs twice: the earlier
    ("2024-03-31 02:30:00", "berlin", us(2024, 3, 31, 1, 30)),  # skipped: offset before the change
    ("2024-03-10 02:30", "ny", us(2024, 3, 10, 7, 30)),
    ("20240301T101112Z", "ny", us(2024, 3, 1, 10, 11, 12)),
    ("2024-366T01:02:03Z", "ny", us(2024, 12, 31, 1, 2, 3)),
    ("2023-366T01:02:03Z", "ny", None),
    ("2020-W53-7", "dmy", us(2021, 1, 3)),
    ("2021-W53-1", "dmy", None),
    ("2024-W01-1", "dmy", us(2024, 1, 1)),
    ("03/04/2024", "dmy", us(2024, 4, 3)),
    ("03/04/2024 1:05 PM", "ny", us(2024, 3, 4, 13, 5, tz=NY)),
    ("01.25.2024 12:10 AM", "ny", us(2024, 1, 25, 0, 10, tz=NY)),
    ("25/12/2024", "ny", None),
    ("Fri, 1 Mar 2024 19:01:40 BST", "ny", us(2024, 3, 1, 18, 1, 40)),
    ("2024-07-01 10:00:00 CST", "ny", us(2024, 7, 1, 16)),
    ("2024-07-01 10:00:00 AEDT", "ny", us(2024, 6, 30, 23)),
    ("Sat Mar 8 00:57:48 2025\n", "dmy", us(2025, 3, 8, 0, 57, 48)),
    ("June 22, 2025, 3:17 PM", "dmy", us(2025, 6, 22, 15, 17)),
    ("April 11, 2024, 2:52 p.m.", "dmy", us(2024, 4, 11, 14, 52)),
    ("11 SEP 2024 02:11", "dmy", us(2024, 9, 11, 2, 11)),
    ("Jan 6 2025", "dmy", us(2025, 1, 6)),
    ("1726394638.48", "dmy", 1_726_394_638_480_000),
    ("1726394638", "dmy", 1_726_394_638_000_000),
    ("1726394638123", "dmy", 1_726_394_638_123_000),
    ("1765880509974365", "dmy", 1_765_880_509_974_365),
    ("2023-02-29 12:00:00", "dmy", None),
    ("25:61", "dmy", None),
    ("Q3 2025", "dmy", None),
    ("", "dmy", None),
    (None, "dmy", None),
    ("x" * 200_000, "dmy", None),
]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("berlin", "Europe/Berlin", "DMY"), ("ny", "America/New_York", "MDY"), ("dmy", "UTC", "DMY"), ("open", "UTC", None), ("vague", "UTC", None), ("lost", "No/Where", "DMY")], "source_id string, default_tz string, date_order string")


def _read(spark, sources, rows):
    values = spark.createDataFrame([("t", n, "f", v, s, "clash") for n, (v, s) in enumerate(rows)], "rec_table string, rec_id bigint, field_name string, value string, source_id string, zone string")
    return {r.rec_id: r for r in timestamps.normalise_instants(values, sources).collect()}


def test_notations(spark, sources):
    got = _read(spark, sources, [c[:2] for c in CASES])
    assert [(CASES[n][0], got[n].utc_us) for n in got if got[n].utc_us != CASES[n][2]] == []
    assert len(got) == len(CASES)


def test_undeclared_order_is_fitted_or_marked(spark, sources):
    got = _read(spark, sources, [("25/01/2024", "open")] * 30 + [("03/04/2024", "open"), ("03/04/2024", "vague"), ("03/04/2024", None), ("01/02/2024 10:00 JST", "lost")])
    assert got[30].utc_us == us(2024, 4, 3) and got[30].status == "read"
    assert got[31].status == "ambiguous" and got[31].utc_us is None and got[31].month_first_share == pytest.approx(0.5)
    assert got[32].status == "ambiguous"
    assert got[33].utc_us == us(2024, 2, 1, 1)


def test_mixture_converges_to_its_fixed_point():
    # a values only month first, b only day first, c either, half an imagined value each: s = (a + .5) / (a + b + 1).
    for a, b, c in ((3, 1, 900), (0, 0, 50), (0, 7, 3)):
        w = timestamps.fit_mixture([["month first"], ["day first"], ["month first", "day first"], ["epoch"]], [a, b, c, 40], {})
        assert w["month first"] / (w["month first"] + w["day first"]) == pytest.approx((a + 0.5) / (a + b + 1), abs=1e-5)
        assert sum(w.values()) == pytest.approx(1)
    assert timestamps.fit_mixture([["month first", "day first"]], [10], {"day first": 20.0})["day first"] > 0.9
    with pytest.raises(RuntimeError, match="still moves"):
        timestamps.fit_mixture([["a"], ["a", "b"]], [1, 9], {}, most=1)


def test_hidden_orders_are_found_from_the_sources_other_dates(spark):
    sources = spark.createDataFrame([("m", "UTC", "MDY"), ("d", "UTC", "DMY"), ("u", "UTC", "DMY")], "source_id string, default_tz string, date_order string")
    rows = [("m", "01/25/2024")] * 40 + [("m", "03/04/2024")] * 3 + [("d", "25.01.2024")] * 40 + [("d", "03.04.2024 10:00")] * 2 + [("u", "03/04/2024"), ("u", "2024-01-01")]
    values = spark.createDataFrame([("t", n, "f", v, s) for n, (s, v) in enumerate(rows)], "rec_table string, rec_id bigint, field_name string, value string, source_id string")
    assert {tuple(r) for r in timestamps.hidden_orders(values, sources).collect()} == {("MDY", "MDY", 3), ("DMY", "DMY", 2), ("DMY", "ambiguous", 1)}


def test_canonical_values_are_those_without_anything_around(spark):
    got = spark.createDataFrame([("2024-03-01T10:00:00.123Z",), ("2024-03-01T10:00:00.123Z\n",)], "v string").select(F.col("v").rlike(timestamps.CANONICAL)).collect()
    assert [r[0] for r in got] == [True, False]


def test_empty_tables(spark, sources):
    assert _read(spark, sources, []) == {}
    assert _read(spark, sources.limit(0), [("2024-03-01", "berlin")])[0].utc_us == us(2024, 3, 1)


def test_values_of_payloads(spark):
    raw = spark.createDataFrame([], "item_seq bigint, published_at string, source string")
    rss = spark.createDataFrame([(1, "2024-01-01", "s")], "rss_seq bigint, iso_date string, source_id string")
    pwc = spark.createDataFrame([(7, '{"created_at": 1741036735, "published_at": true}'), (8, '{"created_at": "x"'), (9, None)], "record_no bigint, payload string")
    rows = {(r.rec_table, r.rec_id, r.field_name): r.value for r in timestamps.timestamp_values(raw, rss, pwc).collect() if r.value}
    assert rows == {("rss_items", 1, "iso_date"): "2024-01-01", ("pwc_raw", 7, "created_at"): "1741036735"}
