import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import text, urls
from tidewell.operators import analysis


def _values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_clean_up_cascade(spark):
    prompt = "Event briefing for analysis:\nTitle: Chips get faster.\nSource: blog\nURL: x\n\nReturn the JSON object now."
    rows = [(prompt, "fallback text"), ("Full content:\nReturn the JSON object now.", "The real thing"), ("", ""), ("source: only inside source: words", "f")]
    clean = _values(spark, rows, "a string, b string", text.sanitised(F.col("a"), F.col("b"), 20))
    assert clean == [("Chips get faster.",), ("The real thing",), ("Summary unavailable.",), ("f",)]
    plain = _values(spark, [("The post Alpha wins appeared first on Blog. More here. Read more on X",), ("Follow us on social media now",)], "a string", text.without_boilerplate(F.col("a")))
    assert plain == [("Alpha wins More here.",), ("",)]
    low = _values(spark, [("one two three four five", "t"), ("one two three four five six", "t"), ("The post is about six or more words", "t"), ("Same as the title of this", "same as the title of THIS"), (None, "t")], "a string, b string", text.is_low_quality(F.col("a"), F.col("b")))
    assert [x[0] for x in low] == [True, False, True, True, True]


def test_ids_and_keys(spark):
    rows = [("2024-01-15", "Alpha Lab Opens Beta-5: A Big Step!"), ("2024-01-15", "AI & ML: What's Next? (2024 Edition)"), ("2024-01-15", "x" * 90)]
    got = _values(spark, rows, "d string, t string", text.event_id(F.to_date("d"), F.col("t")), text.month_key(F.to_date("d"), F.col("t")))
    assert got[0] == ("2024-01-15-alpha-lab-opens-beta-5-a-big-step", "2024-01-alpha-lab-opens-beta-5-a-big-step")
    assert got[1][0] == "2024-01-15-ai-ml-what-s-next-2024-edition"
    assert len(got[2][0]) == 61


def test_insights_payloads_paragraphs_authors(spark):
    got = _values(spark, [([" a ", "", "b!", "c"],), ([],), (None,)], "a array<string>", text.key_takeaways(F.col("a")))
    assert [x[0] for x in got] == ["Key takeaways: a. b!", None, None]
    got = _values(spark, [('say ```json\n{"a": 1}\n``` done',), ('x {"a": {"b": 2}} y',), ("none",)], "a string", text.json_payload(F.col("a")))
    assert [x[0] for x in got] == ['{"a": 1}', '{"a": {"b": 2}}', None]
    assert _values(spark, [("one\ntwo\r\n\r\nthree",)], "a string", text.first_paragraph(F.col("a"))) == [("one two",)]
    assert _values(spark, [("Alexandra Doe,Bo",)], "a string", text.comma_and_authors(F.col("a")))[0][0] == ["Alex", "ra Doe", "Bo"]


def test_categories_and_scores(spark):
    got = _values(spark, [(" Research ",), ("HARDWARE",), ("nonsense",), (None,)], "a string", text.mapped_category(F.col("a"), text.ANALYSED_CATEGORIES))
    assert [x[0] for x in got] == ["Research Breakthroughs", "Hardware Advances", "Research Breakthroughs", "Research Breakthroughs"]
    schema = "s struct<technological_breakthrough: double, industry_impact: double, adoption_scale: double, novelty: double>"
    assert _values(spark, [((8.0, 7.0, 6.0, 7.0),), ((None, 7.0, 6.0, 7.0),), (None,)], schema, analysis.impact_score(F.col("s"))) == [(7.2,), (None,), (None,)]
    assert _values(spark, [("new POLICY",), ("a launch",), ("adoption",), ("",)], "a string", analysis.built_in_category(F.col("a"))) == [("regulation",), ("product",), ("industry",), ("research",)]


def test_urls(spark):
    rows = [("https://www.Example.com:80/a?utm_source=x&b=1#f",), ("http://u:p@a.www.b.org/",), ("no url",), (None,), ("https://e.org/?utm_medium=a&utm_term=b",), ("https://e.org/?a=1&utm_term=b&c=2",)]
    got = _values(spark, rows, "u string", urls.domain(F.col("u")), urls.sanitised(F.col("u")), urls.is_valid(F.col("u")))
    assert got == [("example.com", "https://www.Example.com:80/a?b=1", True), ("a.b.org", "http://u:p@a.www.b.org/", True), ("", "no url", False), ("", None, False), ("e.org", "https://e.org/", True), ("e.org", "https://e.org/?a=1&c=2", True)]
    got = _values(spark, [("../x", "https://e.org/a/b/"), (None, "https://e.org")], "u string, b string", urls.absolute(F.col("u"), F.col("b")))
    assert got == [("https://e.org/a/x",), (None,)]
    got = _values(spark, [({"a b": "1&2", "z": None},), ({},)], "m map<string, string>", urls.with_query(F.lit("https://e.org"), F.col("m")))
    assert got == [("https://e.org?a+b=1%262",), ("https://e.org",)]


def test_unit_vector(spark):
    texts = ["", "abc", "The quick brown fox jumps", "é"]
    got = _values(spark, [(t,) for t in texts], "a string", analysis.unit_vector(F.col("a")))
    for t, (vector,) in zip(texts, got, strict=True):
        sums = [sum(ord(c) for c in t[k::12]) for k in range(12)]
        norm = math.sqrt(sum(x * x for x in sums)) or 1
        assert vector == pytest.approx([x / norm for x in sums], abs=1e-6)


def _similarity(a, b):
    def jac(x, y):
        return len(x & y) / len(x | y) if x and y else 0.0

    def terms(t):
        return {w for w in t.split(" ") if len(w) > 4 or any(c.isdigit() for c in w) or (len(w) >= 2 and w.isalpha())}

    def edit(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != e)))
        return row[-1]

    if a == b:
        return 1.0
    over = len(terms(a) & terms(b)) / min(len(terms(a)), len(terms(b))) if terms(a) and terms(b) else 0.0
    words = lambda t: {w for w in t.split(" ") if len(w) > 2}
    return max(jac(words(a), words(b)), 0.9 if a in b or b in a else 0.0, over if over > 0.5 else 0.0, 1 - edit(a, b) / max(len(a), len(b)))


_PLAIN = st.lists(st.sampled_from(["alpha", "be", "gamma9", "x", "delta", "1"]), max_size=5).map(" ".join)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(_PLAIN, _PLAIN), min_size=20, max_size=40))
def test_similarity_equals_brute_force(spark, pairs):
    got = _values(spark, pairs, "a string, b string", text.text_similarity(F.col("a"), F.col("b")))
    assert [x[0] for x in got] == pytest.approx([_similarity(a, b) for a, b in pairs])
