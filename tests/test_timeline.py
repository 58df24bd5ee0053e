import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell import shared

from tidewell.operators import analysis, fuzzy, ingest, stats, timeline
from tidewell.streaming import windows

ENTRY = "entry_seq bigint, id string, title string, day date, category string, k string"


def _entries(spark, rows):
    return spark.createDataFrame([(n, i, t, d and datetime.fromisoformat(d).date(), c, "clash") for n, i, t, d, c in rows], ENTRY)


def test_leaders_equal_a_sequential_scan(spark):
    rng = random.Random(5)
    pairs, want = [], {}
    for graph in range(40):
        size = rng.randint(2, 12)
        edges = {(graph * 100 + i, graph * 100 + j) for i in range(size) for j in range(i + 1, size) if rng.random() < 0.3}
        pairs += edges
        lead = []
        for v in sorted({x for e in edges for x in e}):
            near = [u for u in lead if (u, v) in edges]
            want[v] = near[0] if near else v
            if not near:
                lead.append(v)
    got = {r.member: r.leader for r in fuzzy.leaders(spark.createDataFrame(pairs, "i bigint, j bigint")).collect()}
    assert got == want


def test_chain_is_not_transitive(spark):
    chain = spark.createDataFrame([(n, n + 1) for n in range(4)], "i bigint, j bigint")
    assert {r.leader for r in fuzzy.leaders(chain).collect()} == {0, 2, 4}
    assert fuzzy.leaders(chain.limit(0)).count() == 0


def test_duplicate_pairs(spark):
    t0 = datetime(2024, 1, 1)
    rows = [
        (1, "Alpha opens Betagamma agent", t0, "s", "https://a.org/1", "same words here"),
        (2, "Alpha opens Betagamma agents", t0 + timedelta(hours=48), "s", "https://a.org/2", "same words here"),
        (3, "Alpha opens Betagamma agent", t0 + timedelta(hours=97), "s", "https://a.org/3", "same words here"),
        (4, "Unrelated", t0 + timedelta(days=300), "s", "https://a.org/1", None),
        (4, "Unrelated", t0 + timedelta(days=300), "s", "https://a.org/1", None),
        (5, None, None, None, None, None),
    ]
    events = spark.createDataFrame(rows, "event_seq bigint, title string, event_date timestamp, source string, url string, content string")
    got = {(r.i, r.j) for r in fuzzy.duplicate_pairs(events).collect()}
    assert got == {(1, 2), (1, 4)}
    assert fuzzy.duplicate_pairs(events.limit(0)).count() == 0
    groups = fuzzy.leaders(fuzzy.duplicate_pairs(events))
    merged = fuzzy.merged_groups(events, groups, spark.createDataFrame([("s", 3)], "source string, priority int")).collect()
    assert [(m.leader, m.primary_seq, m.content_seq, m.duplicate_count) for m in merged] == [(1, 1, 1, 3)]


def test_classes_are_pairs_of_each_other(spark):
    rng = random.Random(7)
    pairs, classes, want = [], [], {}
    for graph in range(40):
        nodes = [graph * 100 + n for n in range(rng.randint(2, 12))]
        edges = {(i, j) for i in nodes for j in nodes if i < j and rng.random() < 0.15}
        pairs += edges
        cls = {}
        for v in nodes:
            if rng.random() < 0.6:
                cls.setdefault(rng.randint(0, 1), []).append(v)
        for held in cls.values():
            if len(held) > 1:
                classes += [(v, held[0]) for v in held]
                edges |= {(i, j) for i in held for j in held if i < j}
        lead = []
        for v in sorted({x for e in edges for x in e}):
            near = [u for u in lead if (u, v) in edges]
            want[v] = near[0] if near else v
            if not near:
                lead.append(v)
    got = {r.member: r.leader for r in fuzzy.leaders(spark.createDataFrame(pairs, "i bigint, j bigint"), spark.createDataFrame(classes, "event_seq bigint, first bigint")).collect()}
    assert got == want


def test_url_shared_by_a_member_of_another_group(spark):
    """Event 2 belongs to 1; 3, 4 and 5 share its URL but not 1's, so 3 leads them."""
    t0 = datetime(2024, 1, 1)
    rows = [(1, "Alpha opens Betagamma agent", t0, "https://a.org/1"), (2, "Alpha opens Betagamma agent", t0, "https://a.org/2")]
    rows += [(n, f"Other{n} thing{n}", t0 + timedelta(days=100 * n), "https://a.org/2") for n in (3, 4, 5)]
    events = spark.createDataFrame([(a, b, c, "s", u, None) for a, b, c, u in rows], "event_seq bigint, title string, event_date timestamp, source string, url string, content string")
    assert {(r.member, r.leader) for r in fuzzy.duplicate_groups(events).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)}
    assert fuzzy.duplicate_groups(events.limit(0)).count() == 0


def test_sliding_counts_across_slots(spark):
    rng = random.Random(3)
    rows = [(n, rng.choice(["a", "b", None]), None if n % 10 == 0 else datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 400))) for n in range(200)]
    got = {r.n: r.in_window for r in stats.sliding_failures(spark.createDataFrame(rows, "n bigint, k string, t timestamp"), "k", "t", 60).collect()}
    for n, k, t in rows:
        same = [u for _, x, u in rows if x == k]
        assert got[n] == (sum(u is None for u in same) if t is None else sum(u is not None and timedelta(0) <= t - u <= timedelta(seconds=60) for u in same))


def test_budget_across_blocks(spark):
    rng = random.Random(4)
    rows = [(n, rng.choice(["a", "b", None]), rng.choice([None, "", "x" * rng.randint(1, 40)])) for n in rng.sample(range(1000), 200)]
    got = {r.n: r.running for r in analysis.within_budget(spark.createDataFrame(rows, "n bigint, k string, t string"), "k", "n", "t", 60, 10).collect()}
    want, totals = {}, {}
    for n, k, t in sorted(rows, key=lambda r: r[0]):
        totals[k] = totals.get(k, 0) + -(-len(t or "") // 4)
        if totals[k] <= 60:
            want[n] = totals[k]
    assert got == want


def test_sentences_and_violations(spark):
    texts = spark.createDataFrame([("One.  Two! " + "x" * 200,), ("",), (None,), ("..",)], "t string")
    assert [r.s for r in texts.select(analysis.first_sentences(F.col("t"), 3).alias("s")).collect()] == [["One", "Two", "x" * 160], [], None, []]
    schema = "id string, title string, event_date string, description string, category string, sources array<string>, url string, impact_score double, significance struct<technological_breakthrough:double,industry_impact:double,adoption_scale:double,novelty:double>"
    good = ("2024-01-01-a", "T", "2024-01-01T00:00:00.000Z", "D", "product", ["https://a.org/1"], None, 5.0, (1.0, 2.0, 3.0, 10.0))
    bad = ("2024-1-1-a", "", "2024-01-01", None, "other", ["no"], "no", float("nan"), (1.0, None, 3.0, 4.0))
    got = [r.v for r in spark.createDataFrame([good, bad, (None,) * 9], schema).select(analysis.violations().alias("v")).collect()]
    assert got == [[], ["id", "title", "date", "description", "category", "sources", "url", "impact_score", "significance"], ["id", "title", "date", "description", "category", "sources", "impact_score", "significance"]]


def test_new_entries_and_conflicts(spark):
    old = _entries(spark, [(1, "a", "Same Title", "2024-01-03", "x")])
    new = _entries(spark, [(2, "a", "Other", "2024-02-01", "x"), (3, "b", "same title!", "2024-01-20", "x"), (4, "c", "Fresh", "2024-02-02", "x"), (5, "d", "fresh", "2024-02-03", "x"), (6, "e", "same title", "2024-01-03", "x")])
    assert [r.entry_seq for r in timeline.new_entries(new, old).collect()] == [4]
    assert {tuple(r) for r in timeline.conflicts(new, old, "2024-02-02").collect()} == {(2, "id"), (3, "key"), (6, "key"), (5, "repeated"), (6, "repeated"), (5, "future")}
    assert {tuple(r) for r in timeline.similar_existing(new, old).collect()} == {(6, 1)}
    assert timeline.new_entries(new.limit(0), old).count() == 0


def test_normalised_rows_and_weeks(spark, tmp_path):
    rows = [(2024, "March", " T ", None, "policy", "https://e.org"), (2024, "99", "U", "d", None, "https://e.org"), (2024, "nope", "V", "d", "x", "https://e.org"), (2024, "1", " ", "d", "x", "https://e.org"), (2024, "1", "W", "d", "x", "bad")]
    got = timeline.normalised_rows(spark.createDataFrame(rows, "year int, month string, title string, description string, category string, link string")).collect()
    assert [(r.id, r.category, r.description) for r in got] == [("2024-03-01-t", "Ethics & Policy", "T"), ("2024-12-01-u", "Research Breakthroughs", "d"), ("2024-01-01-v", "Research Breakthroughs", "d")]
    days = spark.createDataFrame([("2024-03-04",), ("2024-01-01",)], "d string").select(timeline.week_name(F.to_date("d")).alias("w"))
    assert [r.w for r in days.collect()] == ["auto-update/week-2024-10", "auto-update/week-2024-01"]
    entries = _entries(spark, [(1, "a", "T", "2024-03-04", "x")])
    two = _entries(spark, [(2, "b", "U", "2024-03-12", "x"), (3, "c", "V", "2024-03-05", "x"), (4, "d", "W", None, "x")])
    path = str(tmp_path / "weeks")
    assert timeline.append_weeks(entries, path, F.to_date("day")) == ["week-2024-10"]
    assert timeline.append_weeks(two, path, F.to_date("day")) == ["week-2024-11"]  # week 10 stays as it is
    assert timeline.append_weeks(two, path, F.to_date("day")) == []
    assert {(r.entry_seq, r.week) for r in spark.read.parquet(path).collect()} == {(1, "week-2024-10"), (2, "week-2024-11")}
    assert [p.name for p in tmp_path.iterdir()] == ["weeks"]


def test_statistics(spark):
    rows = spark.createDataFrame([("Public Releases", 8.0, "2024-01-15"), ("Research Breakthroughs", 7.0, "2024-01-10"), ("Public Releases", 9.0, "2024-01-20")], "category string, impact_score double, day string")
    got = {r.category: tuple(r)[1:] for r in stats.timeline_stats(rows).collect()}
    assert got == {"(all)": (3, 8.0, "2024-01-10", "2024-01-20"), "Public Releases": (2, 8.5, "2024-01-15", "2024-01-20"), "Research Breakthroughs": (1, 7.0, "2024-01-10", "2024-01-10")}
    empty = {r.category: r.total for r in stats.timeline_stats(rows.limit(0)).collect()}
    assert empty in ({"(all)": 0}, {})
    assert tuple(stats.selection_metrics(rows.limit(0), "impact_score", 7.5).first()) == (0, 0, 0.0, 0.0, 0.0)
    assert tuple(stats.selection_metrics(rows, "impact_score", 7.5).first()) == (3, 2, 8.0, 9.0, 7.0)


def test_ingest_and_budget(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", None), (4, "a", 9)], "n bigint, k string, v int")
    assert [r.n for r in ingest.latest(rows, "v", "n", 2).collect()] == [4, 1]
    assert {r.n for r in ingest.first_per_key(rows, ["k"], ["n"]).collect()} == {1, 3}
    assert {r.n for r in ingest.top_per_key(rows, ["k"], [F.desc("v"), "n"], 2).collect()} == {4, 1, 3}
    texts = spark.createDataFrame([(1, "a", "x" * 8), (2, "a", "x" * 9), (3, "a", None), (4, "b", "x" * 100)], "n bigint, k string, t string")
    assert {r.n for r in analysis.within_budget(texts, "k", "n", "t", 4).collect()} == {1}


def test_model_calls_in_batches(spark):
    rows = spark.createDataFrame([(1, "p"), (2, None)], "n bigint, prompt string")
    got = analysis.analysed(rows, lambda: lambda batch: [None if p is None else p.upper() for p in batch]).orderBy("n").collect()
    assert [r.answer for r in got] == ["P", None]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 01:00:00", "a"), (2, "2024-01-01 02:00:00", "a"), (1, "2024-01-01 03:00:00", "a"), (3, "2024-01-04 00:00:00", "a"), (4, "2024-01-02 23:00:00", "b")]
    spark.createDataFrame(rows, "n bigint, t string, k string").withColumn("t", F.col("t").cast("timestamp")).write.parquet(f"{tmp_path}/x.parquet")
    stream = windows.parquet_stream(spark, str(tmp_path), "x")
    # Only the day that ended two days before the newest row is over.
    assert [(r.k, r.n) for r in windows.run_once(windows.windowed_counts(stream, "t", "k")).collect()] == [("a", 3)]
    once = windows.run_once(windows.first_deliveries(windows.parquet_stream(spark, str(tmp_path), "x"), "t", ["n"]).select("n"))
    assert sorted(r.n for r in once.collect()) == [1, 2, 3, 4]


def test_keywords_by_count_then_place(spark):
    rows = spark.createDataFrame([(1, "Beta alpha beta, alpha gamma https the delta delta-delta"), (2, None), (3, "a b c")], "n bigint, t string")
    got = [tuple(r) for r in analysis.top_keywords(rows, "n", "t", 3).orderBy("rnk").collect()]
    assert got == [(1, 1, "delta", 3), (1, 2, "beta", 2), (1, 3, "alpha", 2)]


def test_the_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session)


def _pair_score(a, b):

    def edits(x, y):
        row = list(range(len(y) + 1))
        for n, c in enumerate(x, 1):
            row, last = [n], row
            for m, e in enumerate(y, 1):
                row.append(min(row[-1] + 1, last[m] + 1, last[m - 1] + (c != e)))
        return row[-1]

    def similar(x, y):
        x, y = (re.sub("[^a-z0-9_]+", " ", t.lower()).strip() for t in (x, y))
        if x == y:
            return 1.0
        longs = [{w for w in t.split() if len(w) > 2} for t in (x, y)]
        terms = [{w for w in t.split() if len(w) > 4 or re.search("[0-9]", w) or re.fullmatch("[a-z]{2,}", w)} for t in (x, y)]
        jaccard = len(longs[0] & longs[1]) / len(longs[0] | longs[1]) if all(longs) else 0.0
        overlap = len(terms[0] & terms[1]) / min(map(len, terms)) if all(terms) else 0.0
        return max(jaccard, 0.9 if x in y or y in x else 0.0, overlap if overlap > 0.5 else 0.0, 1 - edits(x, y) / max(len(x), len(y)))

    gap, width = abs(a[0] - b[0]), 172_800_000
    if gap > width:
        return 0.0
    content = similar(a[3][:500], b[3][:500]) if a[3] and b[3] else 0.0
    return similar(a[2], b[2]) * 0.5 + content * 0.3 + (0.1 if a[1] == b[1] else 0.0) + (1 - gap / width) * 0.1


def test_duplicate_pairs_equal_all_pairs_in_two_days(spark):
    """Contained and empty titles, titles alike by letters only, half-equal titles with equal contents."""
    rng = random.Random(11)
    names = ["model", "opens", "lab", "7b", "agent", "of", "safety", "ships", "new", "robotics", "a", "x9", "planner", "court"]
    texts = [" ".join(rng.choices(names, k=rng.randint(1, 9))) for _ in range(25)] + ["", "日本語", "an"]
    texts += ["".join(c for c in t if rng.random() < 0.85) for t in texts[:15]]
    rows = []
    for n in range(220):
        when = datetime(2024, 1, 1) + timedelta(milliseconds=rng.randint(0, 86_400_000 * 9))
        rows.append((n, rng.choice([*texts, None]), when, "s", f"https://{rng.choice('ab')}.org/{n}", rng.choice([*texts[:8], rng.choice(texts), None])))
    rows.append((220, "long title " * 40, rows[0][2], "s", "https://a.org/220", None))
    rows.append((221, "long title " * 39 + "lang title", rows[0][2], "s", "https://a.org/221", None))
    plain = [(int((r[2] - datetime(2024, 1, 1)) / timedelta(milliseconds=1)), r[4].split("/")[2], r[1] or "", r[5] or "") for r in rows]
    scores = {(i, j): _pair_score(plain[i], plain[j]) for i in range(len(rows)) for j in range(i + 1, len(rows))}
    want = {k for k, v in scores.items() if v >= 0.6}
    sure = {k for k in scores if abs(scores[k] - 0.6) > 1e-9}
    events = spark.createDataFrame(rows, "event_seq bigint, title string, event_date timestamp, source string, url string, content string")
    got = {(r.i, r.j): r.score for r in fuzzy.duplicate_pairs(events).collect()}
    assert len(want) > 300 and any(not re.search("[a-z]", plain[i][2]) for i, _ in want)
    assert set(got) & sure == want & sure
    assert all(abs(got[k] - scores[k]) < 1e-9 for k in got)
    prepared = fuzzy.prepared_events(events)
    squares = fuzzy.candidate_pairs(prepared, block=10).collect()
    assert sorted(squares) == sorted(fuzzy.candidate_pairs(prepared).collect()) and len(set(squares)) == len(squares)
