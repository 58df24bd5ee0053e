import math
import random
from datetime import datetime, timedelta, timezone

from tidewell.llm import topn

SCHEMA = "event_id bigint, event_date string, impact_score double, source_id string, block string, rnk int"


def brute(rows, n):
    groups = {}
    for e, d, s, src in set(rows):
        try:
            t = datetime.fromisoformat(d.replace("Z", "+00:00")).astimezone(timezone.utc)
        except (ValueError, AttributeError):
            continue
        if src is not None and s is not None and not math.isnan(s) and 0 <= s <= 10:
            groups.setdefault((src, t.strftime("%Y-%m-%d")), set()).add((-s, -t.timestamp(), e))
    return sorted((*g, k + 1, x[2]) for g, v in groups.items() for k, x in enumerate(sorted(v)[:n]))


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in topn.top_events(df, **options).collect())


def test_equals_brute_force_with_ties_hot_groups_and_bad_rows(spark):
    rng = random.Random(1)
    rows = []
    for e in range(3000):
        t = datetime(2025, 11, 1, tzinfo=timezone.utc) + timedelta(seconds=rng.randint(0, 2 * 86_400))
        score = rng.choice([None, float("nan"), float("inf"), -1.0, 11.0, 0.0, 10.0, *[round(rng.random() * 10, 1)] * 9])
        rows.append((e, rng.choice([t.strftime("%Y-%m-%dT%H:%M:%SZ"), (t + timedelta(hours=5)).strftime("%Y-%m-%dT%H:%M:%S") + "+05:00", "2025-02-30T00:00:00Z", None]), score, rng.choice([None, "hot", "hot", "hot", f"s{e % 40}"])))
    rows += rows[:400]
    want = brute(rows, 3)
    assert run(spark, rows) == want
    assert run(spark, rows, block_rows=3) == want
    assert run(spark, rows, n=7, block_rows=1) == brute(rows, 7)


def test_blocks_below_the_nth_score_are_not_read(spark):
    rows = [(e, "2025-11-01T00:00:00Z", e % 100 / 10, "hot") for e in range(2000)] + [(5000 + e, "2025-11-01T00:00:00Z", 1.0 + e % 7, f"s{e % 50}") for e in range(200)]
    layout, blocks = topn.clustered_layout(topn.scored_events(spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)), 50, row_group=4096)
    first = layout.where("block = 0")
    assert first.where("source_id = 'hot'").count() < 200 and layout.count() == 2200
    assert blocks.agg({"top": "max"}).first()[0] < first.where("source_id = 'hot'").agg({"score": "min"}).first()[0]
    # With three ranks nothing beyond the first blocks is due; with 70, of the hot group the next block only.
    order = "row_number() over (partition by source_id, event_day order by score desc, utc_us desc, event_id) as rnk"
    best = first.selectExpr("*", order)
    assert topn.due_blocks(blocks, best, 3, 0).count() == 0
    due = topn.due_blocks(blocks, best, 70, 0)
    assert {r.source_id for r in due.collect()} == {"hot"}
    read = topn.read_block(layout, due, 1, "hot", "hot", 0.0)
    assert 0 < read.count() <= 120
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(block,1)" in plan and "GreaterThanOrEqual(source_id,hot)" in plan


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "x", 5.0, "s")]) == []
