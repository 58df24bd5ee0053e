import random
import re
from datetime import date, timedelta

import pytest

from tidewell.llm import history

SCHEMA = "entry_seq bigint, batch_no int, id string, title string, event_date string, wc string"


def brute(rows):
    out, accepted = set(), []
    for seq, _, i, title, day in sorted(rows):
        words = set(re.findall(r"[^\W_]+", title.lower())) if title else set()
        d = date.fromisoformat(day[:10]) if day else None
        met = [k for k, ki, kw, kd in accepted if (i is not None and i == ki) or (words and kw and d and kd and abs((d - kd).days) <= 3 and 10 * len(words & kw) >= 6 * len(words | kw))]
        if met:
            out.add((min(met), seq))
        else:
            accepted.append((seq, i, words, d))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in history.repeated_entries(df, **options).collect())


def some_rows(seed, n=160):
    rng = random.Random(seed)
    names = [f"name{k}" for k in range(200)]
    common = ["new", "opens", "the", "with", "of", "chip"]
    rows = []
    for seq in range(n):
        words = rng.sample(names, 3) + rng.sample(common, rng.randint(0, 5))
        title = " ".join(words) if rng.random() > 0.05 else rng.choice([None, "", "..."])
        day = str(date(2025, 11, 1) + timedelta(days=rng.randint(0, 8))) + "T00:00:00.000Z" if rng.random() > 0.05 else None
        rows.append((seq, seq // 40, rng.choice([None, f"id{rng.randint(0, 400)}"]), title, day))
        if rows and rng.random() < 0.3:
            old = list(rng.choice(rows))
            title = old[3] and " ".join(rng.sample(old[3].split(" "), max(1, len(old[3].split(" ")) - rng.randint(0, 2))))
            rows[-1] = (seq, seq // 40, rng.choice([old[2], None, f"x{seq}"]), title, rng.choice([old[4], rows[-1][4]]))
    return rows


def test_equals_a_sequential_scan(spark):
    rows = some_rows(3)
    want = sorted(brute(rows))
    assert len(want) > 20
    assert run(spark, rows) == want


def test_titles_that_share_enough_have_a_fingerprint_in_common():
    rng = random.Random(5)
    frequent = {k: 100 - k for k in range(6)}
    alike = 0
    for _ in range(4000):
        a = set(rng.sample(range(30), rng.randint(1, 12)))
        b = (a - set(rng.sample(sorted(a), rng.randint(0, len(a) - 1)))) | set(rng.sample(range(30), rng.randint(0, 4)))
        if 10 * len(a & b) >= 6 * len(a | b):
            alike += 1
            pa, pb = (history.winnowed(sorted(x), frequent, 6) for x in (a, b))
            order = lambda x: (frequent.get(x, 0), x)
            first = min(a & b, key=order)
            assert first in pa and first in pb
            # The bound by the place of the first common word holds too.
            left = min(len(x) - sorted(x, key=order).index(first) for x in (a, b))
            assert left * 16 >= 6 * (len(a) + len(b))
    assert alike > 500


def test_chain_of_look_alikes_and_hot_copies(spark):
    day = "2025-11-01T00:00:00.000Z"
    chain = [(n, 0, f"c{n}", f"a{n} a{n + 1} a{n + 2} a{n + 3}", day) for n in range(5)]  # neighbours share 3 of 5 words
    copies = [(100 + n, n // 20, f"h{n % 7}", "one hot title", day) for n in range(200)] + [(200 + n, 2, "same", None, None) for n in range(5)]
    assert run(spark, chain + copies) == sorted(brute(chain + copies))


def test_repeated_rows_and_empty_table(spark):
    row = (1, 0, "a", "t", None)
    assert run(spark, [row, row, (2, None, "a", None, None)]) == [(1, 2)]
    assert run(spark, []) == []


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def test_a_reopened_store_goes_on_with_other_settings(spark, tmp_path):
    rows = some_rows(9, 120)
    got, before = set(), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k in range(3):
            spark.conf.set("spark.sql.shuffle.partitions", str(2 + 3 * k))
            store = history.HistoryStore(spark, str(tmp_path / "store"))
            assert store.steps == k
            got |= {tuple(r) for r in store.add(_frame(spark, rows[k * 40 : k * 40 + 40])).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows)
    # What is stored already is repeated as a whole, by the entries accepted before.
    again = [(1000 + r[0], *r[1:]) for r in rows if r[2] is not None]
    store = history.HistoryStore(spark, str(tmp_path / "store"))
    accepted = {r[0] for r in rows} - {d for _, d in got}
    found = {tuple(r) for r in store.add(_frame(spark, again)).collect()}
    assert {d for _, d in found} == {r[0] for r in again} and {k for k, _ in found} <= accepted
    with pytest.raises(ValueError, match="written with"):
        history.HistoryStore(spark, str(tmp_path / "store"), days=5)


def test_history_of_other_weeks_is_not_read(spark, tmp_path):
    old = [(n, 0, None, f"a{n} b{n} c{n}", f"20{10 + n % 10}-01-01T00:00:00.000Z") for n in range(600)]
    store = history.HistoryStore(spark, str(tmp_path / "store"))
    store.add(_frame(spark, old))
    new = [(1000, 1, None, "a3 b3 c3", "2024-06-01T00:00:00.000Z"), (1001, 1, None, "a5 b5 c5", "2015-01-02T00:00:00.000Z")]
    assert {tuple(r) for r in store.add(_frame(spark, new)).collect()} == {(5, 1001)}
    assert 0 < store.looked_at[1] <= 600 * 2 / 10 + 10
    assert store.add(_frame(spark, [(2000, 2, None, "q r s", "2030-01-01T00:00:00.000Z")])).count() == 0
    assert store.looked_at[2] <= 10


def test_waiting_batches_take_few_steps_that_all_look_into_the_store(spark, monkeypatch):
    rows = [(r[0], 0 if k < 60 else k // 3, *r[2:]) for k, r in enumerate(some_rows(11))]  # a history and 34 batches
    stores = []
    monkeypatch.setattr(history.HistoryStore, "fix_order", lambda self, first, old=history.HistoryStore.fix_order: (stores.append(self), old(self, first)))
    assert run(spark, rows) == sorted(brute(rows))
    assert stores[0].steps == len(stores[0].looked_at) == 3
    assert stores[0].looked_at[0] == 0 < min(stores[0].looked_at[1:])


def test_titles_that_share_only_frequent_words_do_not_meet(spark, tmp_path):
    template = "firm opens lab in city".split(" ")
    titles = [[f"a{n}", f"b{n}", f"c{n}", *template] for n in range(300)]
    rows = [(n, 0, None, " ".join(title), "2025-11-01T00:00:00.000Z") for n, title in enumerate(titles)]
    rows += [(1000 + n, 0, None, " ".join([f"b{n}", *template, f"c{n}"]), "2025-11-02T00:00:00.000Z") for n in range(20)]
    store = history.HistoryStore(spark, str(tmp_path / "store"))
    prepared = store.prepared(_frame(spark, rows))
    store.fix_order(prepared)
    chosen = [(r["wc"], r["day"], r["words"], history.winnowed(r["words"], store.order, 6)) for r in prepared.collect()]
    classes = spark.createDataFrame(chosen, history._CLASS)
    met = store._prints(classes).join(store._probes(classes).withColumnRenamed("wc", "nb"), ["era", "fp"]).where("wc <> nb").select("wc", "nb").distinct()
    assert met.count() == 40  # each of the 20 alike pairs from both sides, of 102,080 pairs with five words in common
    assert {tuple(r) for r in store.add(_frame(spark, rows)).collect()} == {(n, 1000 + n) for n in range(20)}


def test_a_level_of_ids_alone_and_a_long_title(spark):
    long = " ".join(f"w{n}" for n in range(700))
    day = "1960-01-01T00:00:00.000Z"
    rows = [(1, 0, "a", None, None), (2, 1, "b", long, day), (3, 2, "c", f"{long} more", day), (4, 3, "a", long[:20], day), (5, 3, "b", None, None)]
    assert run(spark, rows) == sorted(brute(rows)) == [(1, 4), (2, 3), (2, 5)]
