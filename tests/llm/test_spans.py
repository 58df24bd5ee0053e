import random

import pytest

from tidewell.llm import spans


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13])
def test_covers_hold_every_difference(q):
    p = q * q + q + 1
    cover = spans.difference_cover(q)
    assert len(cover) == q + 1 and {(a - b) % p for a in cover for b in cover} == set(range(p))


def brute(docs, length):
    docs = {(i, t) for i, t in docs if i is not None and t is not None}
    where = {}
    for i, t in docs:
        for k in range(len(t) - length + 1):
            where.setdefault(t[k : k + length], set()).add(i)
    out = {}
    for i, t in docs:
        hit = set()
        for k in range(len(t) - length + 1):
            if len(where[t[k : k + length]]) > 1:
                hit.update(range(k, k + length))
        if hit:
            out[i] = len(hit)
    return out


def run(spark, docs, length):
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, hash string")
    return {r.doc_id: r.shared_chars for r in spans.shared_spans(df, length).collect()}


@pytest.mark.parametrize("length", [1, 7, 20, 60])
def test_equals_brute_force(spark, length):
    rng = random.Random(length)
    text = lambda n: "".join(rng.choices("abcdefghij 🙂é", k=n))
    passages = [text(rng.randint(length, 3 * length)) for _ in range(6)]
    docs = []
    for n in range(80):
        parts = [text(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 3)
            parts += [p[cut:], text(rng.randint(0, 20))]
        docs.append((n, "".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (3, docs[3][1]), (102, None), (103, ""), (104, "aaaa" * 40), (105, "aaaa" * 30)]
    if length < 5:
        docs = docs[:20] + docs[-7:]
    assert run(spark, docs, length) == brute(docs, length)


def test_many_near_copies_and_empty_table(spark):
    rng = random.Random(0)
    base = "".join(rng.choices("abcdefghij ", k=900))
    docs = [(n, base[: 300 + n] + f"<{n}>" + base[300 + n :]) for n in range(60)]
    assert run(spark, docs, 400) == brute(docs, 400)
    assert run(spark, [], 400) == {}
    assert run(spark, [(1, base)], 400) == {}
