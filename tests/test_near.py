import random

import numpy as np
import pyarrow as pa

from tidewell.functions import text
from tidewell.operators import near


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for k, y in enumerate(b):
            row.append(before[k] + 1 if x == y else max(before[k + 1], row[k]))
    return row[-1]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for n, x in enumerate(a):
        before, row = row, [n + 1]
        for k, y in enumerate(b):
            row.append(min(before[k] + (x != y), before[k + 1] + 1, row[k] + 1))
    return row[-1]


def _texts():
    rng = random.Random(5)
    sizes = [0, 1, 2, 62, 63, 64, 65, 126, 127, 128, 200, *(rng.randint(1, 160) for _ in range(20))]
    out = ["".join(rng.choice("abcde 1_") for _ in range(n)).strip() for n in sizes]
    return [*out, *(x[:k] + "z" + x[k + 1 :] for x in out for k in (len(x) // 2,))]


def test_bounds_by_characters_are_exact():
    texts = _texts()
    columns = near.Texts(texts, 64).columns()
    p, q = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    assert near.common_subsequences(columns, columns, p, q, chunk=100).tolist() == [_subsequence(texts[i], texts[j]) for i, j in zip(p, q, strict=True)]
    assert near.same_places(columns, columns, p, q, chunk=100).tolist() == [max(len(texts[i]), len(texts[j])) - _edits(texts[i], texts[j]) for i, j in zip(p, q, strict=True)]


def test_only_pairs_that_cannot_score_are_left_out():
    titles = ["alpha opens beta model to users", "alpha opens beta model to users now", "quite another story of ships", "", "7 x"]
    rows = [(n, 1000 * n, 0, None, f"h{n}", t, "same words in both contents" if n < 2 else "", n < 2) for n, t in enumerate(titles)]
    names = ["event_seq", "ms", "slot", "url", "domain", "nt", "nc", "has_content"]
    table = pa.table({k: pa.array(x, pa.int64() if k == "url" else None) for k, x in zip(names, zip(*rows, strict=True), strict=True)})
    i, j = near.possible_pairs(table, table, 172_800_000, 0.6)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(0, 1)}


def test_similarity_with_words_taken_apart_once_is_the_same(spark):
    texts = [x for x in _texts() if len(x) < 70][:14]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    both = text.with_similarity(rows, "a", "b", "once").withColumn("plain", text.text_similarity(rows.a, rows.b)).collect()
    assert len(both) == len(texts) ** 2 and all(r.once == r.plain for r in both)
