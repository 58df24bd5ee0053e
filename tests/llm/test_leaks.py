import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import leaks


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, last = [i], row
        for j, e in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != e)))
    return row


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=16), st.integers(0, 4), st.booleans())
def test_myers_equals_the_table(pattern, text, most, at_end):
    a, b = (pattern[::-1], text[::-1]) if at_end else (pattern, text)
    want = min(edits(a, b[: len(a) + most])) if a else 0
    assert leaks.myers_distance(pattern, text, most, at_end) == (want if want <= most else most + 1)


def test_normal_form():
    assert leaks.normalised("  Ré-SUMÉ, naïve_x 2,742!") == " re sume naive x 2 742 "


WORDS = [f"word{n}" for n in range(300)]


def _found(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, text string, doc_id string")
    return sorted(tuple(r) for r in leaks.leaked_passages(d, i, **options).collect())


def test_equals_brute_force_in_one_block_or_many(spark):
    rng = random.Random(2)
    items = [(n, " ".join(rng.choices(WORDS, k=rng.randint(8, 30)))) for n in range(40)]
    docs = []
    for n in range(150):
        words = rng.choices(WORDS, k=60)
        item = rng.choice(items)[1].split()
        size = rng.randint(9, 15)
        at = rng.randint(0, max(0, len(item) - size))
        words[20:20] = [w.upper() if rng.random() < 0.3 else w for w in item[at : at + size]]
        docs.append((n, ", ".join(words)))
    docs += [(900, None), (901, ""), (0, docs[0][1])]
    want = set()
    for n, t in docs:
        words = leaks.normalised(t or "").strip()
        for i, x in items:
            xs = leaks.normalised(x).split()
            if any(f" {' '.join(xs[k : k + 12])} " in f" {words} " for k in range(len(xs) - 11)):
                want.add((n, i))
    assert len(want) > 20
    for options in ({}, {"block_chars": 900}, {"errors": 0}, {"errors": 2}):
        got = _found(spark, docs, items, **options)
        assert {(a, b) for a, b, e in got if e == 0} == want
        assert len({(a, b) for a, b, _ in got}) == len(got)


def test_one_edit_is_found_and_two_are_not(spark):
    item = "the quick brown fox jumps over the lazy dog while seven birds sing"
    docs = [(1, item.replace("brown", "brwn")), (2, item.replace("seven", "sevenn")), (3, item.replace("brown", "brwn").replace("seven", "sevn").replace("over", "ovr")), (4, item.replace("fox jumps", "foxjumps"))]
    got = {a: e for a, b, e in _found(spark, docs, [(7, item)])}
    assert got == {1: 1, 2: 1, 4: 1}


def test_an_edit_anywhere_in_twelve_words_is_found():
    item = leaks.normalised("the quick brown fox jumps over seven lazy dogs while birds sing")
    index = leaks.PassageIndex([(7, item)], 12, 1)
    assert len(item.split()) == 12 and index.found(item) == {7: 0}
    for n in range(len(item)):
        for new in ("", "x", " ", "x" + item[n], " " + item[n]):
            text = leaks.normalised("yes" + item[:n] + new + item[n + 1 :] + "yes")
            assert index.found(text) == {7: 0 if item in text else 1}, text


def test_distances_equal_the_table():
    """Against the least distance of any passage, with its blanks, to any part of the text."""
    rng = random.Random(4)
    for _ in range(600):
        words, errors = rng.randint(1, 4), rng.randint(0, 3)
        item = [rng.choice(["ab", "b", "abc", "ca"]) for _ in range(rng.randint(words, 5))]
        text = leaks.normalised(" ".join(rng.choice(["ab", "b", "abc", "ca", "cab"]) for _ in range(rng.randint(0, 6))))
        best = 99
        for at in range(len(item) - words + 1):
            passage = f" {' '.join(item[at : at + words])} "
            row = [0] * (len(text) + 1)
            for i, c in enumerate(passage, 1):
                row, last = [i], row
                for j, e in enumerate(text, 1):
                    row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != e)))
            best = min(best, *row)
        assert leaks.PassageIndex([(1, leaks.normalised(" ".join(item)))], words, errors).found(text) == ({1: best} if best <= errors else {})


def test_empty_tables(spark):
    assert _found(spark, [], [(1, "a b c")]) == []
    assert _found(spark, [(1, "a b c")], [(1, None), (None, "a")]) == []
