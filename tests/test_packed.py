import json

import pytest

from tidewell.operators import packed

CASES = [
    (["Ada B. Lovelace, Alan Turing and Grace Hopper"], ["Ada B. Lovelace", "Alan Turing", "Grace Hopper"]),
    (["by Ann Lee, and Bo Li"], ["Ann Lee", "Bo Li"]),
    (["BY: Ann Lee"], ["Ann Lee"]),
    (["Byron Smith"], ["Byron Smith"]),
    (["Doe, Jane; Roe, R. P."], ["Doe, Jane", "Roe, R. P."]),
    (["Doe, Jane, Roe, Rick"], ["Doe, Jane", "Roe, Rick"]),
    (["Max Roe, Jr., Ann Lee, III"], ["Max Roe, Jr.", "Ann Lee, III"]),
    (['"Institute for A, B and C", Ann Lee'], ["Institute for A, B and C", "Ann Lee"]),
    (['"Ann ""Bo"" Lee", "Cy Dee"'], ['Ann "Bo" Lee', "Cy Dee"]),
    (["'Roe, Max';'O'Neil, Pat'"], ["Roe, Max", "O'Neil, Pat"]),
    (['Ann "Bo, Mo" Lee, Cy Dee'], ['Ann "Bo', 'Mo" Lee', "Cy Dee"]),
    (["Ann Lee (Uni A, City), Bo Li (Lab & Co)"], ["Ann Lee (Uni A, City)", "Bo Li (Lab & Co)"]),
    (["Ann Lee，Bo Li、Cy Dee；Di Eck"], ["Ann Lee", "Bo Li", "Cy Dee", "Di Eck"]),
    (["Ann Lee | Bo Li • Cy Dee\tDi Eck\r\nEd Fox"], ["Ann Lee", "Bo Li", "Cy Dee", "Di Eck", "Ed Fox"]),
    (["Ann Lee / Bo Li &amp; Cy/Dee Co & Al Bee"], ["Ann Lee", "Bo Li", "Cy/Dee Co", "Al Bee"]),
    (["Sandra Anderson and Andy Brand"], ["Sandra Anderson", "Andy Brand"]),
    (["Ann  Lee,, ; ", "", " "], ["Ann Lee"]),
    (["Ann Lee", "Bo Li and Cy Dee"], ["Ann Lee", "Bo Li", "Cy Dee"]),
    (["Cher"], ["Cher"]),
    (["by", ", ;"], []),
]


def _split(spark, values):
    rows = spark.createDataFrame([(n, v, "clash") for n, v in enumerate(values)], "rec bigint, packed array<string>, pos string")
    out = {}
    for r in packed.split_packed(rows, ["rec"], "packed").orderBy("rec", "pos").collect():
        out.setdefault(r.rec, []).append((r.pos, r.author_name))
    return out


def test_rules(spark):
    got = _split(spark, [c[0] for c in CASES])
    for n, (value, names) in enumerate(CASES):
        assert got.get(n, []) == list(enumerate(names, 1)), value


def test_shuffle_join_gives_the_same_as_broadcast(spark):
    rows = spark.createDataFrame([(n, c[0]) for n, c in enumerate(CASES * 3)], "rec bigint, packed array<string>")
    want = sorted(packed.split_packed(rows, ["rec"], "packed").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(packed.split_packed(rows, ["rec"], "packed").collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nulls_long_texts_repeats_and_empty_tables(spark):
    many = "; ".join(f"Ann Lee{n}" for n in range(20_000))
    got = _split(spark, [None, [None], [many], ["Ann Lee"], ["Ann Lee"]])
    assert set(got) == {2, 3, 4} and len(got[2]) == 20_000 and got[2][-1] == (20_000, "Ann Lee19999")
    assert _split(spark, [])  == {}


def test_fields_of_documents(spark):
    payloads = [{"authors": "A B, C D"}, {"author_list": ["A B", None, "C D and E F"]}, {"author_names": '["A B", "C \\"x\\" D"]'}, {"authors": None}, {"other": 1}]
    pwc = spark.createDataFrame([(n, json.dumps(p)) for n, p in enumerate(payloads)] + [(9, '{"authors": "A'), (10, None)], "record_no bigint, payload string")
    nodes = [{"author": {"@type": "Person", "name": "A B"}}, {"author": ["A B", {"name": "C D"}, {"@type": "Person"}, None, 5]}, {"author": {}}]
    ld = spark.createDataFrame([(n, json.dumps(p)) for n, p in enumerate(nodes)], "node_id bigint, node string")
    got = {(r.rec_table, r.rec_id): r.packed for r in packed.author_fields(pwc, ld).collect()}
    assert got == {("pwc_raw", 0): ["A B, C D"], ("pwc_raw", 1): ["A B", "C D and E F"], ("pwc_raw", 2): ["A B", 'C "x" D'], ("jsonld_nodes", 0): ["A B"], ("jsonld_nodes", 1): ["A B", "C D"]}


@pytest.mark.parametrize("code,want", [("W", [(0, 1, "")]), ("w, W", [(0, 4, "")]), ('"W,W",W', [(1, 3, '"'), (6, 1, "")]), ("(W,W", [(0, 2, ""), (3, 1, "")]), ("", [])])
def test_divide(code, want):
    assert packed.divide(code) == want
