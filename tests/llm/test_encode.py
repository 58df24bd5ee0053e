import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import encode

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="the vocabulary files are not here")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = encode.read_ranks(PATH)
    return encode.PrefixEncoder(ranks), tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(encoder, text):
    from array import array

    out = array("i")
    encoder.encode(text, out)
    return list(out)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abeinrst '\n0.", max_size=80), st.text(alphabet="ao ", max_size=60)))
def test_same_as_merging(both, text):
    assert ids_of(both[0], text) == both[1].encode_ordinary(text)


def test_special_strings_long_runs_and_round_trip(both):
    for text in ["<|endoftext|>", "a" * 30_000, " " * 5_000 + "x", "🙂é漢字\x00​" * 50, "𝓊́"]:
        ids = ids_of(both[0], text)
        assert ids == both[1].encode_ordinary(text)
        tokens = {v: k for k, v in both[0].ranks.items()}
        assert b"".join(tokens[i] for i in ids).decode() == text


def test_small_memory_gives_the_same(both):
    small = encode.PrefixEncoder(both[0].ranks, remember=5)
    text = "The quick brown foxes jumped over thirteen lazy dogs, unbelievably.\n" * 3
    assert ids_of(small, text) == both[1].encode_ordinary(text)


def test_corpus(spark, both):
    docs = spark.createDataFrame([(1, "Hello world", "c"), (2, "", "c"), (3, None, "c"), (1, "Hello world", "c")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode.encode_corpus(docs, PATH).collect())
    hello = both[1].encode_ordinary("Hello world")
    assert got == [(1, hello), (1, hello), (2, []), (3, [])]
    assert encode.encode_corpus(docs.limit(0), PATH).count() == 0


def test_rank_file(tmp_path):
    (tmp_path / "r").write_bytes(base64.b64encode(b"ab") + b" 7\n")
    assert encode.read_ranks(str(tmp_path / "r")) == {b"ab": 7}
