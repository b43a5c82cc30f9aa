import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm.bpe import VOCABULARY, PATTERN, Encoder, decode, encode_documents, merge_long, merge_short, token_counts
from fieldloom.plans.scale import table

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def both():
    tiktoken = pytest.importorskip("tiktoken")
    own = Encoder()
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=300))
def test_any_text(both, text):
    own, other = both
    assert own.encode(text) == other.encode_ordinary(text)
    assert decode(own.encode(text), own.ranks) == text.encode("utf-8", "replace")


@settings(max_examples=100, deadline=None)
@given(word=st.text("abcdeilnorst' é", min_size=1, max_size=250))
def test_both_merges_agree(both, word):
    raw = word.encode()
    assert merge_short(raw, both[0].ranks) == merge_long(raw, both[0].ranks)


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a" * 20_000, "é" * 3000, "it's  we'LL\n\n\tx ", "नमी का मान", "海面水温", "\x00�", "1" * 500])
def test_odd_texts(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_documents(spark, both):
    rows = [(1, "Hello world", "x", 9), (2, None, "x", 9), (3, "", None, 9), (1, "Hello world", "x", 9), (4, "<|endoftext|>", "x", 9), (None, "a", "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, ids int")
    got = encode_documents(df).collect()
    assert len(got) == 6 and {r.doc_id: r.ids for r in got if r.doc_id} == {1: both[1].encode_ordinary("Hello world"), 2: [], 3: [], 4: both[1].encode_ordinary("<|endoftext|>")}
    assert encode_documents(df.limit(0)).count() == 0 and encode_documents(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert {r.source: (r.n_documents, r.n_tokens) for r in token_counts(df).collect()}["x"][0] == 5


def test_table(spark, data, both):
    docs = table(spark, data, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in encode_documents(docs).collect():
        assert r.ids == (both[1].encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])
