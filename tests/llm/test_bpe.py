import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import bpe

FILE = os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary here")


@pytest.fixture(scope="module")
def pair():
    data = open(FILE, "rb").read()
    ranks = bpe.read_ranks(data)
    return bpe.Encoder(data), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_fixed_texts(pair):
    ours, theirs = pair
    for t in ("", " ", "hello world", "x<|endoftext|>y", "\r\n\t  a", "it's 2024's", "日本語 текст ελληνικά 👍🏽", "-" * 5000, "ab" * 3000, " ​", "áé"):
        assert ours.encode(t) == theirs.encode_ordinary(t)
    assert ours.encode(None) == []


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_text(t):
    data = open(FILE, "rb").read()
    global _PAIR
    if "_PAIR" not in globals():
        _PAIR = (bpe.Encoder(data), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={}))
    assert _PAIR[0].encode(t) == _PAIR[1].encode_ordinary(t)


@given(st.binary(min_size=2, max_size=200))
@settings(max_examples=100, deadline=None)
def test_queue_gives_ranks_in_order(b):
    q = bpe.RankQueue()
    items = sorted((x * 37 % 5000 + x * 64, i) for i, x in enumerate(b))
    for r, i in sorted(items, key=lambda p: hash(p)):
        q.push(r, i)
    assert [q.pop() for _ in items] == items and q.pop() is None


def test_very_long_pre_token_is_fast(pair):
    import time

    t = time.time()
    assert len(pair[0].encode("=" * 300_000)) > 0
    assert time.time() - t < 30


def test_table(spark):
    df = spark.createDataFrame([(1, "hello"), (2, None), (3, ""), (4, "a b" * 10)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "text", bpe.vocabulary(spark)).collect()}
    assert got[2] == [] and got[3] == [] and got[1] == [31373]
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, "text", bpe.vocabulary(spark)).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
