"""Tree encoding equals tiktoken's, decoding is its inverse, and counts equal the tokenizers library's."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quernstone.llm import bpe, token_count

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n  x", "a" * 30_000, " " * 5_000, "ab " * 9_000, "漢字" * 700, "😀‍😀", "<|endoftext|>", "it's  we'll\t\r\n", "\x1c\x85\xa0x", "same", "same"]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def small():
    return bpe.TreeCodec(bpe.read_ranks(RANKS), P.PATTERN, leaf=4, window=1)


@pytest.fixture(scope="module")
def counter():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return token_count.PairCounter(f.read(), P.PATTERN)


PIECES = st.lists(st.sampled_from(["a", "B", " ", "\n", "\t", "1", "'s", "'", "é", "!", "　", "\x1c", "\x85", "漢", "  ", "\r", "😀", "ing", " the"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=60)))
def test_tree_equals_whole(plain, small, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = small.encode(text)
    assert ids.tolist() == plain.encode_ordinary(text)
    assert small.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=60)))
def test_count_equals_library(counter, text):
    text = text.encode("utf-8", "ignore").decode() + "<|endoftext|>x"
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_join_is_associative(small):
    text = "One  two three,\n four's five 123 six  seven"
    parts = [(0, 9), (9, 21), (21, len(text))]
    whole = [small._tree(text, a, b) for a, b in parts]
    left = small._join(text, 0, 21, len(text), small._join(text, 0, 9, 21, whole[0], whole[1]), whole[2])
    right = small._join(text, 0, 9, len(text), whole[0], small._join(text, 9, 21, len(text), whole[1], whole[2]))
    assert np.concatenate(left).tolist() == np.concatenate(right).tolist()


def test_encode_and_decode_tables(spark, plain):
    df = spark.createDataFrame([(i, t, "kept", -1) for i, t in enumerate(ODD)], "doc_id long, text string, extra string, n_tokens int")
    out = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(out) == len(ODD)
    for r in out:
        t = ODD[r.doc_id] or ""
        want = np.array(plain.encode_ordinary(t), "<u4").tobytes()
        assert (hashlib.sha256(bytes(r.ids)).hexdigest(), bytes(r.decoded), r.n_tokens, r.extra) == (hashlib.sha256(want).hexdigest(), t.encode(), len(want) // 4, "kept")
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_count_table(spark):
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(ODD)], "doc_id long, text string, over_limit boolean")
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in token_count.count_tokens(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect():
        t = ODD[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
    assert token_count.count_tokens(df.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_forgetting_counter_counts_the_same(counter):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        forgetful = token_count.PairCounter(f.read(), P.PATTERN, remembered=3)
    for t in ("one two three four five six one two", "x y z w v u x y z"):
        assert forgetful.count(t) == counter.count(t)
