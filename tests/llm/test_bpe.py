import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import bpe


@pytest.fixture(scope="module")
def library():
    with open(bpe.rank_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sstmdrevl  \n\t19.,!é中　\x85\x1c½²"), max_size=60), max_size=8))
def test_as_the_library(texts):
    with open(bpe.rank_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.coder(bpe.rank_file())
    ids, at = coder.encode([t.encode() for t in texts])
    assert ids == [own.encode_ordinary(t) for t in texts]
    assert [coder.decode(x) for x in ids] == [t.encode() for t in texts]
    assert all(list(a) == sorted(set(a)) for a in at)


def test_long_pieces(library):
    coder = bpe.coder(bpe.rank_file())
    for text in ("ab" * 4000, "!" * 3000, " " * 2000 + "x", "'s" * 500):
        assert coder.encode([text.encode()])[0][0] == library.encode_ordinary(text)


def test_query_rows(spark, library):
    texts = [None, "", "It's here.", "It's here.", "x" * 5000 + "\n\n", "naïve — 12 ½"]
    df = spark.createDataFrame([(i if i != 2 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.round_trip(df, bpe.rank_file()).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        r = got[(i if i != 2 else None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), bpe.rank_file()).count() == 0
