"""Byte-level BPE against the public library, and its round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from spanforge.llm import byte_bpe
from spanforge.llm.byte_bpe import bpe, decode_ids, encode_documents, read_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", "Hello  world's 123 tokens\n\n  x", "日本語のテキスト " * 40, "a" * 3000, "ab" * 2000, " " * 500, "<|endoftext|> ok", "x\x00y퟿", "🙂" * 90, "zqxj" * 60, "I'LL we'll  \t\n tabs",
]


@pytest.fixture(scope="module")
def coder():
    return bpe(read_vocabulary(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_same_as_library(coder, library):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdefgh ïß\n19.,'") for _ in range(rng.randrange(400))) for _ in range(200)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_long_pieces_and_matrices_agree(coder, library):
    for piece in ("b" * 257, "lorem" * 100, "".join(random.Random(3).choice("etaoin") for _ in range(5000))):
        assert np.frombuffer(coder._long(piece.encode()), "<u4").tolist() == library.encode_ordinary(piece)


def test_cache_is_bounded(coder, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 50)
    coder.cache.clear()
    before = coder.encode(["one two three"])
    for i in range(20):
        coder.encode([" ".join(f"w{i}x{j}" for j in range(40))])
        assert len(coder.cache) <= 50
    assert coder.encode(["one two three"]) == before


def test_columns(spark, library):
    rows = [(i, t, "clash", b"z") for i, t in enumerate(TEXTS)] + [(None, None, "c", None), (0, "", "c", None), (0, "", "c", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string, ids binary")
    got = decode_ids(encode_documents(df, PATH, public_tokenizers.PATTERN), PATH)
    assert sorted(got.columns) == ["decoded", "doc_id", "ids", "text"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
    assert encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
