import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
T = Tokenizer.from_file(PATH)
B = bpe.Bpe(open(PATH, "rb").read())


def ids(b):
    return list(struct.unpack(f"<{len(b) // 4}I", b))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("aehtinos '.\n\t<|endoftext|>", max_size=200)), max_size=5))
def test_as_library(texts):
    for t, got in zip(texts, B.encode(texts), strict=True):
        want = T.encode(t, add_special_tokens=False).ids
        assert ids(got) == want
        assert B.decode(got) == T.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("t", ["", "a" * 5000, "ab" * 3000, "th" * 21, "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "é" * 100, "日本語" * 50, " " * 300 + "x", "it's we'll 'tis 2024!!", "\0added\0<|endoftext|>", "‍👩‍👩‍👧 ½ Ⅷ"])
def test_cases(t):
    want = T.encode(t, add_special_tokens=False).ids
    assert ids(B.encode([t])[0]) == want


def test_query(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "hello <|endoftext|>", "x"), (None, "a", "x")]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert len(got) == 5
    for (d, t, _), r in zip(rows, got, strict=True):
        want = T.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (d, len(want))
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    back = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"))).collect()
    assert [r.decoded for r in back] == [t or "" for _, t, _ in rows]
