import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from onoma.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = tokenizers.Tokenizer.from_file(PATH)
LIB.no_truncation(), LIB.no_padding()
CODEC = bpe.BytePairCodec(PATH)

CASES = [
    "", " ", "  a", "a  b   c\n\n d\t", "don't we'll I'm they've 'S 'T", "Éçeau aianre leèvi ñ ß ü", "日本語テキスト", "🙂👍🏽 é",
    "<|endoftext|>", "a<|endoftext|>  b <|endoftext|>", "<|endoftext|", "12,345.67 ² ½ Ⅷ", "x" * 5000, "ab" * 3000 + " !!" * 500,
    " ", "a\x85b\x1cc c​d﻿e", "\r\n\r\n", "é́́", "_ _a __", "\x00\x01", "A|B | C", "### $$$&&&%%%",
]


def same(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    got = CODEC.encode(text)
    assert got == want, text
    assert CODEC.decode(got) == LIB.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_matches_library(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_matches_library_on_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text("etaoinhs r'", max_size=400))
def test_matches_library_on_letters(text):
    same(text)


@given(st.text("abcdeth", min_size=2, max_size=300))
def test_heap_and_array_agree(text):
    parts = [CODEC.byte_id[b] for b in text.encode()]
    assert CODEC._merge_heap(list(parts)) == CODEC._merge_array(list(parts))


def test_cache_is_bounded():
    small = bpe.BytePairCodec(PATH, cache_words=5)
    for n in range(50):
        assert small.encode(f" word{n}") == CODEC.encode(f" word{n}")
    assert len(small.cache) <= 5


def test_documents(spark):
    rows = [(1, "hello there", "x"), (1, "hello there", "x"), (None, None, None), (3, "", "z"), (4, "é" * 4000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode_documents(bpe.encode_documents(docs)).collect()
    assert sorted(r["decoded"] for r in out) == sorted(t or "" for _, t, _ in rows)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip_digests(docs).collect()}
    for d, t, _ in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        sha = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert (d, len(ids), sha, hashlib.sha256((t or "").encode()).hexdigest()) in got
    assert bpe.round_trip_digests(docs.limit(0)).count() == 0
