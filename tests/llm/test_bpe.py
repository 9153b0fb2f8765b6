"""Ids and texts against the tokenizers library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logsift.llm import bpe
from logsift.llm.registry import op3_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "'", "s", "l", "ll", " ", "  ", "\n", "\n\n", "\t", " ", "　", "é", "字", "1", "²", "!", "?!",
    "<|endoftext|>", "<|", "|>", "\x85", "\x1c", "😀", "the", "ing", " t", "\r\n", "'re", "​", "aaaaaaaaaaaaaaa",
    "          ", " word", "\n\n\n\n\n\n\n\n\n", "abababababababababab", "字字字字字字字字字字字", "_", ".\n", " of the",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [4, 8, 16, 64])
def test_tree_equals_library(library, leaf, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 2)
    codec, draw = bpe.codec(PATH), random.Random(leaf)
    for _ in range(3000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 60)))
        assert codec.encode(text, leaf).tolist() == library(text), repr(text)
        parts = codec.parts(text, leaf)
        assert "".join(parts) == text
        assert [i for p in parts for i in codec.encode(p, leaf).tolist()] == library(text), repr(text)
        assert codec.decode(codec.encode(text)) == text


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 50_000, "ab " * 40_000, "!" * 30_000, "中" * 30_000, "\n" * 30_000 + "x"])
def test_unsplit_texts(library, text):
    assert bpe.codec(PATH).encode(text).tolist() == library(text)


def test_single_words_join(library, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 1)
    codec, draw = bpe.codec(PATH), random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice("abcdeinthorsé") for _ in range(draw.randint(1, 80)))
        assert codec._word(text.encode(), 5).tolist() == library(text), text


def test_invalid_ids_decode_with_replacement():
    codec = bpe.codec(PATH)
    assert codec.decode(codec.encode("é")[:0]) == ""
    half = np.array([next(i for i, b in codec.bytes_of.items() if b == b"\xc3")], "<u4")
    assert codec.decode(half) == "�"


def test_rows(spark, library):
    long = "The first words of it, and on. " * 300
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, long), (5, long), (5, long), (5, long + "x"), (6, "x" * 3000)]
    df = spark.createDataFrame([(a, b, "k", b"i") for a, b in rows], "doc_id long, text string, key string, ids binary")
    out = bpe.decode(bpe.encode(df, PATH, leaf=64, spread=1000), PATH).collect()
    got = sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in out)
    assert got == sorted((repr(a), library(b or ""), b or "") for a, b in rows)
    assert bpe.encode(df.limit(0), PATH).count() == 0
    once = bpe.encode(df, PATH, leaf=64, spread=1000, decoded="back").collect()
    assert sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.back) for r in once) == got


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for r in op3_bpe(spark, folder).collect():
        ids = library(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(want[r.doc_id].encode())


def test_every_kind_of_character(library):
    """The faster library's split into words agrees with the other's, character by character."""
    codec = bpe.codec(PATH)
    for code in [*range(0xD800), *range(0xE000, 0x1F000, 3), *range(0x1F000, 0x20000), *range(0x20000, 0x110000, 997)]:
        c = chr(code)
        text = f"a{c}b {c}{c} 1{c}2  {c} !{c}?{c}"
        assert codec.encode(text).tolist() == library(text), hex(code)
