"""Tree reduction against the library's own encoding."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from marisma.llm import bpe_tree

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return bpe_tree.TreeBpe(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(5)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "\r\n", "'s", "'ll", "é", "ß", "漢", "1", "23", "!?", " ", " ", "😀", "é", "Th"]
    for n in (0, 1, 3, 40, 300, 2500):
        for _ in range(12):
            yield "".join(r.choice(alphabet) for _ in range(n))
    odd = ["x", "!", " ", "\x1c", "\x1f", "\x85", "\u2028", "\u3000", "\n", "\t", "7"]
    for _ in range(30):
        yield "".join(r.choice(odd) for _ in range(200))
    yield "x" * 9000
    yield " " * 9000 + "a"
    yield "ab" * 7000 + " tail"
    yield "word " * 3000
    yield "漢字" * 4000
    yield "".join(r.choice("abcdefgh") for _ in range(12000))
    yield "a b " * 1200 + "z" * 6000 + " c d" * 1200


@pytest.mark.parametrize("leaf_chars,leaf_bytes", [(4096, 96), (16, 4), (64, 8)])
def test_same_as_library(bpe, library, monkeypatch, leaf_chars, leaf_bytes):
    monkeypatch.setattr(bpe_tree, "LEAF_CHARS", leaf_chars)
    monkeypatch.setattr(bpe_tree, "LEAF_BYTES", leaf_bytes)
    for text in texts():
        ids = bpe.encode(text)
        assert ids == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_long_piece(bpe, library, monkeypatch):
    monkeypatch.setattr(bpe_tree, "LEAF_BYTES", 5)
    r = random.Random(9)
    for _ in range(60):
        raw = "".join(r.choice(["in", "the", "er", "a", "s", "t", "ou", "q"]) for _ in range(r.randint(1, 120)))
        assert bpe.piece(raw.encode()) == library.encode_ordinary(raw)


def test_table(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", None), (None, "a  b\n", "y"), (1, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe_tree.encode_documents(df).collect()
    assert len(got) == 5
    for (_, text, _), row in zip(rows, got, strict=True):
        ids = library.encode_ordinary(text or "")
        assert row.n_tokens == len(ids) and bytes(row.ids) == np.array(ids, "<u4").tobytes()
        assert hashlib.sha256(bytes(row.decoded)).digest() == hashlib.sha256((text or "").encode()).digest()
    assert bpe_tree.encode_documents(df.limit(0)).count() == 0
