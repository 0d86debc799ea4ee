"""Wavelet shards: exact round trip, access, rank and select against plain arrays."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marisma.llm import wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (700, 2), (5000, 40), (3000, 49000)])
def test_matrix(n, top):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % top).astype(np.uint16)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert np.array_equal(m.all(), ids)
    if n:
        places = r.integers(0, n, 60)
        assert np.array_equal(m.access(places), ids[places])
    for token in {*ids[:20].tolist(), 65000}:
        at = np.flatnonzero(ids == token)
        assert m.rank(token) == len(at) and m.rank(token, n // 2) == np.count_nonzero(ids[: n // 2] == token)
        assert np.array_equal(m.occurrences(token), at)
        for k in {0, len(at) // 2, len(at) - 1} & set(range(len(at))):
            assert m.select(token, k) == at[k]
    with pytest.raises(IndexError):
        m.select(65000, 0)


def test_table(spark, tmp_path):
    texts = ["Hello wörld, it's FINE", None, "", " a \t b\x0b", "x<|endoftext|>y <|startoftext|> z", "H̱ ẖ É é", "word " * 3000, "dup", "dup", "ﬀ  x"]
    rows = [(7 * i % 11, t, i) for i, t in enumerate(texts)] + [(None, "none", 0), (3, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    wavelet.write_shards(df, f"file://{tmp_path}/s", shard_tokens=50)
    got = wavelet.read_documents(spark, f"file://{tmp_path}/s").collect()
    t = Tokenizer.from_file(PATH)
    want = sorted((i if i is not None else -1, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, x, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, zlib.crc32(bytes(r.ids))) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(x[0] for x in want)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    wavelet.write_shards(df, f"file://{tmp_path}/e")
    assert wavelet.read_documents(spark, f"file://{tmp_path}/e").count() == 0
