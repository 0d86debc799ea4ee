"""SimHash fingerprints and components against plain loops."""

import os
import re

import numpy as np
import pytest
import xxhash

from marisma.llm import queries, simhash

FOLDER = "/root/testdata/sf0.001"


def plain_print(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits):
    """Smallest id of each row's component; ids and prints."""
    codes = sorted({p for _, p in rows})
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    array = np.array(codes, np.uint64)
    for i, c in enumerate(codes):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= bits):
            x, y = find(c), find(codes[i + 1 + j])
            root[max(x, y)] = min(x, y)
    least = {}
    for i, p in rows:
        c = find(p)
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return [least[find(p)] for _, p in rows]


def some_codes(r, count):
    """Codes in chains and crowds, and far ones."""
    codes = [int(x) for x in r.integers(0, 1 << 63, count, dtype=np.uint64) * 2 + r.integers(0, 2, count, dtype=np.uint64)]
    while len(codes) < 5 * count:
        base = codes[int(r.integers(count))] if r.random() < 0.5 else codes[-1]
        for b in r.integers(0, 64, int(r.integers(0, 7))):
            base ^= 1 << int(b)
        codes.append(base)
    return codes


def test_fingerprints(spark):
    texts = [None, "", " \n\x0b", "One", "one two THREE", "one  two\tthree\x0cfour", "one two three four five", "É É é é A", "x " * 70_000, *[" ".join(f"w{k}" for k in np.random.default_rng(i).integers(0, 50, 30 * i)) for i in range(20)]]
    rows = [(i, t, "z", 5) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, component_id int")
    got = {r.doc_id: r for r in simhash.near_duplicates(table).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{plain_print(t):016x}" for i, t in enumerate(texts)}
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0
    assert simhash.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("bits,crowd,block", [(4, 2048, 1 << 16), (4, 0, 1 << 16), (4, 2048, 5), (2, 0, 3), (0, 2048, 1 << 16)])
def test_components(spark, monkeypatch, bits, crowd, block):
    """With longer masks, blocks of few codes and small pieces of work also."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(simhash, "SLOT", 500)
    r = np.random.default_rng(bits + block)
    codes = some_codes(r, 60)
    rows = [(int(i) if i % 11 else None, c) for i, c in zip(r.permutation(len(codes)), codes, strict=True)] + [(9000, codes[0]), (9000, codes[0])]
    table = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for i, c in rows], "doc_id bigint, fingerprint bigint")
    got = simhash.near_components(table, bits).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(((i, c, k) for (i, c), k in zip(rows, plain_components(rows, bits), strict=True)), key=key)
    assert sorted(((x.doc_id, x.fingerprint % (1 << 64), x.component_id) for x in got), key=key) == want


def test_masks():
    """Codes with as many differing bits as allowed agree on a mask, however the bits lie."""
    r = np.random.default_rng(1)
    for n, bits in ((10, 4), (1 << 30, 4), (1 << 40, 3), (10, 0)):
        masks = simhash.combinations_of(n, bits)
        for _ in range(300):
            off = sum(1 << int(b) for b in r.choice(64, bits, replace=False))
            assert any(not off & m for m in masks)


def test_index(monkeypatch):
    """Every near pair is connected, also where work is cut into small pieces; each code's own bits and those above it are all 64."""
    monkeypatch.setattr(simhash, "FRONT", 50)
    r = np.random.default_rng(3)
    codes = np.unique(np.array(some_codes(r, 400), np.uint64))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    index = simhash.GrayIndex(codes, np.zeros(len(codes), np.int64), 4)
    a, b = index.links()
    assert (np.bitwise_count(codes[a] ^ codes[b]) <= 4).all()
    root = np.arange(len(codes))
    for x, y in zip(a, b, strict=True):
        root[root == root[x]] = root[y]
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
    assert all(root[i] == root[j] for i, j in zip(*np.nonzero(near), strict=True))
    node, bits = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    for i, level in enumerate(index.levels):
        bits += np.bitwise_count(level[1][node])
        if i + 1 < len(index.levels):
            node = np.searchsorted(index.levels[i + 1][5], node, side="right") - 1
    assert (bits == 64).all()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
def test_query(spark):
    rows = [(r.doc_id, plain_print(r.text)) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = queries.op12_simhash(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{p:016x}", k) for (i, p), k in zip(rows, plain_components(rows, 4), strict=True))


def test_gray_rank():
    codes = np.arange(256, dtype=np.uint64)
    codes ^= codes >> np.uint64(1)
    assert (simhash.gray_rank(codes) == np.arange(256)).all()
