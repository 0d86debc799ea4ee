"""The trie of rebuilt conversations against plain dictionaries."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marisma.llm import prefix_trie, queries

TURNS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    said = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c in sorted(said):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(said.get(c - c % 100, [])[:h] + said[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def found(table):
    c = F.col("conv_id")
    trie = prefix_trie.prefix_trie(table, c - c % 100, F.crc32(c.cast("string")) % 6)
    out = trie.nodes.join(prefix_trie.ends_digests(trie.ends), prefix_trie.NODE, "left")
    out = out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).collect()
    return sorted(tuple(-1 if r[k] is None else r[k] for k in COLUMNS) for r in out)


def conversations(seed):
    r = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 12), *range(100, 125), 199, *range(301, 320), 400, 455]:
        for t in range(int(r.integers(1, 8))):
            rows.append((c, t if r.random() < 0.9 else None, ["user", "assistant", None][t % 3], f"t{r.integers(3)}" * int(r.integers(1, 3))))
    rows += [(100, t, "user", f"long {t % 4}") for t in range(40)] + [(120, t, "user", f"long {t % 4}") for t in range(37)]
    rows += [(7, 1, "user", "twice")] * 2 + [(None, 1, "user", "no one's"), (8, None, None, None), (9, 3, "é", "ß漢😀")]
    return rows


@pytest.mark.parametrize("primes,block,chain,piece", [(None, 1 << 16, 4096, 1 << 16), ((101, 2**127 - 1), 3, 4, 4)])
def test_against_dictionaries(spark, monkeypatch, primes, block, chain, piece):
    """Also with fingerprints that unlike sequences share, small blocks, windows and pieces."""
    if primes:
        for name, value in (("PRIMES", primes), ("BLOCK", block), ("CHAIN", chain), ("PIECE", piece)):
            monkeypatch.setattr(prefix_trie, name, value)
    rows = conversations(11)
    table = spark.createDataFrame([(*x, 5, "z") for x in rows], TURNS + ", depth int, part string")
    assert found(table) == plain(rows)


def test_long_conversation(spark):
    """Most rows are of one conversation, so that it lies in several tasks; its copy has the same turns."""
    rows = [(100, t, "user", f"turn {t}") for t in range(900)] + [(101, t, "user", f"turn {t}") for t in range(900)] + [(c, t, "user", f"turn {t}" if t < 3 else f"own {c}") for c in range(102, 130) for t in range(5)]
    table = spark.createDataFrame(rows, TURNS).repartition(4)
    assert found(table) == plain(rows)


def test_references(spark):
    """A node's reference is a stored turn with the node's last role and text."""
    rows = conversations(4)
    c = F.col("conv_id")
    trie = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), c - c % 100, F.lit(2))
    turns = {(x.conv_id, x.pos): (x.role, x.text) for x in trie.turns.collect()}
    assert all((x.ref_conv, x.ref_pos) in turns for x in trie.nodes.collect() if x.depth)
    assert trie.ends.count() == len({x[0] for x in rows} - {None})


def test_awkward(spark):
    table = spark.createDataFrame([], TURNS)
    assert found(table) == []
    one = [(7, None, None, None)]
    assert found(spark.createDataFrame(one, TURNS)) == plain(one)
    trie = prefix_trie.prefix_trie(spark.createDataFrame([(1, 0, "a", "b"), (2, 0, "a", "b")], TURNS), F.lit(None), F.lit(None))
    assert sorted((x.depth, x.conv_id, x.n_convs) for x in trie.nodes.collect()) == [(0, 1, 2), (1, 1, 2)]


def test_running(spark):
    r = np.random.default_rng(2)
    rows = [(k, i, int(v)) for k in range(3) for i, v in enumerate(r.integers(0, 9, 50 * (k + 1)))]
    keep, prefix_trie.CHAIN = prefix_trie.CHAIN, 4
    try:
        got = prefix_trie.running(spark.createDataFrame(rows, "k int, i bigint, v bigint"), "k", "i", ["v"], 149).collect()
    finally:
        prefix_trie.CHAIN = keep
    assert all(x.before_v == sum(v for k, i, v in rows if k == x.k and i < x.i) for x in got) and len(got) == len(rows)


def test_query(spark):
    got = queries.op11_prefix_trie(spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(-1 if r[k] is None else r[k] for k in COLUMNS) for r in got) == plain(rows)
