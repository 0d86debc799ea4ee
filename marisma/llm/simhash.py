"""SimHash fingerprints, and their components under small Hamming distances by a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.llm import bytetext
from marisma.llm.components import components
from marisma.llm.scratch import keep
from marisma.session import ship

BLOCK_BYTES = 1 << 20
SEED = 42
#: Shingles that are hashed together.
PIECE = 1 << 16
#: Fingerprints of a bucket that are indexed together; a larger bucket is cut into blocks that meet each other in pairs.
BLOCK_MEMBERS = 1 << 16
#: Fingerprints of a bucket, on the average over all possible buckets, beyond which buckets are told apart by more bits.
CROWD = 2048
#: Rows of buckets in one group of a task, about.
SLOT = 100_000
#: Children of a node of the index; pairs of query and node that are looked at together.
FAN = 8
FRONT = 1 << 20


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the lowest."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    # sums of 255 bits fit in a byte
    return bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)


def fingerprint(low: np.ndarray, size: int) -> int:
    """Fingerprint of a text of lower-cased UTF-8 bytes."""
    space = bytetext.SPACE[low]
    solid = ~space
    # one space stands between words, none at the ends
    stays = solid.copy()
    stays[1:] |= solid[:-1]
    raw = np.where(space, np.uint8(32), low)[stays].tobytes().rstrip(b" ")
    if not raw:
        return 0
    gap = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    start, end = np.r_[0, gap + 1], np.r_[gap, len(raw)]
    if len(start) >= size:
        start, end = start[: len(start) - size + 1], end[size - 1 :]
    else:
        start, end = start[:1], end[-1:]
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(start), PIECE):
        part = slice(i, i + PIECE)
        votes += _votes(np.array([digest(raw[s:e], SEED) for s, e in zip(start[part].tolist(), end[part].tolist(), strict=True)], "<u8"))
    return int(np.packbits(2 * votes > len(start), bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id (as long) and fingerprint (64 bits as long) of every text.

    Words are runs outside [\\x20\\x09-\\x0D], A-Z lower-cased; a text's features are its shingles of `size` words with repeats,
    joined by spaces, the whole sequence where it has fewer words. A bit is set if more than half of the features' XXH64 have it. A text
    without words, a null one too, has fingerprint 0. Texts are hashed in pieces, so a task holds one block of texts, or one longer text.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytetext.column(batch.column(1))
            for i, j in bytetext.blocks(offsets, BLOCK_BYTES):
                low = bytetext.LOWER[data[offsets[i] : offsets[j]]]
                own = offsets[i : j + 1] - offsets[i]
                marks = np.array([fingerprint(low[a:b], size) for a, b in zip(own[:-1], own[1:], strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(marks.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(bytetext.tidy(run), "doc_id bigint, fingerprint bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, where neighbours differ in one bit."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Codes of many buckets, each bucket a tree over its codes in Gray order.

    A node stands for FAN neighbours of the level below. It knows the bits that all its codes share; those of
    them that its parent doesn't hold already are its own. Going down, a query adds up its differences to the own
    bits of the nodes it passes, and leaves a node, and with it all codes below, once they are too many. The own bits on a path from a top to a
    code are the whole code, so what has been added up at a code is its distance.
    """

    def __init__(self, codes: np.ndarray, bucket: np.ndarray, bits: int):
        """bucket: ascending numbers from 0; codes of a bucket in Gray order."""
        n, self.codes, self.bits = len(codes), codes, bits
        # neighbours that are near are connected already
        near = (np.bitwise_count(codes[1:] ^ codes[:-1]) <= bits) & (bucket[1:] == bucket[:-1])
        self.label = np.r_[0, np.cumsum(~near)] if n else np.zeros(0, np.int64)
        self.chained = np.flatnonzero(near)
        both, some, owner, begin = codes, codes, bucket, np.arange(n)
        label_low, label_high = self.label, self.label
        self.levels = [(codes, np.full(n, ~np.uint64(0)), begin + 1, label_low, label_high, begin)]
        while len(owner) and (owner[1:] == owner[:-1]).any():
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            begin = np.flatnonzero(place % FAN == 0)
            both, some, owner = np.bitwise_and.reduceat(both, begin), np.bitwise_or.reduceat(some, begin), owner[begin]
            last = np.r_[begin[1:], len(place)]
            label_low, label_high = np.minimum.reduceat(label_low, begin), np.maximum.reduceat(label_high, begin)
            self.levels.append((both, ~(both ^ some), self.levels[-1][2][last - 1], label_low, label_high, begin))
        # shared bits move up to the highest node that has them
        for i in range(len(self.levels) - 1):
            pattern, mask, last, low, high, begin = self.levels[i]
            above, first = self.levels[i + 1][1], self.levels[i + 1][5]
            parent = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(pattern)]))
            self.levels[i] = (pattern, mask & ~above[parent], last, low, high, begin)
        self.top = np.searchsorted(owner, bucket)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs of near codes: enough of them for the components of each bucket."""
        n = len(self.codes)
        out = [np.stack([self.chained, self.chained + 1])]
        work = [(len(self.levels) - 1, np.arange(n), self.top, np.zeros(n, np.int64))] if n else []
        while work:
            level, query, node, far = work.pop()
            if len(query) > FRONT:
                half = len(query) // 2
                work += [(level, query[:half], node[:half], far[:half]), (level, query[half:], node[half:], far[half:])]
                continue
            pattern, own, last, low, high, begin = self.levels[level]
            # codes after the query, not all of its own label
            go = (last[node] > query + 1) & ((low[node] != self.label[query]) | (high[node] != self.label[query])) if level else (node > query) & (self.label[node] != self.label[query])
            query, node, far = query[go], node[go], far[go]
            far = far + np.bitwise_count((self.codes[query] ^ pattern[node]) & own[node])
            go = far <= self.bits
            query, node, far = query[go], node[go], far[go]
            if not len(query):
                continue
            if level:
                below = len(self.levels[level - 1][0])
                size = np.r_[begin[1:], below][node] - begin[node]
                place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                work.append((level - 1, np.repeat(query, size), np.repeat(begin[node], size) + place, np.repeat(far, size)))
            else:  # one link for each two labels
                _, one = np.unique(self.label[query] * n + self.label[node], return_index=True)
                out.append(np.stack([query[one], node[one]]))
        return tuple(np.concatenate(out, 1))


def _search(bits: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows["fingerprint"].to_numpy().view(np.uint64)
        parts = [rows[c].to_numpy() for c in ("b2", "b1", "key", "combination")]
        order = np.lexsort([gray_rank(codes), *parts])
        codes, parts = codes[order], np.stack([p[order] for p in parts])
        bucket = np.cumsum(np.r_[False, (parts[:, 1:] != parts[:, :-1]).any(0)])
        a, b = GrayIndex(codes, bucket, bits).links()
        pairs = np.unique(np.sort(np.stack([codes[a], codes[b]]).view(np.int64), axis=0), axis=1)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    return run


def segments(count: int) -> list[int]:
    """Masks of `count` segments that make up 64 bits."""
    edge = [64 * i // count for i in range(count + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]


def combinations_of(n: int, bits: int) -> list[int]:
    """Masks of which two codes with `bits` or fewer differing bits agree on one at least.

    64 bits are cut into more segments than may differ; a mask is a combination of as many as must agree. More segments make longer masks
    and more of them: as few as leave CROWD of n codes to a bucket.
    """
    count = bits + 1
    while n > CROWD << (64 * (count - bits) // count) and comb(count + 1, bits) <= 500:
        count += 1
    return [sum(c) for c in combinations(segments(count), count - bits)]


def near_components(prints: DataFrame, bits: int = 4) -> DataFrame:
    """component_id beside doc_id and fingerprint: the smallest doc_id that links of `bits` or fewer differing bits reach, itself included.

    prints has doc_id and fingerprint, both long. Equal fingerprints are one code. Each code goes, once for each mask, to the bucket of its
    bits under the mask, so that near codes meet in one at least; a bucket is searched by a GrayIndex. Of a bucket that holds more
    than BLOCK_MEMBERS codes every two blocks are a bucket of their own: no link is lost and none grows beyond two blocks; this
    part grows with the square of a crowd of near, but different codes.

    Defined cases: rows that repeat a doc_id are rows like others; a null doc_id takes part and gets the smallest id of its
    component, null if that has none; an empty table gives an empty table.
    """
    spark = prints.sparkSession
    ship(spark)
    prints = keep(prints.select("doc_id", "fingerprint"), "simhash-prints")
    codes = keep(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-codes")
    n = codes.count()
    masks = [m - (1 << 64) if m >> 63 else m for m in combinations_of(n, bits)]
    keyed = codes.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("combination", "key"))
    crowds = keyed.groupBy("combination", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_MEMBERS)
    crowds = keep(crowds.select("combination", "key", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("blocks")), "simhash-crowds")
    if crowds.isEmpty():
        placed = keyed.withColumns({"b1": F.lit(0), "b2": F.lit(0)})
        total = n * len(masks)
    else:
        placed = keyed.join(crowds, ["combination", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        placed = placed.withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.select("fingerprint", "combination", "key", F.least("part", "other").alias("b1"), F.greatest("part", "other").alias("b2"))
        total = placed.count()
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SLOT + 1)
    placed = placed.withColumn("slot", F.pmod(F.xxhash64("combination", "key", "b1", "b2"), F.lit(slots))).repartition(slots, "slot")
    links = placed.groupBy("slot").applyInPandas(_search(bits), "a bigint, b bigint")
    roots = components(links, "a", "b")
    named = keep(codes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("class")), "simhash-named")
    smallest = keep(named.groupBy("class").agg(F.min("least").alias("component_id")), "simhash-smallest")
    named = keep(named.join(smallest, "class").select("fingerprint", "component_id"), "simhash-components")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, size: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of docs; see simhash and near_components.

    docs has doc_id and text; other columns are not read. Texts without words share fingerprint 0 and are linked like any other.
    """
    out = near_components(simhash(docs, size), bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
