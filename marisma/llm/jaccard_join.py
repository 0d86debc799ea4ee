"""Similarity self-join of documents on word shingles, by PartEnum signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.llm import bytetext
from marisma.llm.components import components
from marisma.llm.scratch import drop, keep
from marisma.session import ship

BLOCK_BYTES = 1 << 20
FLUSH = 700_000
#: Signatures that more sets share than this are searched in blocks of members; below, all pairs are tried at once.
DIRECT = 4
BLOCK_MEMBERS = 8192
SLOT = 20_000
#: Pairs of two components that a task's first search of torn signatures tries, the most alike first; how many times as many each further search tries.
NEAREST, FURTHER = 4, 16
BUCKET_CHARS = 16 << 20
#: Pairs with one pivot that one task compares at most.
PART = 512
_SALT = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 40) - 1)
ID = np.dtype("S16")


class Scheme:
    """Size bands and partitions for sets with 100 * |r & s| >= percent * |r | s|.

    Band t holds sizes [low[t], low[t + 1]); its width is such that similar sets lie in one band or two
    neighbouring ones. A set of band t signs with tags t (it is the larger or both are of t) and t + 1 (it is the smaller).
    Under tag t similar sets differ in at most most(t) elements. The domain of 64-bit shingle hashes is cut into groups of three
    equal ranges; a signature is the content of two ranges of a group, so a group gives the three subsets of size two.

    With (most + 1) / 2 groups, rounded up, and `spare` more, similar sets have at least spare + 1 groups with one differing element or
    none, and agree there in two ranges. That signature is not empty unless the group is bad: two of its ranges are
    empty. A set with more than `spare` bad groups also signs with what is empty. So no pair of similar sets is left without
    a shared signature. Where similar sets are equal (most = 0) the signature is the whole set.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]
        self.of: dict[int, tuple[int, int]] = {}

    def _next(self) -> None:
        # a set of at least the new bound has no similar one below the last bound
        self.low.append(self.low[-1] * 100 // self.percent + 1)

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        while self.low[-1] <= sizes.max(initial=0):
            self._next()
        return np.searchsorted(self.low, sizes, side="right") - 1

    def most(self, tag: int) -> int:
        """Elements that two similar sets of sizes below low[tag + 1] differ in, at most."""
        while len(self.low) <= tag + 1:
            self._next()
        return 2 * (self.low[tag + 1] - 1) * (100 - self.percent) // (100 + self.percent)

    def groups(self, tag: int) -> tuple[int, int]:
        """(groups, spare ones among them); 0 groups where similar sets are equal."""
        if tag not in self.of:
            k = self.most(tag)
            base, n = (k + 2) // 2, self.low[max(0, tag - 1)]
            best = (2.0, 0)
            for spare in range(base + 5):
                g = base + spare
                mean = 3 * g * (1 - 2 / (3 * g)) ** n
                more = 1 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(spare + 1))
                best = min(best, (more, spare))
                if more <= 0.01:
                    best = (more, spare)
                    break
            self.of[tag] = (base + best[1], best[1]) if k else (0, 0)
        return self.of[tag]

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of sets (sorted distinct hashes, none empty) and the number of the set of each."""
        if not sets:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size = np.array([len(x) for x in sets])
        flat, band, signs, whose = np.concatenate(sets), self.bands(size), [], []
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bytetext.mix(flat ^ _SALT[2]))])
        high, end = flat >> np.uint64(32), np.cumsum(size)
        for shift in (0, 1):
            tag = band + shift
            known = {int(t): self.groups(int(t)) for t in np.unique(tag)}
            groups, spare = (np.array([known[int(t)][i] for t in tag]) for i in (0, 1))
            salt = bytetext.mix(tag.astype(np.uint64) ^ _SALT[3])
            same = np.flatnonzero(groups == 0)
            signs.append(bytetext.mix(total[end[same]] - total[end[same] - size[same]] + salt[same]))
            whose.append(same)
            first = np.cumsum(groups) - groups
            # three ranges a group; elements are sorted, so their ranges ascend in a set and from set to set
            place = (high * np.repeat((3 * groups).astype(np.uint64), size) >> np.uint64(32)).astype(np.int64)
            count = np.bincount(np.repeat(3 * first, size) + place, minlength=3 * int(groups.sum())) if len(same) < len(sets) else np.zeros(0, np.int64)
            if len(same):
                some = np.repeat(groups > 0, size)
                count = np.bincount((np.repeat(3 * first, size) + place)[some], minlength=3 * int(groups.sum()))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bytetext.mix(flat[some] ^ _SALT[2]))])
            else:
                sums = total
            ends = np.cumsum(count)
            content = (sums[ends] - sums[ends - count]).reshape(-1, 3)
            empty = (count == 0).reshape(-1, 3)
            owner = np.repeat(np.arange(len(sets)), groups)
            mark = salt[owner] + (np.arange(len(owner)) - first[owner]).astype(np.uint64) * _STEP
            bad = np.bincount(owner, empty.sum(1) >= 2, len(sets))
            open_ = (bad > spare)[owner]
            for j, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
                sign = bytetext.mix(bytetext.mix(content[:, a] + mark + np.uint64(j)) + content[:, b] * _STEP)
                use = ~(empty[:, a] & empty[:, b]) | open_
                signs.append(sign[use])
                whose.append(owner[use])
        return np.concatenate(signs), np.concatenate(whose)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    w = bytetext.words(data, offsets)
    odd = np.random.default_rng(size).integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(w.hash)
    joined = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        joined += w.hash[j : n - size + 1 + j] * odd[j]
    joined = bytetext.mix(joined)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            out.append(bytetext.mix((w.hash[a:b] * odd[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 128-bit name of each set, the same for equal sets."""
    lengths = np.array([len(x) for x in sets])
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    at = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros((len(sets), 2), ">u8")
    for c in (0, 1):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bytetext.mix(flat ^ _SALT[c]))])
        out[:, c] = bytetext.mix(sums[at[1:]] - sums[at[:-1]] + lengths.astype(np.uint64) * _SALT[3])
    out[:, 1] |= np.uint64(1)  # numpy's byte strings drop zeros at the end
    return np.frombuffer(out.tobytes(), ID)


def _cells(raw: bytes) -> list[bytes]:
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


# sketches: bit h mod m is the parity of a set's hashes there, so two sketches differ in at most as many bits as their sets in elements


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """A sketch of each set, of twice to four times as many bits as it has elements (a power of two, 64 at least)."""
    size = np.array([len(x) for x in sets], np.int64)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    end = np.cumsum(bits)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    at = np.repeat(end - bits, size) + (flat & np.repeat((bits - 1).astype(np.uint64), size)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(bool), bitorder="little").tobytes()
    return [raw[(e - b) >> 3 : e >> 3] for e, b in zip(end.tolist(), bits.tolist(), strict=True)]


def fold(sketch: bytes, size: int) -> bytes:
    """The sketch with fewer bits that the same set has: of `size` bytes."""
    x = np.frombuffer(sketch, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0).tobytes()


def may_link(a: bytes, b: bytes, n: int, m: int, percent: int) -> bool:
    """False only where sets of sizes n and m with these sketches can't be similar."""
    if min(n, m) * 100 < percent * max(n, m):
        return False
    if len(a) != len(b):
        size = min(len(a), len(b))
        a, b = fold(a, size), fold(b, size)
    far = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return far * (100 + percent) <= (n + m) * (100 - percent)


# first pass: sign


_PACKED = "bucket int, kind int, base bigint, a binary, b binary, c binary, d array<binary>"
_FOUND = "sign bigint, member bigint, pivot bigint, doc_id bigint, n int, id binary, sketch binary"
_SIGNS, _LATER, _OWNERS = 0, 1, 2


def _pack(percent: int, size: int, buckets: int, direct: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        signs: list[np.ndarray] = []
        whose: list[np.ndarray] = []
        names: dict[bytes, int] = {}
        task, base, number, held, turn = TaskContext.get().partitionId() << 40, 0, 0, 0, 0
        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()))

        def rows(*cells):
            return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate(types)], ["bucket", "kind", "base", "a", "b", "c", "d"])

        def flush():
            nonlocal turn
            sign, who = np.concatenate(signs), np.concatenate(whose) - base
            # a bucket's signatures are told apart by 40 bits
            key = ((sign >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | sign & _LOW
            order = np.argsort(key, kind="stable")
            key, who = key[order], who[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            many = np.diff(np.r_[first, len(key)])
            # of a signature that many sets of this task share one row goes on, and the others are linked to it here
            hot = np.repeat(many > direct, many)
            head = np.repeat(first, many)
            later = np.flatnonzero(hot & (np.arange(len(key)) != head))
            cells = []
            for i in range(0, len(later), 50_000):
                part = later[i : i + 50_000]
                turn += 1
                cells.append((turn % buckets, _LATER, task + base, key[part].tobytes(), who[part].astype("<u4").tobytes(), who[head[part]].astype("<u4").tobytes(), None))
            go = np.ones(len(key), bool)
            go[later] = False
            key, mark = key[go], (who[go] * 2 + hot[go]).astype(np.uint32)
            edge = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(40))
            width = "<u2" if not len(mark) or mark.max() < 65536 else "<u4"
            for k in range(buckets):
                if edge[k] < edge[k + 1]:
                    part = slice(edge[k], edge[k + 1])
                    low = key[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                    cells.append((k, _SIGNS, task + base, low.T.tobytes(), mark[part].astype(width).tobytes(), None, None))
            signs.clear()
            whose.clear()
            names.clear()
            return rows(*cells) if cells else None

        for batch in batches:
            data, offsets = bytetext.column(batch.column(1))
            ids = batch.column(0)
            for i, j in bytetext.blocks(offsets, BLOCK_BYTES):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                own, some = _cells(_ids(sets).tobytes()), ids.slice(i, j - i).to_pylist()
                doc = np.array([x if x is not None else 0 for x in some], "<i8").tobytes() + np.array([x is None for x in some], np.uint8).tobytes()
                # equal sets sign once
                fresh = [k for k, (x, name) in enumerate(zip(sets, own, strict=True)) if len(x) and names.setdefault(name, number + k) == number + k]
                ref = np.full(len(sets), -1, "<i8")
                ref[fresh] = task + number + np.array(fresh, np.int64)
                drawn = sketches([sets[k] for k in fresh])
                parity = [None] * len(sets)
                for k, s in zip(fresh, drawn, strict=True):
                    parity[k] = s
                turn += 1
                yield rows((turn % buckets, _OWNERS, 0, doc, b"".join(own), ref.tobytes() + np.array([len(x) for x in sets], "<i4").tobytes(), parity))
                sign, who = scheme.signatures([sets[k] for k in fresh])
                signs.append(sign)
                whose.append(number + np.array(fresh, np.int64)[who] if len(who) else np.zeros(0, np.int64))
                held += len(sign)
                number += len(sets)
                if held >= most:
                    out, held, base = flush(), 0, number
                    if out is not None:
                        yield out
        if held and (out := flush()) is not None:
            yield out

    return run


def _unpack(direct: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Sets and links of tasks pass. Signatures of one bucket are sorted: of few rows that share one all pairs are candidates, of many the first one with each other.

        sign stands only at the latter, whose other pairs are still to be looked at.
        """
        out, keys, refs = [], [], []
        for kind, base, a, b, c, d in zip(rows["kind"], rows["base"], rows["a"], rows["b"], rows["c"], rows["d"], strict=True):
            if kind == _OWNERS:
                n = len(b) // 16
                doc = pd.array(np.frombuffer(a[: 8 * n], "<i8"), dtype="Int64")
                doc[np.frombuffer(a[8 * n :], np.uint8).astype(bool)] = pd.NA
                none = pd.array([pd.NA] * n, dtype="Int64")
                member = pd.array(np.frombuffer(c[: 8 * n], "<i8"), dtype="Int64")
                out.append(pd.DataFrame({"sign": none, "member": member, "pivot": none, "doc_id": doc, "n": np.frombuffer(c[8 * n :], "<i4"), "id": _cells(b), "sketch": list(d)}))
            elif kind == _LATER:
                out.append(_linked(np.frombuffer(a, np.uint64), base + np.frombuffer(b, "<u4").astype(np.int64), base + np.frombuffer(c, "<u4").astype(np.int64)))
            else:
                low = np.zeros((len(a) // 5, 8), np.uint8)
                low[:, :5] = np.frombuffer(a, np.uint8).reshape(5, -1).T
                keys.append(low.view("<u8")[:, 0])
                mark = np.frombuffer(b, "<u2" if len(b) * 5 == len(a) * 2 else "<u4").astype(np.int64)
                refs.append((base + (mark >> 1)) * 2 + (mark & 1))
        if keys:
            key, ref = np.concatenate(keys), np.concatenate(refs)
            keys.clear()
            order = np.argsort(key, kind="stable")
            key = key[order]
            twice = np.zeros(len(key), bool)
            twice[1:] = key[1:] == key[:-1]
            twice[:-1] |= twice[1:]
            key, ref = key[twice], ref[order[twice]]
            order = np.lexsort((ref, key))
            key, hot, ref = key[order] | np.uint64(int(rows["bucket"].iloc[0])) << np.uint64(40), (ref[order] & 1).astype(bool), ref[order] >> 1
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            many = np.diff(np.r_[first, len(key)])
            wide = (many > direct) | (np.add.reduceat(hot, first) > 0 if len(first) else np.zeros(0, bool))
            head, all_wide = np.repeat(first, many), np.repeat(wide, many)
            later = np.flatnonzero(all_wide & (np.arange(len(key)) != head))
            out.append(_linked(key[later], ref[later], ref[head[later]]))
            pairs = [np.zeros((2, 0), np.int64)]
            for i in range(direct):
                for j in range(i + 1, direct):
                    at = first[~wide & (many > j)]
                    pairs.append(np.stack([ref[at + j], ref[at + i]]))
            member, pivot = np.concatenate(pairs, 1)
            order = np.lexsort((pivot, member))
            member, pivot = member[order], pivot[order]
            new = member != pivot
            new[1:] &= (member[1:] != member[:-1]) | (pivot[1:] != pivot[:-1])
            out.append(_linked(None, member[new], pivot[new]))
        return pd.concat(out) if out else _linked(None, np.zeros(0, np.int64), np.zeros(0, np.int64))

    return run


def _linked(sign: np.ndarray | None, member: np.ndarray, pivot: np.ndarray) -> pd.DataFrame:
    none = pd.array([pd.NA] * len(member), dtype="Int64")
    sign = none if sign is None else pd.array(sign.view(np.int64), dtype="Int64")
    return pd.DataFrame({"sign": sign, "member": pd.array(member, dtype="Int64"), "pivot": pd.array(pivot, dtype="Int64"), "doc_id": none, "n": pd.array([pd.NA] * len(member), dtype="Int32"), "id": None, "sketch": None})


# then: check


def _likely(percent: int):
    """Pairs of names that sizes and sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (batch.column(i).to_pylist() for i in range(6))
            good = [(max(p, q), min(p, q)) for p, q, i, j, s, t in zip(a, b, n, m, x, y, strict=True) if p != q and may_link(s, t, i, j, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.binary()) for k in (0, 1)], ["member", "pivot"])

    return run


def _packed(x: np.ndarray) -> bytes:
    """Sorted hashes by their first 40 bits, 48 in a set of 1,024 or more."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : 5 if len(x) < 1024 else 6].tobytes()


@lru_cache(64)
def _loose(raw: bytes, n: int, width: int) -> np.ndarray:
    own = len(raw) // n
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - width :] = np.frombuffer(raw, np.uint8).reshape(n, own)[:, :width]
    return out.view(">u8")[:, 0].astype(np.uint64)


def _sets(size: int):
    """Full sets of texts: name, size, elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytetext.column(batch.column(0))
            for i, j in bytetext.blocks(offsets, BLOCK_BYTES):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                yield pa.RecordBatch.from_arrays([pa.array(_cells(_ids(sets).tobytes()), pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array([_packed(x) for x in sets], pa.binary())], ["id", "size", "elements"])

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            sizes, others = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            for k, (n, m, x, y) in enumerate(zip(sizes, others, batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                width = min(len(x) // n, len(y) // m)
                common = len(np.intersect1d(_loose(x, n, width), _loose(y, m, width), assume_unique=True))
                if 100 * common >= percent * (n + m - common):
                    good.append(k)
            yield batch.select(["member", "pivot"]).take(pa.array(good, pa.int64()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar. A member's set goes to its pivot's; a pivot of many pairs is in several places."""
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    placed = pairs.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")).select("member", "pivot", "part")
    placed = placed.join(sets.select(F.col("id").alias("member"), F.col("size").alias("r"), F.col("elements").alias("r_elements")), "member")
    pivots = parts.join(sets.select(F.col("id").alias("pivot"), F.col("size").alias("s"), F.col("elements").alias("s_elements")), "pivot")
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = placed.join(pivots, ["pivot", "part"]).select("member", "pivot", "r", "r_elements", "s", "s_elements")
    return keep(both.mapInArrow(bytetext.tidy(_similar(percent)), "member binary, pivot binary"), "jaccard-links")


_ACROSS = "sign bigint, member binary, pivot binary"


def _fewer(held: dict[tuple[bytes, bytes], tuple[int, set[int]]], most: int) -> set[int]:
    """Leaves the `most` most alike pairs; returns the signatures of those that give way, which are searched again."""
    order = sorted(held, key=lambda q: (held[q][0], q))
    return {s for q in order[most:] for s in held.pop(q)[1]}


def _across(percent: int, most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs of members in different components that sizes and sketches don't rule out: of two components the `most` of all signatures here that are most alike.

        Rows of one (sign, b1, b2) are two blocks of the members of one signature, or one block. A row with a sign alone says that pairs of it were left out.
        """
        keys = [rows[c].to_numpy() for c in ("b2", "b1", "sign")]
        order = np.lexsort(keys)
        key = np.stack([k[order] for k in keys])
        edges = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0), True])
        raw, names, group = rows["sketch"].to_numpy()[order], rows["member"].to_numpy()[order], pd.factorize(rows["component"])[0][order]
        size, part = rows["n"].to_numpy().astype(np.int64)[order], rows["part"].to_numpy()[order]
        near: dict[tuple[int, int], dict[tuple[bytes, bytes], tuple[int, set[int]]]] = {}
        cut: set[int] = set()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            sign = int(key[2, lo])
            n, p, g, name, some = size[lo:hi], part[lo:hi], group[lo:hi], names[lo:hi], raw[lo:hi]
            least, two = min(map(len, some)), p.max() > p.min()
            bits = np.frombuffer(b"".join(x if len(x) == least else fold(x, least) for x in some), np.uint64).reshape(len(n), -1)
            for i in np.flatnonzero(p == p.min()):
                may = (g != g[i]) & (np.minimum(n, n[i]) * 100 >= percent * np.maximum(n, n[i]))
                may &= (p != p[i]) if two else (np.arange(len(n)) > i)
                may = np.flatnonzero(may)
                if not len(may):
                    continue
                far = np.bitwise_count(bits[may] ^ bits[i]).sum(1, dtype=np.int64)
                good = far * (100 + percent) <= (n[may] + n[i]) * (100 - percent)
                may, far = may[good], far[good]
                if not len(may):
                    continue
                by = np.lexsort((far, g[may]))
                may, far = may[by], far[by]
                head = np.flatnonzero(np.r_[True, g[may][1:] != g[may][:-1]])
                for x, y in zip(head, np.r_[head[1:], len(may)], strict=True):
                    held = near.setdefault((min(g[i], g[may[x]]), max(g[i], g[may[x]])), {})
                    if y - x > most:
                        cut.add(sign)
                    for k in range(x, min(y, x + most)):
                        two_names = (max(name[i], name[may[k]]), min(name[i], name[may[k]]))
                        if two_names[0] != two_names[1]:
                            held.setdefault(two_names, (int(far[k]), set()))[1].add(sign)
                    if len(held) > 2 * most:
                        cut |= _fewer(held, most)
        for held in near.values():
            cut |= _fewer(held, most)
        found = {q for held in near.values() for q in held}
        out = pd.DataFrame(sorted(found), columns=["member", "pivot"])
        out.insert(0, "sign", pd.array([pd.NA] * len(out), dtype="Int64"))
        return pd.concat([out, pd.DataFrame({"sign": pd.array(sorted(cut), dtype="Int64"), "member": None, "pivot": None})])

    return run


def _settled(docs: DataFrame) -> DataFrame:
    """docs; written first where its rows come out of an exchange, since a repeated task must see them in the same order."""
    return keep(docs, "jaccard-docs") if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def _search(docs: DataFrame, size: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of documents (doc_id, id, n), verified links (member, pivot), components of those (node, root).

    With every, all pairs of distinct similar sets are links; without it enough of them for the components.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = _settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(shuffled, chars // BUCKET_CHARS + 1)
    found = keep(rows.mapInArrow(bytetext.tidy(_pack(percent, size, buckets, DIRECT, FLUSH)), _PACKED).groupBy("bucket").applyInPandas(_unpack(DIRECT), _FOUND), "jaccard-found")
    owners = keep(found.where("n is not null").select("doc_id", "id", "n", "member", "sketch"), "jaccard-owners")
    signers = owners.where("member >= 0").select("member", "id", "n", "sketch")
    shared = found.where("n is null").select("sign", "member", "pivot")

    pairs = keep(shared.select("member", "pivot").distinct(), "jaccard-pairs")
    one, two = (signers.toDF(c, f"{c}_id", f"{c}_n", f"{c}_sketch") for c in ("member", "pivot"))
    both = pairs.join(one, "member").join(two, "pivot").select("member_id", "pivot_id", "member_n", "pivot_n", "member_sketch", "pivot_sketch")
    likely = keep(both.mapInArrow(bytetext.tidy(_likely(percent)), "member binary, pivot binary").distinct(), "jaccard-likely")
    drop(pairs)

    def elements(pairs: DataFrame) -> DataFrame:
        named = keep(pairs.select(F.col("member").alias("id")).union(pairs.select(F.col("pivot").alias("id"))).distinct(), "jaccard-named")
        chosen = keep(owners.join(named, "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("rep")).select("rep").distinct(), "jaccard-chosen")
        texts = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
        sets = texts.mapInArrow(bytetext.tidy(_sets(size)), "id binary, size int, elements binary")
        sets = keep(sets.join(named, "id", "left_semi").dropDuplicates(["id"]), "jaccard-sets")
        drop(named)
        drop(chosen)
        return sets

    sets = elements(likely)
    if every:
        links = _verified(likely, sets, percent)
        roots = components(links, "member", "pivot")
    else:
        # each member with one pivot; after that only pairs that are not connected yet
        lowest = likely.groupBy("member").agg(F.min("pivot").alias("pivot"))
        links = _verified(lowest, sets, percent)
        roots = components(links, "member", "pivot")
        ends = likely.join(lowest, ["member", "pivot"], "left_anti")
        for c in ("member", "pivot"):
            ends = ends.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
        apart = keep(ends.where(F.coalesce("member_root", "member") != F.coalesce("pivot_root", "pivot")).select("member", "pivot"), "jaccard-apart")
        more = _verified(apart, sets, percent)
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links, "member", "pivot")
    drop(sets)

    wide = shared.where("sign is not null")
    members = wide.select("sign", "member").union(wide.select("sign", F.col("pivot").alias("member"))).distinct()
    members = members.join(signers.select("member", "id"), "member").select("sign", F.col("id").alias("member")).distinct()
    members, limit, tried = keep(members, "jaccard-members"), NEAREST, likely
    while True:
        named = members.join(roots, F.col("member") == F.col("node"), "left").select("sign", "member", (F.col("member") if every else F.coalesce("root", "member")).alias("component"))
        named = keep(named, "jaccard-named-members")
        torn = named.groupBy("sign").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
        torn = keep(torn.where("low <> high").select("sign", F.ceil(F.col("m") / BLOCK_MEMBERS).cast("int").alias("blocks")), "jaccard-torn")
        placed = named.join(torn, "sign").withColumn("part", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
        own = signers.join(placed.select(F.col("member").alias("id")).distinct(), "id", "left_semi").groupBy(F.col("id").alias("member")).agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.select("sign", "member", "component", "part", F.least("part", "other").alias("b1"), F.greatest("part", "other").alias("b2"))
        # several signatures are one task's group, of about SLOT rows together
        slots = max(shuffled, placed.count() // SLOT + 1)
        placed = placed.join(own, "member").withColumn("slot", F.pmod(F.xxhash64("sign", "b1", "b2"), F.lit(slots)))
        across = keep(placed.repartition(slots, "slot").groupBy("slot").applyInPandas(_across(percent, limit), _ACROSS), "jaccard-across")
        untried = keep(across.where("member is not null").select("member", "pivot").distinct().join(tried, ["member", "pivot"], "left_anti"), "jaccard-untried")
        if not untried.isEmpty():
            further = _verified(untried, elements(untried), percent)
            if not further.isEmpty():
                links = links.union(further)
                roots = components(links, "member", "pivot")
        for used in (named, torn):
            drop(used)
        # signatures of which pairs were left out are searched again, if their members are still apart
        again = across.where("member is null").select("sign").distinct()
        if again.isEmpty():
            break
        members = keep(members.join(again, "sign", "left_semi"), "jaccard-members")
        limit, tried = limit * FURTHER, tried.union(untried)
    for used in (found, likely, members):
        drop(used)
    return owners.select("doc_id", "id", "n"), links, roots


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Connected components of documents whose sets of word shingles have 100 * intersection >= percent * union.

    docs has doc_id (taken as long) and text; other columns are not read. Words are runs outside
    [\\x20\\x09-\\x0D], A-Z lower-cased; a set holds the distinct shingles of `size` words, the whole sequence where there
    are fewer words, nothing for a null or empty text. Shingles are told apart by 64-bit hashes, in the last comparison of
    two sets by 40 bits of them (48 in sets of 1,024 shingles or more).

    1. Each task signs its sets (see Scheme), equal sets once, and sends its signatures to buckets whose number grows with the text.
       Of a signature that many sets of a task share one row goes on.
    2. In a bucket, sets that share a signature become candidates: all pairs of a few, of many a star about the first.
    3. Sizes and sketches of about three bits a shingle, which never rule out a link, leave few candidates. Their sets meet in full,
       each member's first with one pivot, later only where it is not connected yet.
    4. Signatures of many sets that are still in several components are searched for further links in blocks of
       a fixed number of members, every block against every other, so that no link is lost and no group is one task's. Of two components
       the pairs that are most alike are tried first, since one link makes the others needless; more of those still apart are tried in further searches, until all are.

    Returns one row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links
    reach). Defined cases: an empty set is linked with nothing, not even another empty one; rows that repeat a text are
    linked; rows with a null doc_id take part and get the smallest id of their component, null if it has none; an
    empty table gives an empty table.
    """
    owners, _, roots = _search(docs, size, percent, every=False)
    sets = owners.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("least"))
    sets = keep(sets.join(roots, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("root", "id").alias("class")), "jaccard-classes")
    smallest = keep(sets.groupBy("class").agg(F.min("least").alias("component_id")), "jaccard-smallest")
    named = keep(sets.join(smallest, "class").select("id", "component_id"), "jaccard-named")
    full = owners.where("n > 0").join(named, "id").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return full.union(owners.where("n = 0").select("doc_id", F.lit(0).cast("long"), "doc_id"))


def jaccard_links(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links that jaccard_components follows: pairs of distinct sets (a, b), and for each row of docs its set and number of links.

    The second table has doc_id, id (name of the row's set, as in a and b), n_shingles, n_links: the other rows whose
    sets are similar, those with an equal set among them. It comes from the number of rows of each set, so that equal
    texts are one member of a pair. An empty set has no links. Pairs grow with the square of a group of distinct similar sets.
    """
    owners, links, _ = _search(docs, size, percent, every=True)
    links = links.select(F.least("member", "pivot").alias("a"), F.greatest("member", "pivot").alias("b")).distinct()
    rows = owners.where("n > 0").groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    both = links.union(links.select("b", "a")).toDF("id", "near")
    near = both.join(rows.withColumnRenamed("id", "near"), "near").groupBy("id").agg(F.sum("rows").alias("others"))
    degree = rows.join(near, "id", "left").select("id", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    counts = owners.join(degree, "id", "left").select("doc_id", "id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return links, counts
