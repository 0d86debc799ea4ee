"""Token ids in one succinct file for each shard: a wavelet matrix with rank and select."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marisma.llm import bytetext
from marisma.session import ship

BLOCK_BYTES = 2 << 20
SHARD_TOKENS = 1 << 21
CELL_BYTES = 64 << 20
END = 2
_MAGIC = b"WVLT2"
_RANK_BITS = 512


class Plane:
    """Bits with the number of ones before every 512 of them; unpacked when they are first looked at."""

    def __init__(self, n: int, packed: np.ndarray | None, ones: np.ndarray, raw: bytes | None = None):
        self.n, self._packed, self._raw, self.ones, self._words = n, packed, raw, ones, None
        self.zeros = n - int(ones[-1])

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        per = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), _RANK_BITS // 8), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
        return cls(len(bits), packed, np.concatenate([[0], np.cumsum(per)]))

    @property
    def packed(self) -> np.ndarray:
        if self._packed is None:
            self._packed = np.frombuffer(pa.Codec("zstd").decompress(self._raw, (self.n + 7) // 8, asbytes=True), np.uint8)
        return self._packed

    @property
    def words(self) -> np.ndarray:
        """Eight words for each count, and one block of zeros after them."""
        if self._words is None:
            padded = np.zeros((self.n // _RANK_BITS + 2) * _RANK_BITS // 8, np.uint8)
            padded[: len(self.packed)] = self.packed
            self._words = padded.view("<u8")
        return self._words

    def bit(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits: those before the block, and those of its words."""
        block = i // _RANK_BITS
        left = np.clip((i - block * _RANK_BITS)[:, None] - np.arange(0, _RANK_BITS, 64), 0, 64)
        words = self.words[block[:, None] * (_RANK_BITS // 64) + np.arange(_RANK_BITS // 64)]
        mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left & 63).astype(np.uint64)) - np.uint64(1))
        return self.ones[block] + np.bitwise_count(words & mask).sum(1, dtype=np.int64)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The places of the k-th ones (or zeros)."""
        count = self.ones if one else np.minimum(np.arange(len(self.ones)) * _RANK_BITS, self.n) - self.ones
        block = np.searchsorted(count, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        for i in range(0, len(k), 4096):
            at = block[i : i + 4096]
            words = self.words[at[:, None] * (_RANK_BITS // 64) + np.arange(_RANK_BITS // 64)]
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
            hit = np.cumsum(bits if one else 1 - bits, axis=1, dtype=np.int32) > (k[i : i + 4096] - count[at])[:, None]
            out[i : i + 4096] = at * _RANK_BITS + hit.argmax(1)
        return out


class WaveletMatrix:
    """A sequence of token ids as bit planes over its own alphabet.

    Plane l holds, for each place, one bit of the id's number in the alphabet, most significant first; after each
    plane the places with 0 come first, in order. With a count of ones before every 512 bits, access, rank (how often an id
    stands before a place) and select (where it stands for the k-th time) each take one step a plane.
    """

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[Plane]):
        self.n, self.alphabet, self.planes = n, alphabet, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
        seen[ids] = True
        alphabet = np.flatnonzero(seen).astype("<u4")
        number = np.zeros(len(seen), np.uint32)
        number[alphabet] = np.arange(len(alphabet))
        cur = number[ids]
        cur = cur.astype(np.uint16) if len(alphabet) <= 65536 else cur
        planes = []
        for level in reversed(range(max(1, (len(alphabet) - 1).bit_length()) if len(alphabet) else 0)):
            bits = ((cur >> level) & 1).astype(bool)
            planes.append(Plane.of(bits))
            cur = np.concatenate([cur[~bits], cur[bits]])
        return cls(len(ids), alphabet, planes)

    def access(self, places) -> np.ndarray:
        """Ids at the places."""
        i = np.array(places, np.int64, ndmin=1)
        number = np.zeros(len(i), np.int64)
        for plane in self.planes:
            one, before = plane.bit(i), plane.rank(i)
            number = number * 2 + one
            i = np.where(one, plane.zeros + before, i - before)
        return self.alphabet[number]

    def _bits(self, token: int) -> list[bool] | None:
        """The bits of a token's number, one for each plane; None if it is not in the alphabet."""
        k = int(np.searchsorted(self.alphabet, token))
        if k == len(self.alphabet) or self.alphabet[k] != token:
            return None
        return [bool(k >> level & 1) for level in reversed(range(len(self.planes)))]

    def rank(self, token: int, end: int | None = None) -> int:
        """How often token stands before place end (in all, if None)."""
        bits = self._bits(token)
        if bits is None:
            return 0
        ends = np.array([0, self.n if end is None else end], np.int64)
        for plane, one in zip(self.planes, bits, strict=True):
            before = plane.rank(ends)
            ends = plane.zeros + before if one else ends - before
        return int(ends[1] - ends[0])

    def select(self, token: int, k) -> np.ndarray:
        """The places where token stands for the k-th time, from 0, for each k of an array."""
        k, bits = np.array(k, np.int64, ndmin=1), self._bits(token)
        if len(k) and (bits is None or k.min() < 0 or k.max() >= self.rank(token)):
            raise IndexError(f"token {token} does not stand {int(k.max()) + 1} times")
        if not len(k):
            return k
        start = np.zeros(1, np.int64)
        for plane, one in zip(self.planes, bits, strict=True):
            before = plane.rank(start)
            start = plane.zeros + before if one else start - before
        at = start + k
        for plane, one in zip(reversed(self.planes), reversed(bits), strict=True):
            at = plane.select(at - plane.zeros if one else at, one)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token, in order."""
        return self.select(token, np.arange(self.rank(token)))

    def all(self) -> np.ndarray:
        """The whole sequence: the planes undone from the last to the first."""
        cur = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 65536 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            bits = np.unpackbits(plane.packed, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(cur)
            up[~bits] = cur[: plane.zeros]
            up[bits] = cur[plane.zeros :] | cur.dtype.type(1 << k)
            cur = up
        return self.alphabet[cur] if len(self.alphabet) else np.zeros(0, "<u4")

    def to_bytes(self) -> bytes:
        """Head, sizes of the parts, and the parts: alphabet, then each plane's counts and bits, all compressed."""
        zstd = pa.Codec("zstd")
        parts = [zstd.compress(self.alphabet.tobytes(), asbytes=True)]
        for p in self.planes:
            parts += [zstd.compress(p.ones.astype("<u4").tobytes(), asbytes=True), zstd.compress(p.packed.tobytes(), asbytes=True)]
        head = struct.pack("<5sQII", _MAGIC, self.n, len(self.alphabet), len(self.planes))
        return head + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        magic, n, k, planes = struct.unpack_from("<5sQII", raw)
        if magic != _MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize("<5sQII")
        sizes = struct.unpack_from(f"<{2 * planes + 1}Q", raw, at)
        ends = np.cumsum([at + 8 * len(sizes), *sizes]).tolist()
        parts = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        zstd, counts = pa.Codec("zstd"), 4 * (-(-n // _RANK_BITS) + 1)
        made = [Plane(n, None, np.frombuffer(zstd.decompress(parts[i], counts, asbytes=True), "<u4").astype(np.int64), parts[i + 1]) for i in range(1, len(parts), 2)]
        return cls(n, np.frombuffer(zstd.decompress(parts[0], 4 * k, asbytes=True), "<u4"), made)


class WordTokens:
    """Ids of words by a tokenizers file. Words are cut at [\\x20\\x09-\\x0D], which no token of the file spans, so a text's ids are its words' ids."""

    _BETWEEN = "<|startoftext|>"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(self._BETWEEN)
        self.memory = bytetext.WordMemory(np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32)

    def make(self, words: list[bytes]) -> list[list[int]]:
        texts = [w.decode() for w in words]
        alone = [i for i, t in enumerate(texts) if self._BETWEEN in t]
        sent = ["" if self._BETWEEN in t else t for t in texts]
        groups = [self._BETWEEN.join(sent[i : i + 256]) for i in range(0, len(sent), 256)]
        out: list[list[int]] = []
        for i, e in enumerate(self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)):
            ids = np.array([*e.ids, self.between])
            ends = np.flatnonzero(ids == self.between)
            flat, start = ids.tolist(), 0
            for end in ends:
                out.append(flat[start:end])
                start = int(end) + 1
        for i in alone:
            out[i] = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, one after another, and their count for each text."""
        w = bytetext.words(data, offsets, lower=False)
        ids, size = self.memory.ids(w, self.make)
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return ids, total[w.first[1:]] - total[w.first[:-1]]


@lru_cache(2)
def tokens(path: str) -> WordTokens:
    return WordTokens(path)


def write_shards(docs: DataFrame, out: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text of docs (doc_id, text) and write the shards as a table at out.

    Documents are dealt by ranges of doc_id (and, within one id, of a hash of the text) and sorted, so that the shards follow each
    other in ascending doc_id; a shard closes once it has shard_tokens ids, and no document is cut. Each row of the
    table is one shard: part and number (its order), doc_ids, sizes (of its documents, with the end id), n, and
    matrix, the wavelet matrix as compressed bytes. Defined cases: null texts count as empty and have the end id
    alone; null doc_ids come first; rows that repeat an id are each written; other columns are not read; an
    empty table gives no shard.
    """
    ship(docs.sparkSession)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number, part = tokens(path), 0, TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        total = 0

        def close():
            nonlocal number, total
            ids = np.concatenate(held)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.ListArray.from_arrays([0, sum(map(len, names))], pa.concat_arrays(names)), pa.array([np.concatenate(sizes).astype(np.int64)], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([WaveletMatrix.build(ids).to_bytes()], pa.binary())],
                ["part", "number", "doc_ids", "sizes", "n", "matrix"],
            )
            number, total = number + 1, 0
            for x in (held, names, sizes):
                x.clear()
            return row

        for batch in batches:
            data, offsets = bytetext.column(batch.column(1))
            for i, j in bytetext.blocks(offsets, BLOCK_BYTES):
                ids, size = words.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, np.cumsum(size), END)
                held.append(ids)
                names.append(batch.column(0).slice(i, j - i))
                sizes.append(size + 1)
                total += len(ids)
                if total >= shard_tokens:
                    yield close()
        if total:
            yield close()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("same", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "same").sortWithinPartitions("doc_id", "same").select("doc_id", "text")
    rows.mapInArrow(bytetext.tidy(run), f"part int, number int, doc_ids array<{kind}>, sizes array<bigint>, n bigint, matrix binary").write.parquet(out)


def read_documents(spark: SparkSession, at: str) -> DataFrame:
    """Documents of the shards at a folder: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers)."""
    ship(spark)
    shards = spark.read.parquet(at)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    # ids before a shard: of earlier parts (one row for each part) and of earlier shards of its part
    parts = shards.groupBy("part").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    order = shards.select("part", "number", "n").withColumn("inside", F.sum("n").over(inside)).join(parts.select("part", "before"), "part")
    order = order.select("part", "number", (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("first"))
    rows = shards.join(order, ["part", "number"]).select("first", "doc_ids", "sizes", "matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                first, sizes = batch.column(0)[k].as_py(), batch.column(2).slice(k, 1).flatten().to_numpy()
                ids = WaveletMatrix.from_bytes(batch.column(3)[k].as_py()).all().astype("<u4", copy=False)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                names = batch.column(1).slice(k, 1).flatten()
                # Arrow counts bytes of one array in 32 bits
                for i, j in bytetext.blocks(ends * 4, CELL_BYTES):
                    if (ends[j] - ends[i]) * 4 >= 1 << 31:
                        raise ValueError(f"document {names[i]} has {sizes[i]} ids, too many for one cell")
                    cells = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(((ends[i : j + 1] - ends[i]) * 4).astype(np.int32)), pa.py_buffer(ids[ends[i] : ends[j]])])
                    yield pa.RecordBatch.from_arrays([names.slice(i, j - i), pa.array(first + ends[i:j]), pa.array(sizes[i:j]), cells], ["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(bytetext.tidy(run), f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")
