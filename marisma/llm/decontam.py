"""Benchmark passages in documents, by latent semantic retrieval and a check of word order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.llm import bytetext
from marisma.llm.scratch import keep
from marisma.session import ship

BLOCK_BYTES = 1 << 20
BLOCK_CODES = 200_000
PASSAGE = 24
RANK, MORE = 64, 8
ITEMS_AT_ONCE = 5000
#: Windows that lie near an item, whose words are compared together.
CANDIDATES = 100_000
#: So many of them, and so many of their words, are held side by side.
LANES, CELLS = 4096, 1 << 20
#: Ranges that begin in the same so many words are first taken as one.
NEAR = 64
_SUM = "n bigint, total binary"
#: Sums of what lies before each place of a stretch of running sums.
_BELOW = np.tri(16, 16, -1, dtype=np.float32)


@dataclass
class Items:
    """Benchmark items as sequences of codes (1..number of distinct words); code 0 is any word that no item has."""

    ids: list
    words: np.ndarray
    codes: list[np.ndarray]

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Items:
        raw = [t.encode() for t in texts]
        w = bytetext.words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))
        words, code = np.unique(w.hash, return_inverse=True)
        return cls(ids, words, [code[a:b] + 1 for a, b in zip(w.first[:-1], w.first[1:], strict=True)])

    def code(self, h: np.ndarray) -> np.ndarray:
        spot = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[spot] == h, spot + 1, 0)

    @property
    def dtype(self) -> str:
        return "<u2" if len(self.words) < 65535 else "<u4"

    def size(self, item: int) -> int:
        """Words of the windows that an item is searched with: PASSAGE, fewer for short items."""
        n, size = len(self.codes[item]), PASSAGE
        while n < size // 2:
            size //= 2
        return size


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each place of a. Zeros equal nothing."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & places.get(x, 0) if x else 0
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_bounds(item: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Upper bounds of lcs(item, codes[left:right]) for many ranges together, exact for items of at most 64 words.

    A longer item's is at most the sum over its pieces of 64 words. row has a zero for each code, before and after.
    """
    return bounds_of([item], np.zeros(len(left), np.int64), codes, left, right, row)


def bounds_of(items: list[np.ndarray], which: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray, row: np.ndarray) -> np.ndarray:
    """lcs_bounds of ranges each with the item that `which` names: ranges of all items go through the words side by side."""
    out = np.zeros(len(which), np.int64)
    pieces = np.array([-(-len(c) // 64) for c in items], np.int64)[which]
    lane = np.repeat(np.arange(len(which)), pieces)
    piece = np.arange(len(lane)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    # an item's ranges stand together, beside those of items that are about as long
    order = np.lexsort((piece, which[lane], np.array([len(c) for c in items])[which[lane]]))
    padded, i = np.append(codes, 0), 0
    while i < len(order):
        most = int((right - left)[lane[order[i : i + LANES]]].max())
        own, part = (x[order[i : i + max(1, min(LANES, CELLS // max(1, most)))]] for x in (lane, piece))
        i += len(own)
        lo, hi, of = left[own], right[own], which[own]
        at = np.arange((hi - lo).max())[:, None]
        places, full = np.empty((len(at), len(own)), np.uint64), np.empty(len(own), np.uint64)
        edges = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(part) != 0), True])
        for e, f in zip(edges[:-1], edges[1:], strict=True):
            words = items[of[e]][part[e] * 64 : part[e] * 64 + 64]
            np.bitwise_or.at(row, words, np.uint64(1) << np.arange(len(words), dtype=np.uint64))
            here = lo[e:f] + at
            np.putmask(here, here >= hi[e:f], len(codes))
            places[:, e:f] = np.take(row, np.take(padded, here))
            row[words] = 0
            full[e:f] = (1 << len(words)) - 1
        v = full.copy()
        for u in places:
            u &= v
            v = (v + u) | (v ^ u)
        np.add.at(out, own, np.bitwise_count(full).astype(np.int64) - np.bitwise_count(v & full))
    return out


def may_hold(items: list[np.ndarray], which: np.ndarray, least: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which ranges may have a longest common subsequence of at least `least` with their item, by bounds_of.

    Ranges of one item that begin near each other are first taken as one, which holds what any of them holds.
    """
    order = np.lexsort((left, which))
    head = np.flatnonzero(np.r_[len(order) > 0, (np.diff(which[order]) != 0) | (np.diff(left[order] // NEAR) != 0)][: len(order)])
    if not len(head):
        return order
    # an item has one least
    wide = bounds_of(items, which[order[head]], codes, left[order[head]], np.maximum.reduceat(right[order], head), row) >= least[order[head]]
    order = order[np.repeat(wide, np.diff(np.append(head, len(order))))]
    return np.sort(order[bounds_of(items, which[order], codes, left[order], right[order], row) >= least[order]])


def windows(first: np.ndarray, size: int, step: int, overlap: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin and end of windows of `size` words each `step` words; the last window of a text ends with it (is shorter, without overlap), a shorter text is one."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(0, -(-(n - size) // step)) + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[text] + (np.minimum(turn * step, np.maximum(n[text] - size, 0)) if overlap else turn * step)
    return text, begin, np.minimum(begin + size, first[text + 1])


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dtype: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, codes, first code of each row, one more at the end) in blocks of bounded size."""
    width = np.dtype(dtype).itemsize
    for batch in batches:
        data, offsets = bytetext.column(batch.column(column))
        for i, j in bytetext.blocks(offsets, BLOCK_CODES * width):
            raw = data[offsets[i] : offsets[j]].tobytes()
            yield batch.slice(i, j - i), np.frombuffer(raw, dtype).astype(np.int64), (offsets[i : j + 1] - offsets[i]) // width


def _total(rows: DataFrame) -> tuple[int, np.ndarray | None]:
    """Sum of (n, float64 array) rows: in as many tasks as the root of their number first, so that the driver gets few."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw)
                n, total = n + k, part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = rows.repartition(max(1, int(tasks**0.5))).mapInArrow(add, _SUM).collect()
    return sum(r["n"] for r in got), sum((np.frombuffer(r["total"]) for r in got), np.zeros(1)) if got else None


def _running(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Running sums of the rows of table at codes, a row of zeros first: inside stretches by one product each, then over the stretches."""
    n, size = len(codes), len(_BELOW)
    inside = np.matmul(_BELOW, np.take(table, np.pad(codes, (0, size - n % size)), axis=0).reshape(-1, size, table.shape[1]))
    inside[1:] += np.cumsum(inside[:-1, -1] + np.take(table, codes[size - 1 : n - n % size : size], axis=0), axis=0)[:, None]
    return inside.reshape(-1, table.shape[1])


def _project(table: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of the rows of table at the codes begin..end, in ascending order; row 0 is zero, so that only other codes are looked up."""
    out = np.empty((len(begin), table.shape[1]), np.float32)
    if not len(begin):
        return out
    known = codes[begin[0] : end.max()] != 0
    before = np.concatenate([[0], np.cumsum(known)])
    codes, begin, end = codes[begin[0] : end.max()][known], before[begin - begin[0]], before[end - begin[0]]
    # running sums over short stretches: overlapping windows take each word once
    for i in range(0, len(begin), 512):
        lo, hi = begin[i : i + 512], end[i : i + 512]
        running = _running(table, codes[lo[0] : hi.max()])
        np.subtract(np.take(running, hi - lo[0], axis=0), np.take(running, lo - lo[0], axis=0), out=out[i : i + 512])
    return out


def _sums(coded: DataFrame, dtype: str, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A' A basis, with A the TF-IDF matrix of all passages."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast((weight[:, None] * basis).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        total = np.zeros(table.shape)
        for _, codes, first in _blocks(batches, 0, dtype):
            known = np.flatnonzero(codes)
            if not len(known):
                continue
            _, begin, end = windows(first, PASSAGE, PASSAGE, overlap=False)
            y = _project(table, codes, begin, end)
            code, of = codes[known].astype(dtype), np.searchsorted(begin, known, side="right") - 1
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0, True])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                total[code[order[lo]]] += y[of[order[lo:hi]]].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    total = _total(coded.select("codes").mapInArrow(bytetext.tidy(run), _SUM))[1]
    return weight[:, None] * (total.reshape(basis.shape) if total is not None else np.zeros(basis.shape))


def latent_basis(coded: DataFrame, dtype: str, weight: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF matrix A of all passages, by randomised SVD in one pass over them.

    A' A meets random orthonormal directions once; A' A is then taken as y (directions' y)^-1 y' with y what came out, and
    that matrix's eigenvectors follow from a small decomposition.
    """
    width = min(RANK + MORE, len(weight) - 1)
    basis, _ = np.linalg.qr(np.random.default_rng(17).normal(size=(len(weight), width)))
    y = _sums(coded, dtype, weight, basis)
    y += basis * (1e-9 * max(np.linalg.norm(y), 1e-30))
    inner = basis.T @ y
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    half = vectors / np.sqrt(np.maximum(values, 1e-12 * max(values.max(), 1e-30)))
    return np.linalg.svd(y @ half, full_matrices=False)[0][:, :RANK]


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.6, whole: float = 0.7, part_share: float = 0.5) -> DataFrame:
    """Documents that hold a benchmark item or a paraphrase of one: doc_id, content (xxhash64 of text), item_id, cosine, lcs_share, answer_share.

    docs has doc_id and text, benchmark has item_id and text; other columns are not read. Words are lower-cased (A-Z) runs
    outside [\\x20\\x09-\\x0D].

    1. Each word of each document becomes its number among the items' words (0 for all others), one table.
    2. TF-IDF weights of these words come from the number of passages (runs of 24 words) that hold them; a randomised SVD of the matrix
       of all passages gives a latent space. Sums are formed in tasks, of a size that the items alone determine.
    3. Overlapping windows of all documents meet the windows that make up each item by cosine in that space. Words
       that no item has weigh nothing there, so that only windows without a word of an item are left out.
    4. Candidates are checked on the words around them: the longest common subsequence has at least the share `whole` of the
       item, or the share `part_share` and at least 0.8 of the answer (the item's last fifth, three words at least). An item of fewer than
       12 words, which prose may come near by chance, is there in whole.

    Items are taken in blocks of about 5,000, one on the driver at a time. Defined cases: items and documents that are null or without a word match nothing;
    items that repeat a text are each reported; an item shorter than 12 words is searched with shorter windows;
    rows that repeat a document are each reported; empty tables give an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))
    schema = f"doc_id {kind}, content bigint, item_id {item_kind}, cosine double, lcs_share double, answer_share double"
    out = spark.createDataFrame([], schema)
    given = benchmark.where("text is not null").select("item_id", "text")
    parts = -(-given.count() // ITEMS_AT_ONCE)
    for part in range(parts):
        # by a hash, so that the driver holds one block of items at a time
        block = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        block = sorted(((r["item_id"], r["text"]) for r in block), key=lambda r: (r[0] is None, r[0], r[1]))
        items = Items.of([i for i, _ in block], [t for _, t in block])
        if len(items.words):
            out = out.union(_find(rows, items, schema, kind, item_kind, cosine, whole, part_share))
    return out


def _find(rows: DataFrame, items: Items, schema: str, kind: str, item_kind: str, cosine: float, whole: float, part: float) -> DataFrame:
    spark = rows.sparkSession
    shared, dtype = spark.sparkContext.broadcast(items), items.dtype

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = bytetext.column(batch.column(2))
            for i, j in bytetext.blocks(offsets, BLOCK_BYTES):
                w = bytetext.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                codes = own.code(w.hash).astype(dtype)
                cells = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((w.first * codes.itemsize).astype(np.int32)), pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), cells], ["doc_id", "content", "codes"])

    coded = keep(rows.select("doc_id", "content", "text").mapInArrow(bytetext.tidy(code), f"doc_id {kind}, content bigint, codes binary"), "decontam-codes")
    size = len(items.words) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for _, codes, first in _blocks(batches, 0, dtype):
            _, begin, _ = windows(first, PASSAGE, PASSAGE, overlap=False)
            n += len(begin)
            known = np.flatnonzero(codes)
            of = np.searchsorted(begin, known, side="right") - 1
            total += np.bincount(np.unique(of * size + codes[known]) % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    passages, counts = _total(coded.select("codes").mapInArrow(bytetext.tidy(count), _SUM))
    counts = counts if counts is not None and len(counts) == size else np.zeros(size)
    weight = np.log((1 + passages) / (1 + counts)) + 1e-3
    weight[0] = 0.0
    basis = latent_basis(coded, dtype, weight)
    table = (weight[:, None] * basis).astype(np.float32)
    queries = {}
    for k in range(len(items.codes)):
        if len(items.codes[k]):
            length = items.size(k)
            _, begin, end = windows(np.array([0, len(items.codes[k])]), length, length)
            for a, b in zip(begin, end, strict=True):
                queries.setdefault(length, []).append((k, int(a), int(b), table[items.codes[k][a:b]].sum(0)))
    for length, some in queries.items():
        vectors = np.stack([q[3] for q in some])
        queries[length] = (np.array([q[:3] for q in some]), vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12))
    search = spark.sparkContext.broadcast((items, table, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table, queries = search.value
        row = np.zeros(len(table), np.uint64)
        sizes = np.array([len(c) for c in own.codes])
        # what an item's longest common subsequence has at least where it counts as found
        least = np.where(sizes < PASSAGE // 2, sizes, np.ceil(min(whole, part) * sizes - 1e-9))
        for batch, codes, first in _blocks(batches, 2, dtype):
            found: dict[tuple[int, int], tuple[float, float, float]] = {}
            known = np.concatenate([[0], np.cumsum(codes != 0)])
            for length, (which, vectors) in queries.items():
                text, begin, end = windows(first, length, max(1, length // 3))
                likely = np.flatnonzero(known[end] > known[begin])
                tried: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for i in range(0, len(likely), 1024):
                    some = likely[i : i + 1024]
                    x = _project(table, codes, begin[some], end[some])
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    near = x @ vectors.T
                    a, q = np.divmod(np.flatnonzero(near >= cosine), len(vectors))
                    tried.append((some[a], q, near[a, q]))
                    if i + 1024 < len(likely) and sum(len(t[0]) for t in tried) < CANDIDATES:
                        continue
                    at, q, close = map(np.concatenate, zip(*tried, strict=True))
                    tried.clear()
                    item, lo = which[q, 0], which[q, 1]
                    # the words around the window where the whole item would stand, and a window more
                    left = np.maximum(first[text[at]], begin[at] - lo - length)
                    right = np.minimum(first[text[at] + 1], begin[at] - lo + sizes[item] + length)
                    may = np.flatnonzero(known[right] - known[left] >= least[item])
                    # words that no item has are in no common subsequence
                    for c in may[may_hold(own.codes, item[may], least[item[may]], codes[codes != 0], known[left[may]], known[right[may]], row)]:
                        k, t = int(item[c]), int(text[at[c]])
                        held = found.get((t, k), (0.0, 0.0, 0.0))
                        if held[1] == 1.0:
                            continue
                        there = codes[left[c] : right[c]]
                        share = lcs(own.codes[k], there) / len(own.codes[k])
                        answer = own.codes[k][-max(3, len(own.codes[k]) // 5) :]
                        found[t, k] = max(held, (float(close[c]), share, lcs(answer, there) / len(answer)), key=lambda v: (v[1], v[2], v[0]))
            sure = [(t, k, *v) for (t, k), v in sorted(found.items()) if v[1] == 1 or len(own.codes[k]) >= PASSAGE // 2 and (v[1] >= whole or v[1] >= part and v[2] >= 0.8)]
            if sure:
                t, k, near, share, answer = map(list, zip(*sure, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(t)), batch.column(1).take(pa.array(t)), pa.array([own.ids[x] for x in k], batch_type), pa.array(near), pa.array(share), pa.array(answer)], ["doc_id", "content", "item_id", "cosine", "lcs_share", "answer_share"]
                )

    batch_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    return coded.mapInArrow(bytetext.tidy(run), schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. A document is its doc_id (null equals null) and text."""
    leaks = keep(find_leaks(docs, benchmark, **limits).select("doc_id", "content").distinct(), "decontam-leaks").alias("leaks")
    here = docs.alias("docs")
    return here.join(leaks, F.col("docs.doc_id").eqNullSafe(F.col("leaks.doc_id")) & (F.xxhash64(F.coalesce("docs.text", F.lit(""))) == F.col("leaks.content")), "left_anti")
