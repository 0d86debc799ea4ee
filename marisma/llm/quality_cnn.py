"""Quality of documents by a convolutional network over their bytes, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.llm import bytetext
from marisma.llm.language_id import drawn, fold
from marisma.session import ship

BLOCK_BYTES = 1 << 20
FILTERS = 16
WIDTH = 6
#: Filters see each of the 256 byte values, and what stands after a text's end as one value more.
AFTER, VALUES = 256, 257
#: A chunk is four cells of 256 bytes; the next one begins three cells on, so that neighbours overlap by one.
CELL, CELLS, STRIDE = 256, 4, 3


@dataclass
class Cnn:
    """taps: filter weights for each of WIDTH places and byte values; head: weights of the mean and the maximum over chunks."""

    taps: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: float
    fixed: float | None = None
    pairs: list[np.ndarray] = field(default_factory=list)

    def prepare(self) -> Cnn:
        """Tables of two neighbouring places at once, for reading only."""
        self.pairs = [(self.taps[k][:, None, :] + self.taps[k + 1][None, :, :]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)]
        return self

    def cells(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greatest response of each filter in each cell, each text's first cell (one more at the end), and the padded bytes."""
        size = np.diff(offsets)
        cells = np.maximum(1, -(-size // CELL))
        first = np.concatenate([[0], np.cumsum(cells)])
        # each text is padded to whole cells; filters reach WIDTH - 1 bytes into the next cell of the same text
        padded = np.full(int(first[-1]) * CELL + WIDTH, AFTER, np.int32)
        padded[np.arange(len(data)) + np.repeat(first[:-1] * CELL - offsets[:-1], size)] = data
        n = int(first[-1]) * CELL
        two = padded[:-1] * VALUES + padded[1:]
        response = self.pairs[0][two[:n]]
        for k in (1, 2):
            response += self.pairs[k][two[2 * k : n + 2 * k]]
        return response.reshape(-1, CELL, FILTERS).max(1), first, padded

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One probability for each text."""
        if self.fixed is not None:
            return np.full(len(offsets) - 1, self.fixed)
        if not len(offsets) - 1:
            return np.zeros(0)
        best, first, _ = self.cells(data, offsets)
        pooled, of = chunks(best, first)
        hidden = np.maximum(pooled + self.bias, 0)
        mean, top, _ = combine(hidden, of)
        return 1 / (1 + np.exp(-np.clip(np.concatenate([mean, top], 1) @ self.head + self.offset, -30, 30)))


def chunks(best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum over the cells of each chunk; first chunk of each text, one more at the end. The last chunk of a text ends with it."""
    cells = np.diff(first)
    count = np.maximum(1, -(-(cells - CELLS) // STRIDE) + 1)
    of = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1], count) + (np.arange(of[-1]) - np.repeat(of[:-1], count)) * STRIDE
    end = np.repeat(first[1:], count)
    out = best[begin]
    for k in range(1, CELLS):
        out = np.maximum(out, best[np.minimum(begin + k, end - 1)])
    return out, of


def combine(hidden: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and maximum over each text's chunks, and the chunk of the maximum."""
    count = np.diff(of)
    mean = np.add.reduceat(hidden, of[:-1]) / count[:, None]
    top = np.maximum.reduceat(hidden, of[:-1])
    hit = hidden == np.repeat(top, count, axis=0)
    place = np.where(hit, np.arange(len(hidden))[:, None], len(hidden))
    return mean, top, np.minimum.reduceat(place, of[:-1])


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 8, batch: int = 64, seed: int = 11) -> Cnn:
    """Fit by Adam on the cross-entropy, both classes weighing the same; gradients pass through the maxima to the windows that gave them."""
    r = np.random.default_rng(seed)
    net = Cnn((r.normal(size=(WIDTH, VALUES, FILTERS)) * 0.15).astype(np.float32), np.zeros(FILTERS, np.float32), (r.normal(size=2 * FILTERS) * 0.1).astype(np.float32), 0.0)
    if not len(labels) or labels.min() == labels.max():
        net.fixed = 0.5 if not len(labels) else float(labels[0])
        return net
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    values = [net.taps, net.bias, net.head, np.zeros(1, np.float32)]
    moment = [[np.zeros_like(v), np.zeros_like(v)] for v in values]
    step = 0
    for _ in range(rounds):
        order = r.permutation(len(texts))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            offsets = np.concatenate([[0], np.cumsum([len(texts[k]) for k in some])]).astype(np.int64)
            net.prepare()
            best, first, padded = net.cells(np.frombuffer(b"".join(texts[k] for k in some), np.uint8), offsets)
            pooled, of = chunks(best, first)
            hidden = np.maximum(pooled + net.bias, 0)
            mean, top, place = combine(hidden, of)
            seen = np.concatenate([mean, top], 1)
            p = 1 / (1 + np.exp(-np.clip(seen @ net.head + values[3][0], -30, 30)))
            wrong = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
            g_seen = wrong[:, None] * net.head[None, :]
            g_hidden = np.repeat(g_seen[:, :FILTERS] / np.diff(of)[:, None], np.diff(of), axis=0)
            np.add.at(g_hidden, (place, np.arange(FILTERS)[None, :]), g_seen[:, FILTERS:])
            g_hidden *= hidden > 0
            g_taps = np.zeros_like(net.taps)
            chunk, filters = np.nonzero(g_hidden)
            if len(chunk):
                # the window that gave a chunk's maximum: its cell, then its place in the cell
                text = np.searchsorted(of, chunk, side="right") - 1
                begin = first[text] + (chunk - of[text]) * STRIDE
                reach = np.minimum(begin[:, None] + np.arange(CELLS), first[text + 1][:, None] - 1)
                cell = np.take_along_axis(reach, best[reach, filters[:, None]].argmax(1)[:, None], 1)[:, 0]
                at = cell[:, None] * CELL + np.arange(CELL)
                response = sum(net.taps[k][padded[at + k], filters[:, None]] for k in range(WIDTH))
                at = cell * CELL + response.argmax(1)
                for k in range(WIDTH):
                    np.add.at(g_taps[k], (padded[at + k], filters), g_hidden[chunk, filters])
            step += 1
            for v, g, (m, s) in zip(values, (g_taps, g_hidden.sum(0), seen.T @ wrong, wrong.sum(keepdims=True)), moment, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    # the classes weighed the same while learning; their shares shift the offset
    share = float(labels.mean())
    net.offset = float(values[3][0]) + float(np.log(share / (1 - share)))
    return net


def sample(docs: DataFrame, labels: DataFrame, per_class: int, chars: int) -> tuple[list[bytes], np.ndarray]:
    """At most per_class labelled texts of each class, in the order of a hash of doc_id, and of each one a stretch of at most `chars` code points from anywhere in it."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(fold(3) != 1).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = drawn(known, "quality", per_class, 8).limit(2 * per_class)
    begin = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.greatest(F.length("text") - chars, F.lit(0)) + 1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.substr("text", begin.cast("int") + 1, F.lit(chars)).alias("text"))
    got = sorted((x.doc_id, x.text, x.quality) for x in rows.limit(4 * per_class).collect())
    return [t.encode() for _, t, _ in got], np.array([q for _, _, q in got], np.float64)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 600, chars: int = 6000) -> DataFrame:
    """Probability that a document is of quality 1: doc_id, score, predicted (1 from 0.5 on).

    docs has doc_id and text, labels has doc_id and quality; other columns are not read. The network is trained on the
    driver on a bounded sample: per_class texts of each class, `chars` code points of each, of documents whose
    crc32(doc_id as text) mod 3 is not 1. Its filters then pass over every byte of every text: responses are
    max-pooled in overlapping chunks, and mean and maximum over all chunks give one probability.

    Defined cases: null texts count as empty and are one chunk of padding; repeated rows get the same score; of
    labels that repeat a doc_id the smallest counts, null ones and ones other than 0 and 1 do not; with labels of one
    class alone the score is that class, without labels 0.5; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    net = train(*sample(docs, labels, per_class, chars))
    net.pairs = []
    shared = spark.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.prepare()
        for batch in batches:
            data, offsets = bytetext.column(batch.column(1))
            for i, j in bytetext.blocks(offsets, BLOCK_BYTES):
                score = own.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(bytetext.tidy(run), f"doc_id {kind}, score double, predicted int")
