"""Language of documents by a linear-chain conditional random field over their words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.llm import bytetext
from marisma.session import ship

#: Labels of a block of this size take about 45 MB, of 1 MB 90 MB.
BLOCK_BYTES = 1 << 18
HASHED = 1 << 15
SEGMENT = 64
UND = "und"


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


@dataclass
class Crf:
    """labels; emission weights of hashed features and of lexicon words; transition weights; all in nats."""

    labels: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, w: bytetext.Words) -> tuple[np.ndarray, np.ndarray]:
        """(score of each label for each distinct word, number of the distinct word of each word)."""
        _, sample, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        feature, owner = features(w, sample)
        score = np.zeros((len(sample), len(self.labels)), np.float32)
        at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
        if len(owner):
            score[owner[at]] = np.add.reduceat(self.weights[feature], at)
        if len(self.lexicon):
            spot = np.minimum(np.searchsorted(self.lexicon, w.hash[sample]), len(self.lexicon) - 1)
            score += np.where((self.lexicon[spot] == w.hash[sample])[:, None], self.lexicon_weights[spot], 0)
        return score, inverse


def lettered(w: bytetext.Words, which: np.ndarray) -> np.ndarray:
    """Whether words have an ASCII letter or a byte of another alphabet."""
    letter = np.zeros(len(w.data) + 1, np.int32)
    np.cumsum((w.data >= 97) & (w.data <= 122) | (w.data >= 128), out=letter[1:])
    return letter[w.end[which]] > letter[w.start[which]]


def features(w: bytetext.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words `which`: (feature, number of the word), words in order.

    Affixes of one to four bytes and all n-grams of two and three bytes; none for words without letters.
    """
    which_n = np.arange(len(which))
    solid = lettered(w, which)
    start, size, number = w.start[which][solid], (w.end - w.start)[which][solid], which_n[solid]
    data = np.concatenate([w.data, np.zeros(4, np.uint8)]).astype(np.uint32)
    kinds, owners = [], []

    def add(kind: int, at: np.ndarray, n: int, who: np.ndarray) -> None:
        h = np.full(len(at), kind * 0x9E3779B1 % 2**32, np.uint32)
        for k in range(n):
            h = (h ^ data[at + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        kinds.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(17))
        owners.append(who)

    for n in (1, 2, 3, 4):
        long = size >= n
        add(n, start[long], n, number[long])
        add(4 + n, (start + size - n)[long], n, number[long])
    for n in (2, 3):
        count = np.maximum(size - n + 1, 0)
        begin = np.repeat(start - (np.cumsum(count) - count), count)
        add(8 + n, begin + np.arange(int(count.sum())), n, np.repeat(number, count))
    feature, owner = np.concatenate(kinds).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return feature[order], owner[order]


def marginals(emission: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward: probability of each label for each word. emission: (words, labels); first: first word of each text, one more at the end.

    What each pair of labels of neighbours is expected to number is added to pairs; before a text's first word any label may stand.
    Texts are cut into segments. The matrix of each segment carries the chain over it, so that the values at its ends follow
    by one step a segment, and all segments are filled in at once; the result is that of the whole chains.
    """
    n, k = emission.shape
    if not n:
        return np.zeros((0, k), np.float32)
    size = np.diff(first)
    segments = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(size)), segments)
    place = np.arange(len(text)) - np.repeat(np.cumsum(segments) - segments, segments)
    begin = first[text] + place * SEGMENT
    length = np.minimum(size[text] - place * SEGMENT, SEGMENT)
    s = len(text)
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    psi = np.ones((SEGMENT, s, k), np.float32)
    there = np.arange(SEGMENT)[:, None] < length[None, :]
    index = (begin[None, :] + np.arange(SEGMENT)[:, None])[there]
    psi[there] = np.exp(emission - emission.max(1, keepdims=True))[index] + 1e-12

    carry = np.broadcast_to(np.eye(k, dtype=np.float32), (s, k, k)).copy()
    for t in range(SEGMENT):
        live = there[t]
        if not live.any():
            break
        moved = (carry[live].reshape(-1, k) @ step).reshape(-1, k, k) * psi[t][live][:, None, :]
        carry[live] = moved / moved.max((1, 2), keepdims=True)
    enter, leave = np.full((s, k), 1.0 / k, np.float32), np.ones((s, k), np.float32)
    order = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[order], np.arange(place.max() + 2))
    for p in range(1, place.max() + 1):
        now = order[edges[p] : edges[p + 1]]
        enter[now] = np.einsum("si,sij->sj", enter[now - 1], carry[now - 1])
        enter[now] /= enter[now].sum(1, keepdims=True)
    for p in range(place.max(), 0, -1):
        now = order[edges[p] : edges[p + 1]]
        leave[now - 1] = np.einsum("sij,sj->si", carry[now], leave[now])
        leave[now - 1] /= leave[now - 1].max(1, keepdims=True)

    forward, cur = np.empty_like(psi), enter
    for t in range(SEGMENT):
        moved = (cur @ step) * psi[t]
        moved /= moved.sum(1, keepdims=True)
        cur = np.where(there[t][:, None], moved, cur)
        forward[t] = cur
    cur = leave
    for t in reversed(range(SEGMENT)):
        if pairs is not None:
            joint = (forward[t - 1] if t else enter)[:, :, None] * step * (psi[t] * cur)[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True))[there[t]].sum(0)
        forward[t] *= cur
        back = (psi[t] * cur) @ step.T
        back /= back.max(1, keepdims=True)
        cur = np.where(there[t][:, None], back, cur)
    out = np.empty((n, k), np.float32)
    out[index] = forward[there]
    return out / out.sum(1, keepdims=True)


def train(texts: list[bytes], langs: list[str], rounds: int = 6, span: int = 12, seed: int = 3) -> Crf:
    """Fit by stochastic gradients of the log-likelihood.

    Training sequences switch language: spans of words of texts in random order are strung together, each word labelled
    with the language of its text. That is what the transitions are learned from.
    """
    labels = sorted(set(langs))
    k = len(labels)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    w = bytetext.words(np.frombuffer(b"".join(texts), np.uint8), offsets)
    truth = np.repeat([labels.index(x) for x in langs], np.diff(w.first)).astype(np.int64)
    crf = Crf(labels, np.zeros((HASHED, k), np.float32), np.zeros(0, np.uint64), np.zeros((0, k), np.float32), np.zeros((k, k), np.float32))
    if k == 1 or not len(w.hash):
        return crf
    unique, sample, inverse, count = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
    crf.lexicon = np.sort(unique[np.argsort(-count, kind="stable")[:4096]])
    crf.lexicon_weights = np.zeros((len(crf.lexicon), k), np.float32)
    entry = np.searchsorted(crf.lexicon, unique)
    entry = np.where((entry < len(crf.lexicon)) & (crf.lexicon[np.minimum(entry, len(crf.lexicon) - 1)] == unique), entry, -1)
    feature, owner = features(w, sample)
    start = np.searchsorted(owner, np.arange(len(unique) + 1))
    r = np.random.default_rng(seed)
    spans = np.concatenate([np.arange(a, b, span) for a, b in zip(w.first[:-1], w.first[1:], strict=True) if b > a])
    ends = np.minimum(spans + span, w.first[1:][np.searchsorted(w.first, spans, side="right") - 1])
    squares = [np.full_like(x, 1e-2) for x in (crf.weights, crf.lexicon_weights, crf.transitions)]
    for _ in range(rounds):
        order = r.permutation(len(spans))
        for i in range(0, len(order), 1024):
            chosen = order[i : i + 1024]
            size = ends[chosen] - spans[chosen]
            at = bytetext.ragged(np.arange(len(w.hash)), spans[chosen], size)
            # four spans are one sequence
            first = np.concatenate([[0], np.cumsum(size)])[[*range(0, len(chosen), 4), len(chosen)]]
            word, place = np.unique(inverse[at], return_inverse=True)
            rows = start[word + 1] - start[word]
            used = bytetext.ragged(feature, start[word], rows)
            score = np.zeros((len(word), k), np.float32)
            have = rows > 0
            if len(used):
                score[have] = np.add.reduceat(crf.weights[used], (np.cumsum(rows) - rows)[have])
            score += np.where((entry[word] >= 0)[:, None], crf.lexicon_weights[np.maximum(entry[word], 0)], 0)
            emission = score[place]
            expected = np.zeros((k, k))
            wrong = -marginals(emission, first, crf.transitions, expected)
            wrong[np.arange(len(at)), truth[at]] += 1
            by_word = np.stack([np.bincount(place, wrong[:, c], len(word)) for c in range(k)], 1)
            touched, number = np.unique(used, return_inverse=True)
            grad = np.stack([np.bincount(number, np.repeat(by_word[:, c], rows), len(touched)) for c in range(k)], 1)
            in_lexicon = entry[word] >= 0
            # pairs of neighbours: what is there, less what is expected; what stands before a first word is known by its label alone
            inner = np.ones(len(at), bool)
            inner[first[:-1]] = False
            b = np.flatnonzero(inner)
            pairs = np.bincount(truth[at[b - 1]] * k + truth[at[b]], minlength=k * k).reshape(k, k) - expected
            begin = np.exp(crf.transitions)
            pairs += begin / begin.sum(0) * np.bincount(truth[at[first[:-1]]], minlength=k)
            for x, sq, rows_of, g in ((crf.weights, squares[0], touched, grad), (crf.lexicon_weights, squares[1], entry[word][in_lexicon], by_word[in_lexicon]), (crf.transitions, squares[2], slice(None), pairs)):
                g = (g / len(chosen) - 1e-5 * x[rows_of]).astype(np.float32)
                sq[rows_of] += g * g
                x[rows_of] += 0.3 * g / np.sqrt(sq[rows_of])
    return crf


def drawn(rows: DataFrame, by: str, most: int, seed: int) -> DataFrame:
    """Of each value of `by` at most `most` rows, in the order of a hash of doc_id.

    The counts of the values say which share of the hashes leaves about four times as many; only these are ranked.
    """
    counts = F.broadcast(rows.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n")))
    mark = F.xxhash64("doc_id", F.lit(seed))
    near = rows.join(counts, F.col(by) == F.col("_by")).where(F.pmod(mark, F.lit(1 << 40)) <= (F.lit(float(1 << 40)) * (4 * most + 50)) / F.col("_n"))
    turn = F.row_number().over(Window.partitionBy(by).orderBy(F.pmod(mark, F.lit(1 << 40)), "doc_id"))
    return near.withColumn("turn", turn).where(F.col("turn") <= most).select(*rows.columns)


def sample(docs: DataFrame, per_language: int, chars: int) -> tuple[list[bytes], list[str]]:
    """Of each language at most per_language texts, in the order of a hash of doc_id, and of each one a stretch of at most `chars` code points from anywhere in it."""
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").where(fold(5) != 0)
    ids = drawn(labelled.select("doc_id", "lang"), "lang", per_language, 5).select("doc_id").distinct().limit(per_language * 200)
    begin = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.greatest(F.length("text") - chars, F.lit(0)) + 1)
    rows = labelled.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "doc_id", F.substr("text", begin.cast("int") + 1, F.lit(chars)).alias("text"))
    got = sorted((r.lang, r.doc_id, r.text) for r in rows.limit(per_language * 200).collect())
    return [t.encode() for _, _, t in got], [x for x, _, _ in got]


def predict_languages(docs: DataFrame, per_language: int = 400, chars: int = 2000) -> DataFrame:
    """Adds lang_pred (a language learned, or "und") and lang_score (0 to 1) to documents.

    docs has doc_id, text and lang. The field is trained on a bounded sample: per_language texts of each language, of documents whose
    crc32(doc_id as text) mod 5 is not 0, `chars` code points of each; its weights have a fixed size for each language
    (of at most 200). Every word of every text is then labelled by its marginal probabilities; lang_pred
    has the largest sum over the words with letters and lang_score is its mean there. lang, source and doc_id are not
    looked at for a prediction.

    Other columns are kept; one named lang_pred or lang_score is replaced. Defined cases: a null text and one
    without a letter are "und" with score 0, and so is every text where no language could be learned; one learned
    language is predicted for every text with a letter; repeated rows get the same; ties go to the
    language first in alphabet; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    texts, langs = sample(docs, per_language, chars)
    crf = spark.sparkContext.broadcast(train(texts, langs) if texts else Crf([], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0))))
    rest = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytetext.column(batch.column(batch.schema.get_field_index("text")))
            for i, j in bytetext.blocks(offsets, BLOCK_BYTES):
                lang, score = label(crf.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cells = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*cells.columns, pa.array(lang), pa.array(score)], [*batch.schema.names, "lang_pred", "lang_score"])

    table = docs.select(*rest)
    return table.mapInArrow(bytetext.tidy(run), T.StructType([*table.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def label(crf: Crf, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a block."""
    n = len(offsets) - 1
    lang, score = [UND] * n, np.zeros(n)
    if not crf.labels:
        return lang, score
    w = bytetext.words(data, offsets)
    counts = lettered(w, np.arange(len(w.hash)))
    if len(crf.labels) > 1:
        emission, number = crf.emissions(w)
        p = marginals(emission[number], w.first, crf.transitions)
    else:
        p = np.ones((len(w.hash), 1), np.float32)
    sums = np.zeros((len(w.hash) + 1, p.shape[1] + 1))
    np.cumsum(np.column_stack([p * counts[:, None], counts]), axis=0, out=sums[1:])
    sums = sums[w.first[1:]] - sums[w.first[:-1]]
    for d in np.flatnonzero(sums[:, -1] > 0):
        low = w.data[offsets[d] : offsets[d + 1]]
        if ((low >= 97) & (low <= 122)).any() or any(c.isalpha() for c in low.tobytes().decode()):
            best = int(sums[d, :-1].argmax())
            lang[d], score[d] = crf.labels[best], min(1.0, sums[d, best] / sums[d, -1])
    return lang, score
