"""Log-probability of documents by a causal self-attention model, trained and run in numpy inside tasks."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from copy import deepcopy
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.llm import bytetext
from marisma.llm.language_id import fold
from marisma.llm.scratch import drop, keep
from marisma.session import ship

BLOCK_BYTES = 1 << 20
WINDOW, NEW = 32, 24
DIM, HIDDEN = 16, 32
CLASSES, MEMBERS = 32, 32
KNOWN = CLASSES * MEMBERS
RARE, BEGIN = KNOWN, KNOWN + 1
HEAD = 1 << 19
ROUNDS = 3
#: Windows of a step. On the driver: steps, over at most so many ids of documents of at most so many.
BATCH, STEPS, START_IDS, START_MOST = 128, 600, 400_000, 50_000
#: About so many ids are one group, whose weights are learned in one place; so many steps at least, over few ids several times.
GROUP_IDS, LEAST = 1_500_000, 500
#: Windows that a task holds together while it trains.
AT_ONCE = 65_536
#: Windows that are scored together; ids of one class that meet its members together.
AT_A_TIME, BLOCK = 256, 32
_COUNTS, _PIECES, _WINDOWS = 0, 1, 2


class Pieces:
    """Subword ids of words (each with a space before it) by a file of ranks; the id after the last one ends a text."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.memory = bytetext.WordMemory(np.uint16 if self.size <= 65536 else np.uint32)

    def make(self, words: list[bytes]) -> list[list[int]]:
        encode = self.encoding.encode_ordinary
        return [encode(" " + w.decode()) for w in words]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[bytetext.Words, np.ndarray, np.ndarray]:
        """Words; ids of all texts with their ends, one after another; the first id of each text, one more at the end."""
        w = bytetext.words(data, offsets)
        ids, size = self.memory.ids(w, self.make)
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[w.first]
        return w, np.insert(ids, total[1:], self.end), total + np.arange(len(total))


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Model:
    """One causal self-attention layer and one hidden layer; an id is its class, then its place in the class.

    The KNOWN most frequent ids have a class and a place of their own; all others are one class, inside which an id has its
    smoothed share of the training counts. So every id has a probability and they add up to one.
    """

    NAMES = ("embed", "place", "q", "k", "v", "out", "w1", "b1", "w2", "class_w", "class_b", "member_w", "member_b")

    def __init__(self, counts: np.ndarray):
        r = np.random.default_rng(1)
        order = np.argsort(-counts, kind="stable")[:KNOWN]
        self.number = np.full(len(counts), RARE, np.int32)
        self.number[order] = np.arange(len(order))
        rare = counts + 0.5
        rare[order] = 0
        self.rare_log = np.log(np.maximum(rare, 1e-300) / max(rare.sum(), 1e-300)).astype(np.float64)
        top = np.concatenate([counts[order] + 0.5, np.full(KNOWN - len(order), 0.5)]).reshape(CLASSES, MEMBERS)
        sums = np.concatenate([top.sum(1), [rare.sum()]])
        small = lambda *s: (r.normal(size=s) * 0.3 / np.sqrt(DIM)).astype(np.float32)
        self.p = {
            "embed": small(KNOWN + 2, DIM) * 3, "place": small(WINDOW, DIM), "q": small(DIM, DIM) * 3, "k": small(DIM, DIM) * 3, "v": small(DIM, DIM) * 3, "out": small(DIM, DIM),
            "w1": small(DIM, HIDDEN) * 3, "b1": np.zeros(HIDDEN, np.float32), "w2": small(HIDDEN, DIM),
            "class_w": small(DIM, CLASSES + 1), "class_b": np.log(sums / sums.sum()).astype(np.float32),
            "member_w": small(CLASSES, DIM, MEMBERS), "member_b": np.log(top / top.sum(1, keepdims=True)).astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        self._lay(flat.astype(np.float32))

    def _lay(self, flat: np.ndarray) -> None:
        """Weights become views of flat."""
        at = 0
        for n in self.NAMES:
            size = self.p[n].size
            self.p[n] = flat[at : at + size].reshape(self.p[n].shape)
            at += size

    def _wide(self) -> dict[str, np.ndarray]:
        """Weights for rows that carry a one behind them, so that biases, and sums over the places seen, come with the same products.

        ask is what queries and keys come to together, give what values and outputs do: both act on the inputs themselves.
        """
        p = self.p
        ask, give = np.zeros((DIM + 1, DIM + 1), np.float32), np.zeros((DIM + 1, DIM + 1), np.float32)
        np.divide(np.dot(p["q"], p["k"].T), np.float32(np.sqrt(DIM)), out=ask[:DIM, :DIM])
        give[:DIM, :DIM] = np.dot(p["v"], p["out"])
        return {
            "embed": np.concatenate([p["embed"], np.ones((KNOWN + 2, 1), np.float32)], 1), "place": np.concatenate([p["place"], np.zeros((WINDOW, 1), np.float32)], 1).ravel(), "ask": ask, "give": give,
            "w1": np.concatenate([p["w1"], p["b1"][None]]), "w2": np.concatenate([p["w2"], np.zeros((HIDDEN, 1), np.float32)], 1),
        }

    def _heads(self) -> dict[str, np.ndarray]:
        p = self.p
        return {"class": np.concatenate([p["class_w"], p["class_b"][None]]), "member": np.concatenate([p["member_w"], p["member_b"][:, None]], 1)}

    def _context(self, inputs: np.ndarray, w: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        """All layers for windows of input ids (windows, WINDOW); queries and later layers for the last NEW places alone."""
        w, b = w or self._wide(), len(inputs)
        x0 = np.take(w["embed"], inputs, axis=0)
        x0.reshape(b, -1)[:] += w["place"]
        last = np.ascontiguousarray(x0[:, -NEW:]).reshape(-1, DIM + 1)
        # gradients of the weights s are put behind them
        q, both = np.dot(last, w["ask"]).reshape(b, NEW, DIM + 1), np.empty((b, 2 * NEW, WINDOW), np.float32)
        s = both[:, :NEW]
        np.matmul(q, x0.transpose(0, 2, 1), out=s)
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(s, out=s)
            s *= _MASK
            y = np.matmul(s, x0).reshape(-1, DIM + 1)
        if not _sound(y[:, DIM]):
            np.matmul(q, x0.transpose(0, 2, 1), out=s)
            s -= np.where(_MASK > 0, s, -np.inf).max(2, keepdims=True)
            np.minimum(s, 0, out=s)
            np.exp(s, out=s)
            s *= _MASK
            y = np.matmul(s, x0).reshape(-1, DIM + 1)
        share = 1 / y[:, DIM:]
        y *= share
        x1 = np.dot(y, w["give"])
        x1 += last
        u = np.dot(x1, w["w1"])
        np.maximum(u, 0, out=u)
        wide = np.dot(u, w["w2"])
        wide += x1
        return {"x0": x0, "last": last, "q": q, "both": both, "share": share, "y": y, "x1": x1, "u": u, "wide": wide, "x2": wide[:, :DIM].reshape(b, NEW, DIM)}

    def log_probability(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of target numbers (RARE: of the class of all others) after contexts x, with or without a one behind them."""
        w = self._heads()
        if x.shape[1] == DIM:
            x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
        kind = (target >> _SHIFT).astype(np.uint8)
        out = _log_share(lambda: np.dot(x, w["class"]), kind)
        of, row, slot = _blocks(kind)
        inner = np.zeros(of.size * BLOCK + 1, np.float32)
        some, member = np.take(x, row, axis=0).reshape(-1, BLOCK, DIM + 1), w["member"][of]
        inner[:-1] = _log_share(lambda: np.matmul(some, member).reshape(-1, MEMBERS), np.take(target & (MEMBERS - 1), row))
        out += inner[slot]
        return out

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each text: windows overlap, and each id is scored once, among the last NEW of a window."""
        if len(first) < 2:
            return np.zeros(0)
        numbers = self.number[ids]
        size = np.diff(first)
        windows = -(-size // NEW)
        text = np.repeat(np.arange(len(size)), windows)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)) * NEW
        start, end = first[text], first[text + 1]
        logs, w = np.zeros(len(ids)), self._wide()
        for i in range(0, len(text), AT_A_TIME):
            # the input at a place is the id before it; before a text's first id all are BEGIN
            at = begin[i : i + AT_A_TIME, None] + np.arange(NEW - WINDOW - 1, NEW - 1)
            inputs = np.take(numbers, start[i : i + AT_A_TIME, None] + at, mode="clip")
            inputs[at < 0] = BEGIN
            scored = (start[i : i + AT_A_TIME] + begin[i : i + AT_A_TIME])[:, None] + np.arange(NEW)
            there = np.flatnonzero(scored < end[i : i + AT_A_TIME, None])
            scored = scored.ravel()[there]
            logs[scored] = self.log_probability(np.take(self._context(inputs, w)["wide"], there, axis=0), numbers[scored])
        logs += np.where(numbers == RARE, self.rare_log[ids], 0)
        return np.add.reduceat(logs, first[:-1]) / np.log(10)

    def fit(self, windows: np.ndarray, rate: float, seed: int, steps: int | None = None, least: int | None = None, state: list | None = None) -> list:
        """Adam over windows (n, WINDOW + 1) of numbers: inputs, and one id on the targets; -1 is after a text.

        One pass at one rate, or least (LEAST) steps if that is more; with steps, so many in passes over the windows, at a rate that falls to a twentieth.
        Gives the state of Adam, from which the next windows go on.
        """
        r = np.random.default_rng(seed)
        weights = self.flat()
        self._lay(weights)
        done, m, s = state or [0, np.zeros_like(weights), np.zeros_like(weights)]
        g, a_pass = np.empty_like(weights), -(-len(windows) // BATCH)
        for i in range(steps or max(a_pass, LEAST if least is None else least)):
            step, turn = done + i + 1, i % a_pass
            if not turn:
                order = r.permutation(len(windows))
            now = rate * (1 - 0.95 * step / steps) if steps else rate
            found = self._gradient(windows[order[turn * BATCH : (turn + 1) * BATCH]])
            np.concatenate([found[n].ravel() for n in self.NAMES], out=g, casting="same_kind")
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            np.square(g, out=g)
            g *= np.float32(0.01)
            s *= np.float32(0.99)
            s += g
            # the corrections for the moments' start at zero are a factor each
            np.multiply(s, np.float32(1 / (1 - 0.99**step)), out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= np.float32(now / (1 - 0.9**step))
            weights -= g
        return [step, m, s]

    def _gradient(self, windows: np.ndarray) -> dict[str, np.ndarray]:
        p, w, b = self.p, self._wide() | self._heads(), len(windows)
        inputs, target = np.maximum(windows[:, :-1], 0), windows[:, -NEW:].ravel()
        c = self._context(inputs, w)
        x0, both, y, x1, u, x2 = c["x0"], c["both"], c["y"], c["x1"], c["u"], c["wide"]
        there = target >= 0
        n, g = np.float32(1 / max(1, np.count_nonzero(there))), {}
        # places after a text are of no class, and weigh nothing
        kind = np.where(there, target >> _SHIFT, CLASSES + 1).astype(np.uint8)
        wrong = _wrong(lambda: np.dot(x2, w["class"]), np.minimum(kind, CLASSES), there * n)
        wide = np.dot(x2.T, wrong)
        g["class_w"], g["class_b"] = wide[:DIM], wide[DIM]
        g2 = np.dot(wrong, w["class"].T)
        of, row, slot = _blocks(kind)
        weight = np.zeros(of.size * BLOCK + 1, np.float32)
        weight[slot] = n
        x, member = np.take(x2, row, axis=0).reshape(-1, BLOCK, DIM + 1), w["member"][of]
        wrong = _wrong(lambda: np.matmul(x, member).reshape(-1, MEMBERS), np.take(target & (MEMBERS - 1), row), weight[:-1]).reshape(-1, BLOCK, MEMBERS)
        mine = (of == np.arange(CLASSES)[:, None]).astype(np.float32)
        wide = np.dot(mine, np.matmul(x.transpose(0, 2, 1), wrong).reshape(len(of), (DIM + 1) * MEMBERS)).reshape(w["member"].shape)
        g["member_w"], g["member_b"] = wide[:, :DIM], wide[:, DIM]
        gx = np.zeros((of.size * BLOCK + 1, DIM + 1), np.float32)
        np.matmul(wrong, member.transpose(0, 2, 1), out=gx[:-1].reshape(-1, BLOCK, DIM + 1))
        g2 += np.take(gx, slot, axis=0)
        g["w2"] = np.dot(u.T, g2)[:, :DIM]
        gu = np.dot(g2, w["w2"].T)
        gu *= u > 0
        wide = np.dot(x1.T, gu)
        g["w1"], g["b1"] = wide[:DIM], wide[DIM]
        g2 += np.dot(gu, w["w1"].T)
        ggive = np.dot(y.T, g2)[:DIM, :DIM]
        # behind the gradient of each sum over places: what takes the softmax's mean off those of its weights
        own = np.dot(g2, w["give"].T)
        own[:, DIM] = -np.einsum("ij,ij->i", own, y)
        behind = np.empty((b, 2 * NEW, DIM + 1), np.float32)
        np.multiply(own.reshape(b, NEW, DIM + 1), c["share"].reshape(b, NEW, 1), out=behind[:, :NEW])
        behind[:, NEW:] = c["q"]
        gs = both[:, NEW:]
        np.matmul(behind[:, :NEW], x0.transpose(0, 2, 1), out=gs)
        gs *= both[:, :NEW]
        g0 = np.matmul(both.transpose(0, 2, 1), behind)
        gq = np.matmul(gs, x0).reshape(-1, DIM + 1)
        gask = np.dot(c["last"].T, gq)[:DIM, :DIM] / np.float32(np.sqrt(DIM))
        g2 += np.dot(gq, w["ask"].T)
        g0[:, -NEW:] += g2.reshape(b, NEW, DIM + 1)
        g["q"], g["k"], g["v"], g["out"] = gask @ p["k"], gask.T @ p["q"], ggive @ p["out"].T, p["v"].T @ ggive
        g["place"] = np.dot(np.ones(b, np.float32), g0.reshape(b, -1)).reshape(WINDOW, -1)[:, :DIM]
        cell = np.take(_CELLS, inputs.ravel(), axis=0)
        g["embed"] = np.bincount(cell.ravel(), g0.ravel(), _CELLS.size).reshape(_CELLS.shape)[:, :DIM].astype(np.float32)
        return g


#: Which places of a window each of its last NEW places sees.
_MASK = np.tri(NEW, WINDOW, WINDOW - NEW, dtype=np.float32)
_SHIFT = MEMBERS.bit_length() - 1
#: Where the weights of each number's input, and a one, stand one after another.
_CELLS = np.arange((KNOWN + 2) * (DIM + 1)).reshape(-1, DIM + 1)


def _sound(sums: np.ndarray) -> bool:
    """Whether sums of exponentials neither overflowed nor vanished."""
    return bool(sums.min(initial=1) > 1e-20 and sums.max(initial=1) < 1e30)


def _softmax(make: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the logits that make gives, and their sum in each row; rows are moved by their largest if need be."""
    e = make()
    ones = np.ones(e.shape[1], np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(e, out=e)
        sums = np.dot(e, ones)
    if not _sound(sums):
        e = make()
        e -= e.max(1, keepdims=True)
        np.exp(e, out=e)
        sums = np.dot(e, ones)
    return e, sums


def _wrong(make: Callable[[], np.ndarray], which: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Softmax of the logits that make gives less one at one column of each row, times the row's weight."""
    e, sums = _softmax(make)
    e *= (weight / sums)[:, None]
    e.ravel()[np.arange(0, e.size, e.shape[1]) + which] -= weight
    return e


def _log_share(make: Callable[[], np.ndarray], which: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax, at one column of each row, of the logits that make gives."""
    e, sums = _softmax(make)
    at = np.arange(0, e.size, e.shape[1]) + which
    own = np.take(e.ravel(), at)
    if own.min(initial=1) < 1e-30:
        logits = make()
        logits -= logits.max(1, keepdims=True)
        return np.take(logits.ravel(), at) - np.log(np.exp(logits).sum(1))
    return np.log(own / sums)


def _blocks(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows dealt by class to blocks of BLOCK places: class of each block; row at each place (0 where none is); place of each row.

    Rows of no class that has members have one place after all others.
    """
    order = np.argsort(kind, kind="stable")
    n = np.bincount(kind, minlength=CLASSES)[:CLASSES]
    blocks = -(-n // BLOCK)
    known, places = n.sum(), blocks.sum() * BLOCK
    to = np.arange(known) + np.repeat((np.cumsum(blocks) - blocks) * BLOCK - np.cumsum(n) + n, n)
    row, slot = np.zeros(places, np.int64), np.full(len(kind), places)
    row[to] = order[:known]
    slot[order[:known]] = to
    return np.repeat(np.arange(CLASSES), blocks), row, slot


def _gather(path: str):
    """Of training texts: word counts, subword counts, and the subword ids of each text, as rows of kind, key, n, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        counts = np.zeros(own.size, np.int64)
        table, lost, held = bytetext.WordCounts(), [], 0

        def rows(kind: int, key, n, payload=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n), pa.nulls(len(key), pa.binary()) if payload is None else pa.array(payload, pa.binary())], ["kind", "key", "n", "payload"])

        def flush() -> pa.RecordBatch:
            key, inverse = np.unique(np.concatenate([k for k, _ in lost]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n for _, n in lost]), len(key)).astype(np.int64)
            lost.clear()
            return rows(_COUNTS, key.view(np.int64), n)

        for batch in batches:
            data, offsets = bytetext.column(batch.column(0))
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in bytetext.blocks(offsets, BLOCK_BYTES):
                w, ids, first = own.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lost.append(table.add(w.hash))
                held += len(lost[-1][0])
                counts += np.bincount(ids, minlength=own.size)
                raw = ids.astype(_width(own.size))
                yield rows(_WINDOWS, marks[i:j], np.diff(first), [raw[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)])
                if held > 1_500_000:
                    held = 0
                    yield flush()
        lost.append(table.rest())
        yield flush()
        used = np.flatnonzero(counts)
        yield rows(_PIECES, used, counts[used])

    return run


def _windows(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Training windows (n, WINDOW + 1) of subword ids, of which the last NEW are learned (-2: before the text, -1: after it).

    Windows follow each other by NEW, as in scores(), so that every id of every text is learned in one of them.
    """
    size = np.diff(first)
    take = -(-size // NEW)
    text = np.repeat(np.arange(len(size)), take)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(take) - take, take)
    at = turn[:, None] * NEW + np.arange(NEW - WINDOW - 1, NEW)
    out = ids[np.clip(first[text][:, None] + at, 0, len(ids) - 1)].astype(np.int32)
    out[at >= size[text][:, None]] = -1
    out[at < 0] = -2
    return out


def _width(size: int) -> str:
    return "<u2" if size <= 65536 else "<u4"


def _numbered(model: Model, payloads: list[bytes]) -> np.ndarray:
    """Windows of gathered texts, as numbers of the model."""
    ids = np.frombuffer(b"".join(payloads), _width(len(model.number)))
    first = np.concatenate([[0], np.cumsum([len(p) for p in payloads])]) // ids.itemsize
    w = _windows(ids, first)
    return np.where(w == -1, -1, np.where(w == -2, BEGIN, model.number[np.maximum(w, 0)]))


def _learn(model: Model, payloads: list[bytes], rate: float, seed: int) -> int:
    """One pass over all windows of a group's texts, or LEAST steps in all if that is more; how many windows there are.

    They are held in pieces of about AT_ONCE; a piece goes on where the one before ended, and has its share of LEAST.
    """
    width = np.dtype(_width(len(model.number))).itemsize
    whole = sum(-(-len(p) // (width * NEW)) for p in payloads)
    held, n, state = [], 0, None
    for i, payload in enumerate(payloads):
        held.append(payload)
        n += len(payload)
        if n >= AT_ONCE * NEW * width or i + 1 == len(payloads):
            windows = _numbered(model, held)
            held, n = [], 0
            for k in range(0, len(windows), AT_ONCE):
                piece = windows[k : k + AT_ONCE]
                state = model.fit(piece, rate, seed, least=LEAST * len(piece) // whole, state=state)
    return whole


def train(gathered: DataFrame, size: int) -> Model:
    """A model of the gathered counts and texts.

    First steps over some texts on the driver set out from the subword frequencies of the whole training corpus. Then texts are
    dealt, by a hash of their id and content, to ROUNDS rounds and to groups of about GROUP_IDS ids. In a round each
    group learns all of its windows in a fixed order, and the weights are averaged, in two steps, so that the driver gets few of
    them. Every id of the corpus is learned; how tables are partitioned makes no difference. Groups grow in number with the corpus, not in
    size.
    """
    spark = gathered.sparkSession
    counts = np.zeros(size)
    for row in gathered.where(F.col("kind") == _PIECES).groupBy("key").agg(F.sum("n").alias("n")).collect():
        counts[row["key"]] = row["n"]
    model = Model(counts)
    texts = gathered.where(F.col("kind") == _WINDOWS).select("key", "n", "payload")
    total = texts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return model
    few, held = [], 0
    # keys first: with their payloads many rows of every task would come to the driver
    for row in texts.where(F.col("n") <= START_MOST).select("key", "n").orderBy("key", "n").limit(START_IDS // 100).collect():
        if held < START_IDS:
            few.append(row["key"])
            held += row["n"]
    if few:
        got = texts.where((F.col("n") <= START_MOST) & (F.col("key") <= few[-1])).select("key", "payload").collect()
        model.fit(_numbered(model, [p for _, p in sorted((r["key"], bytes(r["payload"])) for r in got)]), 0.02, 0, STEPS)
    groups = -(-total // (GROUP_IDS * ROUNDS))
    schema = "weights binary, n bigint"
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def learn(rows: pd.DataFrame) -> pd.DataFrame:
            # a copy: another task of the same Python process starts from the round's weights too
            own = deepcopy(shared.value)
            seen = _learn(own, [p for _, p in sorted(zip(rows["key"], map(bytes, rows["payload"]), strict=True))], 0.01 / (1 + turn), turn)
            return pd.DataFrame({"weights": [own.flat().tobytes()], "n": [seen]})

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for batch in batches:
                for raw, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total, n = total + np.frombuffer(raw, np.float32) * float(k), n + k
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float64).tobytes()], pa.binary()), pa.array([n], pa.int64())], ["weights", "n"])

        mine = texts.where(F.pmod(F.col("key"), F.lit(ROUNDS)) == turn).withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
        some = mine.groupBy("group").applyInPandas(learn, schema)
        got = some.repartition(max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))).mapInArrow(average, schema).collect()
        if got:
            model.load(sum(np.frombuffer(r["weights"]) * r["n"] for r in got) / sum(r["n"] for r in got))
        shared.unpersist()
    return model


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Score every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs has doc_id and text; other columns are not read. The model learns from every id of the documents whose crc32(doc_id as text)
    mod 10 is not 0; score is its log10 probability of a text as subword ids of its lower-cased words, and an end. The 1,024 most
    frequent ids are told apart by the network; all others are one class to it, inside which they have their smoothed shares
    of the counts. Scores don't depend on how docs is partitioned, but for rounding.
    base_score is that of a smoothed word frequency model over the same documents.

    Word counts are one table. Of it, words over a count that at most 524,288 words reach are sent to all tasks; the others are
    joined to the words of each document by hash, where none can be frequent. Words are told apart by 64-bit hashes.

    Defined cases: null and empty texts are one end; a null doc_id counts as empty text for the fold, which
    makes it held out; repeated rows count and are scored each; without training documents base_score is 0 and
    the model gives all ids the same probability; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold(10) == 0).alias("held_out"))
    training = rows.where("not held_out").select("text", F.xxhash64("doc_id", "text").alias("mark"))
    gathered = keep(training.mapInArrow(bytetext.tidy(_gather(path)), "kind int, key bigint, n bigint, payload binary"), "lm-gathered")
    counts = keep(gathered.where(F.col("kind") == _COUNTS).groupBy("key").agg(F.sum("n").alias("n")), "lm-counts")
    own = pieces(path)
    model = train(gathered, own.size)
    ends = gathered.where((F.col("kind") == _PIECES) & (F.col("key") == own.end)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    drop(gathered)

    # the lowest count that at most HEAD words reach, to an eighth of a power of two
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = sorted(((r["step"], r["words"], r["total"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("total")).collect()), reverse=True)
    total = sum(r[2] for r in sizes) + ends
    distinct = sum(r[1] for r in sizes) + (ends > 0)
    lowest, reached = (sizes[0][0] + 1 if sizes else 0), 0
    for s, words, _ in sizes:
        if reached + words > HEAD:
            break
        lowest, reached = s, reached + words
    head = counts.where(step >= lowest).toArrow()
    key = head.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    often = np.log10(np.append(head.column("n").to_numpy()[order].astype(np.float64), 0.9) + 0.1)  # the last is for words outside: 0
    shared = spark.sparkContext.broadcast((model, key[order], often, float(ends)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (net, known, often, ends) = pieces(path), shared.value
        index = bytetext.HashIndex(known)
        for batch in batches:
            data, offsets = bytetext.column(batch.column(1))
            for i, j in bytetext.blocks(offsets, BLOCK_BYTES):
                w, ids, first = own.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                spot = index.find(w.hash)
                inside = spot < len(known)
                log = often[spot]
                sums = np.zeros((len(w.hash) + 1, 2))
                np.cumsum(np.column_stack([log, inside]), axis=0, out=sums[1:])
                sums = sums[w.first[1:]] - sums[w.first[:-1]]
                words = np.diff(w.first)
                outside = np.concatenate([[0], np.cumsum(~inside)])[w.first]
                tail = pa.ListArray.from_arrays(pa.array(outside.astype(np.int32)), pa.array(w.hash[~inside].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(words + 1), pa.array(sums[:, 1].astype(np.int64) + (ends > 0)), pa.array(sums[:, 0] + np.log10(ends + 0.1)), pa.array(net.scores(ids, first)), tail],
                    ["doc_id", "held_out", "n_tokens", "known", "logs", "score", "tail"],
                )

    scored = rows.select("doc_id", "text", "held_out").mapInArrow(bytetext.tidy(run), f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, score double, tail array<bigint>")
    scored = keep(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rest = scored.select("row", F.explode("tail").alias("key")).join(counts.where(step < lowest), "key", "left")
    rest = rest.groupBy("row").agg(F.count("n").alias("tail_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("tail_logs"))
    base = F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + 0.1 * (distinct + 1)))
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
