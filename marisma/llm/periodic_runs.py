"""Stretches of text that repeat a few words again and again, found by a dictionary of basic factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.llm import bytetext
from marisma.session import ship

BLOCK_BYTES = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal keys, and their order by key, then by place."""
    order = np.argsort(key, kind="stable")
    step = np.zeros(len(key), np.int64)
    step[1:] = key[order][1:] != key[order][:-1]
    name = np.empty(len(key), np.int64)
    name[order] = np.cumsum(step)
    return name, order


def periodic_runs(code: np.ndarray, first: np.ndarray, times: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of the texts code[first[i]:first[i + 1]], by start, then period.

    Level k names the factors of 2**k words. A run of period q, 2**(k-1) < q <= 2**k, and of at least four periods
    holds a factor of that level at each place but its last q + 2**k - 1, and the next place with the same one is q
    further: the root of a run is not a power, so it does not meet itself earlier. Places whose successor is
    equally far away, in a row, are one such progression. A factor that occurs once is part of no longer one
    that occurs twice, so each level looks only at what is left of the last.
    """
    n = len(code)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text] if n else text
    name, order = _named(code + text * (int(code.max(initial=0)) + 1))
    at, found = np.arange(n), [np.zeros((3, 0), np.int64)]
    longest, width = int(np.diff(first).max(initial=0)), 1
    while len(at) and 2 * width <= max(longest, 2):
        # at: places in ascending order; name: of the factor at each
        same = name[order[1:]] == name[order[:-1]]
        here, there = at[order[:-1][same]], at[order[1:][same]]
        gap = there - here
        near = (gap <= width) & (2 * gap > width)
        here, gap = here[near], gap[near]
        by = np.argsort(here)
        here, gap = here[by], gap[by]
        new = np.ones(len(here), bool)
        new[1:] = (here[1:] != here[:-1] + 1) | (gap[1:] != gap[:-1])
        head = np.flatnonzero(new)
        last = np.r_[head[1:], len(here)] - 1 if len(head) else head
        begin, period = here[head], gap[head]
        stop = here[last] + period + width
        begin, stop = _extended(code, first[:-1][text[begin]], end[begin], begin, stop, period)
        good = stop - begin >= np.maximum(least, times * period)
        found.append(np.stack([begin, stop - begin, period])[:, good])
        # factors of twice the width, where both halves occur more than once
        twice = np.zeros(len(at), bool)
        twice[order[:-1][same]] = True
        twice[order[1:][same]] = True
        at, name = at[twice], name[twice]
        second = np.searchsorted(at, at + width)
        inside = second < len(at)
        inside[inside] = at[second[inside]] == at[inside] + width
        inside &= at + 2 * width <= end[at]
        key = name[inside] * (int(name.max(initial=0)) + 1) + name[second[inside]]
        at = at[inside]
        name, order = _named(key)
        width *= 2
    begin, length, period = np.unique(np.concatenate(found, 1), axis=1)
    order = np.lexsort((period, begin))
    return begin[order], length[order], period[order]


def _extended(code, low, high, begin, stop, period):
    """Stretches grown by one word at either side as long as any keeps its period."""
    for side in (-1, 1):
        grow = np.arange(len(begin))
        while len(grow):
            if side < 0:
                ok = begin[grow] > low[grow]
                grow = grow[ok]
                ok = code[begin[grow] - 1] == code[begin[grow] - 1 + period[grow]]
                grow = grow[ok]
                begin[grow] -= 1
            else:
                ok = stop[grow] < high[grow]
                grow = grow[ok]
                ok = code[stop[grow]] == code[stop[grow] - period[grow]]
                grow = grow[ok]
                stop[grow] += 1
    return begin, stop


def collapse_runs(docs: DataFrame, times: int = 4, least: int = 6) -> DataFrame:
    """Runs of every text and the text without their repeats: doc_id, n_words, runs, collapsed.

    docs has doc_id and text; other columns are not read. Words are runs outside [\\x20\\x09-\\x0D], as they are written.
    A run is a stretch of consecutive words with smallest period q, of at least `least` words and `times` (four or more) times
    q, that no neighbouring word extends. runs holds start (number of a word, from 0), length and period of
    each, by start, then period. collapsed has the words that no run contains after its first q ones, joined by one space.

    Defined cases: a null or empty text, or one of white space, has no words, no runs and an empty collapsed text;
    each of repeated rows gets its own result, rows with a null doc_id too; an empty table gives an empty table. A text is
    searched whole, however long; a task holds one block of texts of about a megabyte, or one longer text.
    """
    if times < 4:
        raise ValueError("a run has at least four periods")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytetext.column(batch.column(1))
            for i, j in bytetext.blocks(offsets, BLOCK_BYTES):
                words = [data[offsets[k] : offsets[k + 1]].tobytes().split() for k in range(i, j)]
                number: dict[bytes, int] = {}
                code = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64)
                first = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)
                begin, length, period = periodic_runs(code, first, times, least)
                # words in a run after its first period
                depth = np.zeros(len(code) + 1, np.int64)
                np.add.at(depth, begin + period, 1)
                np.add.at(depth, begin + length, -1)
                dropped = np.cumsum(depth[:-1]) > 0
                edge = np.searchsorted(begin, first)
                runs, left = [], []
                for k, ws in enumerate(words):
                    lo, hi = edge[k], edge[k + 1]
                    runs.append([{"start": int(b - first[k]), "length": int(n), "period": int(q)} for b, n, q in zip(begin[lo:hi], length[lo:hi], period[lo:hi], strict=True)])
                    gone = dropped[first[k] : first[k + 1]]
                    left.append(b" ".join([w for w, d in zip(ws, gone.tolist(), strict=True) if not d] if lo < hi else ws))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(runs, _RUN), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(bytetext.tidy(run), f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")
