"""Words of many texts at once, found in the UTF-8 bytes of an Arrow column.

A word is a run of bytes outside [\\x20\\x09-\\x0D]; A-Z count as a-z. Each word gets a 64-bit
polynomial hash of its lower-cased bytes (random value for each byte, odd base, mixed at the end), so
that equal words have equal hashes and no Python string is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64; kept up to four million, no more than twice what was asked for."""
    if len(_POWERS["up"]) > n:
        return _POWERS["up"], _POWERS["down"]
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        x = np.full(max(1 << n.bit_length(), 1 << 16), base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    if n < 1 << 22:
        _POWERS["up"], _POWERS["down"] = out
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a block of texts: byte spans in data, hash, and the first word of each text (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive texts [i, j) of about most bytes together; a longer text stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def tidy(run: Callable) -> Callable:
    """run, which gives freed memory back to the machine when a task ends: Spark keeps its Python workers for the next one."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """All words of the texts data[offsets[i]:offsets[i + 1]]; with A-Z as they are if not lower."""
    low = LOWER[data] if lower else data
    n = len(low)
    solid = ~SPACE[low]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges], after[edges - 1] = False, False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[low] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(low, start, end, h, np.searchsorted(start, offsets))


class WordMemory:
    """Small results for words seen before, by hash: a ragged row of integers for each word.

    A table of fixed size with two slots for each word; one that finds both taken takes the first, and a word that lost its
    slot is made anew when it comes again. That costs time and changes nothing.
    """

    def __init__(self, dtype, bits: int = 21, most: int = 12_000_000):
        self.dtype, self.mask, self.most = dtype, np.uint64((1 << bits) - 1), most
        self._clear()

    def _clear(self) -> None:
        n = int(self.mask) + 1
        self.key, self.row = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def ids(self, w: Words, make) -> tuple[np.ndarray, np.ndarray]:
        """The results of all words of w, one after another, and their count for each word. make(list of words) gives lists."""
        if self.used > self.most:
            self._clear()
        slot = (w.hash & self.mask).astype(np.int64)
        away = np.flatnonzero(self.key[slot] != w.hash)
        second = ((w.hash[away] >> np.uint64(40)) & self.mask).astype(np.int64)
        there = self.key[second] == w.hash[away]
        slot[away[there]] = second[there]
        row, miss = self.row[slot], away[~there]
        if len(miss):
            new, sample, inverse = np.unique(w.hash[miss], return_index=True, return_inverse=True)
            made = make([w.word(i) for i in miss[sample]])
            size = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.fromiter(chain.from_iterable(made), self.dtype, int(size.sum()))
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(flat), len(self.flat)), self.dtype)])
            self.flat[self.used : self.used + len(flat)] = flat
            packed = ((self.used + np.cumsum(size) - size) << 24 | size).astype(np.uint64)
            self.used += len(flat)
            row[miss] = packed[inverse]
            own, other = slot[miss[sample]], ((new >> np.uint64(40)) & self.mask).astype(np.int64)
            own = np.where((self.key[own] != 0) & (self.key[other] == 0), other, own)
            self.key[own], self.row[own] = new, packed
        size = (row & np.uint64(0xFFFFFF)).astype(np.int64)
        return ragged(self.flat, (row >> np.uint64(24)).astype(np.int64), size), size


class HashIndex:
    """Places of hashes in an array of distinct ones, by a table with open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, len(keys).bit_length() + 2)
        self.keys, self.mask = np.concatenate([keys, np.zeros(1, np.uint64)]), np.uint64((1 << bits) - 1)
        self.table = np.full(1 << bits, len(keys), np.int32)
        left, probe = np.arange(len(keys)), np.uint64(0)
        while len(left):
            slot = ((keys[left] + probe) & self.mask).astype(np.int64)
            free = self.table[slot] == len(keys)
            self.table[slot[free]] = left[free]
            left, probe = left[self.table[slot] != left], probe + np.uint64(1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash; the number of keys for those that are none."""
        none = len(self.keys) - 1
        out = self.table[(h & self.mask).astype(np.int64)]
        left, probe = np.flatnonzero((self.keys[out] != h) & (out != none)), np.uint64(1)
        while len(left):
            out[left] = self.table[((h[left] + probe) & self.mask).astype(np.int64)]
            left, probe = left[(self.keys[out[left]] != h[left]) & (out[left] != none)], probe + np.uint64(1)
        return out


class WordCounts:
    """Counts of hashes in a table of fixed size; a hash that loses its slot is handed out with its count so far."""

    def __init__(self, bits: int = 20):
        self.mask = np.uint64((1 << bits) - 1)
        self.key, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def add(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count h; returns hashes and counts that have no slot any more."""
        slot = (h & self.mask).astype(np.int64)
        hit = self.key[slot] == h
        self.n += np.bincount(slot[hit], minlength=len(self.n))
        new, n = np.unique(h[~hit], return_counts=True)
        slot = (new & self.mask).astype(np.int64)
        slot, first = np.unique(slot, return_index=True)
        old = self.n[slot] > 0
        rest = np.ones(len(new), bool)
        rest[first] = False
        out = np.concatenate([self.key[slot[old]], new[rest]]), np.concatenate([self.n[slot[old]], n[rest]])
        self.key[slot], self.n[slot] = new[first], n[first]
        return out

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.n)
        return self.key[at], self.n[at]


def ragged(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[at[i]:at[i] + size[i]] for all i, one after another."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    begin = np.cumsum(size, dtype=np.int64) - size
    return flat[np.arange(total) + np.repeat(at - begin, size)]
