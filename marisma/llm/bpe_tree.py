"""Byte-level BPE of whole texts by tree reduction: halves are encoded, neighbours joined over a boundary window."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.llm import bytetext
from marisma.session import ship

#: Longer texts, runs, matches and lists of ids are halved.
LEAF_CHARS = 128
LEAF_BYTES = 96
BLOCK_BYTES = 2 << 20


class TreeBpe:
    """Encoding and decoding by the ranks of a vocabulary file.

    Encodings form a monoid: the encoding of a text follows from those of its halves. Two facts say when tokens outside
    a boundary window can't change.

    - Text: the pattern (that of public_tokenizers, for which alone this holds) never matches a character that is not white space and
      then white space. So where such a pair stands, a match ends in any text, and what follows depends only on characters to the right.
      The window runs from the last such place of the left half to the first one of the right half.
    - Bytes of one long match: a token sequence is the encoding exactly if each two neighbours, encoded together, stay those two.
      The window takes more tokens on both sides until that holds at its two ends.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.leaf = tiktoken.Encoding("leaf", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.stay = lru_cache(1 << 16)(self._stay)

    # texts

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF_CHARS:
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        a, b = self._around(text, lo, mid, hi)
        if b - a > LEAF_CHARS:
            # the middle lies in a long run: cut at an end of it
            if a == lo and b == hi:
                return self._run(text[lo:hi])
            mid = a if a > lo else b
            a, b = self._around(text, lo, mid, hi)
        left, right = self._encode(text, lo, mid), self._encode(text, mid, hi)
        window = self._run(text[a:b]) if b - a > LEAF_CHARS else self.leaf(text[a:b])
        keep = len(left) - self._count(reversed(left), len(text[a:mid].encode()))
        skip = self._count(right, len(text[mid:b].encode()))
        return left[:keep] + window + right[skip:]

    def _around(self, text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
        """The last place before mid and the first one behind it where a space follows what is none; lo and hi where there is none."""
        a, b = text.rfind(" ", lo, mid), text.find(" ", mid + 1, hi)
        while a > lo and text[a - 1].isspace():
            a = text.rfind(" ", lo, a)
        while b > 0 and text[b - 1].isspace():
            b = text.find(" ", b + 1, hi)
        return max(a, lo), b if b > 0 else hi

    def _count(self, tokens, size: int) -> int:
        n = 0
        for t in tokens:
            if size <= 0:
                break
            size -= len(self.bytes_of[t])
            n += 1
        return n

    # one run without a place to cut: match by match, long matches as trees of bytes

    def _run(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.pattern.finditer(text):
            raw = m[0].encode()
            out += self.leaf(m[0]) if len(raw) <= LEAF_CHARS else self.piece(raw)
        return out

    def piece(self, raw: bytes) -> list[int]:
        """Encoding of the bytes of one match."""
        if len(raw) <= LEAF_BYTES:
            return self._merge(raw)
        mid = len(raw) // 2
        left, right = self.piece(raw[:mid]), self.piece(raw[mid:])
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            inner = b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j])
            window = self._merge(inner)
            holds_left = i == len(left) or self.stay(left[-i - 1], window[0])
            holds_right = j == len(right) or self.stay(window[-1], right[j])
            if holds_left and holds_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i * 2 if not holds_left else i, j * 2 if not holds_right else j

    def _stay(self, a: int, b: int) -> bool:
        return self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _merge(self, raw: bytes) -> list[int]:
        """Merges in order of rank, the first of equal ones first."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        none = len(self.ranks)
        rank = [self.ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while rank:
            i = min(range(len(rank)), key=rank.__getitem__)
            if rank[i] == none:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i < len(rank):
                rank[i] = self.ranks.get(parts[i] + parts[i + 1], none)
            if i:
                rank[i - 1] = self.ranks.get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    # back

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join([self.bytes_of[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(4)
def tree(path: str) -> TreeBpe:
    return TreeBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every text and decode it again: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (bytes).

    docs has doc_id and text; other columns are not read. path is a file of ranks that every executor has. Each task
    works on blocks of texts; every text of more than 128 characters is a tree. Defined cases: a null or empty text has no tokens and decodes
    to no bytes; each of repeated rows is encoded; white space and white-space-free runs of any length are
    exact; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree(path)
        for batch in batches:
            data, offsets = bytetext.column(batch.column(1))
            for i, j in bytetext.blocks(offsets, BLOCK_BYTES):
                count, ids, decoded = [], [], []
                for k in range(i, j):
                    tokens = bpe.encode(data[offsets[k] : offsets[k + 1]].tobytes().decode())
                    count.append(len(tokens))
                    ids.append(np.array(tokens, "<u4").tobytes())
                    decoded.append(bpe.decode(tokens))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(count, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(bytetext.tidy(run), f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary")
