"""Binary files: digests and perceptual hashes of images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, path: str, least: int = 64, most: int = 8 << 20) -> DataFrame:
    """Files between two sizes, with their SHA-256 and an id made from it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length").between(least, most))
    digest = F.sha2("content", 256)
    return rows.select("path", "length", digest.alias("sha256"), F.concat(F.lit("IMG-"), F.substring(digest, 1, 16)).alias("image_id"), "content")


# Kinds of pictures that are taken, by the bytes a file begins with.
PICTURES = {"image/jpeg": "ffd8ff", "image/png": "89504e470d0a1a0a", "image/gif": "47494638", "image/bmp": "424d"}


def picture_kind(content: Column) -> Column:
    """The kind of a picture by its first bytes, WebP among them; null for any other file, which is not taken."""
    head = F.lower(F.hex(F.substring(content, 1, 16)))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for kind, first in PICTURES.items():
        out = out.when(head.startswith(first), kind)
    return out


def class_counts(files: DataFrame, classes: DataFrame) -> DataFrame:
    """Files in each class folder, zero for classes without any."""
    of = files.select(F.element_at(F.split("path", "/"), -2).alias("class"))
    return classes.join(of.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class", "left").fillna(0, ["n"])


def byte_hash(raw: bytes | None) -> str | None:
    """256 bits of a byte string, without an image library: the means of 256 equal stretches against their median."""
    if not raw:
        return None
    data = np.frombuffer(raw, np.uint8).astype(np.float64)
    edges = np.linspace(0, len(data), 257).astype(int)
    sums = np.concatenate([[0.0], np.cumsum(data)])
    means = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(edges[1:] - edges[:-1], 1)
    return np.packbits(means > np.median(means)).tobytes().hex()


def average_hashes(pixels: np.ndarray) -> list[str]:
    """64 bits of each grey picture of (pictures, 64) values, eight by eight: which are above their mean."""
    return [x.tobytes().hex() for x in np.packbits(pixels > pixels.mean(1, keepdims=True), axis=1)]


def image_hash(content: Column) -> Column:
    """Hashes of byte strings; those of one length are taken together."""

    @F.pandas_udf("string")
    def hashes(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), index=x.index, dtype=object)
        for n, some in x[x.map(bool)].groupby(x.str.len()):
            data = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), int(n)).astype(np.float64)
            edges = np.linspace(0, int(n), 257).astype(int)
            sums = np.concatenate([np.zeros((len(data), 1)), np.cumsum(data, axis=1)], axis=1)
            means = (sums[:, edges[1:]] - sums[:, edges[:-1]]) / np.maximum(edges[1:] - edges[:-1], 1)
            out[some.index] = [b.tobytes().hex() for b in np.packbits(means > np.median(means, axis=1, keepdims=True), axis=1)]
        return out

    return hashes(content)


def grey_hash(content: Column) -> Column:
    """Average hash of raw grey pictures of 64 bytes (eight rows of eight); null for any other length."""

    @F.pandas_udf("string")
    def hashes(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), index=x.index, dtype=object)
        some = x[x.str.len() == 64]
        if len(some):
            out[some.index] = average_hashes(np.frombuffer(b"".join(some), np.uint8).reshape(-1, 64).astype(np.float64))
        return out

    return hashes(content)


def cosines(n: int) -> np.ndarray:
    """The matrix of the orthonormal DCT-II of n values."""
    k, i = np.mgrid[:n, :n]
    out = np.cos((2 * i + 1) * k * np.pi / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def wave_hashes(pixels: np.ndarray, size: int = 16) -> list[str]:
    """Perceptual hashes of grey pictures (pictures, 2 * size, 2 * size): which of the lowest size by size frequencies of their DCT-II are above their median, row by row; the mean brightness counts as the median."""
    c = cosines(2 * size)
    low = (c @ pixels @ c.T)[:, :size, :size].reshape(len(pixels), -1).copy()
    low[:, 0] = np.median(low, axis=1)
    return [x.tobytes().hex() for x in np.packbits(low > np.median(low, axis=1, keepdims=True), axis=1)]


def wave_hash(content: Column, size: int = 16) -> Column:
    """Perceptual hash of raw grey pictures of (2 * size) ** 2 bytes, size ** 2 / 4 hex digits; null for any other length."""
    side = 2 * size

    @F.pandas_udf("string")
    def hashes(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), index=x.index, dtype=object)
        some = x[x.str.len() == side * side]
        for i in range(0, len(some), 4096):
            part = some.iloc[i : i + 4096]
            out[part.index] = wave_hashes(np.frombuffer(b"".join(part), np.uint8).reshape(-1, side, side).astype(np.float64), size)
        return out

    return hashes(content)
