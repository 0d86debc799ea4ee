"""Identities made from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marisma.functions.text import normalise


def sha(x: Column) -> Column:
    return F.sha2(x, 256)


def content_id(url: Column, fallback: Column) -> Column:
    """CNT- and twelve hex digits of the url, else of the fallback."""
    key = F.coalesce(F.nullif(F.trim(url), F.lit("")), F.nullif(fallback, F.lit("")), F.lit("inapp"))
    return F.concat(F.lit("CNT-"), F.substring(sha(key), 1, 12))


def text_sha(title: Column, body: Column) -> Column:
    return sha(normalise(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))))


def short_id(prefix: str, n: int, *parts: Column) -> Column:
    """prefix and n hex digits of the parts joined by colons."""
    return F.concat(F.lit(prefix), F.substring(sha(F.concat_ws(":", *parts)), 1, n))


def split_of(digest: Column) -> Column:
    """train, val or test (70, 15, 15 of a hundred) by the first eight hex digits of a digest."""
    n = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100
    return F.when(n < 70, "train").when(n < 85, "val").otherwise("test")


def hamming_bits(a: Column, b: Column, digits: int = 64) -> Column:
    """Bits in which two hex texts of `digits` digits differ, eight digits at a time."""
    out = F.lit(0)
    for i in range(1, digits, 8):
        x, y = (F.conv(F.substring(c, i, 8), 16, 10).cast("bigint") for c in (a, b))
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def similarity_percent(a: Column, b: Column, digits: int = 64) -> Column:
    return F.lit(100.0) * (F.lit(1.0) - hamming_bits(a, b, digits) / F.lit(4.0 * digits))
