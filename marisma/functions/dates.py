"""Dates that arrive as text, in several layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_datetime(x: Column) -> Column:
    """Timestamp of a text: eight digits (alone or before T: that midnight), ISO with or without offset, else RFC 822; null if none fits.

    The week day of RFC 822 is not looked at.
    """
    t = F.trim(x.cast("string"))
    compact = F.when(t.rlike(r"^\d{8}($|T)"), F.try_to_timestamp(F.substring(t, 1, 8), F.lit("yyyyMMdd")))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(F.substring(t, 1, 19))))
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|UT)$", " +0000")
    return F.coalesce(compact, iso, F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")))


def iso(x: Column) -> Column:
    """Timestamp of a text that begins with an ISO date; null for other layouts."""
    t = F.trim(x.cast("string"))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(F.substring(t, 1, 19))))


def day(published: Column, collected: Column) -> Column:
    """The date of publication, else of collection."""
    return F.to_date(F.coalesce(parse_datetime(published), parse_datetime(collected)))


def lag_seconds(newest: Column, now: Column) -> Column:
    """Seconds from newest to now, not below 0."""
    return F.greatest(F.lit(0).cast("bigint"), F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(newest.cast("timestamp")))
