"""Series over time that are shown together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Beyond so many days, or so many days with something, a series is shown by month; so many series are shown; from this share on a week stands out.
MOST_DAYS, MOST_POINTS, SHOWN, DOMINANT = 90, 18, 4, 0.45


def bucketed(daily: DataFrame, group: str, day: str, n: str) -> DataFrame:
    """group, bucket, n: days of groups that are short, months ("2026-01") of those that span more than MOST_DAYS or have more than MOST_POINTS days; days without anything are left out."""
    live = daily.where((F.col(n) > 0) & F.col(day).isNotNull())
    wide = live.groupBy(F.col(group).alias("_g")).agg((F.datediff(F.max(day), F.min(day)) > MOST_DAYS).alias("a"), (F.count(F.lit(1)) > MOST_POINTS).alias("b")).select("_g", (F.col("a") | F.col("b")).alias("_by_month"))
    rows = live.join(wide, F.col(group) == F.col("_g"))
    bucket = F.date_format(day, "yyyy-MM-dd")
    return rows.groupBy(group, F.when(F.col("_by_month"), F.substring(bucket, 1, 7)).otherwise(bucket).alias("bucket")).agg(F.sum(n).alias("n"))


def aligned(daily: DataFrame, group: str, day: str, n: str, most: int = SHOWN) -> DataFrame:
    """bucket, group, n of the `most` largest groups (ties by name): every bucket that one of them has, 0 where another hasn't.

    Each group has buckets of its own width, as it would have alone; together they are a full outer join on the bucket's name.
    """
    live = daily.where(F.col(n) > 0)
    shown = live.groupBy(group).agg(F.sum(n).alias("_total")).orderBy(F.desc("_total"), group).limit(most).select(group)
    points = bucketed(live.join(F.broadcast(shown), group, "left_semi"), group, day, n)
    # a handful of groups by the names of their buckets
    spine = points.select("bucket").distinct().crossJoin(F.broadcast(shown))
    return spine.join(points, ["bucket", group], "left").select("bucket", group, F.coalesce("n", F.lit(0)).alias("n"))


def peak(lines: DataFrame, group: str) -> DataFrame:
    """The highest point of aligned series, one row or none: the first bucket of equal ones, then the first group."""
    return lines.where("n > 0").agg(F.min(F.struct((-F.col("n")).alias("m"), "bucket", group)).alias("p")).where("p is not null").select("p.bucket", f"p.{group}", (-F.col("p.m")).alias("n"))


def dominant_week(daily: DataFrame, day: str, n: str, total: Column | None = None) -> DataFrame:
    """The Monday of the week with most, and its count, where it has DOMINANT of the total or more; no row if there are fewer than two weeks or days, or fewer than four in all."""
    live = daily.where(F.col(n) > 0).groupBy(F.to_date(F.date_trunc("week", day)).alias("week")).agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("days"))
    top = live.agg(F.min(F.struct((-F.col("n")).alias("m"), "week")).alias("top"), F.count(F.lit(1)).alias("weeks"), F.sum("days").alias("days"), F.sum("n").alias("own"))
    whole = F.col("own") if total is None else total
    return top.where((F.col("weeks") >= 2) & (F.col("days") >= 2) & (whole >= 4) & (-F.col("top.m") >= DOMINANT * whole)).select("top.week", (-F.col("top.m")).alias("n"))
