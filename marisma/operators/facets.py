"""Counts by facet, over time and by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(rows: DataFrame, key: str, wanted: DataFrame, order: str = "pos") -> DataFrame:
    """Counts of the wanted keys, zero where there are no rows, in their order."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, key, "left").select(order, key, F.coalesce("n", F.lit(0)).alias("n"))


def dense_daily(rows: DataFrame, day: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """One row for each day from the first to the last: count (0 where missing), missing flag, and measures (null where missing)."""
    got = rows.groupBy(day).agg(F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in (measures or {}).items()])
    ends = rows.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    spine = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias(day))
    return spine.join(got, day, "left").select(day, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"), *(measures or {}))


def chart_window(rows: DataFrame, day: str, default_days: int = 90, most_days: int = 400) -> DataFrame:
    """First and last day of a chart: the last day of the data, and at most default_days before it."""
    ends = rows.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return ends.select(F.greatest("a", F.date_sub("b", min(default_days, most_days))).alias("first_day"), F.col("b").alias("last_day"))


def buckets(score: Column) -> Column:
    """Six risk buckets; no score is one of them."""
    return F.when(score.isNull(), "sin_riesgo").when(score <= 20, "0-20").when(score <= 40, "21-40").when(score <= 60, "41-60").when(score <= 80, "61-80").otherwise("81-100")


def quality(rows: DataFrame, main_source: str, short: int = 500) -> DataFrame:
    """How complete articles are: counts and rounded percents, in one pass."""
    n = F.count(F.lit(1))
    percent = lambda c: F.when(n == 0, 0).otherwise(F.bround(c * 100.0 / n, 0)).cast("bigint")
    bare = F.count_if((F.length("text") < short) | F.col("text").isNull())
    main = F.count_if(F.col("source") == main_source)
    return rows.agg(n.alias("total"), bare.alias("no_body"), main.alias("main"), percent(bare).alias("no_body_percent"), percent(main).alias("main_percent"))


def last_counts(daily: DataFrame, day: str, n: str, keep: int) -> DataFrame:
    """The counts of the last days as one array, oldest first; [0] without any."""
    last = daily.orderBy(F.desc(day)).limit(keep)
    return last.agg(F.array_sort(F.collect_list(F.struct(day, n))).alias("s")).select(F.when(F.size("s") > 0, F.transform("s", lambda x: x[n])).otherwise(F.array(F.lit(0).cast("bigint"))).alias("counts"))


def share_of_total(counts: DataFrame, n: str) -> DataFrame:
    """Adds the share of each row in the sum of n (one row is added up, and joined to all)."""
    total = counts.agg(F.sum(n).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(*counts.columns, F.round(F.col(n) * 100.0 / F.col("total"), 4).alias("percent"))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark drops rows beyond k before the exchange too."""
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= k)
