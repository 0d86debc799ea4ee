"""Feeds and landed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marisma.functions import text

#: What an item or an entry may hold; the link of an entry is an attribute.
_RSS = "title string, link string, description string, summary string, `content:encoded` string, content string, pubDate string, published string, updated string, `dc:date` string, author string, `dc:creator` string"
_ATOM = "title string, link struct<_href: string, _VALUE: string>, summary string, content string, published string, updated string, author struct<name: string>"


def _first(rows: DataFrame, *columns: str) -> Column:
    return F.coalesce(*[text.non_empty(F.col(f"`{c}`")) for c in columns if c in rows.columns])


def _items(rows: DataFrame, link: Column, author: Column) -> DataFrame:
    body = F.coalesce(_first(rows, "description", "summary", "content:encoded", "content"), F.lit(""))
    return rows.select(
        F.input_file_name().alias("feed"), F.trim("title").alias("title"), F.trim(link).alias("link"), text.strip_html(body).alias("text"), _first(rows, "pubDate", "published", "updated", "dc:date").alias("published"), author.alias("author"),
    ).where(text.non_empty(F.col("link")).isNotNull())


def feed_items(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Items of RSS and entries of Atom files: feed, title, link, text, published, author.

    Text and date are the first of several elements that is not empty; items without a link are left out, and so are entries of a file that has
    items; `most` for each feed, in order of the date as text.
    """
    rss = spark.read.schema(_RSS).option("rowTag", "item").xml(path)
    rss = _items(rss, F.col("link"), _first(rss, "author", "dc:creator"))
    atom = spark.read.schema(_ATOM).option("rowTag", "entry").xml(path)
    atom = _items(atom, F.coalesce(text.non_empty(F.col("link._VALUE")), F.col("link._href")), F.col("author.name")).join(rss.select("feed").distinct(), "feed", "left_anti")
    out = rss.unionByName(atom)
    if most is None:
        return out
    turn = F.row_number().over(Window.partitionBy("feed").orderBy("published", "link"))
    return out.withColumn("turn", turn).where(F.col("turn") <= most).drop("turn")


def rss_items(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Items of RSS files: feed, title, link, text, published."""
    return feed_items(spark, path, most).drop("author")


def landed_json(spark: SparkSession, *paths: str) -> DataFrame:
    """Articles of landed query responses, one for each url: of several folders (recent, historical) the earlier counts, then the earlier file."""
    rows = None
    for i, path in enumerate(paths):
        part = spark.read.option("multiLine", True).json(path)
        part = part.select(F.lit(i).alias("tier"), F.input_file_name().alias("file"), F.explode("articles").alias("a")).select("tier", "file", "a.*")
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in ("tier", "file", "url")]
    return rows.where(text.non_empty(F.col("url")).isNotNull()).groupBy("url").agg(F.min_by(F.struct(*rest), F.struct("tier", "file")).alias("a")).select("url", "a.*")


def history_windows(spark: SparkSession, now: str, offset_days: int, lookback_days: int, n: int, hours: int = 24) -> DataFrame:
    """Past query windows of `hours` each, newest first, none starting before the look-back."""
    first = F.to_timestamp(F.lit(now)) - F.expr(f"make_dt_interval({offset_days})")
    rows = spark.range(n).select(F.col("id").alias("i"), (first - F.expr(f"make_dt_interval(0, {hours}) * id")).alias("until"))
    rows = rows.withColumn("since", F.col("until") - F.expr(f"make_dt_interval(0, {hours})"))
    return rows.where(F.col("since") >= F.to_timestamp(F.lit(now)) - F.expr(f"make_dt_interval({lookback_days})")).select("i", "since", "until")
