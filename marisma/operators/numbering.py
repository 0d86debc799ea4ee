"""Row numbers over whole tables, and finding rows by whatever a user types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.operators import gazetteer
from marisma.session import shared_checkpoints

PREFIX = "CNT-"


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the place of each row in an order of the whole table: 1, 2, 3 and so on, without gaps.

    Rows go to ranges of the order, are sorted inside them and written once; counts of ranges, one row a task, tell where each begins. No task sees more than its
    range. Rows that the order doesn't tell apart are numbered as they lie.
    """
    spark = rows.sparkSession
    shared_checkpoints(spark)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).checkpoint()
    start, offsets = 0, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("_part").agg(F.count(F.lit(1))).collect()):
        offsets.append((part, start))
        start += n
    begins = spark.createDataFrame(offsets, "_part int, _start bigint")
    return placed.join(F.broadcast(begins), "_part").select(*rows.columns, (F.col("_start") + F.col("_at") + 1).alias(name))


def unquoted(x: Column) -> Column:
    """What stands behind %xx, without white space at the ends; the text itself where that is no address."""
    return F.trim(F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))


def candidates(raw: Column) -> Column:
    """The ids that a typed text may mean, in the order they are tried: itself, and with or without the prefix of ids."""
    bare = F.substring(raw, len(PREFIX) + 1, 1 << 20)
    has = F.lower(raw).startswith(PREFIX.lower())
    more = F.when(has, F.array(F.concat(F.lit(PREFIX), bare), F.concat(F.lit(PREFIX.lower()), bare), bare)).when(raw.rlike("^[a-zA-Z0-9]+$"), F.array(F.concat(F.lit(PREFIX), raw))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(F.array(raw), more)), lambda c: c != "")


def resolved(asked: DataFrame, typed: str, rows: DataFrame, key: str, number: str, place: str) -> DataFrame:
    """asked with the key of the row each typed text means, and how it was found; null where it means none.

    Ways in order: each candidate as it is (0, 2, 4, ...), then in any case (1, 3, ...), the number of a row (100), the place in the listing (101). All are
    equality joins of one row for each candidate; the first way counts, of rows that one way finds the smallest key.
    """
    q = asked.select(F.col(typed).alias("typed")).distinct().withColumn("raw", unquoted(F.coalesce("typed", F.lit(""))))
    tried = q.select("typed", F.posexplode(candidates(F.col("raw"))).alias("turn", "c"))
    ids = rows.select(F.col(key).alias("_key"), F.lower(key).alias("_low"))
    found = tried.join(ids, F.lower("c") == F.col("_low")).select("typed", (2 * F.col("turn") + F.when(F.col("c") == F.col("_key"), 0).otherwise(1)).alias("how"), "_key")
    digits = q.where(F.col("raw").rlike("^[0-9]{1,18}$")).select("typed", F.col("raw").cast("bigint").alias("_n"))
    for how, column in ((100, number), (101, place)):
        found = found.union(digits.join(rows.select(F.col(column).cast("bigint").alias("_n"), F.col(key).alias("_key")), "_n").select("typed", F.lit(how).alias("how"), "_key"))
    best = found.groupBy(F.col("typed").alias("_typed")).agg(F.min(F.struct("how", "_key")).alias("best"))
    return asked.join(best, F.col(typed).eqNullSafe(F.col("_typed")), "left").select(*asked.columns, F.col("best._key").alias(key), F.col("best.how").alias("how"))


def resolved_images(asked: DataFrame, typed: str, images: DataFrame, key: str, storage: str, digest: str, least: int = 6) -> DataFrame:
    """asked with the key of the image each typed text means: its key (0), else, from `least` characters on that are not all digits, a part of the storage key or the beginning of the digest (1).

    Parts are looked for by an automaton of the typed texts, so an image is read once however many are asked for.
    """
    q = asked.select(F.col(typed).alias("typed")).where("typed <> ''").distinct()
    exact = q.join(images.select(F.col(key).alias("_key")), F.col("typed") == F.col("_key")).select("typed", F.lit(0).alias("how"), "_key")
    parts = q.where((F.length("typed") >= least) & ~F.col("typed").rlike("^[0-9]+$"))
    terms = parts.select(F.lower("typed").alias("term"), F.col("typed").alias("canonical"), F.lit("part").alias("kind"), F.lit(None).cast("string").alias("edge"))
    inside = gazetteer.mentions(images, key, F.col(storage), terms).select(F.col("canonical").alias("typed"), F.lit(1).alias("how"), F.col(key).alias("_key"))
    begins = gazetteer.mentions(images, key, F.col(digest), terms).where("at = 0").select(F.col("canonical").alias("typed"), F.lit(1).alias("how"), F.col(key).alias("_key"))
    best = exact.union(inside).union(begins).groupBy(F.col("typed").alias("_typed")).agg(F.min(F.struct("how", "_key")).alias("best"))
    return asked.join(best, F.col(typed) == F.col("_typed"), "left").select(*asked.columns, F.col("best._key").alias(key), F.col("best.how").alias("how"))
