"""Line deduplication across documents, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.llm.scratch import keep

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop lines that many documents share from all of them but the one with the largest doc_id.

    docs has doc_id and text; it may have other columns. A line whose key has at least min_chars code
    points and stands in at least min_docs documents stays only in the largest of their doc_ids, in all
    places there. Adds n_lines and n_dropped and replaces text by the lines that stay, joined by "\\n";
    an input column of one of these two names is replaced.

    Defined cases: a null text counts as one empty line and becomes empty; all rows with a null doc_id
    count as one document, below every other; rows that repeat a doc_id count as one document and each
    is rewritten by its own lines; an empty table gives an empty table. The largest doc_id is unique,
    so there are no ties.

    Texts are moved once. What is counted and joined is a 16-byte hash for each line long enough;
    counts are combined before each exchange, so that a line of a third of all documents is one row of
    each task, and the join on hashes is one whose large partitions adaptive execution splits.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("content"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "content", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    lines = keep(lines.select("doc_id", "content", "pos", F.unhex(F.md5("key")).alias("hash")), "lines")
    shared = lines.groupBy("hash", "doc_id").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("owner")).where(F.col("n") >= min_docs).select("hash", "owner")
    shared = keep(shared, "shared-lines")  # read back, so that both sides of the join come straight from an exchange
    drops = lines.join(shared, "hash").where(~F.col("doc_id").eqNullSafe(F.col("owner"))).groupBy(F.col("doc_id").alias("drop_id"), F.col("content").alias("drop_content")).agg(F.collect_set("pos").alias("drops"))

    whole = docs.select("doc_id", text.alias("whole"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in extra]).alias("extra"), F.xxhash64(text).alias("own_content"))
    whole = whole.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("own_content") == F.col("drop_content")), "left")
    split = F.split("whole", "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("drops"))
    # the one-element array binds the split lines once for all positions
    text_of = F.transform(F.array(split), lambda all_lines: F.array_join(F.transform(stays, lambda p: F.element_at(all_lines, p + 1)), "\n"))[0]
    return whole.select(
        "doc_id",
        F.when(F.col("drops").isNull(), F.col("whole")).otherwise(text_of).alias("text"),
        *[F.col("extra")[c].alias(c) for c in extra],
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
