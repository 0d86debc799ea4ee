"""Exact deduplication as a stateful stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.llm.scratch import keep, place

SPACE = " \t\n\x0b\x0c\r"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else each state partition reserves some megabytes of disk before it holds anything
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def bare(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha(bare: Column) -> Column:
    return F.unhex(F.sha2(bare, 256))


def _located(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows with their normalised text, its digest, and the place of the row in the files."""
    return rows.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).alias("chars"),
        bare(F.col("text")).alias("bare"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"),
    ).withColumn("digest", digest(F.col("bare")))


def _rank() -> Column:
    """The smallest of these stays: most code points, then the smallest doc_id (null last), then the first place."""
    return F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("place"))


def dedup_stream(spark: SparkSession, path: str, max_batch_bytes: int = 256 << 20, state: str | None = None, digest: Callable[[Column], Column] = sha) -> DataFrame:
    """Deduplicate the Parquet table at path (doc_id, text, ...) by normalised text, as one run of a stream.

    New files are read in micro-batches of about max_batch_bytes. The stream's keyed state lies in RocksDB on
    disk and never expires. For each digest it retains the digest, the doc_id and length of the row that
    stays so far, that row's content locator (file and row number) and a count; a batch is combined before
    it is exchanged, so a text that fills a third of the table is one row of each task.

    state is a folder that every executor reaches, for the stream's checkpoint and its log of changed keys. A later run with the same
    folder, or a run after one that was stopped, reads only what is new: the state holds all rows before. A batch that was stopped
    is done again and its log replaced. Without a folder each call starts anew. digest is what texts are keyed by.

    On hits (digests of more than one row) the full normalised bytes of each row are compared with those
    found at the locator. Rows that differ, which a collision of digests would need, are grouped by
    their bytes instead.

    Returns one row for each row: doc_id, keep_id, group_size, kept, text_sha256. Defined cases: a null or
    empty text is an empty text, and all of these are one group; a null doc_id comes after every other; of
    rows that repeat doc_id and text, the first in file order stays; other columns are not read; an empty table
    gives an empty table.
    """
    table = spark.read.parquet(path)
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    own = state.rstrip("/") if state else place(spark, "dedup-state")
    log = f"{own}/log"
    try:
        stream = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", max_batch_bytes).parquet(_watched(spark, path))
        states = _located(stream, digest).groupBy("digest").agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("n"))
        states.writeStream.outputMode("update").option("checkpointLocation", f"{own}/checkpoint").trigger(availableNow=True).foreachBatch(
            lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{log}/{i}")
        ).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    logged = spark.read.schema(states.withColumn("batch", F.lit(0)).schema)
    logged = logged.parquet(f"{log}/*") if _exists(spark, log) else spark.createDataFrame([], states.withColumn("batch", F.lit(0)).schema)
    last = logged.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "batch").alias("last")).select("digest", "last.*")

    rows = _located(spark.read.parquet(path), digest)
    hits = keep(rows.join(last.where("n > 1"), "digest").select("digest", "bare", "place", "chars", "doc_id", "n", (F.col("place") == F.col("best.place")).alias("at_locator")), "dedup-hits")
    # a large group meets its locator's bytes in several parts of about 500 rows
    parts = F.ceil(F.col("n") / 500)
    at_locator = hits.where("at_locator").select("digest", F.col("bare").alias("found"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    compared = hits.where("not at_locator").withColumn("part", F.pmod(F.xxhash64("place"), parts))
    # unlike bytes under one digest: whole groups of such digests are told apart by their bytes
    unlike = compared.join(at_locator, ["digest", "part"]).where(F.col("bare") != F.col("found")).select("digest").distinct()
    told = hits.join(unlike, "digest", "left_semi")
    own = told.groupBy("digest", "bare").agg(F.min(_rank()).alias("own_best"), F.count(F.lit(1)).alias("own_n"))
    apart = told.join(own, ["digest", "bare"]).select("place", "own_best", "own_n")

    out = rows.select("doc_id", "digest", "place").join(last, "digest").join(apart, "place", "left").select(
        "doc_id",
        "place",
        "digest",
        F.coalesce("own_best", "best").alias("best"),
        F.coalesce("own_n", "n").alias("n"),
    )
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == F.col("best.place")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _watched(spark: SparkSession, path: str) -> str:
    """A stream takes folders and patterns; a table that is one file is named by a pattern that fits it alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return f"{path[:-1]}[{path[-1]}]" if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile() else path


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
