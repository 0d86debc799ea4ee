"""Queues between workers: a folder of messages each, drained in bounded batches."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marisma.streaming import folders

# The queues there are, and how many messages one drain takes at most.
QUEUES = ("ingest", "nlp", "image", "embedding", "evidence", "narrative")
LIMIT = 500
_MESSAGE = StructType([StructField("value", StringType())])
_TAKEN = StructType([StructField("n", LongType())])


def _named(root: str, name: str) -> str:
    if name not in QUEUES:
        raise ValueError(f"no queue of the name {name}")
    return f"{root.rstrip('/')}/{name}"


def enqueue(rows: DataFrame, root: str, name: str, most: int = LIMIT) -> None:
    """Each row becomes a message, a line of JSON; files hold `most` messages at most, so that a drain can stop between them."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").option("maxRecordsPerFile", most).text(f"{_named(root, name)}/messages/{uuid.uuid4().hex}")


def drain(spark: SparkSession, root: str, name: str, schema: StructType, handler: Callable[[DataFrame], DataFrame], files: int = 1) -> int:
    """Handles the next messages of a queue, those of its `files` oldest files; returns how many there were, 0 for an empty queue.

    The queue has a checkpoint of its own, so that a message is handled once, and a drain that broke off is repeated as it was. handler gets the
    messages that are objects of the schema as rows and returns what is kept of them, in done/; a message that is not is set aside in poison/ as it came.
    """
    at = _named(root, name)
    if not any(True for _ in _folders(spark, f"{at}/messages")):
        return 0
    source = spark.readStream.schema(_MESSAGE).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").text(f"{at}/messages")
    taken: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        whole = StructType([*schema.fields, StructField("_poison", StringType())])
        rows = batch.select("value", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_poison"}).alias("m")).persist()
        try:
            bad = F.col("m").isNull() | F.col("m._poison").isNotNull()
            folders.write(rows.where(bad).select("value"), f"{at}/poison", number)
            folders.write(handler(rows.where(~bad).select(*[F.col("m")[f.name].alias(f.name) for f in schema.fields])), f"{at}/done", number)
            folders.write(rows.agg(F.count(F.lit(1)).alias("n")), f"{at}/taken", number)
            taken.append(rows.count())
        finally:
            rows.unpersist()

    # one batch is wanted: the next one would begin an hour later
    query = source.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(processingTime="1 hour").foreachBatch(write).start()
    try:
        while query.isActive and not (query.status["message"].startswith("Waiting for next trigger") and not query.status["isTriggerActive"]):
            time.sleep(0.05)
    finally:
        failure = query.exception()
        query.stop()
    if failure is not None:
        raise failure
    return sum(taken)


def _folders(spark: SparkSession, path: str):
    fs, p = folders._fs(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def size(spark: SparkSession, root: str, name: str) -> int:
    """Messages that wait: all that came without those that a drain has taken."""
    at = _named(root, name)
    if not _folders(spark, f"{at}/messages"):
        return 0
    came = spark.read.schema(_MESSAGE).option("recursiveFileLookup", "true").text(f"{at}/messages").count()
    return came - (folders.read(spark, f"{at}/taken", _TAKEN).agg(F.sum("n")).first()[0] or 0)
