"""A stream that keeps two tables alike: the store and a mirror that may come later or get lost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marisma.streaming import folders

Sink = Callable[[DataFrame, str, int], None]


def backfill(store: str, mirror: str, like: DataFrame, but: int) -> bool:
    """Copies the batches of the store, all but one, into a mirror that has not been filled yet. Returns whether it did.

    The copy is one folder with a mark at its end, so a copy that broke off is made again as a whole.
    """
    spark = like.sparkSession
    if folders.whole(spark, f"{mirror}/batch={folders.BEFORE}"):
        return False
    folders.write(folders.read(spark, store, like.schema, but), mirror, folders.BEFORE)
    return True


def mirrored(rows: DataFrame, key: str, order: str, store: str, mirror: str, checkpoint: str, audit: str | None = None, sink: Sink = folders.write) -> StreamingQuery:
    """Starts a stream that writes each row with a key the store lacks, the first by order of a batch, to the store and to the mirror, for all that is there.

    Both are written under the number of the batch. Spark repeats a batch that failed with the same number and rows: the first write is replaced by an
    equal one, the rows of that batch not being looked for in the store, and the second one follows, so that nothing is lost or doubled. A mirror that is
    empty gets all earlier batches before its first one. Rows with a null key have none and are all written. audit names a table
    with a row for each batch: batch, stored, backfilled.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = folders.read(spark, store, batch.schema, number).select(key)
        keyed = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*batch.columns), F.struct(order, *batch.columns)).alias("r")).select("r.*")
        fresh = keyed.join(known, key, "left_anti").select(*batch.columns).unionByName(batch.where(F.col(key).isNull()))
        sink(fresh, store, number)
        filled = backfill(store, mirror, batch, number)
        # what the store holds of this batch is what goes on
        done = spark.read.schema(batch.schema).parquet(f"{store}/batch={number}")
        sink(done, mirror, number)
        if audit:
            folders.write(done.agg(F.count(F.lit(1)).alias("stored")).withColumns({"number": F.lit(number), "backfilled": F.lit(filled)}), audit, number)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
