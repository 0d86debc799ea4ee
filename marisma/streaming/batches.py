"""Micro-batches over file sources."""

from __future__ import annotations

import uuid

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marisma.session import own_folder
from marisma.streaming import folders


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling_counts(events: DataFrame, ts: str, width: str, late: str, by: str) -> DataFrame:
    """Counts in event-time windows; rows later than the watermark are dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))


def dedup_batches(rows: DataFrame, key: str, order: str, target: str, checkpoint: str) -> None:
    """Append rows with keys that the target lacks, the first of each batch; memory is the keys of the target itself and never expires.

    A batch is a folder of the target (folders.read), so one that is repeated after a failure replaces itself, rows with a null key, which are none, included.
    """

    def write(batch: DataFrame, number: int) -> None:
        known = folders.read(batch.sparkSession, target, batch.schema, number).select(key)
        first = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        folders.write(first.join(known, key, "left_anti").select(*batch.columns).unionByName(batch.where(F.col(key).isNull())), target, number)

    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def peer_batches(anchors: DataFrame, near: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """The peers of anchors that come as a stream, among rows that are at rest: near gets each batch of anchors (relations.peers or stories.peers with the rows), its result is a folder of the target."""

    def write(batch: DataFrame, number: int) -> None:
        folders.write(near(batch), target, number)

    anchors.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def run_to_files(result: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run a stream of one aggregate by keys over all that is there and return its result; no row of it comes to the driver.

    Each batch writes the keys that it changed to the shared folder; of each key the row of the last batch counts.
    """
    spark = result.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{own_folder(spark, 'marisma-')}"
    target = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema, whole = result.schema, StructType([*result.schema.fields, StructField("batch", IntegerType())])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    result.writeStream.outputMode("update").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    try:
        rows = spark.read.option("basePath", f"{target}/rows").schema(whole).parquet(f"{target}/rows")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    last = F.max_by(F.struct(*[c for c in result.columns if c not in keys]), "batch").alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, "r.*").select(*result.columns)


def failure_counts(rows: DataFrame, key: str, at: str, ok: str) -> DataFrame:
    """A stream of key, runs, failures: after each batch how many runs of a key there were and how many of the last ones failed in a row.

    The state of a key is these two numbers and is kept for good; a batch of a key is put in order of time first.
    """

    def count(name, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        runs, failures = state.get if state.exists else (0, 0)
        got = pd.concat(list(parts)).sort_values("at", kind="stable")["ok"].to_numpy()
        good = got.nonzero()[0]
        runs, failures = runs + len(got), len(got) - 1 - int(good[-1]) if len(good) else failures + len(got)
        state.update((runs, failures))
        yield pd.DataFrame({key: [name[0]], "runs": [runs], "failures": [failures]})

    kind = rows.schema[key].dataType.simpleString()
    some = rows.select(key, F.col(at).alias("at"), F.col(ok).alias("ok"))
    return some.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, runs bigint, failures bigint", "runs bigint, failures bigint", "update", "NoTimeout")
