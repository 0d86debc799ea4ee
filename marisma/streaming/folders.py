"""Tables of which every micro-batch is a folder of its own: a batch that is repeated replaces what it wrote before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

#: The number of rows that were there before the first batch.
BEFORE = -1


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def write(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were written to their end."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch=") and whole(spark, f"{path}/{n}"))


def read(spark: SparkSession, path: str, schema: StructType, but: int | None = None) -> DataFrame:
    """All rows of the batches that were written to their end, without the one numbered `but`; none where there is no folder."""
    some = [f"{path}/batch={n}" for n in batches(spark, path) if n != but]
    if not some:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", path).schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(*some).drop("batch")
