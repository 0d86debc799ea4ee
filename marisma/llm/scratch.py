"""Tables written between steps, in a folder that every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

from marisma.session import own_folder

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of this process only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if "dir" not in _own:
        _own["dir"] = own_folder(spark, "marisma-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that keep() wrote and that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    jvm = spark._jvm
    parent = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).delete(parent, True)
