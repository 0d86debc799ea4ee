"""Sessions: a builder for own use, and the package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Spark sends Python 10,000 rows at once, however long their texts are, unless their bytes are bounded too.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def session(app: str = "marisma", **conf: str) -> SparkSession:
    """A session with the settings that the library's results rely on: UTC, ANSI, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """From now on this session gives Python about BATCH_BYTES at once; a bound that its owner set stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once for each application; a driver started from a checkout needs no installation."""
    small_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    at = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="marisma-code-")), "marisma.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def own_folder(spark: SparkSession, prefix: str) -> str:
    """A folder of this process for what every executor has to reach: only where driver and executors are one, as in tests."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor reaches")
    return tempfile.mkdtemp(prefix=prefix)


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that spark.checkpoint.dir names; to one of this process only where it is unset and the master is local."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(own_folder(spark, "marisma-checkpoints-"))
