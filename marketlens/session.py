"""Session settings the engine relies on, and where lineage may be cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs a later exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    A machine's own folder is taken for local masters alone, where driver and executors are one
    process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not _is_local(sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="marketlens-"))
    return sc.getCheckpointDir()


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so that later reads see one fixed version."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, and read from there.

    Later steps read one fixed version whatever executors are lost, and the optimizer knows its size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def batches_of(spark: SparkSession, size: int) -> AbstractContextManager[None]:
    """Batches for Python of at most ``size`` bytes and a row while jobs run inside; by default only rows are bounded."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of what is written inside go when its last task ends, not when the driver next collects its garbage.

    For writes, which are planned anew each time; a DataFrame that is collected inside and again
    later would have its shuffles computed twice.
    """
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
