"""Parquet tables: versioned publishing, copying, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlens.operators.joins import common_columns, insert_or_ignore
from marketlens.session import shuffles_dropped


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def publish(df: DataFrame, folder: str, name: str, version: int, partition_by: Sequence[str] = ()) -> str:
    """Writes a new version of a table. A version without its success marker is not read."""
    path = f"{folder}/{name}/version={version:08d}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def latest_version(spark: SparkSession, folder: str, name: str) -> int | None:
    """Newest complete version of a table, None when there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = [
        int(s.getPath().getName().split("=")[1])
        for s in fs.listStatus(root)
        if s.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    return max(done) if done else None


def read_version(spark: SparkSession, folder: str, name: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}/version={version:08d}")


def copy_table(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with the source rows whose key it lacks, in the columns both share."""
    shared = common_columns(target, source, without=())
    order = [c for c in ("id",) if c in shared] or list(keys)
    return target.unionByName(insert_or_ignore(target, source.select(*shared), keys, order), allowMissingColumns=True)


REPORTS = (
    "db-products", "db-base-models", "db-storage-sizes", "db-standard-groups", "db-price-history", "subito-stats", "subito-sold-stats",
    "ebay-stats", "subito-ads", "subito-sold", "ebay-sold", "valuation-opportunities", "combined-latest", "sources",
)


def export_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """Writes each named report as a folder of JSON lines in gzipped files, which Spark reads by their names.

    Lines repeat the names of all columns, so plain files take some ten times the room. What a
    report has shuffled is dropped before the next one begins.
    """
    unknown = sorted(set(reports) - set(REPORTS))
    if unknown:
        raise ValueError(f"unknown reports: {unknown}")
    for name, df in reports.items():
        with shuffles_dropped(df.sparkSession):
            df.write.mode("overwrite").json(f"{folder}/{name}", compression="gzip")


def report_sizes(spark: SparkSession, folder: str, reports: Sequence[str] = REPORTS) -> DataFrame:
    """Rows of each written report. Reports are read as lines of text, so one without rows needs no columns."""
    out = None
    for name in reports:
        one = spark.read.text(f"{folder}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("report"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def dimension(df: DataFrame, column: str) -> DataFrame:
    return df.select("id", column).orderBy(F.col(column))
