"""Job logs and run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlens import catalog
from marketlens.operators.aggregates import last_segment
from marketlens.operators.ordering import number_rows

COVERAGE = "date date, coverage_pct double, verified long, skipped long, sold_new long"
CHUNK_METRICS = (
    "ts string, chunk long, ads_total long, sold long, blocked_403 long, cffi_active long, duration_s double, coverage_pct double"
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files with file and a line number without gaps."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_in_block"),
    )
    return number_rows(raw, [F.col("_block"), F.col("_in_block")], ["file"], out="line_no").drop("_block", "_in_block")


def read_job_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the last run of every log, with job and file time."""
    lines = read_lines(spark, path)
    named = lines.withColumn("job", F.regexp_replace(F.regexp_extract("file", r"([^/]+)\.log$", 1), "^source-", "scrape-"))
    return last_segment(named, ["job"], "line_no")


def started_at(lines: DataFrame, keys: Sequence[str], line_no: str = "line_no", pattern: str = catalog.LOG_STARTED) -> DataFrame:
    """Start time named by the first start line of each log."""
    told = F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    marked = lines.withColumn("_t", told)
    return marked.groupBy(*keys).agg(F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col(line_no))).alias("started_at"))


def first_match_line(lines: DataFrame, keys: Sequence[str], pattern: Column | str, line_no: str = "line_no") -> DataFrame:
    """First line of each log that fits the pattern, at most 200 characters of it."""
    hit = F.col("line").rlike("(?i)" + pattern) if isinstance(pattern, str) else pattern
    return lines.groupBy(*keys).agg(
        F.substring(F.trim(F.min_by("line", F.when(hit, F.col(line_no)))), 1, 200).alias("first_match")
    )


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COVERAGE).option("header", True).csv(path)


def read_chunk_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_METRICS).json(path)


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count("*").alias("runs"), F.min("coverage_pct").alias("min_pct"), F.avg("coverage_pct").alias("mean_pct"), F.max("coverage_pct").alias("max_pct"),
        F.sum("verified").alias("verified"), F.sum("sold_new").alias("sold_new"),
    )
