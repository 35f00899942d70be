"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from marketlens.session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, and read from there.

    Later steps read one fixed version whatever executors are lost, only the columns they need,
    and the optimizer knows its size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
