"""Recording job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketlens import catalog
from marketlens.functions import scores
from marketlens.operators import joins, windows


def record_jobs(runs: DataFrame, new: DataFrame, order: str = "ended_at") -> DataFrame:
    """Appends runs; an illegal status is stored as error, ``alert`` marks steps into warn or error."""
    legal = new.withColumn("status", scores.one_of(F.col("status"), catalog.JOB_STATUS, "error")).drop("id")
    numbered = joins.next_ids(legal, runs, [F.col(order), F.col("job")])
    both = runs.withColumn("recorded_now", F.lit(False)).unionByName(numbered.withColumn("recorded_now", F.lit(True)), allowMissingColumns=True)
    return windows.status_transitions(both).withColumn("alert", F.col("alert") & F.col("recorded_now")).drop("prev_status", "recorded_now")
