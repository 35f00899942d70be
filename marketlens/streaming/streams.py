"""Streaming forms: change detection, announce-once, daily series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from marketlens.plans.ingest import Policy, change_rows, diff_offers, fold_offers, fresh_ids, merge_state
from marketlens.sources import tables
from marketlens.sources.parts import PartedTable


def state_table(folder: str, schema: StructType, keys: Sequence[str], parts: int = 16) -> PartedTable:
    return PartedTable(f"{folder}/state", schema, keys, parts)


def stream_changes(
    offers: DataFrame, folder: str, initial: Callable[[SparkSession], DataFrame], keys: Sequence[str], *, order: str, as_of: Callable[[DataFrame], Column],
    policy: Policy, fk: str = "entity_id", parts: int = 16,
):
    """Change rows and state from a stream of offers; returns a writer to start.

    State is kept by key in ``parts`` (as many as leave a part at about a file). A micro-batch reads and rewrites only the parts its keys
    fall into and goes through the batch difference against them, so a key with many offers is
    no burden, a key in another part costs nothing, and the outcome is that of the batch
    operator. State and changes are written per batch id: a batch that is run again replaces
    its own output.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = initial(spark)
        state = state_table(folder, first.schema, keys, parts)
        # Batch ``n`` reads version ``n`` and writes the next; version 0 is what there was before.
        if batch_id == 0:
            state.write(first, 0)
        touched = state.touched(batch)
        stored = state.read(spark, batch_id, touched)
        now = as_of(batch)
        diffed = diff_offers(batch, stored, keys, order, "last_price", "last_available")
        top = F.lit(state.top(spark, batch_id)).cast("long")
        folded = fold_offers(batch, keys, order, policy)
        merged = merge_state(stored, folded, keys, policy, now, fresh_ids(stored, folded, keys, top))
        state.write(merged, batch_id + 1, touched, before=batch_id)
        known = state.read(spark, batch_id + 1, touched)
        tables.publish(change_rows(diffed, known, keys, order, "last_price", "last_available", now, fk), folder, "changes", batch_id)

    return offers.writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{folder}/progress")


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/changes").drop("version")


def stream_alert_dedup(deals: DataFrame, key: str, ts: str, days: int = 90, spread: int = 16) -> DataFrame:
    """Each listing once within ``days``.

    Copies of one listing are first thinned out in ``spread`` shares, so that the task that
    settles a much-copied listing sees at most that many rows of it. Which share a copy falls
    into does not matter for the result.
    """
    thinned = (
        deals.select(key, ts)
        .withWatermark(ts, f"{days} days")
        .withColumn("_share", F.floor(F.rand() * spread))
        .dropDuplicatesWithinWatermark([key, "_share"])
    )
    return thinned.dropDuplicatesWithinWatermark([key]).drop("_share")


def stream_daily_series(rows: DataFrame, ts: str, group: str, price: str, lateness: str = "1 day") -> DataFrame:
    """Per day and group: rows, mean and lowest positive price. A day is final once it is too late for more."""
    positive = F.when(F.col(price) > 0, F.col(price))
    counted = rows.withWatermark(ts, lateness).groupBy(F.window(ts, "1 day"), group).agg(
        F.count("*").alias("count"), F.avg(positive).alias("avg_price"), F.min(positive).alias("min_price")
    )
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), group, "count", "avg_price", "min_price")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Runs a stream over everything available and stops."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
