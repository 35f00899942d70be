"""Streams over the event table: each runs to the end of what is there and returns its table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlens.bindings.catalogue import _APPLIED, _CUT, _KEYED, _event_state
from marketlens.bindings.roles import stamp, table
from marketlens.session import shared_dir
from marketlens.streaming import streams


def _event_stream(spark, sf):
    """The event file as a stream; the clock is the events' own."""
    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark):
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def stream_changes(spark, sf):
    folder = _folder(spark)
    offers = _event_stream(spark, sf).where(F.col("ts") >= stamp("2024-01-01 12:00:00")).select(
        F.col("event_id").alias("pos"), F.col("user_id").alias("key"), F.when(F.col("event_type") != "signup", F.col("value")).alias("last_price"),
        F.when(F.col("event_type") != "error", 1).otherwise(0).alias("last_available"),
    )
    writer = streams.stream_changes(offers, folder, lambda s: _event_state(s, sf), ["key"], order="pos", as_of=lambda batch: stamp(_CUT), policy=_KEYED)
    writer.trigger(availableNow=True).start().awaitTermination()
    return streams.read_changes(spark, folder).select("entity_id", "pos", "price_old", "price_new", "available_old", "available_new", "change_type")


def stream_dedup(spark, sf):
    folder = _folder(spark)
    rows = _event_stream(spark, sf).select(F.col("user_id").alias("urn_id"), "ts")
    streams.run_to_table(streams.stream_alert_dedup(rows, "urn_id", "ts"), folder)
    return spark.read.parquet(f"{folder}/rows").select("urn_id")


def stream_daily(spark, sf):
    folder = _folder(spark)
    streams.run_to_table(streams.stream_daily_series(_event_stream(spark, sf), "ts", "event_type", "value"), folder)
    return spark.read.parquet(f"{folder}/rows")


QUERIES = {
    "stream_changes": (
        stream_changes,
        f"WITH {_APPLIED} SELECT ids.id AS entity_id, pos, price_old, price AS price_new, available_old, avail AS available_new, change_type FROM d JOIN ids USING (key) WHERE change_type <> 'unchanged'",
    ),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT user_id AS urn_id FROM events"),
    "stream_daily": (
        stream_daily,
        "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS count, avg(value) FILTER (value > 0) AS avg_price, min(value) FILTER (value > 0) AS min_price FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2",
    ),
}
