import datetime as dt

from pyspark.sql import functions as F

from marketlens.plans.ingest import Policy, apply_offers
from marketlens.sources.parts import PartedTable
from marketlens.streaming import streams

POLICY = Policy(last=("last_price", "last_available"))
SCHEMA = "pos long, key string, last_price double, last_available int"


def _state(spark):
    return spark.createDataFrame([(1, "a", 1.0, 1, None, None)], "id long, key string, last_price double, last_available int, first_seen timestamp, last_seen timestamp")


def test_stream_of_changes_equals_batch(spark, tmp_path):
    rows = [(i, "abc"[i % 3] if i % 5 else "a", float(i % 4), i % 2) for i in range(40)]
    source = str(tmp_path / "in")
    for n, part in enumerate((rows[:15], rows[15:30], rows[30:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    now = F.lit("2024-01-01").cast("timestamp")
    out = str(tmp_path / "out")

    def run():
        offers = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        streams.stream_changes(offers, out, _state, ["key"], order="pos", as_of=lambda _: now, policy=POLICY).trigger(availableNow=True).start().awaitTermination()

    run()
    state, changes, _ = apply_offers(_state(spark), spark.createDataFrame(rows, SCHEMA), now, keys=["key"], policy=POLICY)
    cols = ["pos", "price_old", "price_new", "available_old", "available_new", "change_type"]
    want = sorted(tuple(r) for r in changes.select(*cols).collect())
    got = sorted(tuple(r) for r in streams.read_changes(spark, out).select(*cols).collect())
    assert got == want
    kept = streams.state_table(out, _state(spark).schema, ["key"])
    last = kept.latest(spark)
    assert last == 3 and sorted(tuple(r) for r in kept.read(spark, last).collect()) == sorted(tuple(r) for r in state.select(*_state(spark).columns).collect())
    # Started again with nothing new, the stream adds nothing.
    run()
    assert sorted(tuple(r) for r in streams.read_changes(spark, out).select(*cols).collect()) == want


def test_dedup_and_late_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    schema = "urn_id string, ts timestamp, price double"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(schema).parquet(source)

    feed([("a", day(0), 1.0)] * 30 + [("b", day(1), 2.0)])
    streams.run_to_table(streams.stream_alert_dedup(stream(), "urn_id", "ts"), out)
    feed([("a", day(5), 1.0), ("c", day(6), 3.0)])
    streams.run_to_table(streams.stream_alert_dedup(stream(), "urn_id", "ts"), out)
    assert sorted(r["urn_id"] for r in spark.read.parquet(f"{out}/rows").collect()) == ["a", "b", "c"]

    daily = str(tmp_path / "daily")
    streams.run_to_table(streams.stream_daily_series(stream(), "ts", "urn_id", "price"), daily)
    feed([("a", day(0), 0.5), ("z", day(20), 9.0)])
    streams.run_to_table(streams.stream_daily_series(stream(), "ts", "urn_id", "price"), daily)
    got = {(r["day"], r["urn_id"]): (r["count"], r["min_price"]) for r in spark.read.parquet(f"{daily}/rows").collect()}
    # The first day was final before its late row came, and stays as it was.
    assert got[("2024-01-01", "a")] == (30, 1.0) and got[("2024-01-07", "c")] == (1, 3.0) and ("2024-01-21", "z") not in got


def _files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_only_touched_parts_are_written(spark, tmp_path):
    schema = _state(spark).schema
    table = PartedTable(str(tmp_path), schema, ["key"], parts=16)
    rows = spark.createDataFrame([(i, None if i == 0 else f"k{i}", float(i), 1, None, None) for i in range(200)], schema)
    table.write(rows, 0)
    before = _files(tmp_path)
    some = rows.where("key in ('k1', 'k2') or key is null")
    touched = table.touched(some)
    assert len(touched) <= 3 and table.top(spark, 0) == 199
    for _ in range(2):
        # Run twice, the update replaces itself.
        changed = table.read(spark, 0, touched).withColumn("last_price", F.when(F.col("key") == "k1", -1.0).otherwise(F.col("last_price")))
        table.write(changed, 1, touched, before=0)
    after = _files(tmp_path)
    assert all(after[p] == t for p, t in before.items())
    new = {p.parent.name for p in after if p not in before and "data" in p.parts}
    assert new == {f"part={p}" for p in touched}
    manifest = table.manifest(spark, 1)
    assert {p for p, (written, _, _) in manifest.items() if written == 1} == set(touched) and set(manifest) == set(range(16))
    was, now = ({r["id"]: r["last_price"] for r in table.read(spark, v).collect()} for v in (0, 1))
    assert len(was) == len(now) == 200 and {i for i in was if was[i] != now[i]} == {1}
    # A part can become empty, and a version without rows is an empty table.
    table.write(changed.limit(0), 2, touched, before=1)
    assert {r["id"] for r in table.read(spark, 2).collect()}.isdisjoint(r["id"] for r in changed.collect())
    table.write(rows.limit(0), 3)
    assert table.read(spark, 3).count() == 0 and table.top(spark, 3) == 0 and table.latest(spark) == 3


def test_a_batch_leaves_other_parts_alone(spark, tmp_path):
    source, out = str(tmp_path / "in"), tmp_path / "out"
    now = F.lit("2024-01-01").cast("timestamp")
    initial = lambda s: s.createDataFrame([(i, f"k{i}", 1.0, 1, None, None) for i in range(300)], _state(s).schema)
    spark.createDataFrame([(1, "k5", 9.0, 1), (2, "new", 1.0, 0), (3, "k5", 8.0, 1)], SCHEMA).coalesce(1).write.parquet(source)
    offers = spark.readStream.schema(SCHEMA).parquet(source)
    streams.stream_changes(offers, str(out), initial, ["key"], order="pos", as_of=lambda _: now, policy=POLICY).trigger(availableNow=True).start().awaitTermination()
    table = streams.state_table(str(out), initial(spark).schema, ["key"])
    manifest = table.manifest(spark, 1)
    assert sum(written == 1 for written, _, _ in manifest.values()) <= 2 and sum(n for _, n, _ in manifest.values()) == 301
    got = {r["key"]: (r["id"], r["last_price"]) for r in table.read(spark, 1).collect()}
    assert got["k5"] == (5, 8.0) and got["new"] == (300, 1.0) and got["k6"] == (6, 1.0)
    changes = [(r["entity_id"], r["price_old"], r["price_new"], r["change_type"]) for r in streams.read_changes(spark, str(out)).orderBy("pos").collect()]
    assert changes == [(5, 1.0, 9.0, "price"), (300, None, 1.0, "new"), (5, 9.0, 8.0, "price")]
