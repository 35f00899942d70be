import pytest
from pyspark.sql import functions as F

from marketlens.operators import joins, windows
from marketlens.plans import ingest
from marketlens.session import settle

NOW, LATER = "2024-03-01 10:00:00", "2024-03-02 10:00:00"
STATE = (
    "id long, source string, name string, condition string, url string, image_url string, last_price double, last_available int, sku string, "
    "category string, storage_label string, first_seen timestamp, last_seen timestamp"
)
OFFER = "pos long, name string, source string, condition string, price double, available boolean, sku string, grade string, url string, image_url string"


def ts(text):
    return F.lit(text).cast("timestamp")


def offers(spark, rows):
    """Rows are (name, source, condition, price, available)."""
    return ingest.clean_offers(spark.createDataFrame([(i, *r[:5], None, None, "u", "") for i, r in enumerate(rows)], OFFER))


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], STATE)


def apply(state, batch, now=NOW):
    # The state is published between snapshots, as a table would be.
    new, changes, counters = ingest.apply_offers(state, batch, ts(now))
    return settle(new), changes, counters.first().asDict()


def test_new_then_same_then_changed(spark, empty):
    batch = offers(spark, [("Xbox One S 1TB", "cex", "Usato", 100.0, True), ("Xbox 360 250GB", "cex", "Usato", None, True), ("", "cex", "Usato", 1.0, True), ("X", None, "Usato", 1.0, True)])
    state, changes, counters = apply(empty, batch)
    assert counters == {"new": 2, "price_changes": 0, "avail_changes": 0, "unchanged": 0}
    assert sorted(r["id"] for r in state.collect()) == [1, 2]
    assert {r["storage_label"] for r in state.collect()} == {"1 TB", "250 GB"}
    _, changes, counters = apply(state, batch, LATER)
    assert counters == {"new": 0, "price_changes": 0, "avail_changes": 0, "unchanged": 2}
    assert changes.count() == 0
    moved = offers(spark, [("Xbox One S 1TB", "cex", "Usato", None, True), ("Xbox 360 250GB", "cex", "Usato", 5.0, False)])
    state2, changes, counters = apply(state, moved, LATER)
    assert counters == {"new": 0, "price_changes": 2, "avail_changes": 1, "unchanged": 0}
    kinds = {r["product_id"]: (r["price_old"], r["price_new"], r["change_type"]) for r in changes.collect()}
    assert sorted(kinds.values(), key=str) == sorted([(100.0, None, "price"), (None, 5.0, "both")], key=str)
    assert {str(r["first_seen"]) for r in state2.collect()} == {NOW}


def test_repeated_key_in_one_batch(spark, empty):
    batch = offers(spark, [("A", "cex", "Usato", 1.0, True), ("A", "cex", "Usato", 2.0, True), ("A", "cex", "Usato", 2.0, False), ("A", "cex", "Usato", 2.0, False)])
    state, changes, counters = apply(empty, batch)
    assert counters == {"new": 1, "price_changes": 1, "avail_changes": 1, "unchanged": 1}
    assert [(r["price_old"], r["price_new"], r["change_type"]) for r in changes.orderBy("pos").collect()] == [(None, 1.0, "new"), (1.0, 2.0, "price"), (2.0, 2.0, "availability")]
    row = state.first()
    assert (row["last_price"], row["last_available"]) == (2.0, 0)


def test_empty_batch(spark, empty):
    state, _, _ = apply(empty, offers(spark, [("A", "cex", "Usato", 1.0, True)]))
    same, changes, counters = apply(state, offers(spark, []), LATER)
    assert same.collect() == state.collect() and changes.count() == 0 and sum(counters.values()) == 0


def test_state_is_last_change(spark, empty):
    rows = [(f"P{i % 7}", "cex", "Usato", float((i * 31) % 11) if i % 5 else None, i % 4 != 0) for i in range(60)]
    state, changes, counters = apply(empty, offers(spark, rows))
    last = {r["product_id"]: (r["p"], r["a"]) for r in changes.groupBy("product_id").agg(F.max_by(F.struct("price_new"), "pos")["price_new"].alias("p"), F.max_by("available_new", "pos").alias("a")).collect()}
    assert {r["id"]: (r["last_price"], r["last_available"]) for r in state.collect()} == last
    both = changes.where("change_type = 'both'").count()
    assert sum(counters.values()) - both == len(rows)


AD = (
    "id long, urn_id string, name string, body_text string, text_hash string, url string, image_url string, city string, region string, seller_type string, published_at string, "
    "first_seen timestamp, last_seen timestamp, last_active_seen timestamp, first_inactive_seen timestamp, last_price double, last_available int, sold_at timestamp, sold_at_estimated timestamp, sold_window_hours double"
)
AD_OFFER = "pos long, urn_id string, name string, body_text string, url string, image_url string, city string, region string, seller_type string, published_at string, last_price double, last_available int"


def ad_batch(spark, rows):
    """Rows are (urn, url, price, available)."""
    return spark.createDataFrame([(i, u, "n", "", url, "", "", "", "privato", "", p, a) for i, (u, url, p, a) in enumerate(rows)], AD_OFFER)


def test_listing_life(spark):
    state = spark.createDataFrame([], AD)
    state = settle(ingest.apply_ads(state, ad_batch(spark, [("A", "ua", 10.0, 1), ("B", "ub", 10.0, 0)]), ts("2024-03-01 00:00:00"))[0])
    rows = {r["urn_id"]: r for r in state.collect()}
    assert rows["A"]["sold_at"] is None and str(rows["A"]["last_active_seen"]) == "2024-03-01 00:00:00"
    assert rows["B"]["sold_window_hours"] == 0.0 and rows["B"]["last_active_seen"] is None
    state, changes, _ = ingest.apply_ads(state, ad_batch(spark, [("A", "ua", 10.0, 0), ("B", "ub", 12.0, 1)]), ts("2024-03-02 00:00:00"))
    state = settle(state)
    rows = {r["urn_id"]: r for r in state.collect()}
    assert str(rows["A"]["sold_at"]) == "2024-03-02 00:00:00" and str(rows["A"]["sold_at_estimated"]) == "2024-03-01 12:00:00" and rows["A"]["sold_window_hours"] == 24.0
    assert rows["B"]["sold_at"] is None and rows["B"]["sold_window_hours"] is None
    assert {r["change_type"] for r in changes.collect()} == {"availability", "both"}
    # A second sighting as ended leaves the sale as it is.
    state, changes, _ = ingest.apply_ads(state, ad_batch(spark, [("A", "ua", 10.0, 0)]), ts("2024-03-05 00:00:00"))
    row = state.where("urn_id = 'A'").first()
    assert str(row["sold_at"]) == "2024-03-02 00:00:00" and row["sold_window_hours"] == 24.0 and changes.count() == 0


def test_listing_found_by_address(spark):
    state = settle(ingest.apply_ads(spark.createDataFrame([], AD), ad_batch(spark, [("A", "ua", 10.0, 1), ("B", "ub", 1.0, 1)]), ts(NOW))[0])
    state, changes, counters = ingest.apply_ads(state, ad_batch(spark, [("NEW", "ua", 11.0, 1), ("C", "", 5.0, 1), ("B", "ub", 1.0, 1)]), ts(LATER))
    got = {r["urn_id"]: (r["id"], r["last_price"]) for r in state.collect()}
    assert got == {"NEW": (1, 11.0), "B": (2, 1.0), "C": (3, 5.0)}
    assert counters.first().asDict() == {"new": 1, "price_changes": 1, "avail_changes": 0, "unchanged": 1}


def test_listing_changes_read_the_offers_no_second_time(spark, tmp_path):
    state = settle(ingest.apply_ads(spark.createDataFrame([], AD), ad_batch(spark, [("A", "ua", 10.0, 1), ("B", "ub", 1.0, 1)]), ts(NOW))[0])
    ad_batch(spark, [("NEW", "ua", 11.0, 1), ("C", "uc", 5.0, 1), ("D", "uc", 6.0, 0), ("B", "ub", 1.0, 1), ("NEW", "ua", 11.0, 0)]).write.parquet(f"{tmp_path}/offers")
    state, changes, counters = ingest.apply_ads(state, spark.read.parquet(f"{tmp_path}/offers"), ts(LATER))
    for result in (state, changes, counters):
        assert not [f for f in result.inputFiles() if str(tmp_path) in f]
    got = [tuple(r) for r in changes.orderBy("pos").select("ad_id", "pos", "price_old", "price_new", "available_old", "available_new", "change_type").collect()]
    assert got == [(1, 0, 10.0, 11.0, 1, 1, "price"), (3, 1, None, 5.0, None, 1, "new"), (3, 2, 5.0, 6.0, 1, 0, "both"), (1, 4, 11.0, 11.0, 1, 0, "availability")]


PRODUCT = (
    "id long, name string, source string, condition string, sku string, url string, image_url string, category_id long, storage_id long, is_base_model int, "
    "first_seen timestamp, last_seen timestamp, last_price double, last_available int"
)


def product(i, name, source, condition, url, price=10.0, seen=NOW):
    import datetime as dt

    t = dt.datetime.fromisoformat(seen)
    return (i, name, source, condition, None, url, None, None, None, 0, t, t, price, 1)


def test_cleaning(spark):
    rows = [
        product(1, "Xbox One S 1TB usata", "gameshock", "Nuovo", "https://g/a"), product(2, "Xbox One S", "gameshock", "Nuovo", "https://g/a/"),
        product(3, "Xbox 360 250GB", "cex", "Nuovo", "https://c/1"), product(4, "Xbox One S 500GB console [Buono]", "rebuy", "Usato", "https://r/1", 90.0),
        product(5, "Xbox One S 500GB console [Eccellente]", "rebuy", "Usato", "https://r/1", 120.0), product(6, "annuncio", "subito", "Usato", "https://s/1"),
        product(7, " ", "cex", "Usato", "https://c/2"), product(8, "Xbox One S 500GB console", "rebuy", "Usato", "https://r/1", 118.0), product(9, "Xbox pad", "rebuy", "Usato", "https://r/2"),
    ]
    changes = spark.createDataFrame([(i, i) for i in range(1, 10)] + [(10, 77)], "id long, product_id long")
    out, log, summary = ingest.clean_catalog(spark.createDataFrame(rows, PRODUCT), changes)
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1]["condition"] == "Usato" and got[3]["condition"] == "Usato"
    assert {r["product_id"] for r in log.collect()} == {1, 3, 4, 5}
    # The row without a grade went into the variant with the nearest price.
    assert sorted(r["id"] for r in log.where("product_id = 5").collect()) == [5, 8]
    assert {r["step"]: r["rows"] for r in summary.collect()}["removed_separate_sources"] == 1
    assert all(r["rank_fits"] and r["display_id"] // 1000 == {"cex": 1, "gameshock": 4, "rebuy": 5}[r["source"]] for r in got.values())
    assert got[3]["canonical_model"] == "12161"


def test_prune(spark):
    rows = [product(1, "old", "cex", "Usato", "u1", seen="2000-01-01 00:00:00"), product(2, "new", "cex", "Usato", "u2"), product(3, "x", "subito", "Usato", "u3", seen="2000-01-01 00:00:00"), product(4, "y", "subito", "Usato", "u4")]
    df = spark.createDataFrame(rows, PRODUCT)
    assert [tuple(r) for r in ingest.count_stale(df).collect()] == [("cex", 1)]
    kept, log = ingest.prune_stale(df, spark.createDataFrame([(1, 1), (2, 2)], "id long, product_id long"))
    assert sorted(r["id"] for r in kept.collect()) == [2, 3, 4] and [r["product_id"] for r in log.collect()] == [2]
    assert ingest.count_stale(kept).count() == 0


def test_whole_snapshot(spark, empty):
    log = spark.createDataFrame([], "product_id long, changed_at timestamp, price_old double, price_new double, available_old int, available_new int, change_type string")
    raw = lambda rows: spark.createDataFrame([(i, *r, None, None, f"https://x/{r[0]}", "") for i, r in enumerate(rows)], OFFER)
    rows = [("Xbox One S 1TB", "cex", "Usato", 100.0, True), ("Xbox 360 250GB", "cex", "Usato", 50.0, True), ("Xbox One X 1TB usata", "gameshock", "Nuovo", 90.0, True), ("Xbox Series S console", "rebuy", "Usato", 9.0, True), ("Cavo", "rebuy", "Usato", 9.0, True)]
    state, log, counters = ingest.process_snapshot(empty, log, raw(rows), ts(NOW))
    assert counters.first()["new"] == 5
    got = {r["name"]: r for r in state.collect()}
    assert set(got) == {r[0] for r in rows} - {"Cavo"}
    assert got["Xbox One X 1TB usata"]["condition"] == "Usato" and got["Xbox One S 1TB"]["standard_name"] == "Xbox One S 1 T - Bianco"
    assert got["Xbox 360 250GB"]["display_id"] == 1001 and log.count() == 4
    # The next snapshot of one source drops what it no longer lists, and nothing of the others.
    state, log, counters = ingest.process_snapshot(settle(state.drop("display_id", "rank_fits")), settle(log), raw(rows[:1]), ts(LATER))
    assert {r["name"] for r in state.collect()} == {"Xbox One S 1TB", "Xbox One X 1TB usata", "Xbox Series S console"}
    assert log.count() == 3 and counters.first().asDict() == {"new": 0, "price_changes": 0, "avail_changes": 0, "unchanged": 1, "removed_stale": 1}


def test_display_ids(spark):
    rows = [product(1, "Zeta", "gamelife", "Usato", "a"), product(2, "Zeta", "gamelife", "Nuovo", "b"), product(3, "alfa", "gamelife", "Usato", "c"), product(4, "B", "cex", "Usato", "d"), product(5, "q", "elsewhere", "Usato", "e")]
    got = {r["id"]: r["display_id"] for r in windows.display_ids(spark.createDataFrame(rows, PRODUCT)).collect()}
    assert got == {3: 2001, 2: 2002, 1: 2003, 4: 1001, 5: 9001}


def test_dedupe_first(spark):
    df = spark.createDataFrame([(0, "A1", "1", "one"), (1, "A1", "2", "two"), (2, "", "3", "three"), (3, "", "3", "four"), (4, "", "", "")], "pos int, sku string, url string, name string")
    assert [r["name"] for r in windows.dedupe_first(df, ["pos"]).orderBy("pos").collect()] == ["one", "three"]


def test_additive_merge_keeps_what_is_there(spark):
    here = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, key string, price double")
    there = spark.createDataFrame([(1, "b", 9.0, "x"), (5, "c", 3.0, "x"), (6, "c", 4.0, "x")], "id long, key string, price double, extra string")
    kids = spark.createDataFrame([(1, 1, "old")], "id long, fk long, note string")
    more = spark.createDataFrame([(1, 1, "of b"), (2, 5, "of c"), (3, 6, "of c twin")], "id long, fk long, note string")
    new, children = joins.additive_merge(here, there, ["key"], kids, more, "fk")
    assert [tuple(r) for r in new.collect()] == [(3, "c", 3.0)]
    assert [(r["fk"], r["note"]) for r in children.collect()] == [(3, "of c")]


def test_backfill_is_idempotent(spark):
    df = spark.createDataFrame([(1,)], "id long")
    steps = [(2, "b", lambda d: d.withColumn("b", F.col("a") + 1)), (1, "a", lambda d: ingest.add_missing(d, {"a": ("int", 5)}))]
    out, done = ingest.backfill(df, steps)
    assert out.first()["b"] == 6 and done == [(1, "a"), (2, "b")]
    again, done = ingest.backfill(out, steps, applied=[1, 2])
    assert done == [] and again.columns == out.columns


def test_constraints(spark):
    from marketlens.operators.filters import split_constraints

    df = spark.createDataFrame([(1, 1.0, 1), (2, -1.0, 1), (3, None, 2), (4, None, None)], "id int, p double, a int")
    good, bad = split_constraints(df, ["p"], ["a"])
    assert [r["id"] for r in good.orderBy("id").collect()] == [1, 4]
    assert [(r["id"], r["violation"]) for r in bad.orderBy("id").collect()] == [(2, "p negative"), (3, "a not 0/1")]
