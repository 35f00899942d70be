import pytest
from pyspark.sql import functions as F

from marketlens import catalog
from marketlens.operators import aggregates, filters, joins, windows
from marketlens.plans import alerts, cascade, jobs, statistics, valuation, verify

OFFER = "id long, source string, canonical_model string, console_family string, price double, available int, model_segment string, edition_class string"


def priced(spark, rows):
    return spark.createDataFrame([(i, *r, "base", "standard") for i, r in enumerate(rows)], OFFER)


def test_fair_values(spark):
    rows = [("cex", "m", "360", p, 1) for p in (100.0, 200.0, 300.0)] + [("ebay", "m", "x", p, 0) for p in (80.0, 90.0)] + [("subito", "m", "y", 50.0, 1), ("subito", "m", "y", 9.0, 0)]
    rows += [("subito", "unknown", "one", p, 1) for p in (10.0, 20.0, 30.0, 40.0, 50.0, 600.0)] + [("cex", "", "zero", 0.0, 1)]
    got = {r["key"]: r for r in valuation.fair_values(priced(spark, rows)).collect()}
    assert set(got) == {"m", "family:one"}
    m = got["m"]
    assert m["console_family"] == "360" and m["cex_net"] == pytest.approx(156.0)
    assert m["fair_value"] == pytest.approx(0.45 * 156 + 0.35 * 85 + 0.2 * 50)
    assert m["spread"] == pytest.approx(106.0) and m["sample_count"] == 6
    assert m["confidence"] == pytest.approx(0.3 + 0.54 + 0.036)
    one = got["family:one"]
    # Six prices: trimming takes none away that the median would use.
    assert one["fair_value"] == 35.0 and one["spread"] == 0.0 and one["fallback_family_key"] == "one" and one["canonical_model"] is None


def test_weight_of_the_only_source_is_zero(spark):
    rows = [("ebay", "m", "f", 10.0, 1)]
    assert valuation.fair_values(priced(spark, rows), include_ebay=False).count() == 0
    summary, _ = valuation.backtest(priced(spark, rows))
    assert tuple(summary.first()) == (0, None, None)


def test_opportunities_take_the_cheapest_first(spark):
    ads = spark.createDataFrame(
        [(1, 50.0, "m"), (2, 40.0, None), (3, 40.0, "m"), (4, 30.0, "m")],
        "id long, last_price double, canonical_model string",
    ).select("*", F.lit("f").alias("console_family"), F.lit(1).alias("last_available"), F.lit("i").alias("image_url"), F.lit("").alias("city"), F.lit(None).cast("string").alias("region"),
             F.lit("privato").alias("seller_type"), F.lit("base").alias("model_segment"), F.lit("standard").alias("edition_class"))
    values = valuation.fair_values(priced(spark, [("subito", "m", "f", 100.0, 1)]))
    got = valuation.score_opportunities(ads, values, 3).collect()
    # Equal prices: the lower id is inside the limit; the family stands in for a missing model.
    assert [r["id"] for r in got] == [3, 2, 4] or sorted(r["id"] for r in got) == [2, 3, 4]
    by = {r["id"]: r for r in got}
    assert by[4]["quality_score"] == 45 + 12 + 8 - 18 and by[2]["fair_value"] == 100.0
    assert by[4]["opportunity_score"] == pytest.approx(70 * 0.7 + 47 * 0.3)


def test_statistics_of_small_groups(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 4.0), ("b", 4.0), ("b", 4.0), ("c", 1.0), ("c", 2.0), ("c", 6.0)], "k string, p double")
    z = {r["k"]: r["z_score"] for r in statistics.z_score_of_min(df, "k", "p").collect()}
    assert z["a"] is None and z["b"] == 0.0 and z["c"] == pytest.approx((1 - 3) / 2.6457513110645907)
    ci = {r["k"]: (r["margin"], r["volatile"], r["lower"]) for r in statistics.mean_ci95(df, "k", "p").collect()}
    assert ci["a"] == (None, None, None) and ci["b"] == (0.0, False, 4.0) and ci["c"][1] is True and ci["c"][2] == pytest.approx(max(0.0, 3 - 1.96 * 2.6457513 / 3**0.5), abs=1e-5)


def test_correlation_guards(spark):
    df = spark.createDataFrame([("one", 1, 5.0), ("one", 1, 6.0), ("flat", 1, 5.0), ("flat", 2, 5.0), ("up", 1, 5.0), ("up", 2, 7.0)], "k string, s int, p double")
    got = {r["k"]: r["correlation"] for r in statistics.storage_correlation(df, ["k"], "s", "p").collect()}
    assert got["one"] is None and got["flat"] == 0.0 and got["up"] == pytest.approx(1.0)


def test_series_of_one_day(spark):
    daily = spark.createDataFrame([("a", "2024-01-01", 5.0), ("b", "2024-01-01", 10.0), ("b", "2024-01-02", 20.0)], "k string, d string, price double").select("k", F.to_date("d").alias("day"), "price")
    assert {r["k"]: r["ema"] for r in windows.ema(daily, "k").collect()} == {"a": None, "b": 12.5}
    assert {r["k"]: r["slope"] for r in statistics.linear_slope(daily, "k").collect()} == {"a": None, "b": 10.0}
    assert [r["k"] for r in statistics.price_trend(daily, "k").collect()] == ["b"]


def test_alerts(spark):
    as_of = F.lit("2024-06-01").cast("timestamp")
    ads = spark.range(1, 61).select(
        "id", F.concat(F.lit("U"), F.col("id").cast("string")).alias("urn_id"), (F.col("id") + 10).cast("double").alias("last_price"), F.lit("360").alias("console_family"), F.lit(1).alias("last_available"),
        F.when(F.col("id") == 1, "approved").when(F.col("id") == 2, "pending").otherwise("approved_auto").alias("ai_status"), F.lit("Roma").alias("city"), F.lit("Console").alias("name"),
    )
    limits = spark.createDataFrame([("360", 66.5)], "console_family string, threshold double")
    log = spark.createDataFrame([("U3", "2024-05-01T00:00:00+00:00"), ("U4", "2024-03-03T00:00:00Z"), ("U5", "2024-03-02T23:59:59Z"), ("U6", "rubbish")], "urn_id string, ts string")
    sent, after = alerts.check_alerts(ads, limits, log, as_of, F.lit("now"))
    urns = {r["urn_id"] for r in sent.collect()}
    # Announced lately: U3, and U4 exactly 90 days ago. Pending: U2. From 67 on too dear.
    assert urns == {f"U{i}" for i in range(1, 57)} - {"U2", "U3", "U4"}
    assert sent.where("sent").count() == 50
    kept = {r["urn_id"]: r["ts"] for r in after.collect()}
    assert kept["U4"].startswith("2024-03-03") and kept["U5"] == "now" and kept["U6"] == "now" and len(kept) == 55
    assert sent.where("urn_id = 'U1'").first()["message"] == "€11 (soglia €66) · Roma — Console"
    strict, _ = alerts.check_alerts(ads, limits, log, as_of, F.lit("now"), approved=("approved",))
    assert [r["urn_id"] for r in strict.collect()] == ["U1"]


def test_precheck_blocks(spark):
    schema = "id int, chunk int, pre_status int, pre_url string, page_status int, page_url string, page_body string, page_error string, page_tried boolean"
    rows = [(i, 1, 403, "u", 200, "u", "", None, True) for i in range(9)] + [(9, 1, 410, "u", 200, "u", "", None, True)]
    rows += [(20, 2, 403, "u", 200, "u", "", None, True), (21, 2, 200, "u", None, None, None, None, True)]
    rows += [(30, 3, 500, "u", 429, "u", "", None, True), (31, 3, 200, "https://www.subito.it/", None, None, None, None, True), (32, 3, 200, "u", None, None, None, None, True)]
    rows += [(40, 4, None, None, None, None, None, "net::ERR_CONNECTION_RESET", True)] + [(41 + i, 4, 200, "u", None, None, None, None, True) for i in range(3)]
    got = {r["id"]: (r["outcome"], r["reason"]) for r in verify.classify_outcomes(spark.createDataFrame(rows, schema)).collect()}
    assert got[0] == ("pending", "skipped:cffi-block") and got[9] == ("sold", "sold:precheck")
    assert got[20] == ("pending", "skipped:cffi-partial") and got[21] == ("active", "active:cffi-200")
    assert got[30] == ("pending", "blocked:http-429") and got[31][0] == "sold" and got[40] == ("pending", "blocked:network")


def test_unstable_hits(spark):
    rows = [("blocked:timeout", 5), ("x-http-403", 3), ("blocked:http-429", 2), ("skipped:cffi-block", 2), ("active:cffi-200", 20), ("sold:precheck", 7)]
    df = spark.createDataFrame(rows, "reason string, count long")
    assert aggregates.unstable_hits(df).first()[0] == 12
    assert aggregates.unstable_hits(df.where("reason like 'active%'")).first()[0] == 0


def _scores(values):
    """Scorer from fixed answers by id: (taxonomy id, confidence, object type)."""
    def run(rows):
        out = rows.withColumn("_a", F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.struct(*[F.lit(p).alias(n) for p, n in zip(v, "tco")]))]), F.col("id")))
        return out.select(*rows.columns, F.col("_a.t").alias("taxonomy_id"), F.col("_a.c").cast("string").alias("confidence"), F.col("_a.o").alias("object_type"), F.lit("compatible").alias("price_signal"), F.lit("why").alias("decision_reason"))

    return run


def test_cascade(spark):
    tax = joins.taxonomy_table(spark)
    rows = spark.createDataFrame([(1, 120.0, "h1"), (2, 120.0, "h2"), (3, 5.0, "h3"), (4, None, "h4")], "id int, price double, input_hash string")
    first = _scores({1: ("13222", 61, "console"), 2: ("13222", 95, "accessory"), 3: ("13222", 99, "console"), 4: ("nowhere", 10, "console")})
    second = _scores({1: ("13222", 88, "console"), 2: ("13222", 1, "console"), 3: ("13222", 1, "console"), 4: ("13222", 300, "strange")})
    results, attempts = cascade.cascade(rows, [("m1", first), ("m2", second)], tax)
    got = {r["id"]: (r["status"], r["selected_model"], r["taxonomy_id"], r["confidence"]) for r in results.collect()}
    assert got[1] == ("approved_auto", "m2", "13222", 88)
    assert got[2] == ("rejected_auto", "m1", "other", 95)
    # 5 euro is below the floor of its price family.
    assert got[3] == ("pending_review", "m1", "13222", 99)
    assert got[4] == ("approved_auto", "m2", "13222", 100)
    assert attempts.groupBy("id").count().orderBy("id").collect() == [(1, 2), (2, 1), (3, 1), (4, 2)]
    runs = spark.createDataFrame([(7, "h1", "14111", 90, "approved_auto", "old"), (8, "h1", "other", 10, "failed", "old")], "id int, input_hash string, taxonomy_id_final string, confidence_final long, status_final string, selected_model string")
    again, _ = cascade.cascade(rows.where("id = 1"), [("m1", first), ("m2", second)], tax, runs=runs)
    assert [(r["taxonomy_id"], r["selected_model"], r["status"]) for r in again.collect()] == [("14111", "old", "approved_auto")]


def test_review(spark):
    tax = joins.taxonomy_table(spark)
    ads = spark.createDataFrame(
        [(1, "pending_review", "14111"), (2, "pending_review", None)], "id long, ai_status string, ai_taxonomy_id string"
    ).select("*", *[F.lit("x").alias(c) for c in ("console_family", "sub_model", "model_segment", "edition_class", "canonical_model", "classify_method")], F.lit(0.5).alias("classify_confidence"))
    reviews = spark.createDataFrame([(1, "other", None), (2, "12622", None), (9, "12622", None), (2, "bad", None), (1, "12622", "maybe")], "ad_id long, human_taxonomy_id string, human_status string").select(
        "*", F.lit("").alias("review_reason"), F.lit(None).cast("long").alias("run_id")
    )
    runs = spark.createDataFrame([(5, 1), (6, 1)], "id long, ad_id long")
    state, audit, errors = cascade.apply_review(ads, reviews, runs, tax, F.lit("2024-01-01").cast("timestamp"))
    got = {r["id"]: r for r in state.collect()}
    assert (got[1]["ai_status"], got[1]["canonical_model"]) == ("rejected_manual", "other")
    assert (got[2]["console_family"], got[2]["sub_model"], got[2]["model_segment"], got[2]["classify_confidence"]) == ("360", "E", "base", 1.0)
    assert {(r["ad_id"], r["run_id"]) for r in audit.collect()} == {(1, 6), (2, None)}
    assert {(r["ad_id"], r["error"]) for r in errors.collect()} == {(9, "ad not found"), (2, "invalid taxonomy_id"), (1, "invalid human_status")}


def test_job_runs(spark):
    runs = spark.createDataFrame([], "id long, job string, status string, ended_at timestamp, counts string, error string")
    new = spark.createDataFrame([("a", "ok", 1, '{"n": 3}', None), ("b", "error", 2, None, "boom"), ("b", "error", 3, None, "boom"), ("c", "weird", 4, None, None)], "job string, status string, d int, counts string, error string").select(
        F.lit(None).cast("long").alias("id"), "job", "status", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,d)").alias("ended_at"), "counts", "error"
    )
    out = jobs.record_jobs(runs, new)
    got = [(r["job"], r["status"], r["alert"]) for r in out.orderBy("id").collect()]
    assert got == [("a", "ok", False), ("b", "error", True), ("b", "error", False), ("c", "error", True)]
    catalogue = spark.createDataFrame([("a", "A", 24), ("b", "B", 24), ("d", "D", 24)], "job string, label string, cadence_h int")
    status = aggregates.job_status(catalogue, out, F.lit("2024-01-10").cast("timestamp"))
    assert {r["job"]: (r["status"], r["summary"]) for r in status.collect()} == {"a": ("warn", "n=3"), "b": ("error", "boom"), "d": ("unknown", "no run recorded")}
    assert aggregates.overall_status(status).first()[0] == "error"
    assert aggregates.job_history(out, "b", 0).count() == 1 and aggregates.job_history(out, "zz").count() == 0


def test_log_status(spark):
    lines = spark.createDataFrame(
        [("good", 1, "start"), ("good", 2, "[warning] slow"), ("good", 3, "job done OK"), ("bad", 1, "Traceback (most recent call last):"), ("quiet", 1, "half way")], "job string, line_no long, line string"
    )
    meta = spark.createDataFrame(
        [("good", 10.0, 1.0, None, None, "done OK"), ("bad", 10.0, 1.0, None, None, "done OK"), ("quiet", 10.0, 1.0, None, None, "done OK"), ("none", 10.0, 1.0, None, None, None)],
        "job string, cadence_h double, age_h double, error_re string, problem_re string, ok_re string",
    )
    got = {r["job"]: r["status"] for r in aggregates.job_log_status(lines, meta).collect()}
    assert got == {"good": "ok", "bad": "error", "quiet": "warn", "none": "unknown"}


def test_log_words_cover_their_patterns():
    """Every alternative of a log pattern holds one of the words that are looked for first."""
    for pattern, words in ((catalog.LOG_FATAL, catalog.LOG_FATAL_WORDS), (catalog.LOG_ISSUE, catalog.LOG_ISSUE_WORDS)):
        for alternative in pattern.replace("(ing)?", "").split("|"):
            plain = alternative.replace(r"\b", "").replace("\\", "")
            assert any(w in plain for w in words), alternative


def test_log_status_by_word_and_pattern(spark):
    """Words alone are no hit, case does not matter, null and empty lines are none, old jobs stay stale."""
    texts = {"room": "in the ROOM", "oom": "OOM now", "sub": "unfailed warned", "issue": "a FAILED b", "empty": "", "null": None, "old": "failed"}
    lines = spark.createDataFrame([(k, 1, v) for k, v in texts.items()], "job string, line_no long, line string")
    meta = spark.createDataFrame([(k, 10.0, 30.0 if k == "old" else None, None, None, None) for k in texts], "job string, cadence_h double, age_h double, error_re string, problem_re string, ok_re string")
    got = {r["job"]: (r["status"], r["summary"]) for r in aggregates.job_log_status(lines, meta).collect()}
    assert got["room"][0] == got["sub"][0] == got["empty"][0] == "ok"
    assert got["oom"] == ("error", "OOM now") and got["issue"] == ("warn", "a FAILED b") and got["old"] == ("stale", "stale")


def test_cutoff_day_counts(spark):
    df = spark.createDataFrame([("2024-01-10 00:00:01",), ("2024-01-09 23:59:59",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert filters.recent(df, "t", F.lit("2024-01-15 12:00:00").cast("timestamp"), 5).count() == 1


def test_regions(spark):
    df = spark.createDataFrame([(0, "Lazio"), (1, "valle d'aosta"), (2, "LAZIO"), (3, " ")], "pos int, token string")
    assert [r["slug"] for r in joins.select_regions(df, "token", "pos").collect()] == ["lazio", "valle-d-aosta"]
    with pytest.raises(Exception, match="unknown region"):
        joins.select_regions(df.unionByName(spark.createDataFrame([(9, "Atlantide")], "pos int, token string")), "token", "pos").collect()


def test_legacy_replies(spark):
    df = spark.createDataFrame([('```json\n[{"id": 1, "console_confidence": 90}]\n```',), ('{"ads": [{"id": 2, "console_confidence": 10}]}',), ('broken "id": 3, x "console_confidence": 50 and id: 4 console_confidence: 5',), ("nothing",)], "t string")
    got = df.select(F.explode(cascade.salvage_json(F.col("t"))).alias("s")).select("s.id", "s.console_confidence").collect()
    assert sorted(tuple(r) for r in got) == [(1, 90), (2, 10), (3, 50), (4, 5)]


def test_no_caps_on_logs_histories_and_reviews(spark):
    from marketlens.operators import filters

    rows = spark.range(1500).selectExpr("id", "'j' AS job", "timestamp_seconds(1000000 + id) AS ended_at", "'x' AS file", "id AS line_no")
    as_of = F.timestamp_seconds(F.lit(1_002_000))
    assert filters.recent_errors(rows, "ended_at", as_of, 1).count() == 1500
    assert aggregates.job_history(rows, "j").count() == 1500 and aggregates.job_history(rows, "j", 700).count() == 700
    assert aggregates.tail_lines(rows, ["file"], "line_no", 1200).count() == 1200


def test_missing_families_are_other_in_badges(spark):
    from marketlens.operators import joins

    ads = spark.createDataFrame(
        [(1, None, 50.0, 1), (2, "  ", 150.0, 1), (3, "a", 80.0, 1)], "id long, console_family string, last_price double, last_available int"
    )
    averages = aggregates.family_average(ads)
    assert {r["console_family"]: r["avg_price"] for r in averages.collect()} == {"other": 100.0, "a": 80.0}
    none = spark.createDataFrame([], "id long, delta_pct double, quality_score double")
    assert {r["id"]: r["band"] for r in joins.opportunity_badges(ads, none, averages).collect()} == {1: "fire", 2: "over", 3: "none"}


def test_alerts_are_capped_by_family_then_price(spark):
    ads = spark.createDataFrame(
        [(1, "u1", "b", 10.0), (2, "u2", "a", 20.0), (3, "u3", "a", 15.0), (4, "u4", None, 5.0)], "id long, urn_id string, console_family string, last_price double"
    ).selectExpr("*", "1 AS last_available", "'approved' AS ai_status", "'' AS city", "'n' AS name")
    limits = spark.createDataFrame([("a", 50.0), ("b", 50.0), ("other", 50.0)], "console_family string, threshold double")
    log = spark.createDataFrame([], "urn_id string, ts string")
    sent, _ = alerts.check_alerts(ads, limits, log, F.lit("2024-01-01").cast("timestamp"), F.lit("now"), cap=2)
    assert {r["id"] for r in sent.where("sent").collect()} == {4, 3}
