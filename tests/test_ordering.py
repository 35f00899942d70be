import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.operators import ordering, similarity, windows
from marketlens.plans.statistics import kmeans_1d


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows; values repeat, some keys are tiny, one is null."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 else rng.choice(["a", "b", "c", None])
        rows.append((i, key, float(rng.choice([1, 2, 3, rng.randint(0, 500), rng.random() * 1000]))))
    rows += [(9000, "single", 5.0), (9001, "pair", 1.0), (9002, "pair", 4.0), (9003, "empty", None)]
    pdf = pd.DataFrame(rows, columns=["id", "key", "value"])
    return spark.createDataFrame(rows, "id long, key string, value double").repartition(7), pdf


def test_quantiles_are_exact(skewed):
    df, pdf = skewed
    names = {"lo": 0.01, "q1": 0.25, "med": 0.5, "q3": 0.75, "hi": 0.999}
    got = {r["key"]: r for r in ordering.exact_quantiles(df, ["key"], "value", names).collect()}
    for key, part in pdf.dropna(subset=["value"]).groupby("key", dropna=False):
        row = got[key if isinstance(key, str) else None]
        assert row["_n"] == len(part)
        for name, p in names.items():
            assert row[name] == pytest.approx(part["value"].quantile(p), rel=1e-12)
    assert "empty" not in got


def test_quantiles_without_key(skewed):
    df, pdf = skewed
    row = ordering.exact_quantiles(df, [], "value", {"med": 0.5, "q3": 0.75}).first()
    assert row["med"] == pytest.approx(pdf["value"].median()) and row["q3"] == pytest.approx(pdf["value"].quantile(0.75))


def test_quantiles_beyond_the_bracket_size(spark):
    df = spark.range(200_000).select(F.lit("k").alias("key"), (F.col("id") * 7919 % 200_003).cast("double").alias("value"))
    row = ordering.exact_quantiles(df, ["key"], "value", {"med": 0.5, "p9": 0.9}).first()
    pdf = df.toPandas()
    assert row["med"] == pdf["value"].median() and row["p9"] == pytest.approx(pdf["value"].quantile(0.9))


@pytest.mark.parametrize("ranked, buckets", [(1, 5), (40, 50)])
def test_brackets_are_refined(spark, skewed, monkeypatch, ranked, buckets):
    """Brackets too large for one task give the same values; widths beyond a double too."""
    monkeypatch.setattr(ordering, "RANKED", ranked)
    monkeypatch.setattr(ordering, "_BUCKETS", buckets)
    if ranked > 1:
        test_quantiles_are_exact(skewed)
        test_trimmed_mean(skewed)
    else:
        values = [-1.7e308, -5.0, 0.0, 1e-300, 2e-300, 3e-300, 1.0, 1.0, 1.0, 7.0, 1.7e308]
        row = ordering.exact_quantiles(spark.createDataFrame([("k", v) for v in values], "key string, v double"), ["key"], "v", {"q": 0.3, "med": 0.5}).first()
        assert (row["q"], row["med"]) == (1e-300, 3e-300)


def test_large_bracket_goes_through_no_single_window(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANKED", 500)
    df = spark.range(400_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 900).cast("string")).alias("key"), (F.pow(F.rand(4), 9) * 1000).alias("value"))
    pdf = df.toPandas()
    kept = []
    plain = ordering._refined
    monkeypatch.setattr(ordering, "_refined", lambda *a: kept.append(plain(*a)) or kept[-1])
    got = {r["key"]: (r["a"], r["b"]) for r in ordering.exact_quantiles(df, ["key"], "value", {"a": 0.5, "b": 0.9}).collect()}
    want = pdf.groupby("key")["value"].quantile([0.5, 0.9]).unstack()
    assert all(got[k] == pytest.approx((want.loc[k, 0.5], want.loc[k, 0.9]), rel=1e-12) for k in want.index)
    assert kept and kept[0].groupBy("key", "_i").count().agg(F.max("count")).first()[0] <= 501


def test_trimmed_mean(skewed):
    df, pdf = skewed
    got = {r["key"]: r["trimmed_mean"] for r in ordering.trimmed_mean(df, ["key"], "value").collect()}
    for key, part in pdf.dropna(subset=["value"]).groupby("key", dropna=False):
        v = sorted(part["value"])
        cut = int(len(v) * 0.15) if len(v) >= 6 else 0
        kept = v[cut : len(v) - cut]
        assert got[key if isinstance(key, str) else None] == pytest.approx(sum(kept) / len(kept))


def test_row_numbers(skewed):
    df, pdf = skewed
    got = ordering.number_rows(df, [F.col("value").asc_nulls_last(), F.col("id")], ["key"]).toPandas()
    want = pdf.sort_values(["value", "id"], na_position="last")
    want["row_no"] = want.groupby("key", dropna=False).cumcount() + 1
    assert dict(zip(got["id"], got["row_no"])) == dict(zip(want["id"], want["row_no"]))


def test_previous_row(skewed):
    df, pdf = skewed
    got = ordering.previous_row(df, ["key"], ["id"], ["value"]).toPandas()
    want = pdf.sort_values("id").copy()
    want["prev"] = want.groupby("key", dropna=False)["value"].shift(1)
    want["has"] = want.groupby("key", dropna=False).cumcount() > 0
    a = got.sort_values("id")
    assert list(a["has_prev"]) == list(want["has"])
    assert a["prev_value"].fillna(-1).tolist() == want["prev"].fillna(-1).tolist()


def test_previous_row_of_one_key_at_one_moment(spark):
    """A third of all rows belongs to one key on one day at one time: no task sees more than its share."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("key"), F.lit("2024-01-01").cast("timestamp").alias("ts"), "id",
        F.when(F.col("id") % 7 != 0, F.col("id") * 2).alias("value"),
    )
    # Or such small partitions would be put together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = ordering.previous_row(rows, ["key"], ["ts", "id"], ["value"])
        tasks = [r["c"] for r in seen.select("key", F.spark_partition_id().alias("t")).where("key = 'hot'").groupBy("t").agg(F.count("*").alias("c")).collect()]
        assert len(tasks) > 1 and max(tasks) < 7000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r["id"]: (r["has_prev"], r["prev_value"]) for r in seen.collect()}
    last: dict = {}
    for i in range(30_000):
        key = "hot" if i % 3 == 0 else str(i % 500)
        assert got[i] == (key in last, last.get(key))
        last[key] = i * 2 if i % 7 else None


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_nearest_price(spark, parts):
    rng = random.Random(3)
    variants = [(i, rng.choice("gh"), rng.choice([None, float(rng.randint(0, 60))])) for i in range(80)]
    legacy = [(1000 + i, rng.choice("ghx"), rng.choice([None, float(rng.randint(0, 60))])) for i in range(60)]
    schema = "id long, grp string, price double"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = similarity.nearest_price(spark.createDataFrame(legacy, schema), spark.createDataFrame(variants, schema), "grp", "price").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r["legacy_id"]: r["keep_id"] for r in found}
    want = {}
    for lid, grp, price in legacy:
        group = sorted(v for v in variants if v[1] == grp)
        if not group:
            continue
        priced = [v for v in group if v[2] is not None and price is not None]
        want[lid] = min(priced, key=lambda v: abs(v[2] - price))[0] if priced else group[0][0]
    assert got == want


def test_nearest_known_of_one_group_over_many_tasks(spark):
    """A third of the rows in one group: spread over tasks, some of which hold no known value at all."""
    n = 24_000
    at = F.col("id")
    rows = spark.range(n).select(
        F.when(at % 3 == 0, "hot").when(at % 3 == 1, (at % 100).cast("string")).alias("key"), "id",
        F.when((at % 997 == 0) | (at > n - 50) & (at % 2 == 0), at * 10).alias("value"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = ordering.nearest_known(rows, ["key"], ["id"], "value")
        tasks = [r["c"] for r in seen.select("key", F.spark_partition_id().alias("t")).where("key = 'hot'").groupBy("t").agg(F.count("*").alias("c")).collect()]
        got = {r["id"]: (r["key"], r["value"], r["low"], r["high"]) for r in seen.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == n and len(tasks) > 1 and max(tasks) <= n / 4
    last, following = {}, {}
    for i in range(n):
        key, value, low, _ = got[i]
        last[key] = last.get(key) if value is None else value
        assert low == last[key]
    for i in reversed(range(n)):
        key, value, _, high = got[i]
        following[key] = following.get(key) if value is None else value
        assert high == following[key]


def _best_of_all(titles, anchors):
    out = {}
    for i, title, fam in titles:
        best, score = None, 0.0
        for _, other, family, model in anchors:
            if family != fam:
                continue
            a, b = set(title.split()), set(other.split())
            s = len(a & b) / len(a | b)
            if s > score:
                best, score = model, s
        out[i] = (best, round(score, 3)) if round(score, 3) >= 0.45 else (None, None)
    return out


def _best_anchor(spark, titles, anchors):
    asked = spark.createDataFrame(titles, "id long, name string, console_family string")
    known = spark.createDataFrame(anchors, "id long, name string, console_family string, canonical_model string")
    return {r["id"]: (r["match_model"], r["match_score"]) for r in similarity.best_anchor(asked, known).collect()}


@pytest.mark.parametrize("cell", [20_000, 7])
def test_best_anchor_equals_comparing_everything(spark, monkeypatch, cell):
    monkeypatch.setattr(similarity, "CELL", cell)
    rng = random.Random(11)
    words = [f"w{i:02d}" for i in range(14)]
    name = lambda: " ".join(rng.sample(words, rng.randint(1, 6)))
    titles = [(i, name(), rng.choice("ab")) for i in range(150)]
    anchors = [(i, name(), rng.choice("ab"), f"m{i}") for i in range(60)]
    assert _best_anchor(spark, titles, anchors) == _best_of_all(titles, anchors)


def test_a_word_in_a_third_of_all_titles_is_split(spark, monkeypatch):
    """Titles at one word are dealt to many tasks, every pair of the word meets once, and the result stays."""
    monkeypatch.setattr(similarity, "CELL", 20)
    rng = random.Random(3)
    words = [f"w{i:03d}" for i in range(200)]
    # Rare among the anchors, so it stands at the rare end of a third of the titles.
    titles = [(i, " ".join((["zhot"] if i % 3 == 0 else []) + rng.sample(words, 3)), "a") for i in range(900)]
    anchors = [(i, " ".join((["zhot"] if i < 2 else []) + rng.sample(words, 3)), "a", f"m{i}") for i in range(120)]
    assert _best_anchor(spark, titles, anchors) == _best_of_all(titles, anchors)
    side = lambda n, c: spark.range(n).select(F.lit("a").alias("_fam"), F.lit("zhot").alias("_w"), F.array(F.col("id").cast("string")).alias(c))
    left, right = similarity._in_cells(side(600, "_set"), "_set", side(90, "_aset"), "_aset")
    for rows in (left, right):
        assert rows.groupBy("_i", "_j").count().agg(F.max("count")).first()[0] <= 2 * 20
    met = left.join(right, ["_fam", "_w", "_i", "_j"])
    assert met.count() == met.distinct().count() == 600 * 90


def test_best_anchor_edges(spark):
    """Empty names, null names and families, no anchors at all: nulls, and every row stays."""
    titles = [(1, "", "a"), (2, None, "a"), (3, "w01 w02", None), (4, "w01 w02", "none"), (5, "w01 w02", "a")]
    got = _best_anchor(spark, titles, [(1, "w01 w02", "a", "m1"), (2, None, "a", "m2")])
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (None, None), 5: ("m1", 1.0)}
    assert set(_best_anchor(spark, titles, []).values()) == {(None, None)}


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.3, 1.0])
def test_share_of_rows_is_the_first_in_hash_order(spark, ratio):
    """Repeated ids and ids of one hash half are told apart; the rest of a row stays with it."""
    df = spark.range(3000).select((F.col("id") % 1000).alias("id"), F.concat(F.lit("x"), F.col("id")).alias("name")).unionByName(
        spark.range(1000).select(F.lit(7).cast("long").alias("id"), F.lit("hot").alias("name"))
    )
    got = [r["id"] for r in windows.sample_share(df, ratio, 5).collect()]
    order = [r["id"] for r in df.orderBy(F.xxhash64("id", F.lit(5)), "id").select("id").collect()]
    assert sorted(got) == sorted(order[: int(4000 * ratio)])
    assert windows.sample_share(df.limit(0), ratio, 5).isEmpty()


def _bands(values, k=3):
    if len(values) < k:
        return sorted((v, 1) for v in values)
    lo, hi = min(values), max(values)
    c = [lo + (hi - lo) * (i / (k - 1)) for i in range(k)]
    for _ in range(50):
        groups = [[] for _ in range(k)]
        for v in values:
            d = [abs(v - x) for x in c]
            groups[d.index(min(d))].append(v)
        moved = False
        for j, g in enumerate(groups):
            if g and abs(sum(g) / len(g) - c[j]) > 0.1:
                c[j], moved = sum(g) / len(g), True
        if not moved:
            break
    return sorted((c[j], len(g)) for j, g in enumerate(groups) if g)


@pytest.mark.parametrize("in_task", [10**6, 5])
def test_kmeans(spark, in_task):
    rng = random.Random(2)
    data = {"many": [round(rng.choice([50, 200, 900]) + rng.random() * 80, 2) for _ in range(400)], "two": [3.0, 3.0], "one": [7.0], "equal": [4.0] * 9, "few": [1.0, 2.0, 50.0, 51.0]}
    rows = [(k, v) for k, vs in data.items() for v in vs]
    got: dict = {}
    for r in kmeans_1d(spark.createDataFrame(rows, "key string, price double"), "key", "price", in_task=in_task).collect():
        got.setdefault(r["key"], []).append((r["centroid"], r["size"]))
    for key, values in data.items():
        want = _bands(values)
        assert [n for _, n in sorted(got[key])] == [n for _, n in want], key
        assert [c for c, _ in sorted(got[key])] == pytest.approx([c for c, _ in want])


def test_kmeans_reads_only_blocks_on_a_border(spark, monkeypatch):
    """Rounds over block sums give the bands of all prices, and read single prices of border blocks alone."""
    from marketlens.plans import statistics

    rng = random.Random(5)
    data = {k: [round(rng.gauss(m, 300) ** 2 / 100 + 1, 4) for _ in range(600)] for k, m in (("a", 900), ("b", 300), (None, 50))}
    rows = [(k, v) for k, vs in data.items() for v in vs]
    tables, plain = {}, statistics.written
    monkeypatch.setattr(statistics, "written", lambda df, name: tables.setdefault(name, []).append(plain(df, name)) or tables[name][-1])
    monkeypatch.setattr(statistics, "BLOCK", 16)
    got: dict = {}
    for r in kmeans_1d(spark.createDataFrame(rows, "key string, price double"), "key", "price", in_task=5).collect():
        got.setdefault(r["key"], []).append((r["centroid"], r["size"]))
    for key, values in data.items():
        want = _bands(values)
        assert [n for _, n in sorted(got[key])] == [n for _, n in want], key
        assert [c for c, _ in sorted(got[key])] == pytest.approx([c for c, _ in want])
    blocks = tables["blocks"][0]
    assert blocks.count() < len(rows) / 8 and blocks.agg({"_c": "sum"}).first()[0] == len(rows)
