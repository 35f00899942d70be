import json

import pytest
from pyspark.sql import functions as F

from marketlens.functions.urls import condition_from_markers, condition_from_url
from marketlens.sources import listings, logs, pages, snapshots, tables


@pytest.fixture
def folder(tmp_path):
    def put(name, products, source=None, scraped="2024-01-01T00:00:00"):
        (tmp_path / name).write_text(json.dumps({"source": source or name.split("_20")[0], "url": "u", "scraped_at": scraped, "total": len(products), "products": products}))

    put("cex_2024-01-01_10-00-00.json", [{"name": "a", "price": 1.5, "available": True}])
    put("cex_2024-01-02_10-00-00.json", [{"name": "b", "source": "cex"}, {"name": "c"}], scraped="2024-01-02T00:00:00")
    put("cex_2024-01-03_10-00-00.json", [])
    put("ebay_2024-01-01_10-00-00.json", [])
    put("subito_2024-01-01_10-00-00.json", [{"name": "s"}])
    (tmp_path / "rebuy_2024-01-01_10-00-00.json").write_text('{"source": "rebuy", "products": [')
    return str(tmp_path)


def test_snapshots(spark, folder):
    docs = snapshots.read_snapshots(spark, folder)
    latest = {r["file_source"]: r["file"] for r in snapshots.latest_snapshot(docs).collect()}
    assert latest["cex"] == "cex_2024-01-02_10-00-00.json" and latest["ebay"] == "ebay_2024-01-01_10-00-00.json"
    combined = snapshots.combined_latest(docs)
    assert sorted((r["name"], r["source"], r["pos"]) for r in combined.collect()) == [("b", "cex", 0), ("c", "cex", 1)]
    assert [r["name"] for r in snapshots.history(docs, "cex").collect()] == ["a", "b", "c"]
    kept, gone = snapshots.retain_latest(docs, 1)
    assert gone.where("file_source = 'cex'").count() == 2 and kept.where("file_source = 'cex'").count() == 1
    assert snapshots.retain_latest(docs, 0)[1].count() == 0
    config = spark.createDataFrame([("cex", "CEX", "#e6b800", True)], "id string, label string, color string, enabled boolean")
    meta = {r["id"]: r for r in snapshots.sources_meta(docs, config).collect()}
    assert (meta["cex"]["snapshots"], meta["cex"]["last_total"], meta["cex"]["last_scraped"]) == (3, 2, "2024-01-02T00:00:00")
    assert (meta["ebay"]["label"], meta["ebay"]["color"]) == ("Ebay", "#888")


def test_listing_json(spark):
    item = {
        "subject": "Xbox One S", "body": "bella", "urls": {"default": "https://www.site.it/x.htm"}, "urn": "id:ad:uuid:list:123456789",
        "features": {"/price": {"values": [{"key": "350", "value": "350 €"}]}, "/item_condition": {"values": [{"key": "30", "value": "Buono"}]}},
        "geo": {"town": {"value": "Roma"}, "region": {"value": "Lazio"}}, "images": [{"cdnBaseUrl": "https://img"}], "date": "2024-01-01 10:00:00", "advertiser": {"company": False}, "type": {"key": "s"},
    }
    off_topic, free = {**item, "subject": "box per gatti", "body": ""}, {**item, "urn": "", "features": {"/price": {"values": [{"key": "0"}]}}, "type": {"key": "k"}}
    rows = listings.flatten_listing_json(spark.createDataFrame([(json.dumps(x),) for x in (item, off_topic, free, {})], "json string")).collect()
    assert len(rows) == 2
    first = rows[0]
    assert (first["sku"], first["price"], first["city"], first["available"], first["condition"], first["seller_type"]) == ("SUBITO-123456789", 350.0, "Roma", True, "Usato", "privato")
    assert rows[1]["price"] is None and rows[1]["price_display"] == "Trattabile" and not rows[1]["available"] and len(rows[1]["sku"]) == len("SUBITO-") + 16


def test_sold_rows(spark):
    rows = [("Console Xbox One S", "EUR 120,00", "https://x/none"), ("Controller Xbox One", "EUR 50,00", "u"), ("Console Xbox 360", "EUR 5,00", "u"), ("Shop on eBay", "EUR 20", "u"), ("Xbox Series X console", "EUR 1.350,00", "https://x/itm/77?y")]
    df = spark.createDataFrame([(t, p, " ieri ", u, "q") for t, p, u in rows], "title string, price_text string, sold_date string, url string, query_label string")
    got = {r["name"]: r for r in listings.flatten_sold(df).collect()}
    assert set(got) == {"Console Xbox One S", "Xbox Series X console"}
    assert got["Xbox Series X console"]["sku"] == "EBAY-77" and got["Xbox Series X console"]["price"] == 1350.0
    assert got["Console Xbox One S"]["sku"].startswith("EBAY-") and len(got["Console Xbox One S"]["sku"]) == 21 and got["Console Xbox One S"]["price"] == 120.0


def test_variants(spark):
    buttons = [("a1", "Eccellente", "Eccellente non disponibile", True), ("a2", "Molto buono", "Molto buono + 11,00 €", False), ("a3", "Buono", "Buono", False), ("a4", "", "Accettabile - 7,00 €", False)]
    df = spark.createDataFrame([("Xbox", "R", 218.99, "", True, "", buttons)], "name string, sku string, price double, price_display string, available boolean, grade string, buttons array<struct<code:string,grade:string,text:string,disabled:boolean>>")
    got = [(r["sku"], r["name"], r["price"], r["available"]) for r in listings.expand_variants(listings.variant_prices(df, "price", "buttons").drop("buttons")).orderBy("sku").collect()]
    assert got == [("R-A1", "Xbox [Eccellente]", None, False), ("R-A2", "Xbox [Molto buono]", 229.99, True), ("R-A3", "Xbox [Buono]", 218.99, True), ("R-A4", "Xbox [A4]", 211.99, True)]


CARD = """<html><body><div class="ajax_block_product x"><h3><a href="http://www.shop.it/12-xbox.html" title="Xbox One S 1TB">Xbox One</a></h3>
<img src="/i.jpg"><span class="price">199,99 &euro;</span><br><span class="availability">Disponibile</span></div>
<div class="ajax_block_product"><h3><a href="http://www.shop.it/13-xbox-usata.html" title="Xbox 360">x</a></h3><span class="price">50</span><p>unclosed<span class="availability">Non disponibile</span></div>
<div class="other"><h3><a href="no" title="no">no</a></h3></div><div id="pagination"><a href="?p=2">Successivo</a></div></body></html>"""


def test_cards(spark):
    df = spark.createDataFrame([(1, CARD), (2, None), (3, "<p>none")], "page_id long, html string")
    cards = pages.extract_cards(df, pages.GAMESHOCK)
    offers = pages.cards_to_offers(
        cards, "gameshock", condition=condition_from_markers(F.col("title"), F.col("url")), available=~F.lower("availability").contains("non disp"), sku=F.regexp_extract("url", r"/(\d+-[^/]+)\.html$", 1)
    )
    got = [(r["card_no"], r["title"], r["price"], r["condition"], r["available"], r["sku"], r["image_url"]) for r in offers.orderBy("card_no").collect()]
    assert got == [(0, "Xbox One S 1TB", 199.99, "Nuovo", True, "12-xbox", "/i.jpg"), (1, "Xbox 360", 50.0, "Usato", False, "13-xbox-usata", None)]
    assert [r[0] for r in df.orderBy("page_id").select(pages.has_next_page(F.col("html"))).collect()] == [True, False, False]


def test_other_layouts(spark):
    html = """<div class="js-product product"><article class="product-miniature" data-id-product="5" data-id-product-attribute="7"><div class="thumbnail-container"><img src="s.jpg"></div>
    <h2 class="product-title"><a href="https://j/5-xbox-usato">Xbox</a></h2><span class="price" aria-label="Prezzo">10,00 €</span></article></div>"""
    row = pages.extract_cards(spark.createDataFrame([(1, html)], "page_id long, html string"), pages.JOLLYROGERBAY).first()
    assert (row["product_id"], row["attribute_id"], row["name"], row["price_text"], row["image_url"]) == ("5", "7", "Xbox", "10,00 €", "s.jpg")
    assert spark.createDataFrame([(row["url"],)], "u string").select(condition_from_url(F.col("u"))).first()[0] == "Usato"


def test_card_keys_stay_exact(spark):
    """A large id beside a null one, pages without cards, null and empty pages, repeated rows."""
    html = '<div class="ry-card"><a href="/x"><p class="title">A</p></a></div>'
    rows = [((1 << 60) + 1, html), (None, html), (5, None), (6, ""), (7, "<p>none</p>"), (8, html), (8, html)]
    got = pages.extract_cards(spark.createDataFrame(rows, "page_id long, html string").coalesce(1), pages.REBUY).collect()
    assert sorted(((r["page_id"] or 0, r["card_no"], r["name"], r["url"]) for r in got)) == [(k, 0, "A", "/x") for k in (0, 8, 8, (1 << 60) + 1)]
    assert pages.extract_cards(spark.createDataFrame([], "page_id long, html string"), pages.GAMELIFE).isEmpty()


def test_text_cards(spark):
    html = """<div class="ry-card product--unavailable"><a href="/i,123/xbox"><img src="p.png"><span class="title">Xbox One S 1TB</span></a><p>Molto buono</p><b>da 129,99 €</b></div>"""
    row = pages.extract_cards(spark.createDataFrame([(1, html)], "page_id long, html string"), pages.REBUY).first()
    assert (row["name"], row["url"], row["image_url"]) == ("Xbox One S 1TB", "/i,123/xbox", "p.png")
    assert "129,99" in row["text"] and "product--unavailable" in row["card_class"].split()
    html = """<div class="lista_prodotto"><div class="lista_prodotto_titolo"><a href="/x">Xbox Series S</a></div><table><tr><td><img src="/t.jpg"></td></tr></table>
    Cod. prodotto: AB12 <span class="prezzo_finale">299,00 €</span><span class="float_right"><span class="bold">Disponibile</span><img src="/disponibile.gif"></span></div>"""
    row = pages.extract_cards(spark.createDataFrame([(1, html)], "page_id long, html string"), pages.GAMEPEOPLE).first()
    assert (row["name"], row["url"], row["price_text"], row["availability"], row["stock_image"]) == ("Xbox Series S", "/x", "299,00 €", "Disponibile", "/disponibile.gif")
    assert "AB12" in row["text"]


def test_two_lines_of_a_card(spark):
    html = """<div class="o_wsale_product_grid_wrapper"><form aria-label="Xbox Series X"><h2><a href="/p/hw1">x</a></h2>
    <img class="oe_product_image_img" alt="[HWXX0001_U] Xbox Series X (Usato)" src="/i"><span class="o_ribbons">Novità</span>
    <div class="col-12 d-flex flex-column justify-content-center"><div class="row"><span class="available">Nuovo</span><span class="oe_currency_value">499,98</span></div>
    <div class="row"><span class="unavailable">Usato</span><span class="oe_currency_value">399,98</span></div><div class="row"><span class="available">Noleggio</span></div></div></form></div>"""
    cards = pages.extract_cards(spark.createDataFrame([(1, html)], "page_id long, html string"), pages.GAMELIFE)
    got = [(r["sku"], r["name"], r["condition"], r["price"], r["available"]) for r in listings.two_condition_cards(pages.lines_of(cards)).orderBy("sku").collect()]
    assert got == [("HWXX0001_N", "Xbox Series X", "Nuovo", 499.98, True), ("HWXX0001_U", "Xbox Series X", "Usato", 399.98, False)]


def test_embedded_json(spark):
    html = '<script id="__NEXT_DATA__" type="application/json">{"a": {"b": 3}}</script>'
    row = pages.extract_embedded_json(spark.createDataFrame([(html,), ("<p>",)], "html string"), schema="a struct<b:int>").collect()
    assert row[0]["json"]["a"]["b"] == 3 and row[1]["json"] is None


def test_logs(spark, tmp_path):
    (tmp_path / "source-cex.log").write_text("[x] job old run\nTraceback\n[y] job cex started at 2024-01-01T00:00\nwork\njob scrape-cex OK\n")
    (tmp_path / "backup.log").write_text("no marker\n")
    lines = logs.read_job_logs(spark, str(tmp_path / "*.log"))
    got = {}
    for r in lines.orderBy("line_no").collect():
        got.setdefault(r["job"], []).append(r["line"])
    assert got == {"scrape-cex": ["[y] job cex started at 2024-01-01T00:00", "work", "job scrape-cex OK"], "backup": ["no marker"]}
    assert {r["job"]: r["started_at"] for r in logs.started_at(lines, ["job"]).collect()} == {"scrape-cex": "2024-01-01T00:00", "backup": None}


def test_versions(spark, tmp_path):
    folder = str(tmp_path)
    assert tables.latest_version(spark, folder, "t") is None
    tables.publish(spark.range(3), folder, "t", 1)
    tables.publish(spark.range(5), folder, "t", 2)
    assert tables.latest_version(spark, folder, "t") == 2 and tables.read_version(spark, folder, "t", 1).count() == 3
    with pytest.raises(ValueError):
        tables.export_reports({"nonsense": spark.range(1)}, folder)


DOCUMENT = "file string, source string, url string, scraped_at string, total long, products array<struct<name:string,source:string,price:double>>"


def _documents(spark, rows):
    """Documents in the envelope's columns; products are given as (name, source, price)."""
    df = spark.createDataFrame(rows, DOCUMENT)
    kind = snapshots.ENVELOPE["products"].dataType.elementType
    full = lambda p: F.struct(*[p[f.name].alias(f.name) if f.name in ("name", "source", "price") else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
    return df.withColumn("products", F.transform("products", full))


def test_documents_round_trip(spark, tmp_path):
    """Null and empty products, accents, several partitions; writing again replaces, an empty table writes nothing."""
    folder = str(tmp_path / "docs")
    rows = [
        ("a_2024-01.json", "a", "u", "t1", 2, [("Città \"x\"\n", None, 1.5), ("b", "s", None)]), ("a_2024-02.json", "a", None, "t2", 0, []),
        ("b_2023-01.json", None, None, None, None, [("only", "", 2.0)]), ("c_2023-01.json", "c", "u", "t", 0, None),
    ]
    docs = _documents(spark, rows).repartition(3)
    for _ in range(2):
        snapshots.write_documents(docs, folder)
    read = snapshots.read_snapshots(spark, folder)
    assert sorted(r["file"] for r in read.collect()) == [r[0] for r in rows]
    got = {(r["file"], r["pos"]): (r["name"], r["source"], r["price"]) for r in snapshots.explode_products(read).collect()}
    assert got == {("a_2024-01.json", 0): rows[0][5][0], ("a_2024-01.json", 1): rows[0][5][1], ("b_2023-01.json", 0): rows[2][5][0]}
    # The newest document with products; a source that a product does not name is the file's.
    combined = {(r["file"], r["source"]) for r in snapshots.combined_latest(read).collect()}
    assert combined == {("a_2024-01.json", "a"), ("a_2024-01.json", "s"), ("b_2023-01.json", "b")}
    assert [r["name"] for r in snapshots.history(read, "a").collect()] == [rows[0][5][0][0], "b"]
    snapshots.write_documents(docs.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())


def test_documents_are_written_in_batches_of_bounded_size(spark, tmp_path, monkeypatch):
    """Long documents go to Python a few at a time, however many a task writes."""
    held, plain = [], snapshots._writes

    def counted(docs, folder):
        out = plain(docs, folder).persist()
        held.extend(r["written"] for r in out.collect())
        return out

    monkeypatch.setattr(snapshots, "_writes", counted)
    monkeypatch.setattr(snapshots, "BATCH", 100_000)
    rows = [(f"a_2024-{i:02d}.json", "a", "u", "t", 1, [("x" * 40_000, None, 1.0)]) for i in range(20)]
    snapshots.write_documents(_documents(spark, rows).coalesce(1), str(tmp_path / "docs"))
    assert sum(held) == 20 and max(held) <= 4
    assert snapshots.read_snapshots(spark, str(tmp_path / "docs")).count() == 20


def test_report_sizes(spark, tmp_path):
    """An empty report counts as none, names outside the export are refused."""
    rows = spark.range(3)
    tables.export_reports({"sources": rows, "db-products": rows.limit(0)}, str(tmp_path))
    sizes = tables.report_sizes(spark, str(tmp_path), ("sources", "db-products"))
    assert {r["report"]: r["rows"] for r in sizes.collect()} == {"sources": 3, "db-products": 0}
    with pytest.raises(ValueError, match="unknown reports"):
        tables.export_reports({"other": rows}, str(tmp_path))


def test_reports_of_empty_tables(spark, tmp_path):
    """Every report is there; those of single figures have their row, the others none."""
    from marketlens.bindings import catalogue, roles
    from marketlens.plans import reports

    sf = "/root/testdata/sf0.001"
    none = lambda df: df.limit(0)
    rows, categories, sizes = (none(d) for d in catalogue._dims(spark, sf))
    sales = none(roles.fact(spark, sf).withColumn("first_seen", F.col("ts")).withColumn("id", F.col("l_orderkey")))
    built = reports.build(
        products=rows, categories=categories, sizes=sizes, named=none(catalogue._named(spark, sf)), changes=none(roles.change_log(spark, sf)), ads=none(roles.ads(spark, sf)),
        store_sales=sales, offers=none(roles.offers(spark, sf)), listings=none(roles.active_listings(spark, sf)), documents=none(_documents(spark, [("a_2024.json", "a", "u", "t", 0, [])])).withColumn("file_source", F.col("source")),
        sources=spark.createDataFrame([], "id string, label string, color string, enabled boolean"), as_of=F.lit("2024-01-01").cast("timestamp"), listing_tie=("l_orderkey",), price="price",
    )
    assert set(built) == set(tables.REPORTS)
    tables.export_reports(built, str(tmp_path))
    found = {r["report"]: r["rows"] for r in tables.report_sizes(spark, str(tmp_path)).collect()}
    assert found["subito-stats"] == 1 and {n for n, k in found.items() if k} <= {"subito-stats", "ebay-stats"}


def _size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def _shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_reports_and_steps_leave_no_shuffles_and_little_text(spark, tmp_path):
    """Sorted, doubled and null rows come back whole from a fraction of their text, and what was shuffled for them is gone."""
    from marketlens.session import written

    ids = spark.range(20_000).select(F.col("id"), F.lit("a rather long text that every row repeats").alias("text"), F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("price"))
    rows = ids.unionByName(ids.limit(5)).orderBy(F.col("price").desc(), "id")
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = _shuffle_files(spark), spark.conf.get(setting)
    tables.export_reports({"sources": rows, "db-products": rows.limit(0)}, str(tmp_path))
    steps = written(rows.groupBy("price").agg(F.count("*").alias("n")), "steps")
    assert not _shuffle_files(spark) - before and spark.conf.get(setting) == was
    assert steps.agg(F.sum("n")).first()[0] == 20_005
    whole = rows.toPandas().to_json(orient="records", lines=True)
    assert _size(tmp_path / "sources") < 0.25 * len(whole)
    read = spark.read.schema(rows.schema).json(f"{tmp_path}/sources")
    assert read.exceptAll(rows).isEmpty() and read.count() == 20_005
    assert {r["report"]: r["rows"] for r in tables.report_sizes(spark, str(tmp_path), ("sources", "db-products")).collect()} == {"sources": 20_005, "db-products": 0}


def test_documents_under_names_of_packed_files(spark, tmp_path):
    """A name in .gz is a compressed file with the same document; a document without a name is still written."""
    rows = [(f"a_2024-{i:02d}.json", "a", "u", "t", 300, [(f"Città {i}", None, 1.5)] * 300) for i in range(4)]
    docs = _documents(spark, rows)
    more = _documents(spark, [(None, None, "u", "t", 1, [("x", None, None)])])
    snapshots.write_documents(docs, str(tmp_path / "plain"))
    snapshots.write_documents(docs.withColumn("file", F.concat("file", F.lit(".gz"))).unionByName(more), str(tmp_path / "packed"))
    plain, packed = (snapshots.read_snapshots(spark, str(tmp_path / n)).select("file", "source", "scraped_at", "total", "products") for n in ("plain", "packed"))
    assert sorted(f.name for f in (tmp_path / "packed").glob("[!.]*")) == ["None", *[f"{r[0]}.gz" for r in rows]]
    assert _size(tmp_path / "packed") < 0.5 * _size(tmp_path / "plain")
    named = packed.where("source is not null").withColumn("file", F.regexp_replace("file", r"\.gz$", ""))
    assert named.exceptAll(plain).isEmpty() and named.count() == plain.count() == 4 and packed.count() == 5


def test_documents_of_the_reports_equal_the_plain_ones(spark, tmp_path):
    """Made in parts and compressed, with lines without order, parts without brand, doubled lines and a block number beyond its digits."""
    from marketlens.bindings import snapshots as bound

    parts = [(i, f"part {i}", None if i == 3 else f"Brand#{i % 2}", "SMALL", 20, 1.0) for i in range(4)]
    keys = [1, 2, 4_999, 5_000, 12_345, 60_000, 60_001, 5000 * 123_456_789, 5000 * 123_456_780, None]
    lines = [(k, p, 1, n, 2.0, 10.0 + n, "R" if n else "A", "O") for k in keys for p in range(4) for n in (0, 1) if k is not None or p == 0] * 2
    data = tmp_path / "data"
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{data}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").withColumn(
        "l_shipdate", F.lit("2024-01-01").cast("timestamp")
    ).write.parquet(f"{data}/lineitem.parquet")
    plain, packed = snapshots.read_snapshots(spark, bound._documents(spark, str(data))), bound._packed_documents(spark, str(data))
    assert packed.dtypes == plain.dtypes
    # Of the documents without a name one stays, whichever it is.
    assert packed.where("file = 'None'").count() == plain.where("file = 'None'").count() == 1
    named = [d.where("file <> 'None'") for d in (plain, packed)]
    assert named[0].exceptAll(named[1]).isEmpty() and named[0].count() == named[1].count() == len(set(r["file"] for r in named[1].collect())) > 8


def test_reports_all_writes_compressed_files(spark, tmp_path):
    """All that is written for the reports and their documents is compressed."""
    from marketlens.bindings import snapshots as bound

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bound, "shared_dir", lambda spark: str(tmp_path))
        rows = {r["report"]: r["rows"] for r in bound.reports_all(spark, "/root/testdata/sf0.001").collect()}
    kept = [f for f in tmp_path.rglob("*") if f.is_file() and not f.name.startswith((".", "_")) and f.stat().st_size]
    assert len(rows) == 14 and rows["ebay-sold"] > 1000 and kept and all(f.name.endswith(".gz") for f in kept)
