import pytest
from pyspark.sql import functions as F

from marketlens.functions import titles
from marketlens.operators.joins import fields_of, taxonomy_table
from marketlens.plans import classify


@pytest.fixture(scope="module")
def rated(spark):
    def run(names, hint=None):
        df = spark.createDataFrame([(i, n, hint) for i, n in enumerate(names)], "i int, name string, hint string")
        out = classify.standardize_titles(classify.classify_titles(df, "name", "hint"))
        return [r.asDict() for r in out.orderBy("i").collect()]

    return run


def test_same_product_same_key(rated):
    a, b = rated(["Microsoft Xbox One X 1TB [controller wireless incluso] nero", "Console Xbox One X 1 TB - Nero"])
    assert a["standard_name"] == b["standard_name"] == "Xbox One X 1 T - Nero"
    assert a["standard_key"] == b["standard_key"]


def test_generations_differ(rated):
    a, b = rated(["Console Xbox 360 250 GB nero", "Console Xbox 360 E 250 GB nero"])
    assert a["standard_name"] == "Xbox 360 Base/Core 250 GB - Bianco"
    assert b["standard_name"] == "Xbox 360 E 250 GB - Nero"
    assert a["standard_key"] != b["standard_key"]


@pytest.mark.parametrize(
    "title, wanted",
    [
        ("Microsoft Xbox Series S 512GB [controller wireless per Xbox Series X]", dict(console_family="series", sub_model="S", canonical_model="14111", standard_name="Xbox Series S 512 GB - Bianca")),
        ("Xbox360 250GB HaloR + 1 Pad Pad, Imballata", dict(console_family="360", standard_name="Xbox 360 Base/Core 250 GB - Bianco")),
        ("Xbox 360S 320GB MW3 + 2 Pads, Non Imballata", dict(sub_model="S", standard_name="Xbox 360 Slim/S 320 GB - Nero")),
        ("Xbox 360S Halo Ed +2Casa, Imballata", dict(standard_name="Xbox 360 Slim/S 320 GB - Halo 4")),
        ("Xbox 360 Elite, Resident Evil 5 Ltd. Ed. (No Gioco)", dict(edition_class="standard", canonical_model="12352")),
        ("Xbox Series X Edizione Digitale, 1TB, Robot White, Imballata", dict(standard_name="Xbox Series X 1 T - All-Digital Bianca")),
        ("Xbox360 320GB Halo4 + 1 Pad Pad", dict(canonical_model="12111")),
        ("Xbox 360S Gears3 Ed+1 Pad (No Gioco)", dict(canonical_model="12512")),
        ("Xbox 360 Halo 3 Special Edizione", dict(canonical_model="12111")),
        ("Console Xbox", dict(console_family="original", canonical_model="11111")),
        ("Nintendo Switch", dict(console_family="other", model_segment="unknown", classify_confidence=0.35, canonical_model="unknown")),
    ],
)
def test_known_titles(rated, title, wanted):
    (row,) = rated([title])
    assert {k: row[k] for k in wanted} == wanted


def test_keys_end_with_edition(rated):
    rows = rated(["Xbox360 320GB Halo4 + 1 Pad Pad", "Xbox 360S Gears3 Ed+1 Pad (No Gioco)", "Xbox 360 Halo 3 Special Edizione"])
    assert all(r["standard_key"].endswith("|standard") for r in rows)


def test_hint_wins(rated):
    (row,) = rated(["console nera 1TB"], hint="one-x")
    assert (row["console_family"], row["canonical_model"]) == ("one", "13321")


def test_no_break_space_and_accents(rated):
    (row,) = rated(["Xbox One S 1 TB più giochi"])
    assert (row["console_family"], row["sub_model"], row["canonical_model"]) == ("one", "S", "13222")


def test_attributes(one):
    assert one(titles.colors, t="Xbox bianca e nera, white") == "Bianco/Nero"
    assert one(titles.edition_name, t="Gears e Halo") == "Halo"
    assert one(titles.edition_in_title, t="Gears e Halo") == "Gears"
    assert one(titles.kinect, t="Xbox con Kinect") == 1
    assert one(titles.kinect, t="Xbox senza Kinect") == 0
    assert one(titles.kinect, t="Xbox") is None


def test_rules_without_lists(spark, one):
    import dataclasses

    from marketlens.catalog import CONSOLE_RULES

    bare = dataclasses.replace(CONSOLE_RULES, colors=(), editions=(), families=())
    assert one(lambda t: titles.colors(t, bare), t="nero") == ""
    assert one(lambda t: titles.edition_in_title(t, bare), t="halo") is None
    assert one(lambda t: titles.detect_family(t, bare), t="xbox one") == "original"


def test_taxonomy(spark):
    tax = taxonomy_table(spark)
    assert tax.count() == 67
    rows = spark.createDataFrame([("12622",), ("none",), ("other",)], "tid string")
    got = {r["tid"]: (r["console_family"], r["sub_model"], r["model_segment"], r["canonical_model"]) for r in fields_of(rows, tax, "tid").collect()}
    assert got == {"12622": ("360", "E", "base", "12622"), "none": ("other", "Unknown", "unknown", "other"), "other": ("other", "Unknown", "unknown", "other")}
    labels = {r["id"]: r["label"] for r in tax.collect()}
    assert labels["14233"] == "Xbox Series X 2 T - Galaxy Black" and labels["11111"] == "Xbox Original/OG Base 8 GB - Nero"


def test_rules_and_anchors(spark):
    ads = spark.createDataFrame(
        [(1, "Xbox One S 1TB bianca usata", "", None), (2, "lampada", "", None)], "id long, name string, body_text string, console_family string"
    )
    anchors = spark.createDataFrame([(9, "One S 1TB bianca", "one", "anchor-9"), (8, "One X", "one", "anchor-8")], "id long, name string, console_family string, canonical_model string")
    settled, open_rows = classify.rules_and_anchor_pass(ads, anchors)
    got = {r["id"]: r for r in settled.collect()}
    assert got[1]["canonical_model"] == "anchor-9" and got[1]["classify_method"] == "cex-match:v1"
    # Words: one, 1tb, bianca, usata against one, 1tb, bianca.
    assert got[1]["classify_confidence"] == pytest.approx(max(0.9, 0.65 + 0.75 * 0.3))
    assert [r["id"] for r in open_rows.collect()] == [2]


def test_parsed_view(spark):
    from marketlens.plans.showcase import parsed_view

    rows = spark.createDataFrame([("Xbox 360 Slim 250GB + Kinect gears red", "360", None), ("Xbox Series X 1TB Halo nera", None, "Nuovo")], "name string, console_family string, condition string")
    got = [r["combo_key"] for r in parsed_view(rows).select("name", "combo_key").orderBy("name").collect()]
    assert got == ["360|S|Gears Of War|true|250 GB|—|Imballata", "Serie|X|Halo|false|1 TB|Nuovo|Imballata"]
    assert parsed_view(rows).where(F.col("parsed_color") != "").count() == 0


def test_titles_are_read_once_per_pattern(spark, capsys):
    """The memory pattern and the plain words are columns of the plan, not repeated for each look at a catalogue row."""
    classify.classify_titles(spark.createDataFrame([("Xbox One S 1TB",)], "name string"), "name").explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count(r"memory\s*unit") == 1
    assert sum("[^a-z0-9]+" in line and "_t#" in line for line in plan.splitlines()) == 1
