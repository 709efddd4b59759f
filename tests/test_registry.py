"""Fits and joins over a catalogue small enough to work out by hand."""

import pytest
from pyspark.sql import functions as F

from catalith.operators import registry as R
from catalith.operators import resolve as J
from catalith.operators import stages as S
from catalith.operators import style as Y

SCHEMA = (
    "row_id long, part_number string, dept string, class string, fine string, classpath string, product_name string, manufacturer string, brand string, supplier string, mpn string, "
    "description string, approvals string, hints array<string>, attributes array<struct<label string, value string, uom string>>"
)


def row(i, brand, supplier, mpn, text, hints=(), maker=None, approvals="UL|CSA", path="A > Saws"):
    return (i, str(i), "Tools", "Saws", "Circ", path, "Saw", maker or f"{brand} Inc", brand, supplier, mpn, text, approvals, list(hints), [("Color", "Red", ""), ("Length", "5", "inches")])


@pytest.fixture(scope="module")
def rows(spark):
    found = [
        row(1, "Acme", "Coop (X)", "AC100", "acm saw", ["ACME"]), row(2, "Acme", "Coop (X)", "AC200", "acm drill", ["ACME"]), row(3, "Acme", "Solo", "AC300", "acm", []),
        row(4, "Bolt", "Coop (X)", "BO100", "blt saw", ["Vague"]), row(5, "Bolt", "Other", "BO200", "blt", ["Vague"]), row(6, "Acme", "Other", "AC400", "acm", ["Vague"]),
    ]
    return spark.createDataFrame(found, SCHEMA)


def test_cascade_takes_the_first_rule_that_answers(spark, rows):
    asked = [
        (1, "Coop (X)", ["acme"], "ZZ9", "x"), (2, "nobody", [], "AC777", "x"), (3, "nobody", ["Vague"], "ZZ1", "x"), (4, "nobody", ["Acmes"], "ZZ1", "x"),
        (5, "Solo", [], "ZZ1", "x"), (6, "nobody", [], "ZZ1", "blt thing"), (7, "Coop (X)", [], "ZZ1", "x"), (8, "nobody", [], "", ""),
    ]
    df = spark.createDataFrame(asked, "row_id long, supplier string, hints array<string>, mpn string, description string")
    got = {r.row_id: (r.brand, round(r.confidence, 2), r.provenance) for r in J.resolve(df, R.fit(rows)).collect()}
    assert got[1] == ("Acme", 0.97, "brand-exact")
    assert got[2] == ("Acme", 0.93, "mpn-prefix:AC")
    assert got[3] == ("Bolt", 0.8, "brand-exact-ambiguous")
    assert got[4] == ("Acme", 0.88, "brand-fuzzy")
    assert got[5] == ("Acme", 0.9, "supplier:1.00")
    assert got[6] == ("Bolt", 0.84, "desc-token:blt")
    assert got[7] == ("Acme", 0.6, "supplier:0.67")
    assert got[8] == ("", 0.0, "unresolved")


def test_ties_go_to_the_first_seen(spark):
    counts = R.counted(spark.createDataFrame([(1, "k", "b"), (2, "k", "a"), (3, "k", "a"), (4, "k", "b")], "row_id long, key string, v string"), ["key"], "v")
    assert R.modal(counts, ["key"], "v").first()["v"] == "b"


def test_approvals_need_three_rows_that_agree(rows):
    assert [(r.brand, r.approvals) for r in R.brand_approvals(rows).collect()] == [("Acme", ["CSA", "UL"])]


@pytest.mark.parametrize(("key", "match"), [("ge", None), ("jet", "jet"), ("frigidaire gallery", "frigidaire"), ("frigidare", "frigidaire"), ("hager", None)])
def test_safe_match(spark, key, match):
    table = spark.createDataFrame([("ge",), ("jet",), ("frigidaire",), ("milwaukee tool",)], "key string")
    found = J.safe_match(spark.createDataFrame([(key,)], "key string"), table).collect()
    assert [r.match for r in found] == ([match] if match else ["ge"] if key == "ge" else [])


def test_spellings_of_a_label(spark):
    rows = [("Number of Wash Cycles",), ("",), (None,), ("Mounting Type",), ("Finish",), ("Box / Size",)]
    got = {r.label: r.s for r in spark.createDataFrame(rows, "label string").select("label", Y.spellings(F.col("label")).alias("s")).collect()}
    found = got["Number of Wash Cycles"]
    assert found[:3] == ["Number of Wash Cycles", "Number of Wash Cycl", "Number of Wash Cycleses"] and found[-2:] == ["NOWC", ""] and "Wash" in found
    assert got[""] == got[None] == [""]
    assert got["Mounting Type"] == ["Mounting", "Mounting Type", "Mounting Types", "Mountings", "Type", "Types", "MT", ""]
    assert got["Finish"] == ["Finish", "Finishes", "F", ""] and "Box" in got["Box / Size"] and "Boxes" in got["Box / Size"]


def test_values_are_located_with_their_labels(spark):
    facts = spark.createDataFrame([(1, "p", "long", "Cover, 4 in Length, 4 in Width", "Length", "4 in"), (1, "p", "long", "Cover, 4 in Length, 4 in Width", "Width", "4 in"), (1, "p", "long", "none", "Width", "9")], "row_id long, classpath string, surface string, text string, label string, value string")
    got = {(r.label, r.value): (r.at, r.separator, r.suffix) for r in Y.located(facts).collect()}
    assert got["Length", "4 in"] == (7, " ", "Length")
    assert got["Width", "9"] == (None, None, None)
    assert got["Width", "4 in"][2] in ("Width", "")  # only the first place of a spelling counts


def test_score_counts_present_parts_only(spark):
    df = spark.createDataFrame([({"classpath": 0.9, "brand_name": 0.8}, ["missing X"]), ({}, [])], "c map<string,double>, i array<string>")
    got = [(r.x.overall, r.x.needs_review) for r in df.select(S.overall(F.col("c"), F.col("i")).alias("x")).collect()]
    assert got == [(round((0.9 * 0.25 + 0.8 * 0.2) / 0.45 * 0.92, 3), False), (0.0, True)]
