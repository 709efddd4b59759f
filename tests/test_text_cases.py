"""Each rule of the text and measure functions, on texts that tell it from the others."""

import pytest
from pyspark.sql import functions as F

from catalith.functions import identifiers as I
from catalith.functions import measure as M
from catalith.functions import text as X
from catalith.operators import resolve as J
from catalith.operators import style as Y
from catalith.sources import tables as T

CASES = {
    "o024_strip_condition": (X.strip_condition, [("PDSH4816AF Dishwasher SS - Display Only", "PDSH4816AF Dishwasher SS"), ("Drill (Refurbished)", "Drill"), ("Display", "Display"), ("Saw - Scratch & Dent", "Saw"), ("LED Display Panel", "LED Display Panel"), ("Range - open box", "Range")]),
    "o027_country_name": (X.country_name, [("CN", "China"), ("us.", "United States"), ("Taiwan", "Taiwan"), ("zz", "zz"), ("", "")]),
    "o028_canonical_unit": (X.canonical_unit, [("Inches", "in"), ("LBS.", "lb"), ("vac", "V AC"), ("kwh", "kW-hr"), ("furlong", "furlong"), ("--", "")]),
    "o029_space_units": (X.space_units, [("24in x 3FT", "24 in x 3 ft"), ("120v 15A 60hz", "120 V 15 A 60 Hz"), ("5 rpm", "5 RPM"), ("S6601A", "S6601 A"), ("inch", "inch")]),
    "o030_measure_text": (M.measure_text, [('50.25" H', "50-1/4 in H"), ("42 3/4in", "42 3/4 in"), ("42 3/4 in", "42-3/4 in"), ("5.6 in", "5-5/8 in"), ("6' cord", "6 ft cord"), ("1.68 gal", "1.68 gal"), ("v1.5 24IN", "v1.5 24 in")]),
    "o031_title_case": (X.title_case, [("led flood light with pir", "LED Flood Light with Pir"), ("THE BIG saw", "THE BIG Saw"), ("gfci outlet 15a for the home", "GFCI Outlet 15a for the Home"), ("of mice", "Of Mice"), ("(pvc) pipe", "(PVC) Pipe")]),
    "o033_invoice_line": (X.invoice_line_folded, [("stainless steel duplex receptacle cover with mounting bracket", "SST DUPLEX RCPT COVER WITH MTG BRACKET"), ("short line", "SHORT LINE"), ("industrial square toggle switch cover plate black", "INDL SQ TOGGLE SWITCH COVER PLATE BLACK")]),
    "o035_glue_units": (X.glue_units, [("120 V 15 A", "120V 15A"), ("24 IN x 2 FT", "24IN x 2FT"), ("24 in", "24 in"), (None, "")]),
    "o038_fractions_in_text": (M.fractions_in_text, [("0.5 in and 50.25", "1/2 in and 50-1/4"), ("42 3/4", "42-3/4"), ("v1.5", "v1.5"), ("1.68 gal", "1.68 gal"), ("3.0 ft", "3 ft")]),
    "o039_snap_decimal_inches": (M.snap_decimal_inches, [("5.6 in", "5-5/8 in"), ("8.5in", "8-1/2 in"), ('3.25"', "3-1/4 in"), ("5.6 mm", "5.6 mm"), ("0.99 in", "1 in")]),
    "o039_snap_inches": (M.snap_inches, [("5.6", "5-5/8"), ("0.5", "1/2"), ("2.99", "3"), ("7.01", "7"), ("abc", "abc")]),
    "o046_singular": (X.singular, [("Cycles", "Cycl"), ("Batteries", "Battery"), ("Stainless", "Stainless"), ("Boxes", "Box"), ("Bus", "Bus"), ("As", "As")]),
    "o046_plural": (X.plural, [("Cycle", "Cycles"), ("Battery", "Batteries"), ("Box", "Boxes"), ("Key", "Keys"), ("Switch", "Switches")]),
    "o183_unwrapped": (I.unwrapped, [("https://s.io/l/?uddg=https%3A%2F%2Fa.com%2Fx&r=1", "https://a.com/x"), ("https://a.com/y", "https://a.com/y")]),
    "o034_abbreviate": (lambda c: X.abbreviate(c, X.literal_map({"cover": "CVR", "steel": "STL"})), [("Steel Cover, plate", "STL CVR plate"), ("x", "x"), ("COVER", "CVR")]),
    "o022_is_placeholder": (X.is_placeholder, [("--", True), ("None", True), ("-- No Brand --", True), (" n/a ", True), ("GE", False), (None, True)]),
    "o044_dimensions": (lambda c: F.array_join(F.transform(M.dimensions(c), lambda x: F.concat_ws(":", x["axis"], x["value"], x["unit"])), ","), [("33-7/16 in H x 23-7/8 in W x 22-5/8 in D", "HEIGHT:33-7/16:in,WIDTH:23-7/8:in,LENGTH:22-5/8:in"), ("5 cm L", "LENGTH:5:cm"), ("none", "")]),
    "o045_split_measure": (lambda c: F.concat_ws("|", M.split_measure(c)["value"], M.split_measure(c)["unit"]), [("24 inches", "24|in"), ("1/2 in", "1/2|in"), ("5.6 in", "5-5/8|in"), ("42 3/4 in", "42-3/4|in"), ("blue", "blue|")]),
    "o049_is_abbreviation": (lambda c: X.is_abbreviation(F.split(c, "/")[0], F.split(c, "/")[1]), [("SURF/SURFACE", True), ("SFC/SURFACE", True), ("STL/STEEL", True), ("LST/STEEL", False), ("STEEL/STEEL", False)]),
    "o050_plausible_abbreviation": (lambda c: X.plausible_abbreviation(F.split(c, "/")[0], F.split(c, "/")[1]), [("SURFACE/SURF", True), ("FIRST/FT", False), ("12000/120", False), ("STEEL/STEE", True), ("COVER/CVR", True)]),
    "o056_head": (lambda c: Y.mobile_head(F.split(c, "/")[0], F.split(c, "/")[1]), [("Whirlpool Corporation/Whirlpool®", "Whirlpool"), ("/Acme", "Acme"), ("Acme/", "Acme"), ("Big/Big Brand", "Big Brand"), ("A/B", "A B")]),
    "o060_labelled_barcodes": (lambda c: F.array_join(F.transform(I.labelled_barcodes(c), lambda x: F.concat_ws("=", x["target"], x["code"])), ","), [("UPC: 036000291452, EAN #4006381333931 and GTIN 1234", "UPC=036000291452,GTIN=4006381333931"), ("upc 036000291453", "")]),
}


@pytest.mark.parametrize("name", list(CASES))
def test_rules(spark, name):
    fn, cases = CASES[name]
    out = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string").select("i", fn(F.col("a")).alias("out")).orderBy("i").collect()
    assert [r.out for r in out] == [b for _, b in cases]


def test_headers(spark):
    found = J.header_difference(["a", "c", "b", "x"], ["a", "b", "c", "d"], spark)
    assert {(r.header, r.problem) for r in found.collect()} == {("c", "misordered"), ("b", "misordered"), ("x", "added"), ("d", "missing")}
    assert len(T.delivery_columns(["a"] * 12, ["m"] * 6, ["t"] * 47)) == 252
