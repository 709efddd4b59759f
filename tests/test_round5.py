"""Work that follows from values that repeat is done once, and a row's few labels are ordered without sorting all rows."""

from pyspark.sql import functions as F

from catalith.operators import style as Y
from catalith.plans import more_queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_of_a_row_are_ordered_within_the_row(spark):
    assert "Exchange" not in _plan(more_queries._order(spark, "/root/testdata/sf0.001"))


def test_build_order_sorts_no_windows(spark):
    style = lambda inclusion, rank: (inclusion, rank)
    rows = [(1, "long", 0, "a", True, style(0.9, 2.0), "x"), (1, "long", 1, "b", True, style(0.4, None), "y"), (1, "long", 2, "c", True, style(0.9, 1.0), "z"), (1, "long", 3, "d", True, style(0.1, None), "u"), (2, "mobile", 0, "a", False, None, "v"), (2, "long", 5, "a", False, None, "w")]
    df = spark.createDataFrame(rows, "row_id long, surface string, slot int, label_key string, specific boolean, style struct<inclusion:double,rank:double>, value string")
    out = Y.build_order(df)
    assert "Window" not in _plan(out) and out.columns == [*df.columns, "learned", "position"]
    assert {(r.row_id, r.label_key, r.position) for r in out.collect()} == {(1, "c", 0.0), (1, "a", 1.0), (1, "b", 1.25), (2, "a", 5.0)}


def test_each_fact_has_the_place_of_its_own_value(spark):
    facts = spark.createDataFrame([(1, "p", "invoice", "VALVE BLU 5", "Color", "blue"), (1, "p", "invoice", "VALVE BLU 5", "Color", "valve"), (1, "p", "invoice", "VALVE BLU 5", "Size", None)], "row_id long, classpath string, surface string, text string, label string, value string")
    words = spark.createDataFrame([("BLUE", "BLU")], "word string, short string")
    assert {(r.value, r["at"]) for r in Y.located_in_invoice(facts, words).collect()} == {("blue", 6), ("valve", 0), (None, None)}


def test_rows_meet_what_was_looked_up_in_one_join(spark):
    from catalith.plans import run_queries

    plan = run_queries._hints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 4


def test_a_sheet_takes_rows_of_some_columns(tmp_path):
    from catalith.sources import workbooks as W

    with open(tmp_path / "a.xlsx", "wb") as stream:
        writer = W.SheetWriter(stream, ["x", "y", "z"], "S")
        writer.add([("1",), (None,)], ["C"])
        writer.close()
    assert list(W.Workbook((tmp_path / "a.xlsx").read_bytes()).rows()) == [{0: "x", 1: "y", 2: "z"}, {2: "1"}, {}]


def test_condensed_facts_count_as_often_as_they_stand_for(spark):
    found = spark.createDataFrame([(1, "p", "long", "Size", 0, " ", "Kit", 3), (9, "p", "long", "Size", None, None, None, 1)], "row_id long, classpath string, surface string, label string, at int, separator string, suffix string, _times long")
    (r,) = Y.mined(found).collect()
    assert (r.rows, r.inclusion, r.suffix) == (4, 0.75, "Kit")


def test_descriptions_are_written_down_before_the_search(spark, monkeypatch):
    from catalith.plans import run_queries

    seen, real = [], run_queries.written
    monkeypatch.setattr(run_queries, "written", lambda df, name: seen.append(name) or real(df, name))
    run_queries._descriptions(spark, "/root/testdata/sf0.001")
    assert "texts" in seen
