"""Rows that say the same are worked out once, few keys are dealt out over many tasks, and searches that meet nearly all pairs go block by block."""

from pyspark.sql import functions as F

from catalith.operators import registry as G
from catalith.operators import style as Y
from catalith.plans import record_queries

SMALL = "/root/testdata/sf0.001"


def _facts_seen(monkeypatch, query, spark, name="located"):
    seen, real = [], getattr(Y, name)
    monkeypatch.setattr(Y, name, lambda facts, *more: seen.append(facts) or real(facts, *more))
    query(spark, SMALL)
    return seen[0]


def test_located_looks_at_each_different_fact_once(spark, monkeypatch):
    facts = _facts_seen(monkeypatch, record_queries._located, spark)
    assert facts.groupBy("text", "label", "value").count().agg(F.max("count")).first()[0] < facts.agg(F.sum(G.TIMES)).first()[0] / 100
    assert facts.count() < facts.agg(F.sum(G.TIMES)).first()[0] == 3 * spark.read.parquet(f"{SMALL}/lineitem.parquet").count()


def test_facts_of_one_label_are_dealt_out(spark):
    facts = spark.range(400).select(F.col("id").alias("row_id"), F.lit("p").alias("classpath"), F.lit("long").alias("surface"), F.concat(F.lit("Valve "), F.col("id").cast("string"), F.lit(" Sizes")).alias("text"), F.lit("Size").alias("label"), F.col("id").cast("string").alias("value"))
    found = Y.located(facts)
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["at"], r.suffix, r.n) for r in found.groupBy("at", "suffix").agg(F.count("*").alias("n")).collect()] == [(6, "Sizes", 400)]


def test_facts_do_not_work_out_spellings(spark):
    facts = spark.createDataFrame([(1, "p", "long", "Valve 5", "Size", "5")], "row_id long, classpath string, surface string, text string, label string, value string")
    assert [r["at"] for r in Y.located(facts).collect()] == [6]
    # the plan begins with labels that are written down: what is asked of their spellings stays with them
    assert "labels-" in str(Y.located(facts).inputFiles())


def test_mined_style_looks_at_each_different_row_once(spark, monkeypatch):
    from catalith.plans import stage_queries

    facts = _facts_seen(monkeypatch, stage_queries._mined, spark)
    assert facts.count() < facts.agg(F.sum(G.TIMES)).first()[0]


def test_condensed_rows_are_condensed_again(spark):
    rows = spark.createDataFrame([(3, "a", "x", 2), (1, "a", "y", 5)], "row_id long, k string, v string, _times long")
    assert G.condensed(rows, "k").collect() == [("a", 1, 7)]


def test_descriptions_are_built_once_for_each_record(spark, monkeypatch):
    from catalith.plans import stage_queries

    seen, real = [], Y.described
    monkeypatch.setattr(Y, "described", lambda r, *more: seen.append(r) or real(r, *more))
    out = stage_queries._descriptions(spark, SMALL)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert seen[0].count() < lines == out.count()


def test_search_by_blocks_loses_nothing(spark, monkeypatch):
    from catalith.operators import retrieval
    from tests.test_retrieval import plain, rounded, texts

    monkeypatch.setattr(retrieval, "BLOCK", 60)
    rows = spark.createDataFrame(list(enumerate(texts(250, 1))), "row_id long, text string").cache()
    asked = spark.createDataFrame(list(enumerate([*texts(70, 2), "steel", "", "zzzzzz", "steel cover"])), "query_id long, text string").cache()
    index = retrieval.Index(rows)
    found = index.neighbours(asked, 5)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert rounded(found) == rounded(plain(index, asked, 5))


def test_texts_to_classify_by_are_written_down(spark, monkeypatch):
    from catalith.operators import retrieval
    from catalith.plans import stage_queries

    seen, real = [], retrieval.Index
    monkeypatch.setattr(retrieval, "Index", lambda rows, *more: seen.append(rows) or real(rows, *more))
    stage_queries._classify(spark, SMALL)
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
