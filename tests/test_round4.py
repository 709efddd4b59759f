"""What grew faster than its input: parts of a failing stage, repeated rows of a fit, and broadcasts by the size of a file."""

from functools import reduce

from pyspark.sql import functions as F

from catalith.operators import driver as R
from catalith.operators import registry as G
from catalith.plans.proxy import observations


def test_each_part_that_is_dealt_out_is_read_alone(spark):
    whole = spark.range(1_000).select(F.col("id").alias("row_id"), F.array().cast("array<string>").alias("issues"))
    parts = R._dealt(whole, "row_id", 0)
    assert len(parts) == R.FAN and all(p.inputFiles() for p in parts)
    files = [f for p in parts for f in p.inputFiles()]
    assert len(files) == len(set(files)) and all(p.columns == whole.columns for p in parts)
    assert sorted(r.row_id for r in reduce(lambda a, b: a.unionByName(b), parts).collect()) == list(range(1_000))
    assert len({f for p in R._dealt(parts[0], "row_id", 1) for f in p.inputFiles()} & set(files)) == 0


def test_repeated_rows_are_worked_out_once_and_count_each(spark):
    rows = spark.createDataFrame([(i, "Acme Corp", "acme®" if i % 3 else "Acme", ["Acme Corp"], "AC-1234") for i in range(30)], "row_id long, manufacturer string, brand string, hints array<string>, mpn string")
    each = G.condensed(rows, "brand")
    assert {(r.brand, r.row_id, r[G.TIMES]) for r in each.collect()} == {("Acme", 0, 10), ("acme®", 1, 20)}
    votes = G.brand_votes(rows).groupBy("brand").agg(F.sum("n").alias("n"), F.min("first").alias("first")).collect()
    assert {(r.brand, r.n, r.first) for r in votes} == {("Acme", 20, 0), ("acme®", 40, 8)}
    assert {(r.key, r.brand): (r.n, r.first) for r in G.prefix_votes(rows).collect()}[("AC12", "acme®")] == (20, 1)


def test_parts_are_not_sent_to_the_driver(spark):
    plan = observations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
