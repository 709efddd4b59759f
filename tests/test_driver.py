"""The driver keeps a failure to the row and the stage that it happened in, and the chain runs from end to end."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalith.functions import similarity as M
from catalith.operators import chain as H
from catalith.operators import driver as R
from catalith.operators import extras as A
from catalith.plans import record_queries
from catalith.session import written

SF = "/root/testdata/sf0.001"


def records(spark, n=6):
    return spark.range(n).select(F.col("id").alias("row_id"), F.lit("old").alias("state"), F.array().cast("array<string>").alias("issues"), F.lit(False).alias("needs_review"))


def test_failures_stay_where_they_happen(spark):
    told = []

    def hook(name, when):
        told.append((name, when))
        raise RuntimeError("observers may fail")

    stages = [
        ("one", lambda r: r.withColumn("state", F.lit("new")).withColumn("failed", F.when(F.col("row_id") == 2, "ValueError"))),
        ("two", lambda r: r.select("nothing")),
        ("three", lambda r: r.withColumn("state", F.concat("state", F.lit("!")))),
    ]
    for cut in (None, lambda r, name: written(r, f"test-{name}")):
        told.clear()
        out = {r.row_id: r for r in R.run(records(spark), stages, hook, cut=cut).collect()}
        assert len(out) == 6 and told == [(n, w) for n in ("one", "two", "three") for w in ("start", "end")]
        assert out[2].state == "old!" and out[1].state == "new!"
        assert out[2].issues == ["stage one failed: ValueError", "stage two failed: AnalysisException"] and out[1].issues == ["stage two failed: AnalysisException"]
        assert all(r.needs_review for r in out.values())
    assert R.run(records(spark, 0), stages[:1]).count() == 0


def cut(r, name):
    return written(r, f"test-{name}")


def divided(n):
    """Fails in Python for one row."""

    @F.udf("int")
    def each(i):
        return 1 // (0 if i == n else 1)

    return each


def test_failures_at_run_time_stay_with_their_rows(spark):
    raised = lambda r, ids: r.withColumn("state", F.when(F.col("row_id").isin(*ids), F.raise_error(F.lit("bad"))).otherwise(F.concat("state", F.lit("1"))))
    stages = [
        ("one", lambda r: raised(r, [3, 17])),
        ("two", lambda r: r.withColumn("made", divided(5)(F.col("row_id")))),
        ("three", lambda r: r.withColumn("n", (F.when(F.col("row_id") == 8, F.lit("x")).otherwise(F.lit("1"))).cast("int"))),
        ("four", lambda r: r.withColumn("failed", F.when(F.col("row_id") == 9, "ValueError")).withColumn("state", F.concat("state", F.lit("4")))),
        ("five", lambda r: r.withColumn("last", F.lit(1))),
    ]
    told = []
    out = R.run(records(spark, 40), stages, cut=cut, report=told.append)
    rows = {r.row_id: r for r in out.collect()}
    assert len(rows) == 40 and out.count() == 40
    failed = {i: list(r.issues) for i, r in rows.items() if r.issues}
    assert failed == {3: ["stage one failed: SparkRuntimeException"], 17: ["stage one failed: SparkRuntimeException"], 5: ["stage two failed: ZeroDivisionError"], 8: ["stage three failed: NumberFormatException"], 9: ["stage four failed: ValueError"]}
    assert all(r.needs_review == bool(r.issues) for r in rows.values())
    assert rows[3].state == "old4" and rows[9].state == "old1" and rows[4].state == "old14"
    assert rows[5].made is None and rows[4].made == 1 and rows[8].n is None and rows[4].n == 1 and all(r.last == 1 for r in rows.values())
    assert [(t.stage, t.rows, t.failed) for t in told] == [("one", 40, 2), ("two", 40, 1), ("three", 40, 1), ("four", 40, 1), ("five", 40, 0)]
    assert told[4].tries == 1 and told[0].tries > 8 and all(t.seconds > 0 for t in told)
    assert {r.stage: r.rows for r in R.failures(out).collect()} == {"one": 2, "two": 1, "three": 1, "four": 1}


def test_a_stage_that_fails_for_all_rows_or_for_a_repeated_or_null_key(spark):
    every = [("all", lambda r: r.withColumn("state", F.raise_error(F.lit("bad")).cast("string")))]
    out = R.run(records(spark, 5), every, cut=cut).collect()
    assert len(out) == 5 and all(r.issues == ["stage all failed: SparkRuntimeException"] and r.state == "old" for r in out)
    keyed = records(spark, 8).withColumn("row_id", F.when(F.col("row_id") < 3, F.lit(1)).when(F.col("row_id") > 5, None).otherwise(F.col("row_id")))
    some = [("some", lambda r: r.withColumn("state", F.when(F.coalesce("row_id", F.lit(1)) == 1, F.raise_error(F.lit("bad"))).otherwise("new")))]
    out = Counter((r.row_id, r.state, len(r.issues)) for r in R.run(keyed, some, cut=cut).collect())
    assert out == {(1, "old", 1): 3, (None, "old", 1): 2, (3, "new", 0): 1, (4, "new", 0): 1, (5, "new", 0): 1}
    assert R.run(records(spark, 0), every, cut=cut).count() == 0


def test_errors_of_the_cluster_are_raised(spark):
    def full(r, name):
        raise OSError("No space left on device")

    with pytest.raises(OSError, match="No space"):
        R.run(records(spark), [("one", lambda r: r)], cut=full)


def test_best_choice_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([("ab",), ("zz",), (None,)], "t string")
    got = {r.t: (r.b and (r.b.choice, r.b.score)) for r in rows.select("t", M.best_choice(F.col("t"), ["ba", "ab", "AB", "ab"], M.ratio).alias("b")).collect()}
    assert got == {"ab": ("ab", 100.0), "zz": ("ba", 0.0), None: None}
    assert rows.select(M.best_choice(F.col("t"), []).alias("b")).filter("b is not null").count() == 0


def test_with_clause_and_approvals(spark):
    row = spark.range(1).select(A.with_prefix(F.lit(" Clean  Boost")).alias("a"), A.with_prefix(F.lit("WITH x")).alias("b"), A.with_prefix(F.lit("n/a")).alias("c"), A.approvals(F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("a"))).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("With Clean Boost", "WITH x", "", ["a", "b"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_the_chain_runs_from_end_to_end(spark):
    out = record_queries.enriched(spark, SF).cache()
    held = record_queries._style_rows(spark, SF).filter(record_queries.S.is_holdout(F.col("part_number"))).select("row_id").distinct()
    assert out.count() == held.count() > 0 and out.select("row_id").distinct().count() == out.count()
    r = {c: out.filter(f"{c} is not null").count() for c in ("classpath", "brand_name", "attributes", "mobile_desc", "overall")}
    assert all(n == out.count() for c, n in r.items() if c != "mobile_desc") and r["mobile_desc"] > 0
    assert R.failures(out).count() == 0
    assert out.filter("length(mobile_desc) > 80 or length(invoice_desc) > 40").count() == 0
    decided = out.filter("product_name = 'seen'")
    assert decided.count() > 0 and decided.filter("needs_review").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_a_row_that_every_stage_fails_for(spark):
    known, given, raw = record_queries.catalogue(spark, SF)
    few = written(raw.orderBy("row_id").limit(3), "few")
    bad = few.agg(F.min("row_id")).first()[0]
    poisoned = F.when(F.col("row_id") == bad, F.raise_error(F.lit("bad")).cast("string")).otherwise(F.col("part_number"))
    stages = [(name, lambda r, stage=stage: stage(r).withColumn("part_number", poisoned)) for name, stage in H.stages(known, given)]
    told = []
    out = {r.row_id: r for r in R.run(H.started(few), stages, cut=cut, report=told.append).collect()}
    failed = [i for i in out[bad].issues if " failed: " in i]
    assert failed == [f"stage {name} failed: SparkRuntimeException" for name, _ in stages] and len(failed) == 8
    assert len(out) == 3 and not any(" failed: " in i for k, r in out.items() if k != bad for i in r.issues)
    assert all(r.classpath and r.overall is not None for k, r in out.items() if k != bad) and out[bad].needs_review
    assert [(t.rows, t.failed) for t in told] == [(3, 1)] * 8
