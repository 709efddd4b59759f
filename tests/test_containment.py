"""The automaton finds what plain containment finds, whatever the blocks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalith.operators import containment as K
from catalith.operators import evidence as E


@pytest.mark.parametrize("block", [100_000, 17])
def test_hits_equal_plain_containment(spark, block):
    rng = random.Random(1)
    needles = {"".join(rng.choices("ab1", k=rng.randrange(1, 6))) for _ in range(80)} | {"é", "日本", "a" * 300, "no such"}
    texts = [(rng.choice([i, 3, None]), rng.choice([None, "", "".join(rng.choices("ab12\n ", k=rng.randrange(200))), "x日本é" + "a" * 400])) for i in range(120)]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "id int, body string, needle string").repartition(3)
    wanted = spark.createDataFrame([(n, 1) for n in [*needles, *list(needles)[:9], "", None]], "needle string, body int")
    found = Counter(tuple(r) for r in K.containing(df, "body", ["id"], wanted, block).collect())
    assert found == Counter((i, n) for i, t in texts for n in needles if t and n in t)
    assert K.containing(df, "body", ["id"], wanted.limit(0), block).collect() == [] and K.containing(df.limit(0), "body", ["id"], wanted, block).collect() == []


def test_approvals_that_documents_name(spark):
    records = spark.createDataFrame([("p", "A"), ("q", "A"), ("r", "B")], "part_number string, brand string")
    listed = spark.createDataFrame([("UL Listed",), ("ul-listed",), ("CSA",), ("ENERGY STAR",)], "token string")
    bundle = spark.createDataFrame([("p", "It is UL listed.", [("x", "energy-star CSA")]), ("r", None, None)], "part_number string, text string, tables array<struct<label string, value string>>")
    usual = spark.createDataFrame([("A", ["usual"])], "brand string, approvals array<string>")
    out = {r.part_number: list(r.approvals) for r in E.approvals_from_evidence(records, listed, bundle, usual).collect()}
    assert out == {"p": ["ENERGY STAR", "UL Listed", "ul-listed"], "q": ["usual"], "r": []}


def test_many_needles(spark):
    """A hundred thousand part numbers over pages that name one each."""
    numbers = spark.range(100_000).select(F.concat(F.lit("mpn"), F.lpad(F.conv(F.col("id") * 7919, 10, 36), 6, "0")).alias("needle"))
    pages = spark.range(2_000).select("id", F.concat(F.repeat(F.lit("words of a page "), 200), F.lit("mpn"), F.lpad(F.conv(F.col("id") * 50 * 7919, 10, 36), 6, "0")).alias("body"))
    assert K.containing(pages, "body", ["id"], numbers).select("id").distinct().count() == 2_000
