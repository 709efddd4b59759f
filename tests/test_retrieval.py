"""The search with bounds gives what adding up all grams gives, at any bound."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalith.operators import retrieval


def plain(index, queries, k):
    """All pairs that share a gram."""
    asked = retrieval.weights(retrieval.postings(queries, "query_id", "text"), index.idf, "query_id").withColumnRenamed("weight", "asked").drop("df")
    scores = asked.join(index.weights, "gram").groupBy("query_id", "row_id").agg(F.sum(F.col("asked") * F.col("weight")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.bround("score", 9)), F.desc("row_id"))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["steel", "cover", "plate", "switch", "toggle", "brass", "kit", "a", "in"] + ["".join(rng.choices("abcdeorst", k=6)) for _ in range(60)]
    return [" ".join(["steel", *rng.choices(words, k=rng.randrange(0, 5))]) for _ in range(n)]


def rounded(df):
    return Counter((r.query_id, r.row_id, round(r.score, 8), r.rank) for r in df.collect())


@pytest.mark.parametrize(("heavy", "k"), [(1, 3), (8, 5), (40, 3), (10_000, 12)])
def test_bounds_lose_nothing(spark, heavy, k):
    rows = spark.createDataFrame(list(enumerate(texts(250, 1))), "row_id long, text string").cache()
    asked = spark.createDataFrame(list(enumerate([*texts(40, 2), "steel", "", "zzzzzz", "steel cover"])), "query_id long, text string").cache()
    index = retrieval.Index(rows)
    found, want = rounded(index.neighbours(asked, k, heavy=heavy)), rounded(plain(index, asked, k))
    assert found == want and len(want) > 100
    work = {r.part: r.pairs for r in index.work(asked, k, heavy=heavy).collect()}
    if heavy == 40:
        assert work["completed"] > 0 and work["completed"] + work["opened"] < 40 * 250  # less than all pairs
    if heavy == 10_000:
        assert work["completed"] == work["opened"] == 0


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "row_id long, text string")
    assert retrieval.Index(none).neighbours(spark.createDataFrame([(1, "steel")], "query_id long, text string"), 3).count() == 0
    rows = spark.createDataFrame([(1, "steel"), (2, None)], "row_id long, text string")
    assert [(r.query_id, r.row_id) for r in retrieval.Index(rows).neighbours(spark.createDataFrame([(7, "steel"), (8, None)], "query_id long, text string"), 3).collect()] == [(7, 1)]
