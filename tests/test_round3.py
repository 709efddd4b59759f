"""Signs taken out without trimming, arrays with one entry for each key, and rows dealt out."""

from pyspark.sql import functions as F

from catalith.functions import text as X
from catalith.operators import evidence as E
from catalith.session import spread


def test_symbols_go_and_ends_stay(spark):
    row = spark.createDataFrame([(" a® b™ ", None)], "a string, b string").select(X.without_symbols(F.col("a")), X.strip_symbols(F.col("a")), X.without_symbols(F.col("b")), X.strip_symbols(F.col("b"))).first()
    assert tuple(row) == (" a b ", "a b", None, "")


def test_first_of_each(spark):
    rows = spark.createDataFrame([([("a", 1), ("b", 2), ("a", 3), (None, 4)],), ([],)], "x array<struct<k:string,v:int>>")
    assert [[tuple(y) for y in r.x] for r in rows.select(E.first_of_each(F.col("x"), "k").alias("x")).collect()] == [[("a", 1), ("b", 2)], []]


def test_one_task_becomes_many(spark):
    assert spread(spark.range(100).repartition(1), "id").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
