"""Connected components of a link table, by alternating large-star and small-star steps.

Each round is two joins and aggregates over the links; its result is written to the shared folder, so a
lost executor costs one round at most. Nothing about links or components reaches the driver but two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import new_folder, remove, write


def _stars(links: DataFrame, both: bool) -> DataFrame:
    """Link each neighbour to the least of the neighbourhood; both: look at larger neighbours too, and move only those."""
    near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        near = near.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = near.join(least, "u")
    if both:
        return moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    pairs = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return pairs.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link: root is the least node of its component. links: (a, b), any order, repeats allowed."""
    spark = links.sparkSession
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    paths: list[str] = []
    before = None
    while True:
        paths.append(new_folder(spark, "links"))
        write(links, paths[-1])
        links = spark.read.schema("a long, b long").parquet(paths[-1])
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if len(paths) > 1:
            remove(spark, paths[-2])
        if now == before or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
        links = _stars(_stars(links, True), False)
