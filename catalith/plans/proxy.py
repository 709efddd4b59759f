"""A catalogue out of the driver's tables, in Spark and in SQL: each line item is an observation of a part sold by a supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.session import prepare, table, written

#: The same observations in SQL. Every query over them begins with this.
OBS = """
    obs AS (
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS row_id, l_orderkey || '-' || l_linenumber AS part_number, p_type AS dept, p_brand AS class, CAST(p_size AS VARCHAR) AS fine,
            p_type || ' > ' || p_name AS classpath, p_name AS product_name, 'Maker ' || substr(p_brand, 1, 7) || ' Inc' AS manufacturer, p_brand AS brand, s_name AS supplier,
            replace(p_brand, 'Brand#', '') || '-' || l_partkey AS mpn, p_name || ' ' || p_brand AS description, l_returnflag || '|' || l_linestatus AS approvals,
            l_returnflag AS flag, l_linestatus AS status, CAST(p_size AS VARCHAR) AS size
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows as `catalith.operators.registry` wants them."""
    prepare(spark)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    # a part's file is small, as names repeat, but its rows are not: a broadcast by the file's size would grow with the parts
    rows = line.join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    size = F.col("p_size").cast("string")
    triplet = lambda label, value, uom: F.struct(F.lit(label).alias("label"), value.alias("value"), F.lit(uom).alias("uom"))
    return rows.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("row_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("part_number"),
        F.col("p_type").alias("dept"), F.col("p_brand").alias("class"), size.alias("fine"), F.concat_ws(" > ", "p_type", "p_name").alias("classpath"), F.col("p_name").alias("product_name"),
        F.concat(F.lit("Maker "), F.substring("p_brand", 1, 7), F.lit(" Inc")).alias("manufacturer"), F.col("p_brand").alias("brand"), F.col("s_name").alias("supplier"),
        F.concat(F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit("-"), F.col("l_partkey").cast("string")).alias("mpn"), F.concat_ws(" ", "p_name", "p_brand").alias("description"),
        F.concat_ws("|", "l_returnflag", "l_linestatus").alias("approvals"), F.array("p_type").alias("hints"),
        F.array(triplet("Flag", F.col("l_returnflag"), ""), triplet("Status", F.col("l_linestatus"), "inches"), triplet("Size", size, "pounds")).alias("attributes"),
    )


def stored(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """The same rows written down, for queries that read them several times; once: one for each row_id."""
    rows = observations(spark, sf_dir)
    return written(rows.dropDuplicates(["row_id"]) if once else rows, "observations")
