"""Queries of workbooks, of failures that stay with their rows, and of what a run counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions import fixed_values as V
from catalith.operators import driver as R
from catalith.operators import registry as G
from catalith.operators import retrieval
from catalith.operators import stages as S
from catalith.plans.proxy import OBS, observations, stored
from catalith.plans.record_queries import _RAWS, _raw
from catalith.plans.text_queries import _NEIGHBOURS_SQL
from catalith.session import prepare, shared_path, spread, table, written
from catalith.sources import tables as T
from catalith.sources import workbooks as W

# -- workbooks ----------------------------------------------------------------------------------------------------------------------------


def _scanned(s, d):
    path = shared_path(prepare(s), "workbook")
    W.write(spread(_raw(s, d), "PART_NUMBER"), path, "Input")
    out = T.scan(s, path, V.INPUT_COLUMNS, "xlsx", "Input")
    return out.select(F.col("PART_NUMBER").alias("part_number"), F.col("Dept").alias("dept"), F.col("Class").alias("class"), F.col("`SKU - MY_PART_NUMBER`").alias("sku"), F.col("Mfg_Part_Num").alias("mpn"))


def _uploaded(s, d):
    path = shared_path(prepare(s), "upload")
    W.write(spread(_raw(s, d), "PART_NUMBER"), path)
    out = T.upload(s, path, "xlsx")
    return out.select(F.col("PART_NUMBER").alias("part_number"), F.col("`SKU - MY_PART_NUMBER`").alias("sku"), F.col("Fine").alias("fine"))


def _headed(s, d):
    path = shared_path(prepare(s), "headers")
    W.write(table(s, d, "supplier"), path)
    return s.createDataFrame(list(enumerate(W.headers(s, path))), "place long, name string")


def _delivery(s, d):
    """All columns of a delivery out and in again: cells by column, without the columns that are empty."""
    names = T.delivery_columns([f"Identity {i}" for i in range(12)], [f"Meta {i}" for i in range(6)], [f"Tail {i}" for i in range(47)])
    path = shared_path(prepare(s), "delivery")
    triplet = lambda label, value, uom: F.struct(F.lit(label).alias("label"), value.alias("value"), uom.alias("uom"))
    records = spread(table(s, d, "part"), "p_partkey").select(
        F.create_map(F.lit("MFR URL"), F.col("p_name"), F.lit("Identity 3"), F.concat(F.col("p_name"), F.lit("\n®_x000D_")), F.lit("Tail 46"), F.when(F.col("p_size") > 9, "").otherwise("<&>"), F.lit("unknown"), F.lit("x")).alias("extras"),
        F.create_map(F.lit("PART_NUMBER"), F.col("p_partkey").cast("string"), F.lit("Dept"), F.col("p_type")).alias("source_row"),
        F.array(triplet("Color", F.col("p_brand"), F.lit(None).cast("string")), triplet("Size", F.col("p_size").cast("string"), F.lit("in"))).alias("attributes"), F.array(F.lit("f1"), F.col("p_type")).alias("features"),
    )
    W.write(T.delivery(records, names), path, "Delivery")
    back = W.scan(s, path, "Delivery")
    each = F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), F.col(f"`{c}`").alias("value"))) for i, c in enumerate(back.columns)])
    cells = back.select(F.explode(F.array_compact(each)).alias("x")).groupBy("x.place", "x.name", "x.value").agg(F.count("*").alias("times"))
    # values repeat: a column's different ones are put in order, each then stands as often as it occurs
    sorted_ = F.array_sort(F.collect_list(F.struct("value", F.col("times").cast("int").alias("times"))))
    whole = F.array_join(F.transform(sorted_, lambda x: F.concat(F.repeat(F.concat(x["value"], F.lit("|")), x["times"] - 1), x["value"])), "|")
    return cells.groupBy("place", "name").agg(F.sum("times").alias("n"), F.md5(whole).alias("digest"))


_DELIVERY = """
    WITH c AS (SELECT unnest([
        {'place': 0, 'name': 'MFR URL', 'value': p_name}, {'place': 6, 'name': 'PART_NUMBER', 'value': p_partkey::VARCHAR}, {'place': 7, 'name': 'Dept', 'value': p_type},
        {'place': 20, 'name': 'Identity 3', 'value': p_name || chr(10) || '®_x000D_'}, {'place': 29, 'name': 'ITEM_FEATURES_1', 'value': 'f1'}, {'place': 30, 'name': 'ITEM_FEATURES_2', 'value': p_type},
        {'place': 55, 'name': 'ATTRIBUTE_LABEL 1', 'value': 'Color'}, {'place': 56, 'name': 'ATTRIBUTE_VALUE 1', 'value': p_brand},
        {'place': 58, 'name': 'ATTRIBUTE_LABEL 2', 'value': 'Size'}, {'place': 59, 'name': 'ATTRIBUTE_VALUE 2', 'value': p_size::VARCHAR}, {'place': 60, 'name': 'ATTRIBUTE_UOM 2', 'value': 'in'},
        {'place': 251, 'name': 'Tail 46', 'value': CASE WHEN p_size > 9 THEN '' ELSE '<&>' END}]) AS x FROM part)
    SELECT x.place::INT AS place, x.name AS name, count(*) AS n, md5(string_agg(x.value, '|' ORDER BY x.value)) AS digest FROM c GROUP BY ALL"""

# -- a run that goes on --------------------------------------------------------------------------------------------------------------------


def _divided(c: Column) -> Column:
    """1, and an error of Python where the condition does not hold."""

    @F.pandas_udf("int")
    def each(holds: pd.Series) -> pd.Series:
        return holds.map(lambda x: 1 // int(x))

    return each(c)


def _cut(records, name):
    return written(records, f"isolated-{name}")


def _orders(s, d):
    return table(prepare(s), d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("state"), F.array().cast("array<string>").alias("issues"), F.lit(False).alias("needs_review"))


def _poisoned(s, d, report=None):
    """Two stages that raise while they run, the first one in Spark for the largest key, the second in Python for the least; a third that tells its failures; a fourth that cannot be planned."""
    orders = _orders(s, d)
    least, most = orders.agg(F.min("row_id"), F.max("row_id")).first()
    stages = [
        ("raising", lambda r: r.withColumn("state", F.when(F.col("row_id") == most, F.raise_error(F.lit("bad"))).otherwise(F.concat("state", F.lit("+"))))),
        ("dividing", lambda r: r.withColumn("made", _divided(F.col("row_id") != least))),
        ("telling", lambda r: r.withColumn("state", F.concat("state", F.lit("!"))).withColumn("failed", F.when(F.col("row_id") % 7 == 0, "ValueError"))),
        ("planned", lambda r: r.select("row_id", "nowhere")),
    ]
    return R.run(orders, stages, cut=_cut, report=report)


def _isolated(s, d):
    return _poisoned(s, d).select("row_id", "state", "made", F.array_join("issues", ";").alias("issues"), "needs_review")


_ISOLATED = """
    WITH o AS (SELECT o_orderkey AS row_id, o_orderstatus AS state, min(o_orderkey) OVER () AS least, max(o_orderkey) OVER () AS most FROM orders)
    SELECT row_id, state || CASE WHEN row_id = most THEN '' ELSE '+' END || CASE WHEN row_id % 7 = 0 THEN '' ELSE '!' END AS state, CASE WHEN row_id <> least THEN 1 END AS made,
        CASE WHEN row_id = most THEN 'stage raising failed: SparkRuntimeException;' ELSE '' END || CASE WHEN row_id = least THEN 'stage dividing failed: ZeroDivisionError;' ELSE '' END
            || CASE WHEN row_id % 7 = 0 THEN 'stage telling failed: ValueError;' ELSE '' END || 'stage planned failed: AnalysisException' AS issues, true AS needs_review FROM o"""


def _counted(s, d):
    """What the run's reports say of each stage, from the counts that Spark took on the way."""
    seen: list[R.StageRun] = []
    orders = _orders(s, d)
    tell = lambda name, n: (name, lambda r: r.withColumn("state", F.lit(name)).withColumn("failed", F.when(F.col("row_id") % n == 0, "KeyError")))
    R.run(orders, [tell("classifier", 5), tell("research", 3), ("validator", lambda r: r)], cut=_cut, report=seen.append)
    return s.createDataFrame([(x.stage, x.rows, x.failed, x.tries, x.seconds > 0) for x in seen], "stage string, rows long, failed long, tries int, timed boolean")


_COUNTED = "SELECT stage, count(*) AS rows, count(*) FILTER (n > 0 AND o_orderkey % greatest(n, 1) = 0) AS failed, 1 AS tries, true AS timed FROM orders, (VALUES ('classifier', 5), ('research', 3), ('validator', 0)) AS t(stage, n) GROUP BY stage"

# -- measures ------------------------------------------------------------------------------------------------------------------------------

_LABELS = ["Pressure Rating", "Voltage", "Max Temperature", "Finish", "Overall Depth"]


def _hints(s, d):
    """Labels that tell the hints of a measure apart, with values of answers for even parts and of pages for odd ones."""
    part = table(prepare(s), d, "part").select(F.col("p_partkey").alias("row_id"), "p_size", "p_type")
    each = part.select("row_id", "p_type", "p_size", F.posexplode(F.array(*map(F.lit, _LABELS))).alias("slot", "label"))
    value = F.when(F.col("label") == "Finish", F.lower("p_type")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5in")))
    rows = each.select("row_id", "slot", "label", F.lower("label").alias("label_key"), value.alias("value"), F.col("p_type").alias("classpath"))
    said = rows.filter("row_id % 2 = 0").select("row_id", "label_key", "value", F.lit("").alias("uom"))
    pages = rows.filter("row_id % 2 = 1").select("row_id", "label_key", "value", F.lit("http://x").alias("url"))
    out = S.resolve_attributes(rows.select("row_id", "classpath", "slot", "label"), said, pages, G.fit(observations(s, d)).stored("free", "units", "values"))
    return out.select("row_id", "label", "value", "confidence", "source")


_HINTS = """
    SELECT p_partkey AS row_id, label, CASE WHEN label = 'Finish' THEN CASE WHEN p_partkey % 2 = 0 THEN upper(p_type[1]) || lower(p_type[2:]) ELSE lower(p_type) END
        WHEN label = 'Voltage' THEN p_size || '.5in' ELSE p_size || '-1/2 in' END AS value,
        CASE WHEN p_partkey % 2 = 0 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN p_partkey % 2 = 0 THEN 'llm' ELSE 'spec-table:http://x' END AS source
    FROM part, (VALUES ('Pressure Rating'), ('Voltage'), ('Max Temperature'), ('Finish'), ('Overall Depth')) AS t(label)"""

# -- search --------------------------------------------------------------------------------------------------------------------------------


def _descriptions(s, d):
    """The nearest descriptions of every description, each as a whole."""
    rows = table(prepare(s), d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text")).groupBy("text").agg(F.min("p_partkey").alias("row_id"))
    rows = written(rows, "texts")  # a condition on a text is else worked out for each part that has it
    found = retrieval.Index(rows).stored().neighbours(rows.withColumnRenamed("row_id", "query_id"), 3)
    return found.select("query_id", "row_id", F.bround("score", 6).alias("score"), "rank")


_DESCRIPTIONS = (
    "\n    WITH r AS (SELECT min(p_partkey) AS row_id, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part GROUP BY 2), q AS (SELECT * FROM r),\n"
    + _NEIGHBOURS_SQL.split("\n", 2)[2]
)

# -- snapshots -----------------------------------------------------------------------------------------------------------------------------


def _kept(s, d):
    """The registries of a catalogue by its files' fingerprint: the second call builds nothing and reads no source."""
    folder, sources = shared_path(prepare(s), "kept"), [table(s, d, t) for t in ("lineitem", "part", "supplier")]
    built = []

    def build():
        built.append(1)
        return G.fit(stored(s, d))

    for _ in range(2):
        known = G.Registry.of(s, folder, sources, build)
    return known.triples.select("dept", "class", "fine", "classpath", "n").withColumn("built", F.lit(len(built)))


_KEPT = f"WITH {OBS} SELECT lower(dept) AS dept, lower(class) AS class, lower(fine) AS fine, classpath, count(*) AS n, 1 AS built FROM obs GROUP BY ALL"

QUERIES = {
    "o003_snapshots": (_kept, _KEPT),
    "o097_descriptions": (_descriptions, _DESCRIPTIONS),
    "o001_workbook": (_scanned, f"WITH {_RAWS} SELECT * FROM r"),
    "o004_workbook_upload": (_uploaded, "SELECT CAST(p_partkey AS VARCHAR) AS part_number, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS sku, '--' AS fine FROM part"),
    "o005_workbook_header": (_headed, "SELECT row_number() OVER () - 1 AS place, column_name AS name FROM (DESCRIBE supplier)"),
    "o011_workbook_delivery": (_delivery, _DELIVERY),
    "o140_measure_hints": (_hints, _HINTS),
    "o152_isolated": (_isolated, _ISOLATED),
    "o164_stage_runs": (_counted, _COUNTED),
}
