"""Reviewer decisions: an append-only log, the latest of each part number, and their overlay on records (O-007, O-008, O-103, O-165, O-177, O-182, O-188)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.functions.text import folded

DECISION = (
    "part_number string, decided_at string, status string, fields map<string,string>, attributes array<struct<label string, value string, uom string>>, "
    "extras map<string,string>, notes string"
)
#: Fields that a reviewer may set.
REVIEWABLE = [
    "manufacturer_name", "brand_name", "mpn", "classpath", "product_name", "series", "with_clause", "invoice_desc", "mobile_desc", "short_desc", "long_desc",
    "retail_desc", "marketing_desc", "mfr_url",
]


def append(decisions: DataFrame, path: str) -> None:
    """O-007. Add decisions to the log, one JSON object a line."""
    decisions.write.mode("append").json(path)


def parse_log(lines: DataFrame) -> DataFrame:
    """O-008. Decisions of log lines (value, at); lines that are not JSON objects with a part number and status are passed over."""
    out = lines.select("at", F.from_json("value", DECISION, {"mode": "PERMISSIVE"}).alias("d"))
    return out.select("at", "d.*").filter("part_number is not null and status is not null")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """O-008. The log with its order: modification time of the file, name, then place in it."""
    lines = spark.read.text(path).select("value", "_metadata.file_modification_time", "_metadata.file_name", F.monotonically_increasing_id().alias("_n"))
    return parse_log(lines.select("value", F.struct("file_modification_time", "file_name", "_n").alias("at")))


def latest(log: DataFrame, key: str = "part_number", order: str = "at") -> DataFrame:
    """The last decision of each key by append order; an aggregate, so a key with many decisions combines on the map side."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c not in (key, order)]), order).alias("_d")).select(key, "_d.*")


def recordable(decisions: DataFrame) -> DataFrame:
    """O-177. Decisions fit for the log: known fields only, no blank labels, and something overridden where the status is `corrected`."""
    fields = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(REVIEWABLE))
    named = F.filter(F.coalesce("attributes", F.array().cast("array<struct<label:string,value:string,uom:string>>")), lambda a: F.trim(F.coalesce(a["label"], F.lit(""))) != "")
    out = decisions.withColumn("fields", fields).withColumn("attributes", named)
    changes = (F.size("fields") > 0) | (F.size("attributes") > 0) | (F.size(F.coalesce("extras", F.create_map().cast("map<string,string>"))) > 0)
    return out.filter((F.col("status") == "approved") | ((F.col("status") == "corrected") & changes))


def attribute(attributes: Column, label: str) -> Column:
    """O-182. The attribute of a label, case aside."""
    return F.try_element_at(F.filter(attributes, lambda a: folded(a["label"]) == folded(F.lit(label))), F.lit(1))


def overlay(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """O-103. Records with the latest decisions applied: reviewed fields and attributes win with confidence 1, a null value clears, a missing unit keeps the old one,
    unknown labels are added at the end, and a decided record needs no review. records: part_number, reviewable fields, attributes, extras, confidence (map),
    provenance (map), grounded (map), needs_review."""
    renamed = decisions.select("part_number", F.col("status").alias("_status"), F.col("fields").alias("_f"), F.col("attributes").alias("_a"), F.col("extras").alias("_x"))
    decided = F.col("_status").isNotNull()
    none = F.create_map().cast("map<string,string>")
    fields = F.map_filter(F.coalesce("_f", none), lambda k, v: k.isin(REVIEWABLE))
    own = F.coalesce("_a", F.array().cast("array<struct<label:string,value:string,uom:string>>"))
    key = lambda a: folded(F.trim(a["label"]))
    last = lambda a: F.try_element_at(F.filter(own, lambda o: key(o) == folded(a["label"])), F.lit(-1))
    shape = T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in records.schema["attributes"].dataType.elementType]))
    records = records.withColumn("attributes", F.col("attributes").cast(shape))
    r = records.join(renamed, "part_number", "left")
    made = lambda label, value, uom: F.struct(label.alias("label"), F.nullif(value, F.lit("")).alias("value"), uom.alias("uom"), F.lit(1.0).alias("confidence"), F.lit("reviewer-correction").alias("source"))
    changed = F.transform("attributes", lambda a: F.when(last(a).isNull(), a).otherwise(made(a["label"], last(a)["value"], F.coalesce(F.nullif(last(a)["uom"], F.lit("")), a["uom"]))))
    known = F.transform("attributes", lambda a: folded(a["label"]))
    new = F.filter(own, lambda o, i: ~F.array_contains(known, key(o)) & ~F.exists(F.slice(own, i + 2, F.size(own)), lambda p: key(p) == key(o)))
    added = F.transform(new, lambda o: made(F.trim(o["label"]), o["value"], F.nullif(o["uom"], F.lit(""))))
    touched = F.transform(own, key)
    out = {c: F.when(F.map_contains_key(fields, F.lit(c)), F.nullif(F.try_element_at(fields, F.lit(c)), F.lit(""))).otherwise(F.col(c)) for c in REVIEWABLE if c in records.columns}
    extras = F.map_filter(F.coalesce("_x", none), lambda k, v: F.coalesce(v, F.lit("")) != "")
    over = lambda base, more: F.map_concat(F.map_filter(F.coalesce(base, none), lambda k, v: ~F.map_contains_key(more, k)), more)
    marked = F.transform_values(over(fields, extras), lambda k, v: F.lit("reviewer-correction"))
    note = F.when(F.col("_status") == "corrected", "values corrected by reviewer").otherwise("approved by reviewer as generated")
    marked = F.map_concat(F.map_filter(marked, lambda k, v: k != "review"), F.create_map(F.lit("review"), note))
    sure = F.transform_values(fields, lambda k, v: F.lit(1.0))
    out["attributes"] = F.concat(changed.cast(shape), added.cast(shape))
    out["extras"] = over(F.col("extras"), extras)
    out["confidence"] = F.map_concat(F.map_filter("confidence", lambda k, v: ~F.map_contains_key(sure, k)), sure)
    out["provenance"] = over(F.col("provenance"), marked)
    out["grounded"] = F.map_filter("grounded", lambda k, v: ~F.array_contains(touched, folded(k)))
    out["needs_review"] = F.lit(False)
    return r.select(*[F.when(decided, out[c]).otherwise(F.col(c)).alias(c) if c in out else F.col(c) for c in records.columns])


def status(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """O-188. records with `status`, `pending` where nobody has decided."""
    return records.join(decisions.select("part_number", F.col("status").alias("_s")), "part_number", "left").withColumn("status", F.coalesce("_s", F.lit("pending"))).drop("_s")


def summary(decisions: DataFrame) -> DataFrame:
    """O-165. One row: decided, approved, corrected, fields_changed, attributes_changed, over the latest decisions."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return decisions.agg(F.count("*").alias("decided"), n(F.col("status") == "approved").alias("approved"), n(F.col("status") == "corrected").alias("corrected"), n(F.greatest(F.size("fields"), F.lit(0))).alias("fields_changed"), n(F.greatest(F.size("attributes"), F.lit(0))).alias("attributes_changed"))
