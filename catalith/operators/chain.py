"""The eight stages over a fitted catalogue, ready for the driver (O-152): each takes all records and gives them back with the columns that it sets.

Records begin as (row_id, part_number, dept, class, fine, supplier, hints, mpn, description, issues, needs_review). Every stage joins by row_id, so a
plan of the whole chain has one shuffle of the records' keys for each join and reuses their partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import fixed_values as V
from catalith.functions.text import folded, item_type, rendered_attribute
from catalith.operators import decisions as D
from catalith.operators import evidence as E
from catalith.operators import retrieval
from catalith.operators import stages as S
from catalith.operators import style as Y
from catalith.operators.driver import Stage
from catalith.operators.registry import Registry
from catalith.operators.resolve import template_for
from catalith.session import written

NO_FIELDS = "map<string,string>"


@dataclass
class Knowledge:
    """What the stages look things up in. labelled: (row_id, classpath, product_name); assets: (brand, domain, prefix, image_rate, rates)."""

    registry: Registry
    index: retrieval.Index
    labelled: DataFrame
    styles: DataFrame
    assets: DataFrame


@dataclass
class Given:
    """What stands in for models, the web and reviewers: tables, any of which may be missing."""

    bundle: DataFrame | None = None
    extracted: DataFrame | None = None
    paths: DataFrame | None = None
    brands: DataFrame | None = None
    decisions: DataFrame | None = None


def started(rows: DataFrame) -> DataFrame:
    """Raw records as the chain begins with them."""
    return rows.withColumns({"issues": F.array().cast("array<string>"), "needs_review": F.lit(False)})


def classifier(known: Knowledge, given: Given):
    def stage(r: DataFrame) -> DataFrame:
        out = S.classify(r, known.registry, known.index, known.labelled, given.paths)
        told = F.when(F.col("classify_issue").isNotNull(), F.array_append("issues", F.col("classify_issue"))).otherwise(F.col("issues"))
        return out.withColumn("issues", told).drop("candidates", "level", "classify_issue").withColumn("item_type", item_type(F.col("classpath")))

    return stage


def manufacturer_resolver(known: Knowledge, given: Given):
    def stage(r: DataFrame) -> DataFrame:
        out = S.manufacturer_stage(r, known.registry, given.brands)
        renamed = {"manufacturer": "manufacturer_name", "brand": "brand_name", "confidence": "brand_confidence", "provenance": "brand_provenance"}
        return out.withColumnsRenamed(renamed)

    return stage


def research(known: Knowledge, given: Given):
    def stage(r: DataFrame) -> DataFrame:
        if given.bundle is None:
            return r.withColumns({"mfr_url": F.lit(None).cast("string"), "ref_urls": F.array().cast("array<string>")})
        urls = E.record_urls(given.bundle).select("part_number", "mfr_url", "ref_urls")
        return r.join(urls, "part_number", "left")

    return stage


def attribute_extractor(known: Knowledge, given: Given):
    def stage(r: DataFrame) -> DataFrame:
        spark = r.sparkSession
        templates = template_for(r.select("classpath").distinct(), known.registry.templates, known.registry.leaves)
        labels = r.select("row_id", "classpath").join(templates, "classpath")
        wanted = labels.select("row_id", "classpath", F.posexplode("labels").alias("slot", "label"))
        said = given.extracted if given.extracted is not None else spark.createDataFrame([], "row_id long, label_key string, value string, uom string")
        pages = spark.createDataFrame([], "row_id long, label_key string, value string, url string")
        if given.bundle is not None:
            pairs = E.merged_tables(given.bundle).select("part_number", folded(F.col("label")).alias("label_key"), "value", "url")
            pages = r.select("row_id", "part_number").join(pairs, "part_number").select("row_id", "label_key", "value", "url")
        found = S.resolve_attributes(wanted, said, pages, known.registry)
        row = F.struct("slot", F.struct("label", "value", "uom", "confidence", "source").alias("a"))
        grouped = found.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["a"]).alias("attributes"))
        out = r.join(grouped, "row_id", "left")
        none = F.array().cast(grouped.schema["attributes"].dataType)
        return out.withColumn("attributes", F.coalesce("attributes", none))

    return stage


def description_builder(known: Knowledge, given: Given):
    def stage(r: DataFrame) -> DataFrame:
        # a path and its labels settle the order and the spellings, so each different set is planned once; rows bring their values to the plan
        kind = F.struct("classpath", F.transform("attributes", lambda a: folded(a["label"])).alias("labels"))
        kinds = r.select(kind.alias("kind")).distinct()
        each = kinds.select("kind", "kind.classpath", F.posexplode("kind.labels").alias("slot", "label_key")).withColumn("surface", F.explode(F.array(*map(F.lit, Y.SURFACES))))
        plan = written(Y.planned(each, known.styles, Y.average(known.styles), "kind"), "plan").withColumnRenamed("kind", "_kind")
        records = r.select(F.struct(*r.columns).alias("_was"), kind.alias("_kind"), F.col("brand_name").alias("brand"), F.col("manufacturer_name").alias("manufacturer"), F.coalesce(F.nullif("product_name", F.lit("")), "item_type").alias("item_type"), _attribute("series").alias("series"), "mpn", F.lit("").alias("with_clause"), _attribute("additional information").alias("additional"), F.col("description").alias("raw_description"))
        values = F.transform("_was.attributes", lambda a: rendered_attribute(a["value"], a["uom"]))
        rows = records.join(plan, "_kind", "left").withColumn("_values", values)
        rows = rows.withColumns({f"_{s}": Y.segments_of(F.col("plan"), s, F.col("_values"), F.col("mpn")) for s in Y.SURFACES})
        return Y.described(rows, ["_was"]).select("_was.*", "long_desc", "short_desc", "retail_desc", "mobile_desc", "invoice_desc")

    return stage


def _attribute(label: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter("attributes", lambda a: folded(a["label"]) == label), F.lit(1))["value"], F.lit(""))


def sourcing(known: Knowledge, given: Given):
    def stage(r: DataFrame) -> DataFrame:
        return S.source_stage(r.withColumnRenamed("brand_name", "brand"), known.assets).withColumnRenamed("brand", "brand_name")

    return stage


def validator(known: Knowledge, given: Given):
    def stage(r: DataFrame) -> DataFrame:
        provenance = F.map_filter(F.create_map(F.lit("classpath"), F.col("classpath_provenance"), F.lit("product_name"), F.col("name_provenance"), F.lit("brand_name"), F.col("brand_provenance")), lambda k, v: v.isNotNull())
        found = S.validate_all(r.withColumn("provenance", provenance), known.registry)
        filled = F.filter("attributes", lambda a: F.coalesce(a["value"], F.lit("")) != "")
        mean = F.when(F.size(filled) > 0, F.aggregate(filled, F.lit(0.0), lambda s, a: s + a["confidence"]) / F.size(filled))
        parts = {"classpath": F.col("classpath_confidence"), "brand_name": F.col("brand_confidence"), "product_name": F.col("name_confidence"), "attributes": mean}
        confidence = F.map_filter(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("double"))]), lambda k, v: v.isNotNull())
        out = found.withColumn("confidence", confidence).withColumn("_o", S.overall(F.col("confidence"), F.col("issues")))
        low = F.col("_o.needs_review") & (F.size("issues") == 0)
        out = out.withColumn("issues", F.when(low, F.array(F.lit("low overall confidence"))).otherwise(F.col("issues")))
        return out.withColumn("needs_review", F.col("needs_review") | F.col("_o.needs_review")).withColumn("overall", F.col("_o.overall")).drop("_o")

    return stage


def corrections(known: Knowledge, given: Given):
    def stage(r: DataFrame) -> DataFrame:
        if given.decisions is None:
            return r
        none = F.create_map().cast(NO_FIELDS)
        extra = {c: none for c in ("extras", "provenance", "grounded") if c not in r.columns}
        return D.overlay(r.withColumns(extra) if extra else r, given.decisions)

    return stage


def stages(known: Knowledge, given: Given | None = None) -> list[Stage]:
    """All stages in their fixed order."""
    made = (classifier, manufacturer_resolver, research, attribute_extractor, description_builder, sourcing, validator, corrections)
    return [(name, make(known, given or Given())) for name, make in zip(V.STAGES, made, strict=True)]
