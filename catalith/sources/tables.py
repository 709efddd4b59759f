"""Scans and sinks (O-001..O-021, O-192): all-string scans, snapshots, caches as tables, and the delivery sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.functions.fixed_values import INPUT_COLUMNS
from catalith.functions.text import cell, clean, repair_symbols
from catalith.sources import workbooks

ATTRIBUTES, FEATURES, CACHE_VERSION, TEXT_MOST, LINKS_MOST = 50, 20, 3, 200_000, 60


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, kind: str = "csv", sheet: str | int = 0) -> DataFrame:
    """O-001, O-002. A table of strings with repaired symbols; with `columns`, only those are read. kind: csv, parquet, or xlsx, of which `sheet` is read."""
    reader = spark.read
    if kind == "xlsx":
        df = workbooks.scan(spark, path, sheet, columns)
    else:
        df = reader.option("header", True).option("inferSchema", False).csv(path) if kind == "csv" else reader.parquet(path)
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    return df.select([F.when(F.col(f"`{c}`").isNotNull(), repair_symbols(F.col(f"`{c}`").cast("string"))).alias(c) for c in df.columns])


def upload(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """O-004. An uploaded CSV or workbook: strings, null as empty, PART_NUMBER needed."""
    df = (workbooks.scan(spark, path) if kind == "xlsx" else spark.read.option("header", True).option("inferSchema", False).csv(path)).na.fill("")
    if "PART_NUMBER" not in df.columns:
        raise ValueError("the upload has no PART_NUMBER column")
    return df


def fingerprint(df: DataFrame) -> DataFrame:
    """O-003. (path, fingerprint) of the files behind a scan."""
    m = df.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
    return m.select(F.col("file_path").alias("path"), F.concat_ws(":", F.unix_micros("file_modification_time").cast("string"), F.col("file_size").cast("string")).alias("fingerprint"))


def header(df: DataFrame) -> list[str]:
    """O-005. Column names, without reading a row."""
    return df.columns


def delivery_columns(identity: list[str], meta: list[str], tail: list[str]) -> list[str]:
    """O-006. The delivery's columns by rule: addresses, the raw input, identity and texts, features, meta, attribute triplets, tail."""
    urls = ["MFR URL", *[f"Ref URL {i}" for i in range(1, 6)]]
    triplets = [f"ATTRIBUTE_{part} {i}" for i in range(1, ATTRIBUTES + 1) for part in ("LABEL", "VALUE", "UOM")]
    return [*urls, *INPUT_COLUMNS, *identity, *[f"ITEM_FEATURES_{i}" for i in range(1, FEATURES + 1)], *meta, *triplets, *tail]


def snapshot(payload: DataFrame, order: list[str], path: str) -> None:
    """O-010, O-012. A sorted JSON snapshot of a registry or of metrics."""
    payload.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, computed_cost: Column) -> DataFrame:
    """O-012. Metrics, with the cost worked out where an older file lacks it."""
    df = spark.read.json(path)
    return df.withColumn("cost", F.coalesce(F.col("cost"), computed_cost) if "cost" in df.columns else computed_cost)


def cached_documents(documents: DataFrame) -> DataFrame:
    """O-014. What the document cache keeps: the current version, texts and links within their bounds."""
    out = documents.filter(F.col("version") == CACHE_VERSION)
    return out.withColumn("text", F.substring("text", 1, TEXT_MOST)).withColumn("links", F.slice("links", 1, LINKS_MOST))


def robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """O-017. urls (host) with `allowed`; hosts without rules are allowed. rules: (host, allowed)."""
    return urls.join(rules, "host", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def cache_key(prompt: Column, schema: Column, tag: Column) -> Column:
    """O-019. 40 hex digits of the SHA-256 of tag, prompt and schema, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", tag, prompt, schema), 256), 1, 40)


def answered(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """O-018, O-192. prompts (prompt_hash) with the cached `payload`, null where there is none."""
    return prompts.join(responses.dropDuplicates(["prompt_hash"]), "prompt_hash", "left")


def tolerant_json(text: Column, schema: str) -> Column:
    """O-020. A JSON object out of fences and prose; null if there is none."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?s)^```[A-Za-z]*\s*|\s*```$", "")
    outer = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(bare, schema), F.from_json(F.nullif(outer, F.lit("")), schema))


def raw_records(rows: DataFrame) -> DataFrame:
    """O-134. A clean working copy of the raw input, beside its verbatim echo; a null part number is empty."""
    from catalith.functions.text import strip_condition

    c = lambda name: cell(F.col(f"`{name}`"))
    echo = F.create_map(*[x for n in INPUT_COLUMNS for x in (F.lit(n), F.col(f"`{n}`"))])
    return rows.select(
        "_row_id", c("PART_NUMBER").alias("part_number"), c("Dept").alias("dept"), c("Class").alias("class"), c("Fine").alias("fine"), c("SKU - MY_PART_NUMBER").alias("sku"),
        c("Mfg_Part_Num").alias("mpn"), strip_condition(repair_symbols(F.col("Part_Desc"))).alias("description"),
        F.filter(F.array(c("DIB_Brand"), c("Unilog_Brand"), c("E1_Brand")), lambda h: h != "").alias("hints"), c("Part_Manuf").alias("supplier"), echo.alias("source_row"),
    )


def delivery(records: DataFrame, columns: list[str]) -> DataFrame:
    """O-011, O-021. The wide sink: the echo always wins, then triplets and features by place, then mapped fields; unknown keys are dropped."""
    named = F.map_concat(F.map_filter("extras", lambda k, v: ~k.isin(INPUT_COLUMNS)), F.map_filter("source_row", lambda k, v: F.trim(v) != ""))

    def value(name: str) -> Column:
        head, _, place = name.rpartition(" ")
        if head.startswith("ATTRIBUTE_") and place.isdigit():
            return F.try_element_at("attributes", F.lit(int(place)))[head.removeprefix("ATTRIBUTE_").lower()]
        if name.startswith("ITEM_FEATURES_"):
            return F.try_element_at("features", F.lit(int(name.rpartition("_")[2])))
        return F.try_element_at(named, F.lit(name))

    return records.select([value(c).alias(c) for c in columns])


def readable(df: DataFrame) -> DataFrame:
    """Clean strings throughout."""
    return df.select([clean(F.col(f"`{c}`")).alias(c) for c in df.columns])
