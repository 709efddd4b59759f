"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import exact_dedup, language_id, packing, queries, simhash, substring_dedup
from catalith.llm.common import released, text_bytes, written
from catalith.session import prepare, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _key(mark: Column) -> Column:
    """A row's id and the mark of its text; the mark alone where the id is null."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), mark)


def _one_each(docs: DataFrame, mark: Column, kept: DataFrame) -> DataFrame:
    """One row of docs for each `key` of kept."""
    keyed = docs.select(*COLUMNS, _key(mark).alias("key"))
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear.

    A null text, one without letters, and one whose two best languages are too close go; the lang column teaches but is not looked at in a judgement, so
    a null lang is no reason to go. Repeated rows are judged alike and stay repeated; an empty table stays empty; texts of any length are judged whole;
    columns besides those of documents go, whatever their names.
    """
    prepare(spark)
    out = language_id.identify(docs, language_id.may_teach(), carry=COLUMNS)
    return out.filter("accepted").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the least id's, a null id only where the group has no other; any one of equal texts with that id.

    Null and empty texts are equal to each other and keep one row; rows that repeat an id with different texts are groups of their own; very long texts
    are compared whole; an empty table stays empty; columns besides those of documents go, whatever their names.
    """
    prepare(spark)
    kept = exact_dedup.classes(docs).filter("kept").select(_key(F.col("text_sha256")).alias("key"))
    return _one_each(docs, exact_dedup.text_digest(text_bytes()), kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked fingerprints, chosen by id as in `drop_copies`; the least fingerprint where that id has several.

    Texts without words, null or empty, have fingerprint zero and are linked like any other; rows with equal fingerprints are one component, however many;
    an empty table stays empty; columns besides those of documents go, whatever their names.
    """
    prepare(spark)
    kept = simhash.rooted(docs).filter("doc_id <=> component_id").groupBy("doc_id", "root").agg(F.min("fp").alias("fp"))
    kept = kept.select(_key(F.col("fp").cast("string")).alias("key"))
    return _one_each(docs, simhash.fingerprint(text_bytes()).cast("string"), kept)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that start in an earlier one; a text that loses nothing stays as it is.

    Null texts stay null; a text that loses all its words becomes empty and its row stays; a row with a null id loses what any document with an id has;
    rows that repeat an id lose nothing on each other's account; an empty table stays empty; columns besides those of documents go, whatever their names.
    """
    prepare(spark)
    out = substring_dedup.deduplicate(docs, carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "utf-8")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null or empty text is its closing id alone, repeated rows are packed each, an empty table gives no pieces."""
    prepare(spark)
    return packing.pack(docs, queries.tokenizer_path(queries.WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("packing", pack),
]

#: Compression models, fingerprints by XXH64 and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`; each result is written and read again, and what a stage needed on its way is deleted."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        with released(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return docs
