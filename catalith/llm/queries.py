"""The registered query of each operator: thin wrappers that read a table and derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import alignment, ann, byte_bpe, decontamination, divergence, exact_dedup, language_id, packing, sharding, simhash, substring_dedup, toxicity, url_filter
from catalith.llm.common import remainder
from catalith.session import prepare, table

#: Files of public tokenizers; a path is a parameter of the operators.
BYTE_BPE, WORD_BPE, BYTE_SIDE, PIECE_SIDE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(prepare(spark), sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify(documents(spark, sf_dir), language_id.may_teach())
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), public_tokenizers.PATTERN)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), remainder("doc_id", 5) == 0
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: (host, path, verdict) of the contract's rules.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.classify(table(prepare(spark), sf_dir, "pages"), URL_RULES)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(WORD_BPE))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(documents(spark, sf_dir), tokenizer_path(BYTE_SIDE), tokenizer_path(PIECE_SIDE))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).drop("items")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_substring_dedup, op3_byte_bpe, op4_sharding, op5_exact_dedup, op6_toxicity, op7_nearest, op8_url_filter, op9_simhash, op10_packing)
    found += (op11_divergence, op12_alignment, op13_decontamination)
    return {f.__name__: f for f in found}


#: Words as the contract has them: runs of anything but 0x20 and 0x09-0x0D.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op2_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        n AS (SELECT doc_id, w, len(w) AS n FROM d),
        s AS (SELECT doc_id, unnest(range(1, n - 11)) AS p, w FROM n WHERE n >= 13),
        g AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM s),
        f AS (SELECT g, min(doc_id) AS f FROM g GROUP BY g),
        hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM g JOIN f USING (g) WHERE f < doc_id),
        r AS (SELECT doc_id, list(p) AS ps, count(*) AS c FROM hit GROUP BY doc_id)
        SELECT n.doc_id, n.n AS n_words, coalesce(r.c, 0) AS n_removed,
               sha256(array_to_string(CASE WHEN r.c IS NULL THEN n.w
                   ELSE list_transform(list_filter(range(1, n.n + 1), lambda i: NOT list_contains(r.ps, i)), lambda i: n.w[i]) END, ' ')) AS kept_sha256
        FROM n LEFT JOIN r ON r.doc_id = n.doc_id""",
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op11_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        l AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v)::HUGEINT AS q FROM kept JOIN v USING (lang)),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        cells AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM cells JOIN v USING (lang)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10""",
    "op13_decontamination": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, {_ITEM_WORDS} AS w FROM benchmark),
        g AS (SELECT DISTINCT item, array_to_string(w[p:p + 9], ' ') AS g, least(len(w), 10) AS n FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS x(p) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM g),
        s AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS x(p)),
        m AS (SELECT r, p, s.n, item FROM s JOIN g USING (g)),
        hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
        i AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN i USING (r)""",
}
