"""Queries of the fit and lookup operators over the proxy catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import registry as R
from catalith.operators import resolve as J
from catalith.operators import stages as S
from catalith.plans.proxy import OBS, observations, stored
from catalith.session import prepare, table, written

FOLD = "(CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT) % 1000) < 300"
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '\\(.*?\\)', ' ', 'g'), '\\b(inc|llc|ltd|co|corp|corporation|company|group|holding|holdings|mfg|manufacturing|industries|international|usa|na|the|and)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def flagship(spark, d):
    """Suppliers' brands learned on the training fold, and how they hold on the held-out rows."""
    train, held = S.split(observations(spark, d))
    winners = R.supplier_winners(R.supplier_pairs(train)).withColumnRenamed("brand", "predicted")
    out = held.withColumn("supplier_key", R.match_key(F.col("supplier"))).join(winners.select("supplier_key", "predicted", "confidence"), "supplier_key", "left")
    right = F.sum((F.col("predicted") == F.col("brand")).cast("long"))
    return out.groupBy("supplier_key", "predicted").agg(F.bround(F.first("confidence"), 6).alias("confidence"), F.count("*").alias("held_out_rows"), right.alias("right_rows"))


FLAGSHIP_SQL = f"""
    WITH {OBS}, f AS (SELECT *, {FOLD.format('part_number')} AS held, {_KEY.format('supplier')} AS supplier_key FROM obs),
    c AS (SELECT supplier_key, manufacturer, brand, count(*) AS n, min(row_id) AS first FROM f WHERE NOT held GROUP BY ALL),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY supplier_key) AS share, count(*) OVER (PARTITION BY supplier_key) AS pairs,
        row_number() OVER (PARTITION BY supplier_key ORDER BY n DESC, first) AS rn FROM c),
    w AS (SELECT supplier_key, brand AS predicted, CASE WHEN pairs > 1 THEN 0.9::DOUBLE * share ELSE 0.9::DOUBLE END AS confidence FROM s WHERE rn = 1)
    SELECT f.supplier_key, predicted, round_even(any_value(confidence), 6) AS confidence, count(*) AS held_out_rows, count(*) FILTER (predicted = brand) AS right_rows
    FROM f LEFT JOIN w ON f.supplier_key = w.supplier_key WHERE held GROUP BY f.supplier_key, predicted"""


def _top(counts, key, value):
    return R.modal(counts, key, value)


def q(fn, sql):
    return fn, sql


_MELT = "m AS (SELECT row_id, classpath, 'flag' AS label_key, flag AS value, '' AS uom FROM obs UNION ALL SELECT row_id, classpath, 'status', status, 'in' FROM obs UNION ALL SELECT row_id, classpath, 'size', size, 'lb' FROM obs)"
_VOTES = "v AS (SELECT trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g')) AS key, brand, row_id * 8 AS pos FROM obs UNION ALL SELECT trim(regexp_replace(lower(dept), '[^a-z0-9]+', ' ', 'g')), brand, row_id * 8 + 1 FROM obs), c AS (SELECT key, brand, count(*) AS n, min(pos) AS first FROM v GROUP BY ALL)"
_PREFIX = "p AS (SELECT brand, row_id, upper(regexp_replace(mpn, '[^A-Za-z0-9]+', '', 'g')) AS stem FROM obs), x AS (SELECT brand, row_id, stem, unnest(range(2, least(5, length(stem) - 1) + 1)) AS n FROM p WHERE length(stem) > 2), c AS (SELECT substr(stem, 1, n) AS key, brand, count(*) AS n, min(row_id) AS first FROM x GROUP BY ALL)"
_TRIPLES = "t AS (SELECT lower(dept) AS dept, lower(class) AS class, lower(fine) AS fine, classpath, count(*) AS n, min(row_id) AS first FROM obs GROUP BY ALL)"


def _fallback(spark, d):
    train, held = S.split(observations(spark, d))
    out = J.candidates(held.select("row_id", "dept", "class", "fine"), R.triple_paths(train))
    return out.select("row_id", "level", F.size("candidates").alias("n_candidates"), F.try_element_at("candidates", F.lit(1)).alias("best"))


def _orders_purity(spark, d):
    rows = table(prepare(spark), d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("brand"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    return R.pure_winners(R.counted(rows, ["key"], "brand"))


def _templates(spark, d):
    rows = table(prepare(spark), d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: F.struct(x["l_returnflag"].alias("label"))).alias("attributes"))
    rows = rows.select(F.col("l_orderkey").alias("row_id"), F.concat(F.lit("c"), (F.col("l_orderkey") % 50).cast("string")).alias("classpath"), "attributes")
    return R.templates(rows).select("classpath", F.array_join("labels", ",").alias("labels"))


def _first_match(spark, d):
    orders = table(prepare(spark), d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderpriority")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return J.first_match_join(customers, orders, "key", "o_orderkey")


def _longest_prefix(spark, d):
    rows = observations(spark, d)
    # learned once and written down, as each of the four lookups reads it
    known = written(R.pure_winners(R.prefix_votes(rows)), "prefixes")
    return J.by_prefix(rows, known).distinct()


def _first_token(spark, d):
    rows = observations(spark, d)
    tokens = R.modal(R.counted(rows.select("row_id", F.explode(F.transform(R.words_of(F.col("product_name")), F.lower)).alias("key"), "brand"), ["key"], "brand"), ["key"], "brand")
    return J.by_token(rows, tokens)


def _first_of_two(spark, d):
    rows = observations(spark, d).select("row_id", "brand", "dept")
    known = R.counted(observations(spark, d).filter("fine = '7'").withColumnRenamed("brand", "key"), ["key"], []).select("key", F.col("n").alias("value"))
    return J.first_of_two(rows, "brand", "dept", known, "key", "value", "found", F.lit(0))


#: The held-out rows' brands by the rules that can answer here: a hint with one meaning, the longest pure prefix of the part number, a hint's usual meaning.
RESOLVED = f"""
    WITH {OBS}, u AS (SELECT DISTINCT * FROM obs), tr AS (SELECT * FROM u WHERE NOT {FOLD.format('part_number')}), h AS (SELECT *, upper(regexp_replace(mpn, '[^A-Za-z0-9]+', '', 'g')) AS stem FROM u WHERE {FOLD.format('part_number')}),
    p AS (SELECT brand, row_id, upper(regexp_replace(mpn, '[^A-Za-z0-9]+', '', 'g')) AS stem FROM tr), x AS (SELECT brand, row_id, stem, unnest(range(2, least(5, length(stem) - 1) + 1)) AS n FROM p WHERE length(stem) > 2),
    c AS (SELECT substr(stem, 1, n) AS key, brand, count(*) AS n, min(row_id) AS first FROM x GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS rn FROM c),
    w AS (SELECT key, brand FROM r WHERE rn = 1 AND n >= 2 AND n / total >= 0.85), y AS (SELECT row_id, stem, unnest(range(2, least(5, length(stem)) + 1)) AS l FROM h),
    b AS (SELECT row_id, arg_max(w.brand, l) AS brand, arg_max(w.key, l) AS prefix FROM y JOIN w ON w.key = substr(stem, 1, l) GROUP BY row_id),
    v AS (SELECT {_KEY.format('brand')} AS key, brand, row_id * 8 AS pos FROM tr UNION ALL SELECT {_KEY.format('dept')}, brand, row_id * 8 + 1 FROM tr), vc AS (SELECT key, brand, count(*) AS n, min(pos) AS first FROM v GROUP BY ALL),
    f AS (SELECT key, arg_max(brand, {{'n': n, 'f': -first}}) AS brand, count(*) > 1 AS vague FROM vc GROUP BY key), m AS (SELECT brand, arg_min(manufacturer, row_id) AS manufacturer FROM tr GROUP BY brand),
    t AS (SELECT h.row_id, CASE WHEN NOT f.vague THEN f.brand ELSE coalesce(b.brand, f.brand) END AS brand, CASE WHEN NOT f.vague THEN 0.97 WHEN b.brand IS NOT NULL THEN 0.93 ELSE 0.8 END::DOUBLE AS confidence,
        CASE WHEN NOT f.vague THEN 'brand-exact' WHEN b.brand IS NOT NULL THEN 'mpn-prefix:' || prefix ELSE 'brand-exact-ambiguous' END AS provenance FROM h LEFT JOIN b USING (row_id) JOIN f ON f.key = {_KEY.format('h.dept')}),
    resolved AS (SELECT row_id, coalesce(m.manufacturer, '') AS manufacturer, t.brand, confidence, provenance FROM t LEFT JOIN m ON m.brand = t.brand)"""


def _resolved(spark, d):
    train, held = S.split(stored(spark, d, once=True))
    out = J.resolve(held.select("row_id", "supplier", "hints", "mpn", "description"), R.fit(train).stored(*J.RESOLVES_BY))
    return out.select("row_id", "manufacturer", "brand", F.bround("confidence", 6).alias("confidence"), "provenance")


QUERIES = {
    "flagship_supplier_brand": q(flagship, FLAGSHIP_SQL),
    "o077_hash_split": q(lambda s, d: observations(s, d).groupBy(S.is_holdout(F.col("part_number")).alias("holdout")).agg(F.count("*").alias("n"), F.min("part_number").alias("least")), f"WITH {OBS} SELECT {FOLD.format('part_number')} AS holdout, count(*) AS n, min(part_number) AS least FROM obs GROUP BY 1"),
    "o104_value_counts": q(lambda s, d: R.value_counts(R.melted(observations(s, d))), f"WITH {OBS}, {_MELT} SELECT classpath, label_key, value, count(*) AS n, min(row_id) AS first FROM m GROUP BY ALL"),
    "o104_unit_counts": q(lambda s, d: R.unit_counts(R.melted(observations(s, d))), f"WITH {OBS}, {_MELT} SELECT classpath, label_key, uom, count(*) AS n, min(row_id) AS first FROM m WHERE uom <> '' GROUP BY ALL"),
    "o105_triple_paths": q(lambda s, d: R.triple_paths(observations(s, d)), f"WITH {OBS}, {_TRIPLES} SELECT * FROM t"),
    "o105_leaf_paths": q(lambda s, d: R.leaf_paths(observations(s, d)), f"WITH {OBS} SELECT trim(string_split(classpath, '>')[-1]) AS leaf, arg_min(classpath, row_id) AS classpath FROM obs GROUP BY 1"),
    "o106_modal_name": q(lambda s, d: R.modal(R.counted(observations(s, d), ["dept"], "product_name"), ["dept"], "product_name"), f"WITH {OBS}, c AS (SELECT dept, product_name, count(*) AS n, min(row_id) AS first FROM obs GROUP BY ALL) SELECT dept, product_name FROM c QUALIFY row_number() OVER (PARTITION BY dept ORDER BY n DESC, first) = 1"),
    "o107_top_values": q(lambda s, d: R.top_values(R.counted(observations(s, d), ["dept"], "brand"), ["dept"], "brand", 5).select("dept", F.array_join("permitted", ",").alias("permitted")), f"WITH {OBS}, c AS (SELECT dept, brand, count(*) AS n, min(row_id) AS first FROM obs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dept ORDER BY n DESC, first) AS rn FROM c) SELECT dept, string_agg(brand, ',' ORDER BY rn) AS permitted FROM r WHERE rn <= 5 GROUP BY dept"),
    "o108_ambiguous_keys": q(lambda s, d: R.ambiguous_keys(R.brand_votes(observations(s, d))), f"WITH {OBS}, {_VOTES} SELECT key, count(*) AS brands FROM c GROUP BY key HAVING count(*) > 1"),
    "o109_supplier_pairs": q(lambda s, d: R.supplier_pairs(observations(s, d)).select("supplier_key", "manufacturer", "brand", "n", F.bround("share", 6).alias("share"), "pairs"), f"WITH {OBS}, c AS (SELECT {_KEY.format('supplier')} AS supplier_key, manufacturer, brand, count(*) AS n FROM obs GROUP BY ALL) SELECT supplier_key, manufacturer, brand, n, round_even(n / sum(n) OVER (PARTITION BY supplier_key), 6) AS share, count(*) OVER (PARTITION BY supplier_key) AS pairs FROM c"),
    "o106_brand_forms": q(lambda s, d: R.brand_forms(R.brand_votes(observations(s, d))), f"WITH {OBS}, {_VOTES} SELECT key, arg_max(brand, {{'n': n, 'f': -first}}) AS brand, count(*) > 1 AS ambiguous FROM c GROUP BY key"),
    "o106_brand_makers": q(lambda s, d: R.brand_makers(observations(s, d)), f"WITH {OBS} SELECT brand, arg_min(manufacturer, row_id) AS manufacturer FROM obs GROUP BY brand"),
    "o110_pure_winners": q(_orders_purity, "WITH c AS (SELECT l_orderkey AS key, l_returnflag AS brand, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS rn FROM c) SELECT key, brand, n AS hits, total::BIGINT AS total FROM r WHERE rn = 1 AND n >= 2 AND n / total >= 0.85"),
    "o111_prefix_votes": q(lambda s, d: R.prefix_votes(observations(s, d)), f"WITH {OBS}, {_PREFIX} SELECT key, brand, n, first FROM c"),
    "o111_type_words": q(lambda s, d: R.type_words(observations(s, d)), f"WITH {OBS}, w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(product_name || ' ' || dept || ' ' || class || ' ' || classpath, '[A-Za-z]{{2,}}'))) AS word FROM obs), b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(brand, '[A-Za-z]{{2,}}'))) AS word FROM obs) SELECT word FROM w WHERE word NOT IN (SELECT word FROM b)"),
    "o111_token_votes": q(lambda s, d: R.token_votes(observations(s, d).withColumn("description", F.concat_ws(" ", F.lit("special"), "description"))), f"WITH {OBS}, w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(product_name || ' ' || dept || ' ' || class || ' ' || classpath, '[A-Za-z]{{2,}}'))) AS word FROM obs), b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(brand, '[A-Za-z]{{2,}}'))) AS word FROM obs), k AS (SELECT row_id, brand, lower(regexp_replace(mpn, '[^A-Za-z0-9]+', '', 'g')) AS stem, lower(unnest(regexp_extract_all('special ' || description, '[A-Za-z]{{2,}}'))) AS key FROM obs) SELECT key, brand, count(*) AS n, min(row_id) AS first FROM k WHERE NOT contains(stem, key) AND (key NOT IN (SELECT word FROM w) OR key IN (SELECT word FROM b)) GROUP BY key, brand"),
    "o112_templates": q(_templates, "WITH s AS (SELECT l_orderkey AS row_id, 'c' || (l_orderkey % 50) AS classpath, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS labels FROM lineitem GROUP BY l_orderkey), v AS (SELECT classpath, labels, count(*) AS n, min(row_id) AS first FROM s GROUP BY ALL), b AS (SELECT classpath, labels FROM v QUALIFY row_number() OVER (PARTITION BY classpath ORDER BY n DESC, len(labels) DESC, first) = 1), e AS (SELECT classpath, first, unnest(labels) AS label, unnest(range(len(labels))) AS pos FROM v), bl AS (SELECT classpath, label, min(pos) AS pos FROM (SELECT classpath, unnest(labels) AS label, unnest(range(len(labels))) AS pos FROM b) GROUP BY ALL), rest AS (SELECT e.classpath, e.label, min(first * 1000 + pos) AS seen FROM e ANTI JOIN bl USING (classpath, label) GROUP BY ALL), u AS (SELECT classpath, label, pos - 1000000 AS o FROM bl UNION ALL SELECT classpath, label, seen FROM rest) SELECT classpath, string_agg(label, ',' ORDER BY o) AS labels FROM u GROUP BY classpath"),
    "o113_brand_approvals": q(lambda s, d: R.brand_approvals(observations(s, d).withColumn("brand", F.concat_ws("-", "supplier", "fine", "dept"))).select("brand", F.array_join("approvals", ",").alias("approvals")), f"WITH {OBS}, s AS (SELECT supplier || '-' || fine || '-' || dept AS brand, list_sort([flag, status]) AS st, row_id FROM obs), c AS (SELECT brand, st, count(*) AS n, min(row_id) AS first FROM s GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY brand) AS t, row_number() OVER (PARTITION BY brand ORDER BY n DESC, first) AS rn FROM c) SELECT brand, array_to_string(st, ',') AS approvals FROM r WHERE rn = 1 AND t >= 3 AND n / t >= 0.8"),
    "o114_token_counts": q(lambda s, d: R.approval_counts(observations(s, d)), f"WITH {OBS}, t AS (SELECT row_id, unnest(string_split(approvals, '|')) AS token FROM obs) SELECT token, count(*) AS n, min(row_id) AS first FROM t GROUP BY token"),
    "o115_rates": q(lambda s, d: R.rates(observations(s, d).withColumn("late", F.when(F.col("fine").cast("int") > 25, "x").otherwise("")), "brand", ["late", "supplier"]), f"WITH {OBS} SELECT brand, count(*) AS rows, round_even(count(*) FILTER (CAST(fine AS INT) > 25) / count(*), 3) AS late, round_even(count(*) FILTER (supplier <> '') / count(*), 3) AS supplier FROM obs GROUP BY brand"),
    "o083_free_text": q(lambda s, d: R.free_text_labels(R.value_counts(R.melted(observations(s, d)))), f"WITH {OBS}, {_MELT}, c AS (SELECT classpath, label_key, value, count(*) AS n FROM m GROUP BY ALL), t AS (SELECT classpath, label_key, sum(n)::BIGINT AS total, count(*) AS distinct_values FROM c GROUP BY ALL) SELECT *, contains(label_key, 'size') OR total < 3 OR (distinct_values > 1 AND distinct_values / total >= 0.9) AS free_text FROM t"),
    "o119_summary": q(lambda s, d: R.fit(observations(s, d)).summary().filter("registry in ('triples', 'leaves', 'brands', 'makers')"), f"WITH {OBS}, {_VOTES}, {_TRIPLES} SELECT 'triples' AS registry, count(*) AS entries FROM t UNION ALL SELECT 'leaves', count(DISTINCT trim(string_split(classpath, '>')[-1])) FROM obs UNION ALL SELECT 'brands', count(DISTINCT key) FROM c UNION ALL SELECT 'makers', count(DISTINCT brand) FROM obs"),
    "o088_first_match_join": q(_first_match, "SELECT c_custkey AS key, c_name, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL"),
    "o090_fallback_join": q(_fallback, f"WITH {OBS}, tr AS (SELECT * FROM obs WHERE NOT {FOLD.format('part_number')}), h AS (SELECT row_id, lower(dept) AS dept, lower(class) AS class, lower(fine) AS fine FROM obs WHERE {FOLD.format('part_number')}), a AS (SELECT lower(dept) AS dept, lower(class) AS class, lower(fine) AS fine, classpath, count(*) AS n, min(row_id) AS first FROM tr GROUP BY ALL), b AS (SELECT dept, class, classpath, sum(n) AS n, min(first) AS first FROM a GROUP BY ALL), c AS (SELECT dept, classpath, sum(n) AS n, min(first) AS first FROM a GROUP BY ALL), a3 AS (SELECT dept, class, fine, count(*) AS k, arg_max(classpath, {{'n': n, 'f': -first}}) AS best FROM a GROUP BY ALL), b2 AS (SELECT dept, class, least(25, count(*)) AS k, arg_max(classpath, {{'n': n, 'f': -first}}) AS best FROM b GROUP BY ALL), c1 AS (SELECT dept, least(25, count(*)) AS k, arg_max(classpath, {{'n': n, 'f': -first}}) AS best FROM c GROUP BY ALL) SELECT row_id, CASE WHEN a3.k IS NOT NULL THEN 3 WHEN b2.k IS NOT NULL THEN 2 WHEN c1.k IS NOT NULL THEN 1 ELSE 0 END AS level, coalesce(a3.k, b2.k, c1.k, 0) AS n_candidates, coalesce(a3.best, b2.best, c1.best) AS best FROM h LEFT JOIN a3 USING (dept, class, fine) LEFT JOIN b2 USING (dept, class) LEFT JOIN c1 USING (dept)"),
    "o092_longest_prefix_join": q(_longest_prefix, f"WITH {OBS}, {_PREFIX}, r AS (SELECT *, sum(n) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS rn FROM c), w AS (SELECT key, brand FROM r WHERE rn = 1 AND n >= 2 AND n / total >= 0.85), y AS (SELECT p.row_id, unnest(range(2, least(5, length(p.stem)) + 1)) AS l, p.stem FROM p) SELECT row_id, arg_max(w.brand, l) AS brand, arg_max(w.key, l) AS prefix FROM y JOIN w ON w.key = substr(stem, 1, l) GROUP BY row_id"),
    "o093_first_token_join": q(_first_token, f"WITH {OBS}, k AS (SELECT row_id, lower(unnest(regexp_extract_all(product_name, '[A-Za-z]{{2,}}'))) AS key, brand FROM obs), c AS (SELECT key, brand, count(*) AS n, min(row_id) AS first FROM k GROUP BY ALL), w AS (SELECT key, arg_max(brand, {{'n': n, 'f': -first}}) AS brand FROM c GROUP BY key), e AS (SELECT row_id, regexp_extract_all(description, '[A-Za-z]{{2,}}') AS ts FROM obs), t AS (SELECT row_id, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM e) SELECT row_id, arg_min(w.brand, pos) AS brand, arg_min(token, pos) AS token FROM t JOIN w ON w.key = lower(token) GROUP BY row_id"),
    "o100_first_of_two": q(_first_of_two, f"WITH {OBS}, k AS (SELECT brand AS key, count(*) AS value FROM obs WHERE fine = '7' GROUP BY 1) SELECT row_id, brand, dept, coalesce(a.value, b.value, 0) AS found FROM obs LEFT JOIN k a ON a.key = brand LEFT JOIN k b ON b.key = dept"),
    "o131_union_of_folds": q(lambda s, d: (lambda t, h: t.unionByName(h).groupBy("dept").agg(F.count("*").alias("n")))(*S.split(observations(s, d))), f"WITH {OBS} SELECT dept, count(*) AS n FROM obs GROUP BY dept"),
    "o095_resolve_cascade": q(_resolved, RESOLVED + " SELECT * FROM resolved"),
}
