"""Queries of sources, evidence, style, stages, decisions, scoring and reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions import identifiers as I
from catalith.operators import decisions as D
from catalith.operators import evidence as E
from catalith.operators import registry as R
from catalith.operators import retrieval
from catalith.operators import score as C
from catalith.operators import stages as S
from catalith.operators import style as Y
from catalith.plans.proxy import OBS, observations, stored
from catalith.sources import tables as T
from catalith.session import prepare, table, written


def _t(name):
    return lambda s, d: table(prepare(s), d, name)


_PROPS = "map<string,string>"
# -- decisions: events as an append log, keyed by user ---------------------------------------------------------------------------


def _log(s, d):
    e = _t("events")(s, d)
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("part_number"), F.when(F.col("event_id") % 3 == 0, "approved").otherwise("corrected").alias("status"), F.create_map(F.lit("series"), F.col("event_type")).alias("fields"), F.col("event_id").alias("at"))


_LOG = "l AS (SELECT 'u' || user_id AS part_number, CASE WHEN event_id % 3 = 0 THEN 'approved' ELSE 'corrected' END AS status, event_type AS series, event_id AS pos FROM events), w AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY part_number ORDER BY pos DESC) = 1)"


def _log_lines(s, d):
    """O-008: JSON lines with a broken one among every five."""
    e = _t("events")(s, d)
    line = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("part_number"), F.lit("approved").alias("status"), F.col("event_type").alias("notes")))
    lines = e.select(F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(line).alias("value"), F.col("event_id").alias("at"))
    return D.latest(D.parse_log(lines)).select("part_number", "status", "notes")


def _overlay(s, d):
    c = _t("customer")(s, d)
    attr = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"), F.lit("in").alias("uom"), F.lit(0.5).alias("confidence"), F.lit("x").alias("source"))
    records = c.select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("part_number"), F.col("c_name").alias("series"), F.array(attr("Size", F.col("c_mktsegment"))).alias("attributes"),
        F.create_map(F.lit("k"), F.lit("v")).alias("extras"), F.create_map(F.lit("series"), F.lit(0.3)).alias("confidence"), F.create_map(F.lit("series"), F.lit("llm")).alias("provenance"),
        F.create_map(F.lit("Size"), F.lit("http://x")).alias("grounded"), F.lit(True).alias("needs_review"),
    )
    made = F.array(F.struct(F.lit("SIZE").alias("label"), F.col("status").alias("value"), F.lit(None).cast("string").alias("uom")), F.struct(F.lit("New").alias("label"), F.lit("n").alias("value"), F.lit("ft").alias("uom")))
    decided = D.latest(_log(s, d)).withColumn("attributes", made).withColumn("extras", F.create_map().cast(_PROPS))
    out = D.overlay(records, decided)
    text = F.array_join(F.transform("attributes", lambda a: F.concat_ws(":", a["label"], a["value"], a["uom"], a["confidence"].cast("string"))), ",")
    return out.select("part_number", "series", text.alias("attributes"), F.col("confidence")["series"].alias("confidence"), F.coalesce(F.try_element_at("provenance", F.lit("review")), F.lit("")).alias("review"), F.size("grounded").alias("grounded"), "needs_review")


_OVERLAY = f"WITH {_LOG} SELECT 'u' || c_custkey AS part_number, coalesce(w.series, c_name) AS series, CASE WHEN w.series IS NULL THEN 'Size:' || c_mktsegment || ':in:0.5' ELSE 'Size:' || w.status || ':in:1.0,New:n:ft:1.0' END AS attributes, CASE WHEN w.series IS NULL THEN 0.3 ELSE 1.0 END::DOUBLE AS confidence, CASE w.status WHEN 'corrected' THEN 'values corrected by reviewer' WHEN 'approved' THEN 'approved by reviewer as generated' ELSE '' END AS review, CASE WHEN w.series IS NULL THEN 1 ELSE 0 END AS grounded, w.series IS NULL AS needs_review FROM customer LEFT JOIN w ON w.part_number = 'u' || c_custkey"

# -- scoring: two versions of customers -------------------------------------------------------------------------------------------


def _scored(s, d):
    c = _t("customer")(s, d)
    truth = c.select(F.col("c_custkey").alias("PART_NUMBER"), F.col("c_custkey").alias("row_id"), F.col("c_name").alias("BRAND_NAME"), F.col("c_mktsegment").alias("Classpath"))
    got = c.filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("PART_NUMBER"), F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.col("c_name")).alias("BRAND_NAME"), F.when(F.col("c_custkey") % 4 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("Classpath"))
    return got, truth


def _fields(fuzzy):
    return lambda s, d: C.score_fields(C.field_pairs(*_scored(s, d), fields=["BRAND_NAME", "Classpath"]), fuzzy)


_FIELDS = "f AS (SELECT field, want, got FROM (SELECT 'BRAND_NAME' AS field, c_name AS want, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS got FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'Classpath', c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 'OTHER' ELSE c_mktsegment END FROM customer WHERE c_custkey % 7 <> 0)), s AS (SELECT field, count(*) FILTER (got <> '') AS compared, round_even(count(*) FILTER (got <> '' AND got = want) / greatest(count(*) FILTER (got <> ''), 1), 3) AS exact_match, round_even(count(*) FILTER (got <> '' AND got = want) / greatest(count(*) FILTER (got <> ''), 1), 3) AS fuzzy_match, coalesce(round_even(avg(CASE WHEN got = want THEN 100.0 ELSE 0.0 END) FILTER (got <> '') / 100, 3), 0) AS mean_similarity, round_even(count(*) FILTER (got <> '') / count(*), 3) AS fill_rate, round_even(count(*) FILTER (want <> '') / count(*), 3) AS truth_fill_rate FROM f GROUP BY field)"


def _attributes(s, d):
    line = _t("lineitem")(s, d).groupBy(F.col("l_orderkey").alias("part_number"), F.col("l_linenumber").alias("slot")).agg(F.max("l_returnflag").alias("value"), F.max("l_linestatus").alias("other"))
    truth = line.select("part_number", "slot", F.concat(F.lit("L"), F.col("slot").cast("string")).alias("label"), "value")
    got = line.filter("part_number % 5 <> 0").select("part_number", "slot", F.when(F.col("slot") == 2, "Z").otherwise(F.concat(F.lit("l"), F.col("slot").cast("string"))).alias("label"), F.when(F.col("other") == "O", F.col("value")).otherwise("Q").alias("value"))
    return C.score_attributes(got, truth, fuzzy=False)


_ATTRIBUTES = "WITH a AS (SELECT l_orderkey AS k, l_linenumber AS slot, max(l_returnflag) AS v, max(l_linestatus) AS o FROM lineitem GROUP BY ALL), g AS (SELECT * FROM a WHERE k % 5 <> 0), n AS (SELECT count(*) AS e, count(*) FILTER (slot <> 2) AS h, count(*) FILTER (slot <> 2 AND o = 'O') AS q FROM g) SELECT e AS labels_emitted, round_even(h / e, 3) AS label_precision, h AS values_compared, round_even(q / greatest(h, 1), 3) AS value_accuracy FROM n"


def _texts(s, d):
    p = _t("part")(s, d)
    return p.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.lower("p_name")).alias("INVOICE_DESC"), F.concat_ws(", ", *["p_name"] * 5).alias("MOBILE_DESC"), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " in").otherwise("in")).alias("SHORT_DESC"), F.concat(F.lit("1.5"), F.when(F.col("p_partkey") % 5 == 0, " in").otherwise(" mm")).alias("LONG_DESC1"), F.col("p_name").alias("RETAIL_DESC"))


_TEXTS = "WITH t AS (SELECT upper(p_name) AS i, array_to_string([p_name, p_name, p_name, p_name, p_name], ', ') AS m, p_partkey AS k FROM part) SELECT round_even(avg((length(i) <= 40)::INT), 3) AS invoice_within_40_chars, round_even(avg((k % 2 = 0)::INT), 3) AS invoice_all_caps, round_even(avg((length(m) BETWEEN 60 AND 80)::INT), 3) AS mobile_within_60_80_chars, round_even(avg((k % 2 = 0)::INT), 3) AS unit_spacing_correct, round_even(avg((k % 5 <> 0)::INT), 3) AS fractions_not_decimals FROM t"


def _records(s, d):
    """Orders as records with their lines as citations; every fifth has none, and those of returned lines are editorial."""
    line = _t("lineitem")(s, d)
    kind = F.when(F.col("l_returnflag") == "A", "manual").when(F.col("l_returnflag") == "R", "editorial").otherwise("specification")
    cite = F.when(F.col("l_orderkey") % 5 > 0, F.struct(kind.alias("kind"), F.when(F.col("l_linestatus") == "O", "third-party").otherwise("manufacturer").alias("source")))
    cites = line.groupBy("l_orderkey").agg(F.collect_list(cite).alias("citations"), F.count("*").alias("filled"), F.sum((F.col("l_quantity") > 25).cast("long")).alias("grounded"))
    return cites.withColumn("mfr_url", F.when(F.col("l_orderkey") % 2 == 0, "https://a.com/x").otherwise("https://a.com")).select("citations", "filled", "grounded", "mfr_url")


_SOURCING = "WITH r AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_orderkey % 5 > 0) AS c, count(*) FILTER (l_orderkey % 5 > 0 AND l_returnflag <> 'R') AS v, count(*) FILTER (l_orderkey % 5 > 0 AND l_linestatus = 'O') AS t, count(*) FILTER (l_quantity > 25) AS g FROM lineitem GROUP BY 1) SELECT count(*) AS records, count(*) FILTER (c > 0) AS records_with_a_source, round_even(count(*) FILTER (c > 0) / count(*), 3) AS sourced_rate, count(*) FILTER (v > 0) AS records_with_verified_source, sum(c)::BIGINT AS documents_read, sum(t)::BIGINT AS third_party_documents, count(*) FILTER (t > 0) AS records_supplemented_third_party, count(*) FILTER (k % 2 = 0) AS deep_product_links, round_even(count(*) FILTER (k % 2 = 0) / count(*), 3) AS deep_link_rate, sum(n)::BIGINT AS filled_attribute_values, sum(g)::BIGINT AS grounded_values, round_even(sum(g) / sum(n), 3) AS grounded_rate FROM r"


def _cost(s, d):
    usage = _t("events")(s, d).groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls")).withColumn("total_tokens", F.lit(100_000))
    rates = prepare(s).createDataFrame([(1, "click", 0.2, 0.6, 0.5), (2, "c", 0.1, 0.3, 0.5), (3, "", 0.3, 0.3, 0.0)], "priority int, pattern string, input_rate double, output_rate double, output_share double")
    return C.cost(usage, rates)


_COST = "WITH u AS (SELECT event_type AS model, count(*) AS calls FROM events GROUP BY 1), t AS (SELECT *, 100000 * calls / sum(calls) OVER () AS tokens, CASE WHEN contains(model, 'click') THEN 0.4::DOUBLE WHEN contains(model, 'c') THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS rate FROM u) SELECT model, calls, round_even(tokens, 3) AS tokens, round_even(tokens * rate / 1000000, 6) AS cost FROM t"

# -- evidence: conversations as documents of a record -------------------------------------------------------------------------------


def _bundle(s, d):
    c = _t("conversations")(s, d)
    pairs = F.array(F.struct(F.lit("Role").alias("label"), F.col("role").alias("value")), F.struct(F.lit("_x").alias("label"), F.lit("y").alias("value")))
    kind = F.when(F.col("turn") % 2 == 0, "specification").otherwise("product-page")
    docs = c.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text")).select(
        F.col("conv_id").alias("part_number"), F.concat(F.lit("https://a.com/"), F.col("turn").cast("string")).alias("url"), kind.alias("kind"), F.col("text"), F.lit("t").alias("title"), pairs.alias("tables"),
        (F.col("role") == "user").alias("third_party"), F.col("turn").alias("seen"), F.lit(True).alias("mentions_mpn"), (F.col("turn") % 3 == 0).alias("url_names_part"),
    )
    return E.ordered(docs)


_BUNDLE = "c AS (SELECT conv_id, turn, min(role) AS role, coalesce(min(text), '') AS text FROM conversations GROUP BY ALL), b AS (SELECT *, 'https://a.com/' || turn AS url, CASE WHEN turn % 2 = 0 THEN 'specification' ELSE 'product-page' END AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY role = 'user', turn % 2 <> 0, length(text) DESC, turn) AS place FROM c)"


def _supported(s, d):
    """The middle third of every text, sought in all documents of its conversation."""
    bundle = _bundle(s, d)
    third = F.expr("substring(text, length(text) div 3 + 1, length(text) div 3)")
    values = _t("conversations")(s, d).filter("text is not null").select(F.col("conv_id").alias("part_number"), third.alias("value"))
    return E.supported(values, bundle, 3).groupBy("part_number", "url", "third_party").agg(F.count("*").alias("n"))


_SUPPORTED = f"WITH {_BUNDLE}, v AS (SELECT DISTINCT conv_id, substr(text, length(text) // 3 + 1, length(text) // 3) AS value FROM conversations WHERE text IS NOT NULL), k AS (SELECT *, regexp_replace(replace(lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))), 'ß', 'ss'), '[^a-z0-9]+', '', 'g') AS needle FROM v), h AS (SELECT k.conv_id, k.value, b.url, b.role = 'user' AS third_party, b.place FROM k JOIN b USING (conv_id) WHERE length(needle) >= 3 AND (contains(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', '', 'g'), needle) OR contains(role, needle))), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY conv_id, value ORDER BY place) = 1) SELECT conv_id AS part_number, url, third_party, count(*) AS n FROM f GROUP BY ALL"


def _labelled(s, d):
    ids = _t("conversations")(s, d).select(F.col("conv_id").alias("part_number")).distinct().withColumn("label", F.lit("role"))
    return E.labelled(ids, _bundle(s, d))


def _pages(s, d):
    """O-064: title, text and pairs of the stored pages, as digests."""
    out = E.documents(_t("pages")(s, d))
    return out.select("page_id", "kind", "title", F.length("text").alias("size"), F.size("tables").alias("pairs"), F.size("links").alias("links"))


def _gather(s, d):
    """A record for each page, its language and number as part number. All own example.com; those it does not name fall back to the other two domains."""
    raw = _t("pages")(s, d)
    # parsed pages are kept, as a document cache keeps them: they are read twice
    pages = written(E.documents(raw).withColumn("domain", I.registrable(I.host_of(F.col("url")))).withColumn("seen", F.col("page_id")), "documents")
    records = raw.select(F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("part_number"), F.regexp_extract("url", r"/([a-z]{2}/\d+)", 1).alias("mpn"))
    domains = records.select("part_number", F.lit("example.com").alias("domain"))
    reputable = prepare(s).createDataFrame([("example.org",), ("example.net",)], "domain string")
    return E.gather(records, pages, domains, reputable).select("part_number", "url", "place", "third_party")


# -- style and descriptions over the proxy catalogue ----------------------------------------------------------------------------------


def _style_rows(s, d):
    o = observations(s, d)
    text = F.concat(F.col("product_name"), F.lit(", "), F.col("fine"), F.lit(" lb Size, "), F.col("attributes")[0]["value"], F.lit(" Flag"))
    surfaces = {x: text for x in ("long", "short", "retail", "mobile")} | {"invoice": F.upper(text)}
    return o.withColumns(surfaces)


def _mined(s, d):
    # texts and attributes repeat: each different row of a path is looked at once, and counts as often as it occurs
    surfaces = [x for x in Y.SURFACES if x != "invoice"]
    o = _style_rows(s, d).withColumn("classpath", F.element_at(F.split("classpath", " > "), 1))
    rows = written(R.condensed(o, "classpath", "attributes", *surfaces), "condensed")
    found = Y.located(written(Y.row_facts(rows, surfaces), "facts"))
    return Y.mined(found).select("classpath", "surface", "label_key", F.coalesce("separator", F.lit("")).alias("separator"), F.coalesce("suffix", F.lit("")).alias("suffix"), "inclusion", F.bround("rank", 3).alias("rank"), "rows")


def _descriptions(s, d):
    o = _style_rows(s, d).withColumn("classpath", F.col("dept"))
    # styles follow from what different rows there are and how often each occurs
    rows = written(R.condensed(o, "classpath", "attributes", "product_name", *Y.SURFACES), "condensed")
    facts = written(Y.row_facts(rows), "facts")
    words = written(Y.lexicon(Y.abbreviations(rows.select("row_id", R.TIMES, "invoice", F.split("product_name", " ").alias("words")))), "lexicon")
    places = Y.located(facts.filter("surface <> 'invoice'")).unionByName(Y.located_in_invoice(facts.filter("surface = 'invoice'"), words).withColumns({"separator": F.lit(" "), "suffix": F.lit("")}))
    styles = written(Y.mined(written(places, "places")), "styles")
    # a path and its labels settle order and spellings, so each different set is planned once; rows bring their values to the plan
    kind = F.struct("classpath", F.transform("attributes", lambda a: F.lower(a["label"])).alias("labels"))
    each = rows.select(kind.alias("kind")).distinct().select("kind", "kind.classpath", F.posexplode("kind.labels").alias("slot", "label_key")).withColumn("surface", F.explode(F.array(*map(F.lit, Y.SURFACES))))
    plan = written(Y.planned(each, styles, Y.average(styles), "kind"), "plan")
    values = F.transform("attributes", lambda a: F.trim(F.concat_ws(" ", a["value"], F.nullif(a["uom"], F.lit("")))))
    # lines of a part mostly say the same: texts are built once for each different record, and rows fetch theirs
    content = ["classpath", "attributes", "brand", "manufacturer", "product_name", "mpn", "description"]
    records = written(R.condensed(o, *content), "records").select(*content, F.col("product_name").alias("item_type"), F.lit("").alias("series"), F.lit("").alias("with_clause"), F.lit("").alias("additional"), F.col("description").alias("raw_description"), kind.alias("kind"), values.alias("_values"))
    records = records.join(plan, "kind", "left")
    records = records.withColumns({f"_{x}": Y.segments_of(F.col("plan"), x, F.col("_values"), F.col("mpn")) for x in Y.SURFACES})
    texts = written(Y.described(records, content), "texts").withColumnsRenamed({c: f"_{c}" for c in content})
    return o.join(texts.hint("merge"), [o[c].eqNullSafe(texts[f"_{c}"]) for c in content]).select("row_id", "long_desc", "short_desc", "retail_desc", "mobile_desc", "invoice_desc")


def _classify(s, d):
    train, held = S.split(stored(s, d))
    # written down, as the condition that a text has grams is else worked out for each row, and so that all steps see the same row of a text
    sample = written(train.dropDuplicates(["description"]).select("row_id", F.col("description").alias("text")), "texts")
    index = retrieval.Index(sample).stored()
    out = S.classify(held.select("row_id", "dept", "class", "fine", "description"), R.fit(train).stored("triples", "names"), index, train)
    return out.select("row_id", "classpath", "classpath_confidence", F.element_at(F.split("classpath_provenance", ":"), 1).alias("family"))


def _overall(s, d):
    o = _t("orders")(s, d)
    confidence = F.map_filter(F.create_map(F.lit("classpath"), F.lit(0.9), F.lit("brand_name"), F.lit(0.8), F.lit("attributes"), F.when(F.col("o_orderkey") % 2 == 0, 0.5)), lambda k, v: v.isNotNull())
    found = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("missing X"), F.lit("a outside b"))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", S.overall(confidence, found).alias("x")).select("o_orderkey", "x.overall", "x.needs_review")


_OVERALL = "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (0.9::DOUBLE * 0.25 + 0.8::DOUBLE * 0.2 + 0.5::DOUBLE * 0.25) / 0.7 ELSE (0.9::DOUBLE * 0.25 + 0.8::DOUBLE * 0.2) / 0.45 END * CASE WHEN o_orderkey % 3 = 0 THEN 0.84::DOUBLE ELSE 1.0::DOUBLE END AS s FROM orders) SELECT o_orderkey, round_even(s, 3) AS overall, s < 0.65 AS needs_review FROM x"


def _queue(s, d):
    o = _t("orders")(s, d)
    records = o.select(F.col("o_orderkey").cast("string").alias("part_number"), (F.col("o_totalprice") > 100_000).alias("needs_review"), F.bround(F.col("o_totalprice"), 2).alias("confidence"), F.col("o_orderstatus").alias("status"))
    return S.review_queue(records, "F", 500)


def _json(s, d):
    return _t("events")(s, d).select("event_id", F.to_json(T.tolerant_json(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), _PROPS)).alias("out"), F.to_json(T.tolerant_json(F.concat(F.lit("The answer: "), "props", F.lit(" as asked")), _PROPS)).alias("found")).select("event_id", (F.col("out") == F.col("found")).alias("same"), F.col("out").isNull().alias("empty"))


def _raw(s, d):
    p = _t("part")(s, d)
    c = {"PART_NUMBER": F.col("p_partkey").cast("string"), "Dept": F.col("p_type"), "Class": F.col("p_brand"), "Fine": F.lit("--"), "SKU - MY_PART_NUMBER": F.lit(" n/a "), "Mfg_Part_Num": F.concat(F.lit(" "), "p_name"), "Part_Desc": F.concat("p_name", F.lit(" - Display Only")), "E1_Brand": F.lit("-- Unbranded --"), "Unilog_Brand": F.col("p_brand"), "DIB_Brand": F.lit("-"), "Part_Manuf": F.lit("Acme")}
    rows = p.select(F.col("p_partkey").alias("_row_id"), *[v.alias(k) for k, v in c.items()])
    out = T.raw_records(rows)
    return out.select("part_number", "fine", "sku", "mpn", "description", F.array_join("hints", ",").alias("hints"), F.col("source_row")["Fine"].alias("echo"))


QUERIES = {
    "o008_log_replay": (_log_lines, "WITH l AS (SELECT * FROM events WHERE event_id % 5 <> 0) SELECT 'u' || user_id AS part_number, 'approved' AS status, arg_max(event_type, event_id) AS notes FROM l GROUP BY ALL"),
    "o019_cache_key": (lambda s, d: _t("documents")(s, d).select("doc_id", T.cache_key(F.col("text"), F.lit("{}"), F.col("lang")).alias("key")), "SELECT doc_id, substr(sha256(lang || chr(0) || text || chr(0) || '{}'), 1, 40) AS key FROM documents"),
    "o020_tolerant_json": (_json, "SELECT event_id, true AS same, false AS empty FROM events"),
    "o085_review_queue": (_queue, "SELECT CAST(o_orderkey AS VARCHAR) AS part_number, o_totalprice > 100000 AS needs_review, round_even(o_totalprice, 2) AS confidence, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY needs_review DESC, confidence, part_number LIMIT 200"),
    "o086_page": (lambda s, d: S.page(_t("orders")(s, d).select("o_orderkey", "o_orderstatus"), 30, 25, "o_orderkey"), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 30"),
    "o098_supported": (_supported, _SUPPORTED),
    "o099_labelled": (_labelled, f"WITH {_BUNDLE} SELECT conv_id AS part_number, 'role' AS label, arg_min(role, place) AS value, arg_min(url, place) AS url FROM b GROUP BY 1"),
    "o103_overlay": (_overlay, _OVERLAY),
    "o125_evidence_order": (lambda s, d: _bundle(s, d).select("part_number", "url", "place"), f"WITH {_BUNDLE} SELECT conv_id AS part_number, url, place FROM b"),
    "o126_best_page": (lambda s, d: E.best_page(_bundle(s, d)), f"WITH {_BUNDLE} SELECT conv_id AS part_number, url FROM b WHERE role <> 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3 <> 0, turn % 2 <> 0, length(text) DESC, place) = 1"),
    "o127_merged_tables": (lambda s, d: E.merged_tables(_bundle(s, d)), f"WITH {_BUNDLE} SELECT conv_id AS part_number, 'Role' AS label, arg_min(role, place) AS value, arg_min(url, place) AS url FROM b GROUP BY 1"),
    "o128_url_ranking": (lambda s, d: E.ranked_urls(_t("pages")(s, d).select(F.expr("substring_index(url, '/', 3)").alias("key"), "url", F.col("page_id").alias("at"), F.lit("n/12").alias("mpn"))).select("key", "url", "at", "rank"), "WITH p AS (SELECT array_to_string(string_split(url, '/')[1:3], '/') AS key, url, page_id FROM pages) SELECT key, url, page_id AS at, row_number() OVER (PARTITION BY key ORDER BY NOT contains(regexp_replace(lower(url), '[^a-z0-9]+', '', 'g'), 'n12'), regexp_matches(lower(url), 'search|category|collections|/c/|[?&]q='), length(url), page_id) AS rank FROM p"),
    "o129_distinct_urls": (lambda s, d: E.distinct_urls(_t("pages")(s, d).select((F.col("page_id") % 7).alias("key"), F.expr("substring_index(url, '/', 3)").alias("url"), F.col("page_id").alias("at")), 6), "WITH f AS (SELECT page_id % 7 AS key, array_to_string(string_split(url, '/')[1:3], '/') AS url, min(page_id) AS at FROM pages GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at) AS rank FROM f) SELECT * FROM r WHERE rank <= 6".replace("AS at FROM pages", "AS \"at\" FROM pages").replace("ORDER BY at", "ORDER BY \"at\"")),
    "o134_raw_records": (_raw, "SELECT CAST(p_partkey AS VARCHAR) AS part_number, '' AS fine, '' AS sku, p_name AS mpn, p_name AS description, p_brand AS hints, '--' AS echo FROM part"),
    "o139_record_urls": (lambda s, d: E.record_urls(_bundle(s, d)).select("part_number", F.coalesce("mfr_url", F.lit("")).alias("mfr_url"), F.size("ref_urls").alias("refs"), "research_confidence"), f"WITH {_BUNDLE}, m AS (SELECT conv_id, url FROM b WHERE role <> 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3 <> 0, turn % 2 <> 0, length(text) DESC, place) = 1), n AS (SELECT conv_id, count(*) AS k, count(*) FILTER (role <> 'user') AS own, count(*) FILTER (role = 'user') AS oth FROM b GROUP BY 1) SELECT n.conv_id AS part_number, coalesce(m.url, '') AS mfr_url, least(5, k - CASE WHEN m.url IS NULL THEN 0 ELSE 1 END) AS refs, round_even(least(1.0::DOUBLE, 0.45::DOUBLE + 0.2::DOUBLE * own + 0.1::DOUBLE * oth), 3) AS research_confidence FROM n LEFT JOIN m USING (conv_id)"),
    "o151_overall_confidence": (_overall, _OVERALL),
    "o156_field_scores": (_fields(False), f"WITH {_FIELDS} SELECT * FROM s"),
    "o156_field_scores_fuzzy": (_fields(True), None),
    "o157_attribute_scores": (_attributes, _ATTRIBUTES),
    "o158_compliance": (lambda s, d: C.score_compliance(_texts(s, d)), _TEXTS),
    "o159_coverage": (lambda s, d: C.score_coverage(*[x.drop("row_id") for x in _scored(s, d)]), "WITH a AS (SELECT sum(2 + (c_custkey % 3 <> 0)::INT)::BIGINT AS o FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT 3 * count(*) AS t FROM customer) SELECT o AS cells_filled, t AS truth_cells_filled, round_even(o / t, 3) AS fill_ratio_vs_truth FROM a, b"),
    "o160_sourcing": (lambda s, d: C.score_sourcing(_records(s, d)), _SOURCING),
    "o160_documents_by_kind": (lambda s, d: C.documents_by_kind(_records(s, d)), "SELECT CASE l_returnflag WHEN 'A' THEN 'manual' WHEN 'R' THEN 'editorial' ELSE 'specification' END AS kind, count(*) AS documents FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY 1"),
    "o161_headline": (lambda s, d: C.headline(_fields(False)(s, d)), f"WITH {_FIELDS} SELECT round_even(avg(exact_match), 3) AS mean_exact_match, round_even(avg(fuzzy_match), 3) AS mean_fuzzy_match FROM s"),
    "o162_run_summary": (lambda s, d: C.run_summary(_t("orders")(s, d).select((F.col("o_orderstatus") == "F").alias("needs_review"), (F.col("o_orderkey") % 100 / 100).alias("confidence"))), "SELECT count(*) AS records, count(*) FILTER (o_orderstatus = 'F') AS needs_review, round_even(count(*) FILTER (o_orderstatus = 'F') / count(*), 3) AS review_rate, round_even(avg((o_orderkey % 100) / 100), 3) AS mean_confidence FROM orders"),
    "o163_cost": (_cost, _COST),
    "o164_call_counters": (lambda s, d: C.call_counters(_t("events")(s, d), "event_type", F.col("value") < 5, F.col("user_id") % 2 == 0), "SELECT event_type, count(*) AS calls, count(*) FILTER (user_id % 2 = 0) AS cache_hits, count(*) FILTER (user_id % 2 <> 0) AS live_calls, count(*) FILTER (value < 5) AS failures FROM events GROUP BY 1"),
    "o165_decision_summary": (lambda s, d: D.summary(D.latest(_log(s, d)).withColumn("attributes", F.array().cast("array<string>"))), f"WITH {_LOG} SELECT count(*) AS decided, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'corrected') AS corrected, count(*) AS fields_changed, 0 AS attributes_changed FROM w"),
    "o166_by_family": (lambda s, d: C.by_family(_t("orders")(s, d).select(F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("provenance"), (F.col("o_custkey") % 2 == 0).alias("correct"))), "SELECT o_orderpriority AS family, count(*) AS rows, count(*) FILTER (o_custkey % 2 = 0) AS correct, round_even(count(*) FILTER (o_custkey % 2 = 0) / count(*), 3) AS accuracy FROM orders GROUP BY 1"),
    "o167_coverage_gaps": (lambda s, d: C.coverage_gaps(*_scored(s, d), "PART_NUMBER", ["BRAND_NAME", "Classpath"]), "SELECT 'BRAND_NAME' AS field, count(*) AS missing FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 = 0"),
    "o168_population": (lambda s, d: C.population(*_scored(s, d), ["BRAND_NAME", "Classpath"], ["Classpath"]), "SELECT 'BRAND_NAME' AS column, count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 3 <> 0) AS ours, count(*) AS theirs, 'populated' AS class FROM customer UNION ALL SELECT 'Classpath', count(*) FILTER (c_custkey % 7 <> 0), count(*), 'populated' FROM customer".replace("AS column", 'AS "column"')),
    "o169_word_diff": (lambda s, d: _t("part")(s, d).select("p_partkey", F.size(F.filter(C.word_diff(F.col("p_name"), F.concat_ws(" ", F.lit("LARGE"), F.upper(F.substring_index("p_name", " ", 1)))), lambda x: x["shared"])).alias("shared")), "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: x IN ('large', lower(string_split(p_name, ' ')[1])))) AS shared FROM part"),
    "o170_projection": (lambda s, d: C.projected(0.05, 0.0001, [1_000, 50_000, 1_000_000], prepare(s)), "SELECT * FROM (VALUES (1000::BIGINT, 50.0::DOUBLE, 0.1::DOUBLE), (50000, 2500.0, 5.0), (1000000, 50000.0, 100.0)) AS t(rows, seconds, cost)"),
    "o171_bands": (lambda s, d: _t("orders")(s, d).groupBy(C.band(F.col("o_orderkey") % 100 / 100).alias("band")).agg(F.count("*").alias("n")), "SELECT CASE WHEN o_orderkey % 100 >= 85 THEN 'high' WHEN o_orderkey % 100 >= 65 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1"),
    "o172_two_folds": (lambda s, d: C.two_folds(*[_fields(False)(s, d).select("field", "compared")] * 2), f"WITH {_FIELDS} SELECT field, compared AS compared_holdout, compared AS compared_all FROM s"),
    "o177_recordable": (lambda s, d: D.recordable(_log(s, d).withColumns({"fields": F.create_map(F.lit("secret"), F.col("status"), F.when(F.col("at") % 2 == 0, "series").otherwise("other"), F.lit("v")), "attributes": F.array(F.struct(F.lit(" ").alias("label"), F.lit("v").alias("value"), F.lit("").alias("uom"))), "extras": F.create_map().cast(_PROPS)})).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("fields")).alias("fields")), f"WITH {_LOG} SELECT status, count(*) AS n, count(*) FILTER (pos % 2 = 0) AS fields FROM l WHERE status = 'approved' OR pos % 2 = 0 GROUP BY 1"),
    "o188_status": (lambda s, d: D.status(_t("customer")(s, d).select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("part_number")), D.latest(_log(s, d))), f"WITH {_LOG} SELECT 'u' || c_custkey AS part_number, coalesce(w.status, 'pending') AS status FROM customer LEFT JOIN w ON w.part_number = 'u' || c_custkey"),
    "o064_parsed_pages": (_pages, None),
    "o137_gather": (_gather, None),
    "o117_mined_style": (_mined, None),
    "o146_descriptions": (_descriptions, None),
    "o135_classify": (_classify, None),
}
