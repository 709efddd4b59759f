"""Queries of sources and sinks, page parts, the driver, views, extras and the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions import fixed_values as V
from catalith.functions import similarity as M
from catalith.functions import text as X
from catalith.operators import chain as H
from catalith.operators import decisions as D
from catalith.operators import driver as R
from catalith.operators import evidence as E
from catalith.operators import extras as A
from catalith.operators import registry as G
from catalith.operators import resolve as J
from catalith.operators import retrieval
from catalith.operators import score as C
from catalith.operators import stages as S
from catalith.operators import style as Y
from catalith.plans.proxy import OBS, observations, stored
from catalith.plans.registry_queries import _MELT, _VOTES, FOLD
from catalith.plans.stage_queries import _BUNDLE, _LOG, _bundle, _log, _scored, _style_rows
from catalith.session import prepare, shared_path, spread, table, written
from catalith.sources import tables as T


def _t(name):
    return lambda s, d: table(prepare(s), d, name)


_folder = shared_path

# -- sources and sinks: what is written is read again -------------------------------------------------------------------------------------


def _raw(s, d):
    """Parts as raw input, with symbols to repair, placeholders and nulls."""
    p = _t("part")(s, d)
    c = {"PART_NUMBER": F.col("p_partkey").cast("string"), "Dept": F.concat("p_type", F.lit("Â®")), "Class": F.col("p_brand"), "Fine": F.lit("--"), "SKU - MY_PART_NUMBER": F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")), "Mfg_Part_Num": F.col("p_name"), "Part_Desc": F.concat("p_name", F.lit(" - Display Only")), "E1_Brand": F.lit("-"), "Unilog_Brand": F.col("p_brand"), "DIB_Brand": F.lit("-"), "Part_Manuf": F.lit("Acme")}
    return p.select(*[v.alias(k) for k, v in c.items()])


_RAWS = "r AS (SELECT CAST(p_partkey AS VARCHAR) AS part_number, p_type || '®' AS dept, p_brand AS class, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS sku, p_name AS mpn FROM part)"


def _scan(s, d):
    path = _folder(s, "scan")
    _raw(s, d).write.parquet(path)
    out = T.scan(s, path, V.INPUT_COLUMNS, "parquet")
    return out.select(F.col("PART_NUMBER").alias("part_number"), F.col("Dept").alias("dept"), F.col("Class").alias("class"), F.col("`SKU - MY_PART_NUMBER`").alias("sku"), F.col("Mfg_Part_Num").alias("mpn"))


def _loaded(s, d):
    path = _folder(s, "loaded")
    rows = _raw(s, d)
    rows.write.option("header", True).csv(path)
    inputs = T.scan(s, path, V.INPUT_COLUMNS)
    return inputs.agg(F.count("*").alias("rows"), F.count("Dept").alias("depts"), F.count("SKU - MY_PART_NUMBER").alias("skus"))


def _uploaded(s, d):
    path = _folder(s, "upload")
    _raw(s, d).write.option("header", True).csv(path)
    out = T.upload(s, path)
    return out.select(F.col("PART_NUMBER").alias("part_number"), F.col("`SKU - MY_PART_NUMBER`").alias("sku"), F.col("Fine").alias("fine"))


def _fingerprints(s, d):
    """One fingerprint of size and time for each file; the file is the table's own, so its size is known to no SQL."""
    return T.fingerprint(_t("part")(s, d)).select(F.length("path").alias("path_length"), F.size(F.split("fingerprint", ":")).alias("parts"))


def _appended(s, d):
    path = _folder(s, "log")
    log = _log(s, d).withColumns({"decided_at": F.lit("t"), "attributes": F.array().cast("array<struct<label:string,value:string,uom:string>>"), "extras": F.create_map().cast("map<string,string>"), "notes": F.col("at").cast("string")}).drop("at")
    D.append(log.filter("part_number < 'u5'"), path)
    D.append(log.filter("part_number >= 'u5'"), path)
    # append order is the file's; the note that carries the event's number gives back the order in which events happened
    back = D.read_log(s, path).withColumn("at", F.col("notes").cast("long"))
    return D.latest(back).select("part_number", "status", F.col("fields")["series"].alias("series"))


def _snapshot(s, d):
    path, fitted = _folder(s, "registry"), G.fit(stored(s, d))
    fitted.save(path)
    return G.Registry.load(s, path).triples.select("dept", "class", "fine", "classpath", "n")


def _metrics(s, d):
    path = _folder(s, "metrics")
    T.snapshot(_t("events")(s, d).groupBy("event_type").agg(F.count("*").alias("calls")), ["event_type"], path)
    return T.read_metrics(s, path, F.col("calls") * 2).select("event_type", "calls", "cost")


def _payloads(s, d):
    path = _folder(s, "payload")
    T.snapshot(G.brand_makers(observations(s, d)), ["brand"], path)
    return s.read.json(path).select("brand", "manufacturer")


def _cached(s, d):
    docs = _t("documents")(s, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(T.CACHE_VERSION).alias("version"), F.repeat(F.coalesce("text", F.lit("")), 400).alias("text"), F.array_repeat(F.lit("l"), 70).alias("links"))
    return T.cached_documents(docs).select("doc_id", F.length("text").alias("size"), F.size("links").alias("links"))


def _robots(s, d):
    urls = _t("pages")(s, d).select("page_id", F.expr("substring_index(substring_index(url, '/', 3), '/', -1)").alias("host"))
    rules = urls.select("host").distinct().filter("host like 'b%'").withColumn("allowed", F.lit(False))
    return T.robots(urls, rules).select("page_id", "allowed")


def _answers(s, d):
    prompts = _t("documents")(s, d).select("doc_id", T.cache_key(F.col("lang"), F.lit("{}"), F.lit("m")).alias("prompt_hash"))
    known = s.createDataFrame([("en", '{"a": 1}'), ("fr", "{}")], "lang string, payload string").select(T.cache_key(F.col("lang"), F.lit("{}"), F.lit("m")).alias("prompt_hash"), "payload")
    path = _folder(s, "responses")
    known.write.parquet(path)
    return T.answered(prompts, s.read.parquet(path)).select("doc_id", "payload")


def _echoed(s, d):
    p = _raw(s, d).withColumn("_row_id", F.col("PART_NUMBER").cast("long"))
    raw = T.raw_records(p).withColumns({"extras": F.create_map(F.lit("Dept"), F.lit("made up"), F.lit("MFR URL"), F.lit("u")), "attributes": F.array().cast("array<struct<label:string,value:string,uom:string>>"), "features": F.array().cast("array<string>")})
    out = T.delivery(raw, ["MFR URL", *V.INPUT_COLUMNS])
    return out.select(F.col("MFR URL").alias("url"), F.col("PART_NUMBER").alias("part_number"), F.col("Dept").alias("dept"), F.col("Fine").alias("fine"), F.col("`SKU - MY_PART_NUMBER`").alias("sku"), F.col("Part_Desc").alias("description"))


# -- page parts -----------------------------------------------------------------------------------------------------------------------------

_PAGE = "<table><tr><th>Weight:</th><td>", "</td></tr><tr><td>Weight</td><td>none</td></tr><tr><td>Share</td><td>x</td></tr></table><div class='spec-row'><b>Finish</b><i>", "</i></div>"


def _made_pages(s, d):
    """Parts as pages: a table, a telling node, two links to one PDF file and a JSON-LD product."""
    p = spread(_t("part")(s, d), "p_partkey")
    product = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.lit("036000291453").alias("gtin12"), F.array(F.struct(F.lit("Size:").alias("name"), F.col("p_size").alias("value"))).alias("additionalProperty")))
    links = F.concat(F.lit("<a href='/d/"), F.col("p_partkey").cast("string"), F.lit(".PDF#p2'>Spec <b>sheet</b></a><a href='/d/"), F.col("p_partkey").cast("string"), F.lit(".PDF'>again</a><a href='mailto:a.pdf'>m</a>"))
    html = F.concat(F.lit(_PAGE[0]), "p_type", F.lit(_PAGE[1]), "p_brand", F.lit(_PAGE[2]), links, F.lit('<script type="application/ld+json">'), product, F.lit("</script>"))
    return p.select(F.col("p_partkey").alias("page_id"), html.alias("html"), F.lit("https://a.com/p/").alias("url"))


def _ld(s, d):
    out = E.product_fields(_made_pages(s, d))
    return out.select("page_id", F.col("fields")["name"].alias("name"), F.col("fields")["brand"].alias("brand"), F.try_element_at("fields", F.lit("upc")).alias("upc"), F.array_join(F.transform("pairs", lambda p: F.concat_ws("=", p["label"], p["value"])), ",").alias("pairs"))


def _pairs(s, d):
    out = E.documents(_made_pages(s, d))
    return out.select("page_id", F.array_join(F.transform("tables", lambda p: F.concat_ws("=", p["label"], p["value"])), ",").alias("pairs"))


def _links(s, d):
    return E.documents(_made_pages(s, d)).select("page_id", F.explode("links").alias("l")).select("page_id", "l.url", "l.anchor")


# -- similarity: every scorer beside the plain expression of what it must be on these pairs ----------------------------------------------------


def _scores(s, d):
    """A name against its words in reverse order, and against itself with a word more."""
    p = _t("part")(s, d).select("p_partkey", F.col("p_name").alias("a"), F.array_join(F.reverse(F.split("p_name", " ")), " ").alias("b"), F.concat("p_name", F.lit(" zz")).alias("c"))
    r = lambda x: F.bround(x, 6)
    return p.select("p_partkey", r(M.token_sort_column(F.col("a"), F.col("b"))).alias("sorted"), r(M.token_set_column(F.col("a"), F.col("c"))).alias("held"), r(M.ratio_column(F.col("a"), F.col("c"))).alias("longer"), r(M.weighted_column(F.col("a"), F.col("a"))).alias("same"), r(M.weighted_column(F.col("a"), F.lit(""))).alias("empty"))


def _choice(s, d):
    """Brands with a small first letter among all of them."""
    p = _t("part")(s, d)
    return p.select("p_partkey", M.best_choice(F.lower("p_brand"), [f"Brand#{i}" for i in range(1, 56)], M.ratio).alias("b")).select("p_partkey", "b.choice", F.bround("b.score", 6).alias("score"))


def _matched(s, d):
    """Names that begin with a known one, and names that differ from one by a letter."""
    names = _t("supplier")(s, d).select(F.lower("s_name").alias("key"))
    asked = names.select(F.concat("key", F.lit(" supplies")).alias("key")).unionByName(names.select(F.concat(F.lit("x"), "key").alias("key")))
    return J.safe_match(asked, names)


# -- style ---------------------------------------------------------------------------------------------------------------------------------------


def _spelled(s, d):
    return _t("part")(s, d).select("p_type").distinct().select("p_type", Y.spellings(F.col("p_type")).alias("x")).select("p_type", F.element_at("x", 1).alias("first"), F.element_at("x", -1).alias("last"), F.element_at("x", -2).alias("initials"), F.size(F.array_distinct("x")).alias("n") == F.size("x")).toDF("p_type", "first", "last", "initials", "once")


def _facts(s, d, surfaces=Y.SURFACES):
    return Y.row_facts(_style_rows(s, d), surfaces)


def _located(s, d):
    # texts and what is said in them repeat: each different row is looked at once, and counts as often as it occurs
    rows = written(G.condensed(_style_rows(s, d).withColumn("classpath", F.lit("")), "classpath", "attributes", "long"), "condensed")
    found = Y.located(written(Y.row_facts(rows, ["long"]), "facts"))
    return found.groupBy("label", F.col("at").isNotNull().alias("found")).agg(F.sum(G.TIMES).alias("n"))


def _in_invoice(s, d):
    rows = _style_rows(s, d)
    facts = _facts(s, d, ["invoice"]).filter("label = 'Size'")
    out = Y.located_in_invoice(facts, Y.lexicon(Y.abbreviations(rows.select("row_id", "invoice", F.split("product_name", " ").alias("words")))))
    return out.select("row_id", "at")


def _styled(s, d):
    """Types as paths; only those of odd length have a style of their own."""
    p = _t("part")(s, d).select("p_type", "p_brand").distinct()
    made = p.select(F.col("p_type").alias("classpath"), F.lit("long").alias("surface"), F.lower("p_brand").alias("label_key"), F.lit(" ").alias("separator"), F.lit("Kit").alias("suffix"), F.lit(0.9).alias("inclusion"), F.lit(1.0).alias("rank"), F.lit(2).alias("rows"))
    own = made.filter("length(classpath) % 2 = 1")
    want = p.select(F.concat_ws("/", "p_type", "p_brand").alias("key"), F.col("p_type").alias("classpath"), F.lit("long").alias("surface"), F.lower("p_brand").alias("label_key"), F.lit(0).alias("slot"))
    rest = made.select("surface", "label_key", "separator", F.lit("Set").alias("suffix"), "inclusion", "rank").distinct()
    return Y.styled(want, own, rest).select("key", "specific", F.col("style.suffix").alias("suffix"))


def _bodies(s, d):
    o = _t("orders")(s, d)
    style = F.struct(F.lit("-").alias("separator"), F.when(F.col("slot") == 1, "Kit").alias("suffix"))
    values = F.array("o_orderstatus", "o_orderpriority", F.lit("12"), "o_orderstatus")
    rows = o.select(F.col("o_orderkey").alias("row_id"), F.lit("long").alias("surface"), F.col("o_orderstatus").alias("mpn"), F.posexplode(values).alias("slot", "value")).withColumn("position", -F.col("slot").cast("double")).withColumn("style", style)
    return Y.bodies(rows).select("row_id", F.array_join("segments", ", ").alias("segments"))


def _mobile(s, d):
    p = _t("part")(s, d)
    r = p.select("p_partkey", F.col("p_brand").alias("manufacturer"), F.lit("Acme").alias("brand"), F.lit("Cover").alias("item_type"), F.lit("").alias("series"), F.col("p_partkey").cast("string").alias("mpn"), F.col("p_name").alias("raw_description"), F.array("p_type", F.lit("x" * 60)).alias("_mobile"), F.array("p_name").alias("_long"))
    return Y.with_mobile_line(r).select("p_partkey", "mobile_desc")


_MOBILE = """
    WITH m AS (SELECT p_partkey, p_brand || ' Acme, Cover, ' || p_partkey AS h, p_type, p_name FROM part),
    a AS (SELECT *, h || ', ' || p_type AS t1 FROM m),
    b AS (SELECT *, CASE WHEN length(t1) >= 60 OR contains(t1, p_name) THEN t1 WHEN length(t1 || ', ' || p_name) <= 80 THEN t1 || ', ' || p_name ELSE t1 END AS t2 FROM a),
    c AS (SELECT *, t2 || ', ' || p_name AS w FROM b),
    e AS (SELECT *, CASE WHEN length(w) <= 80 THEN w ELSE regexp_replace(regexp_replace(w[1:80], ' [^ ]*$', ''), '[ ,;:\\-|/]+$', '') END AS cut FROM c)
    SELECT p_partkey, CASE WHEN length(t2) < 60 AND NOT contains(t2, p_name) AND length(cut) > length(t2) THEN cut ELSE t2 END AS mobile_desc FROM e"""

# -- driver, views, extras -----------------------------------------------------------------------------------------------------------------------


def _driven(s, d):
    """Three stages over orders: the first fails for every seventh row, the second cannot be planned, the third is told what the first left."""
    o = _t("orders")(s, d).select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("state"), F.array().cast("array<string>").alias("issues"), F.lit(False).alias("needs_review"))
    first = lambda r: r.withColumn("state", F.lit("changed")).withColumn("added", F.lit(1)).withColumn("failed", F.when(F.col("row_id") % 7 == 0, "ValueError"))
    broken = lambda r: r.select("row_id", "no_such_column")
    last = lambda r: r.withColumn("seen", F.concat_ws("/", "state", F.col("added").cast("string")))
    return R.run(o, [("one", first), ("two", broken), ("three", last)])


def _failures(s, d):
    return R.failures(_driven(s, d))


def _usage(s, d):
    e = _t("events")(s, d)
    counted = lambda rows: rows.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.sum((F.col("user_id") % 2).cast("long")).alias("cache_hits"), F.sum(1 - (F.col("user_id") % 2).cast("long")).alias("live_calls"), F.sum((F.col("value") < 5).cast("long")).alias("failures"), F.sum(F.col("event_id")).alias("total_tokens"))
    return R.usage_delta(counted(e.filter("event_id % 4 = 0 and event_type <> 'click'")), counted(e.filter("event_id % 4 < 2")))


_USAGE = "WITH e AS (SELECT event_type AS model, CASE WHEN event_id % 4 = 0 AND event_type <> 'click' THEN 0 ELSE 1 END AS k, * FROM events WHERE event_id % 4 < 2) SELECT model, sum(k)::BIGINT AS calls, sum(k * (user_id % 2))::BIGINT AS cache_hits, sum(k * (1 - user_id % 2))::BIGINT AS live_calls, sum(k * (value < 5)::INT)::BIGINT AS failures, sum(k * event_id)::BIGINT AS total_tokens FROM e GROUP BY model HAVING sum(k) > 0"


def _payload(s, d):
    o = observations(s, d).withColumnsRenamed({"brand": "brand_name", "manufacturer": "manufacturer_name", "description": "raw_description", "hints": "brand_hints"})
    return R.payload(o).select("part_number", F.col("input.description").alias("description"), F.array_join("input.brand_hints", ",").alias("hints"), F.col("output.brand_name").alias("brand"), F.col("output.series").alias("series"), F.size("attributes").alias("attributes"), "research_note")


def _truth(s, d):
    o = observations(s, d)
    return R.truth(o.select("row_id", F.col("dept").alias("PART_NUMBER"), F.col("brand").alias("BRAND_NAME"), F.col("classpath").alias("Classpath"), F.when(F.col("fine") == "7", F.col("fine")).alias("UPC"))).select(F.col("PART_NUMBER").alias("part_number"), F.col("BRAND_NAME").alias("brand"), F.col("Classpath").alias("classpath"), F.col("UPC").alias("upc"))


def _probe(s, d):
    train, held = S.split(stored(s, d))
    return R.coverage_probe(held.select("row_id", "dept", "class", "fine", "supplier", "hints", "mpn", "description"), G.fit(train).stored("triples", "templates", "leaves", *J.RESOLVES_BY))


#: Of the held-out rows: those whose department the fit knows; the brands that hints, which are departments here, or suppliers give them.
_PROBE = f"WITH {OBS}, t AS (SELECT * FROM obs WHERE NOT {FOLD.format('part_number')}), h AS (SELECT * FROM obs WHERE {FOLD.format('part_number')}) SELECT count(*) AS rows, count(*) FILTER (lower(dept) IN (SELECT lower(dept) FROM t)) AS with_candidates, count(*) FILTER (lower(dept) IN (SELECT lower(dept) FROM t)) AS with_template, count(*) FILTER (lower(dept) IN (SELECT lower(dept) FROM t) OR supplier IN (SELECT supplier FROM t)) AS with_brand FROM h"


def _searched(s, d):
    p = _t("pages")(s, d)
    return p.select((F.col("page_id") % 11).alias("query"), "url", F.col("page_id").alias("at"))


def _permitted(s, d):
    found = _searched(s, d)
    rules = found.select("query").distinct().withColumn("permitted", F.when(F.col("query") % 2 == 0, F.array(F.lit("example.com"))).otherwise(F.array(F.lit("example.org"), F.lit("example.com"))))
    return R.permitted_search(found, rules, ["blocked.com"], [])


_SITE = "regexp_extract(url, '://([^/?#:]*)', 1)"
_DOMAIN = f"array_to_string(string_split({_SITE}, '.')[-2:], '.')"
_PERMITTED = f"WITH f AS (SELECT page_id % 11 AS query, url, min(page_id) AS seen FROM pages WHERE url LIKE 'http%' AND ({_DOMAIN} = 'example.com' OR (page_id % 11 % 2 = 1 AND {_DOMAIN} = 'example.org')) GROUP BY ALL), r AS (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY seen, url) AS rank FROM f) SELECT * FROM r WHERE rank <= 6"


def _third(s, d):
    return R.third_party_search(_searched(s, d), ["example.net"], ["example.com"], ["example.org"], 3)


_THIRD = f"WITH f AS (SELECT page_id % 11 AS query, url, min(page_id) AS seen FROM pages WHERE url LIKE 'http%' AND {_DOMAIN} = 'example.net' GROUP BY ALL), r AS (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY seen, url) AS rank FROM f) SELECT * FROM r WHERE rank <= 3"


def _ready(s, d):
    train, held = S.split(observations(s, d))
    out = R.readiness(G.fit(observations(s, d)), {"train": train, "holdout": held}, D.latest(_log(s, d)))
    return out.filter("part <> 'registry' or name in ('triples', 'leaves', 'brands', 'makers')")


_READY = f"WITH {OBS}, {_VOTES}, {_LOG}, t AS (SELECT DISTINCT lower(dept), lower(class), lower(fine), classpath FROM obs) SELECT 'registry' AS part, 'triples' AS name, count(*) AS n FROM t UNION ALL SELECT 'registry', 'leaves', count(DISTINCT trim(string_split(classpath, '>')[-1])) FROM obs UNION ALL SELECT 'registry', 'brands', count(DISTINCT key) FROM c UNION ALL SELECT 'registry', 'makers', count(DISTINCT brand) FROM obs UNION ALL SELECT 'fold', CASE WHEN {FOLD.format('part_number')} THEN 'holdout' ELSE 'train' END, count(*) FROM obs GROUP BY ALL UNION ALL SELECT 'decisions', status, count(*) FROM w GROUP BY ALL UNION ALL SELECT 'stages', 'stages', 8"


def _views(s, d):
    return R.knowledge(G.fit(observations(s, d))).filter("view in ('classpaths', 'templates', 'brands', 'approvals')")


_VIEWS = f"WITH {OBS} SELECT DISTINCT 'classpaths' AS view, classpath AS key, '' AS value FROM obs UNION ALL SELECT DISTINCT 'templates', classpath, 'Flag, Status, Size' FROM obs UNION ALL SELECT 'brands', brand, arg_min(manufacturer, row_id) FROM obs GROUP BY brand UNION ALL SELECT 'approvals', token, CAST(count(*) AS VARCHAR) FROM (SELECT unnest(string_split(approvals, '|')) AS token FROM obs) GROUP BY token"


def _grammar(s, d):
    p = _t("part")(s, d).select("p_type", "p_brand").distinct()
    styles = p.select(F.col("p_type").alias("classpath"), F.lit("long").alias("surface"), F.col("p_brand").alias("label_key"), F.lit("-").alias("separator"), F.when(F.col("p_brand") > "Brand#3", "Kit").alias("suffix"), F.lit(0.9).alias("inclusion"), F.lit(1.0).alias("rank"), F.lit(4).alias("rows"))
    known = p.filter("p_type like '%S%'").select(F.col("p_type").alias("classpath")).distinct().withColumn("labels", F.array(F.lit("x")))
    return R.style_view(styles, known)


def _vocabularies(s, d):
    o = observations(s, d)
    return R.samples(G.value_counts(G.melted(o.withColumn("classpath", F.col("dept"))))).select("classpath", "label_key", F.array_join("values", ",").alias("values"))


_VOCABULARIES = f"WITH {OBS}, {_MELT.replace('SELECT row_id, classpath,', 'SELECT row_id, dept AS classpath,')}, c AS (SELECT classpath, label_key, value, count(*) AS n, min(row_id) AS first FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY classpath, label_key ORDER BY n DESC, first) AS rn, count(*) OVER (PARTITION BY classpath, label_key) AS kinds FROM c) SELECT classpath, label_key, string_agg(value, ',' ORDER BY rn) AS values FROM r WHERE kinds >= 3 AND rn <= 6 GROUP BY ALL"


def _absorbed(s, d):
    """Answers over all observations: a series from the model or from the attribute, with-clauses with and without their `With`, 30 features, approvals by case and by a slip."""
    o = stored(s, d, once=True)
    rows = o.select("row_id", F.col("dept").alias("classpath"), F.when(F.col("row_id") % 5 == 0, "Own Line").otherwise("").alias("series"), F.lit("").alias("with_clause"), F.array(F.lit("Z")).alias("approvals"), F.transform(F.col("attributes"), lambda a: F.struct(F.when(a["label"] == "Flag", "Series").otherwise(a["label"]).alias("label"), a["value"].alias("value"), a["uom"].alias("uom"), F.lit(0.5).alias("confidence"), F.lit("llm").alias("source"))).alias("attributes"))
    said = o.select("row_id", F.when(F.col("row_id") % 3 == 0, "Sahara Series").otherwise("n/a").alias("series"), F.when(F.col("row_id") % 2 == 0, "Clean Boost").otherwise("with it").alias("with_clause"), F.concat(F.array(F.lit(" ")), F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("f"), i.cast("string")))).alias("features"), F.array(F.lit("a"), F.lit("UL Listedd"), F.lit("nothing like it")).alias("approvals"))
    known = G.fit(rows.select("row_id", "classpath", F.lit("p").alias("part_number"), F.lit("d").alias("dept"), F.lit("c").alias("class"), F.lit("f").alias("fine"), F.lit("n").alias("product_name"), F.lit("m").alias("manufacturer"), F.lit("b").alias("brand"), F.lit("s").alias("supplier"), F.lit("1").alias("mpn"), F.lit("x").alias("description"), F.lit("A|UL Listed").alias("approvals"), F.array().cast("array<string>").alias("hints"), F.array(F.struct(F.lit("Color").alias("label"), F.lit("Red").alias("value"), F.lit("").alias("uom"))).alias("attributes")))
    out = A.absorb(rows, said, known.stored("approvals", "values"))
    first = F.element_at("attributes", 1)
    return out.select("row_id", "series", "series_confidence", "with_clause", F.size("features").alias("features"), F.array_join("approvals", ",").alias("approvals"), first["value"].alias("value"), first["source"].alias("source"))


_ABSORBED = f"WITH {OBS}, a AS (SELECT DISTINCT row_id, CASE WHEN row_id % 5 = 0 THEN 'Own Line' WHEN row_id % 3 = 0 THEN 'Sahara Series' ELSE '' END AS series FROM obs) SELECT row_id, series, CASE WHEN series = 'Sahara Series' THEN 0.7::DOUBLE END AS series_confidence, CASE WHEN row_id % 2 = 0 THEN 'With Clean Boost' ELSE 'with it' END AS with_clause, 20 AS features, 'A,UL Listed,Z' AS approvals, nullif(series, '') AS value, CASE WHEN series = '' THEN 'rejected' ELSE 'series-agent' END AS source FROM a"


def _specs(s, d):
    o = observations(s, d)
    return A.prompt_spec(G.fit(o.withColumn("classpath", F.col("dept")))).select("classpath", "spec")


_SPECS = f"""
    WITH {OBS}, {_MELT.replace('SELECT row_id, classpath,', 'SELECT row_id, dept AS classpath,')}, c AS (SELECT classpath, label_key, value, count(*) AS n, min(row_id) AS first FROM m GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY classpath, label_key ORDER BY n DESC, first) AS rn, sum(n) OVER (PARTITION BY classpath, label_key) AS total, count(*) OVER (PARTITION BY classpath, label_key) AS kinds FROM c),
    f AS (SELECT *, label_key = 'size' OR total < 3 OR (kinds > 1 AND kinds / total >= 0.9::DOUBLE) AS free FROM r),
    l AS (SELECT classpath, label_key, free, string_agg(value, ', ' ORDER BY rn) FILTER (rn <= CASE WHEN free THEN 4 ELSE 15 END) AS vs FROM f GROUP BY ALL),
    x AS (SELECT classpath, CASE label_key WHEN 'flag' THEN 1 WHEN 'status' THEN 2 ELSE 3 END AS o, '- ' || upper(label_key[1]) || label_key[2:] || CASE label_key WHEN 'status' THEN '  [unit: in]' WHEN 'size' THEN '  [unit: lb]' ELSE '' END || '  [' || CASE WHEN free THEN 'examples' ELSE 'allowed' END || ': ' || vs || ']' AS line FROM l)
    SELECT classpath, string_agg(line, chr(10) ORDER BY o) AS spec FROM x GROUP BY classpath"""


def _prompted(s, d):
    o = observations(s, d)
    record = {c: F.col(c) for c in ("description", "brand", "manufacturer", "mpn", "classpath", "product_name")}
    text = A.prompt(record, F.lit("- Flag"), F.when(F.col("fine") == "7", "page"))
    return o.select("row_id", T.cache_key(text, F.lit("{}"), F.lit("model")).alias("key"), F.length(text).alias("size"))


_Q = lambda x: x.replace("'", "''")
_PROMPTED = f"WITH {OBS}, p AS (SELECT row_id, CASE WHEN fine = '7' THEN '{_Q(V.PROMPT_SOURCE)}' || 'page' || chr(10) || chr(10) ELSE '' END || 'Product: ''' || description || '''' || chr(10) || 'Brand: ' || brand || chr(10) || 'Manufacturer: ' || manufacturer || chr(10) || 'Manufacturer part number: ' || mpn || chr(10) || 'Classpath: ' || classpath || chr(10) || 'Product type: ' || product_name || chr(10) || chr(10) || 'Extract values for these attributes:' || chr(10) || '- Flag' || chr(10) || chr(10) || '{_Q(V.PROMPT_RULES)}' AS t FROM obs) SELECT row_id, substr(sha256('model' || chr(0) || t || chr(0) || '{{}}'), 1, 40) AS key, length(t) AS size FROM p"


def catalogue(s, d):
    """What was learned from a part of the catalogue, the reviewers' decisions, and the raw held-out rows."""
    # read by every registry, the index, the styles and the held-out rows
    rows = written(_style_rows(s, d).dropDuplicates(["row_id"]), "catalogue")
    train, held = S.split(rows)
    folder = _folder(s, "knowledge")
    G.fit(train).save(folder)
    registry = G.Registry.load(s, folder)
    # written down, as a condition on a text is else worked out for each row that has it
    texts = written(train.groupBy("description").agg(F.min("row_id").alias("row_id")).withColumnRenamed("description", "text"), "texts")
    index = retrieval.Index(texts).stored()
    surfaces = [x for x in Y.SURFACES if x != "invoice"]
    facts = written(Y.row_facts(written(G.condensed(train, "classpath", "attributes", *surfaces), "condensed"), surfaces), "facts")
    styles = written(Y.mined(written(Y.located(facts), "located")), "styles")
    assets = train.select("brand").distinct().select("brand", F.lit("https://d.com").alias("domain"), F.lit("Pre").alias("prefix"), F.lit(0.8).alias("image_rate"), F.create_map(F.lit("Catalog"), F.lit(0.9)).alias("rates"))
    decided = held.filter("fine = '7'").groupBy("part_number").agg(F.lit("corrected").alias("status")).withColumns({"fields": F.create_map(F.lit("product_name"), F.lit("seen")), "attributes": F.array().cast("array<struct<label:string,value:string,uom:string>>"), "extras": F.create_map().cast("map<string,string>")})
    known = H.Knowledge(registry, index, train.select("row_id", "classpath", "product_name"), styles, assets)
    raw = held.select("row_id", "part_number", "dept", "class", "fine", "supplier", "hints", "mpn", "description")
    return known, H.Given(decisions=decided), raw


def enriched(s, d):
    """The held-out rows through all eight stages."""
    known, given, raw = catalogue(s, d)
    return R.run(H.started(raw), H.stages(known, given), cut=lambda r, name: written(r, f"stage-{name}"))


def _chain(s, d):
    out = enriched(s, d)
    return out.select("row_id", "part_number", "classpath", "brand_name", "manufacturer_name", "product_name", F.size("attributes").alias("attributes"), "mfr_url", F.size("issues").alias("issues"), "overall", "needs_review")


QUERIES = {
    "o001_scan": (_scan, f"WITH {_RAWS} SELECT * FROM r"),
    "o002_loaded": (_loaded, "SELECT count(*) AS rows, count(p_type) AS depts, count(*) FILTER (p_size % 2 = 0) AS skus FROM part"),
    "o003_fingerprint": (_fingerprints, None),
    "o004_upload": (_uploaded, "SELECT CAST(p_partkey AS VARCHAR) AS part_number, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS sku, '--' AS fine FROM part"),
    "o005_header": (lambda s, d: prepare(s).createDataFrame(list(enumerate(T.header(_t("part")(s, d)))), "place int, name string"), "SELECT CAST(row_number() OVER () - 1 AS INT) AS place, column_name AS name FROM (DESCRIBE part)"),
    "o007_append": (_appended, f"WITH {_LOG} SELECT part_number, status, series FROM w"),
    "o009_snapshot": (_snapshot, f"WITH {OBS} SELECT lower(dept) AS dept, lower(class) AS class, lower(fine) AS fine, classpath, count(*) AS n FROM obs GROUP BY ALL"),
    "o010_payload_projection": (_payloads, f"WITH {OBS} SELECT brand, arg_min(manufacturer, row_id) AS manufacturer FROM obs GROUP BY brand"),
    "o012_metrics": (_metrics, "SELECT event_type, count(*) AS calls, 2 * count(*) AS cost FROM events GROUP BY 1"),
    "o014_document_cache": (_cached, "SELECT doc_id, least(200000, length(coalesce(text, '')) * 400) AS size, 60 AS links FROM documents WHERE doc_id % 3 <> 0"),
    "o017_robots": (_robots, "SELECT page_id, NOT string_split(url, '/')[3] LIKE 'b%' AS allowed FROM pages"),
    "o018_answered": (_answers, "SELECT doc_id, CASE lang WHEN 'en' THEN '{\"a\": 1}' WHEN 'fr' THEN '{}' END AS payload FROM documents"),
    "o021_echo": (_echoed, "SELECT 'u' AS url, CAST(p_partkey AS VARCHAR) AS part_number, p_type || 'Â®' AS dept, '--' AS fine, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS sku, p_name || ' - Display Only' AS description FROM part"),
    "o042_cell": (lambda s, d: _raw(s, d).select(F.col("PART_NUMBER").alias("part_number"), X.cell(F.col("Dept")).alias("dept"), X.cell(F.col("`SKU - MY_PART_NUMBER`")).alias("sku"), X.cell(F.col("Fine")).alias("fine")), f"WITH {_RAWS} SELECT part_number, dept, coalesce(sku, '') AS sku, '' AS fine FROM r"),
    "o047_spellings": (_spelled, "SELECT DISTINCT p_type, p_type AS first, '' AS last, upper(array_to_string(list_transform(regexp_extract_all(p_type, '[A-Za-z0-9]+'), lambda w: w[1]), '')) AS initials, true AS once FROM part"),
    "o048_located": (_located, f"WITH {OBS}, m AS (SELECT 'Size' AS label, contains(lower(product_name || ', ' || fine || ' lb Size, ' || flag || ' Flag'), lower(fine || ' pounds')) AS found FROM obs UNION ALL SELECT 'Flag', contains(lower(product_name || ', ' || fine || ' lb Size, ' || flag || ' Flag'), lower(flag)) FROM obs UNION ALL SELECT 'Status', contains(lower(product_name || ', ' || fine || ' lb Size, ' || flag || ' Flag'), lower(status || ' inches')) FROM obs) SELECT label, found, count(*) AS n FROM m GROUP BY ALL"),
    "o051_located_in_invoice": (_in_invoice, f'WITH {OBS} SELECT row_id, CASE WHEN CAST(fine AS INT) >= 10 THEN length(product_name) + 2 END AS "at" FROM obs'),
    "o063_json_ld": (_ld, "SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, NULL::VARCHAR AS upc, 'Size=' || p_size AS pairs FROM part"),
    "o065_spec_pairs": (_pairs, "SELECT p_partkey AS page_id, 'Weight=' || p_type || ',Finish=' || p_brand || ',Size=' || p_size AS pairs FROM part"),
    "o066_pdf_links": (_links, "SELECT p_partkey AS page_id, 'https://a.com/d/' || p_partkey || '.PDF' AS url, 'Spec sheet' AS anchor FROM part"),
    "o072_o074_scores": (_scores, "SELECT p_partkey, 100.0::DOUBLE AS sorted, 100.0::DOUBLE AS held, round_even(200 * length(p_name) / (2 * length(p_name) + 3), 6)::DOUBLE AS longer, 100.0::DOUBLE AS same, 0.0::DOUBLE AS empty FROM part"),
    "o075_best_choice": (_choice, "SELECT p_partkey, p_brand AS choice, round_even(100 * (length(p_brand) - 1) / length(p_brand), 6)::DOUBLE AS score FROM part"),
    "o076_safe_match": (_matched, "SELECT lower(s_name) || ' supplies' AS key, lower(s_name) AS match FROM supplier UNION ALL SELECT 'x' || lower(s_name), lower(s_name) FROM supplier"),
    "o078_selected": (lambda s, d: R.selected(observations(s, d), observations(s, d).filter("fine = '7'")).groupBy("part_number").agg(F.count("*").alias("n")), f"WITH {OBS} SELECT part_number, count(*) AS n FROM obs WHERE part_number IN (SELECT part_number FROM obs WHERE fine = '7') GROUP BY 1"),
    "o087_head_sample": (lambda s, d: R.head_sample(_raw(s, d).withColumn("_row_id", F.col("PART_NUMBER").cast("long")), 500).select(F.col("PART_NUMBER").alias("part_number"), F.col("`SKU - MY_PART_NUMBER`").alias("sku")), "SELECT CAST(p_partkey AS VARCHAR) AS part_number, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS sku FROM part ORDER BY p_partkey LIMIT 200"),
    "o089_common_rows": (lambda s, d: C.common_rows(_t("customer")(s, d).select(F.col("c_custkey").alias("key"), "c_name"), _t("orders")(s, d).select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderstatus"), "key"), "SELECT c_custkey AS key, c_name, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL"),
    "o120_coverage_probe": (_probe, _PROBE),
    "o132_approvals": (lambda s, d: observations(s, d).select("row_id", F.array_join(A.approvals(G.tokens_of(F.col("approvals")), F.array(F.lit("UL"), F.lit("A")), F.lit(None).cast("array<string>")), ",").alias("approvals")), f"WITH {OBS} SELECT row_id, array_to_string(list_sort(list_distinct([flag, status, 'UL', 'A'])), ',') AS approvals FROM obs"),
    "o141_prompt_spec": (_specs, _SPECS),
    "o141_prompt": (_prompted, _PROMPTED),
    "o143_extras": (_absorbed, _ABSORBED),
    "o145_bodies": (_bodies, "SELECT o_orderkey AS row_id, o_orderpriority || '-Kit' AS segments FROM orders"),
    "o147_mobile": (_mobile, _MOBILE),
    "o152_driver": (lambda s, d: _driven(s, d).select("row_id", "state", "added", "seen", F.array_join("issues", ";").alias("issues"), "needs_review"), "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus ELSE 'changed' END AS state, CASE WHEN o_orderkey % 7 <> 0 THEN 1 END AS added, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus ELSE 'changed/1' END AS seen, CASE WHEN o_orderkey % 7 = 0 THEN 'stage one failed: ValueError;' ELSE '' END || 'stage two failed: AnalysisException' AS issues, true AS needs_review FROM orders"),
    "o152_failures": (_failures, "SELECT 'one' AS stage, count(*) AS rows FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'two', count(*) FROM orders"),
    "o152_usage_delta": (_usage, _USAGE),
    "o152_enriched": (_chain, None),
    "o154_compact": (lambda s, d: E.compact(_bundle(s, d).withColumn("tables", F.array_repeat(F.element_at("tables", 1), 50))).select("part_number", "url", F.size("tables").alias("pairs")), f"WITH {_BUNDLE} SELECT conv_id AS part_number, url, 40 AS pairs FROM b"),
    "o174_knowledge": (_views, _VIEWS),
    "o174_style_view": (_grammar, "WITH p AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_type LIKE '%S%') SELECT p_type AS classpath, 'long' AS surface, 4 AS rows_learned_from, string_agg(p_brand || CASE WHEN p_brand > 'Brand#3' THEN '=-Kit' ELSE '' END, ' | ' ORDER BY p_brand) AS grammar FROM p GROUP BY p_type"),
    "o175_payload": (_payload, f"WITH {OBS} SELECT part_number, description, dept AS hints, brand, NULL::VARCHAR AS series, 3 AS attributes, '' AS research_note FROM obs"),
    "o175_truth": (_truth, f"WITH {OBS} SELECT dept AS part_number, arg_min(brand, row_id) AS brand, arg_min(classpath, row_id) AS classpath, CASE WHEN arg_min(fine, row_id) = '7' THEN '7' ELSE '' END AS upc FROM obs GROUP BY dept"),
    "o178_facts": (lambda s, d: _facts(s, d).groupBy("surface", "label").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values")), f"WITH {OBS}, m AS (SELECT 'Flag' AS label, flag AS value FROM obs UNION ALL SELECT 'Status', status || ' inches' FROM obs UNION ALL SELECT 'Size', size || ' pounds' FROM obs) SELECT surface, label, count(*) AS n, count(DISTINCT value) AS values FROM m, (VALUES ('long'), ('short'), ('retail'), ('mobile'), ('invoice')) AS s(surface) GROUP BY ALL"),
    "o179_styled": (_styled, "SELECT DISTINCT p_type || '/' || p_brand AS key, length(p_type) % 2 = 1 AS specific, CASE WHEN length(p_type) % 2 = 1 THEN 'Kit' ELSE 'Set' END AS suffix FROM part"),
    "o181_fit": (lambda s, d: G.fit(observations(s, d)).summary().filter("registry in ('triples', 'leaves', 'makers', 'approvals')"), f"WITH {OBS}, t AS (SELECT DISTINCT lower(dept), lower(class), lower(fine), classpath FROM obs) SELECT 'triples' AS registry, count(*) AS entries FROM t UNION ALL SELECT 'leaves', count(DISTINCT trim(string_split(classpath, '>')[-1])) FROM obs UNION ALL SELECT 'makers', count(DISTINCT brand) FROM obs UNION ALL SELECT 'approvals', count(DISTINCT x) FROM (SELECT unnest(string_split(approvals, '|')) AS x FROM obs)"),
    "o184_permitted_search": (_permitted, _PERMITTED),
    "o184_third_party_search": (_third, _THIRD),
    "o185_kind_rank": (lambda s, d: _bundle(s, d).groupBy(E.kind_rank(F.col("kind")).alias("rank")).agg(F.count("*").alias("n")), f"WITH {_BUNDLE} SELECT CASE kind WHEN 'specification' THEN 0 ELSE 2 END AS rank, count(*) AS n FROM b GROUP BY 1"),
    "o189_cached_results": (lambda s, d: R.cached_results(observations(s, d).select("row_id", F.col("dept").alias("part_number"), "brand", "mpn")).select("part_number", "row_id", "brand", "mpn"), f"WITH {OBS} SELECT dept AS part_number, max(row_id) AS row_id, arg_max(brand, row_id) AS brand, arg_max(mpn, row_id) AS mpn FROM obs GROUP BY dept"),
    "o190_readiness": (_ready, _READY),
    "o192_response_cache": (_answers, "SELECT doc_id, CASE lang WHEN 'en' THEN '{\"a\": 1}' WHEN 'fr' THEN '{}' END AS payload FROM documents"),
    "o194_percent": (lambda s, d: C.score_fields(C.field_pairs(*_scored(s, d), fields=["BRAND_NAME", "Classpath"]), False).select("field", C.percent(F.col("fill_rate")).alias("filled")), "WITH c AS (SELECT * FROM customer WHERE c_custkey % 7 <> 0) SELECT 'BRAND_NAME' AS field, printf('%.1f%%', 100 * round_even(avg((c_custkey % 3 <> 0)::INT), 3)) AS filled FROM c UNION ALL SELECT 'Classpath', '100.0%'"),
    "o195_vocabularies": (_vocabularies, _VOCABULARIES),
}
