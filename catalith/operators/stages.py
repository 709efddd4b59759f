"""The enrichment stages as functions from DataFrame to DataFrame (O-077, O-085, O-086, O-135, O-136, O-140, O-149..O-151).

Undecided rows are the only ones that reach similarity search or model answers: each stage splits them off, and joins them back by row_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions import fixed_values as V
from catalith.functions.measure import dimensions, measure_text
from catalith.functions.similarity import token_set_column
from catalith.functions.text import clean, folded, invoice_line_folded, slug, title_case, truncate_clean
from catalith.operators import retrieval
from catalith.operators.registry import Registry
from catalith.operators.resolve import candidates, canonical, resolve
from catalith.operators.snap import best
from catalith.session import written

REVIEW_BELOW, SEVERE_MOST = 0.65, 3
SNAP_FLOOR, NAMING_NEIGHBOURS = 60.0, 8
#: What a row is classified by.
KIND = ("dept", "class", "fine", "description")
PERMITTED_MOST, MOBILE_LEAST, MOBILE_MOST = 500, 60, 80
#: Texts of a record that must hold no decimal inch and no unit without its space.
TEXTS = ("long_desc", "short_desc", "retail_desc", "mobile_desc", "marketing_desc")


def is_holdout(part_number: Column, ratio: float = 0.3) -> Column:
    """O-077. A fold by hash: the first eight hex digits of SHA-256, modulo 1000, under the ratio."""
    return F.conv(F.substring(F.sha2(part_number.cast("binary"), 256), 1, 8), 16, 10).cast("long") % 1000 < F.lit(ratio * 1000)


def split(rows: DataFrame, key: str = "part_number", ratio: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """O-077. Training and holdout rows."""
    held = is_holdout(F.col(key), ratio)
    return rows.filter(~held), rows.filter(held)


def review_queue(records: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """O-085. Doubtful records first, the least confident ones first among them; 1 to 200 rows."""
    found = records if status is None else records.filter(F.col("status") == status)
    return found.orderBy(F.desc("needs_review"), "confidence", "part_number").limit(max(1, min(limit, 200)))


def page(records: DataFrame, offset: int, limit: int, order: str = "_row_id") -> DataFrame:
    """O-086. A window of the results in input order."""
    return records.orderBy(order).offset(offset).limit(limit)


def classify(rows: DataFrame, registry: Registry, index: retrieval.Index, labelled: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """O-135. rows with `classpath`, `classpath_confidence`, `classpath_provenance`, `product_name` with `name_confidence` and `name_provenance`, and `classify_issue`.

    A sole candidate gives 0.92, a near row 0.90, a model answer on the list its own confidence up to 0.95; one off the list is snapped to the candidate with the most similar words, at 60 or more, else to the first one,
    at 0.55; without an answer, 0.45 by the neighbours' votes or the first candidate. Candidates stand in the order of the neighbours' votes. Names come from neighbours of the path (0.8), else from the answer, else
    they are the path's usual one. labelled: (row_id, classpath, product_name); answers: (row_id, answer, answer_confidence and, if at hand, answer_name).

    Without answers all of this follows from a row's category and description, which repeat, so each different one is classified once."""
    if answers is not None:
        return _classified(rows, registry, index, labelled, answers)
    kinds = rows.select(*KIND).distinct().withColumn("row_id", F.monotonically_increasing_id())
    made = _classified(written(kinds, "kinds"), registry, index, labelled, None).drop("row_id")
    found = [c for c in made.columns if c not in KIND]
    made = made.select(*[F.col(c).alias(f"_{c}") for c in KIND], *found)
    same = [rows[c].eqNullSafe(made[f"_{c}"]) for c in KIND]
    # neither side is small by nature, however well its repeated texts pack: a broadcast would hold it in the driver
    return rows.join(made.hint("merge"), same).select(*[rows[c] for c in rows.columns], *found)


def _classified(rows: DataFrame, registry: Registry, index: retrieval.Index, labelled: DataFrame, answers: DataFrame | None) -> DataFrame:
    known = candidates(rows, registry.triples)
    listed = known.filter(F.size("candidates") > 0)
    open_ = known.filter(F.size("candidates") > 1)
    # descriptions repeat, so each is searched once and its neighbours go to all rows that have it
    texts = listed.groupBy("description").agg(F.min("row_id").alias("query_id"))
    names = labelled.select("row_id", "classpath", "product_name")
    # four steps below look at the neighbours, so they are written down
    found = written(index.neighbours(texts.select("query_id", F.col("description").alias("text")), 12), "neighbours").join(names, "row_id").withColumnRenamed("query_id", "text_id")
    of = listed.select(F.col("row_id").alias("asking"), "description").join(texts, "description").select(F.col("asking").alias("query_id"), F.col("query_id").alias("text_id"))
    near = of.join(found.hint("merge"), "text_id").drop("text_id")
    options = open_.select(F.col("row_id").alias("query_id"), F.posexplode("candidates").alias("_at", "classpath"))
    decided = retrieval.decide(near.filter("rank <= 5"), options.drop("_at")).select(F.col("query_id").alias("row_id"), F.col("classpath").alias("_near"), F.col("score").alias("_score"))
    ranked = retrieval.rank_candidates(near, options.drop("_at"))
    voted = ranked.filter("rank = 1").select(F.col("query_id").alias("row_id"), F.col("classpath").alias("_voted"))
    out = known.join(decided.hint("merge"), "row_id", "left").join(voted.hint("merge"), "row_id", "left")
    if answers is None:
        out = out.withColumns({"answer": F.lit(None).cast("string"), "answer_confidence": F.lit(None).cast("double"), "answer_name": F.lit(None).cast("string"), "_snapped": F.lit(None).cast("string")})
    else:
        said = answers.withColumn("answer", F.trim("answer")) if "answer_name" in answers.columns else answers.withColumn("answer", F.trim("answer")).withColumn("answer_name", F.lit(None).cast("string"))
        strays = said.select(F.col("row_id").alias("query_id"), "answer").join(options.join(ranked.select("query_id", "classpath", F.col("rank").alias("_voted")), ["query_id", "classpath"], "left"), "query_id")
        scored = strays.withColumn("score", token_set_column(F.col("answer"), F.col("classpath"))).filter(F.col("score") >= SNAP_FLOOR)
        snapped = scored.groupBy("query_id").agg(F.min_by("classpath", F.struct(-F.col("score"), F.coalesce("_voted", F.lit(1 << 30)), "_at")).alias("_snapped"))
        out = out.join(said.select("row_id", "answer", "answer_confidence", "answer_name"), "row_id", "left").join(snapped.withColumnRenamed("query_id", "row_id"), "row_id", "left")
    first, many = F.try_element_at("candidates", F.lit(1)), F.size("candidates")
    on_list = F.array_contains("candidates", F.col("answer"))
    none = F.lit(None).cast("string")
    rules = [
        (many == 0, none, F.lit(0.0), F.lit("none"), F.lit("no classpath candidates for category triple")),
        (many == 1, first, F.lit(0.92), F.lit("registry-unique"), none),
        (F.col("_near").isNotNull(), F.col("_near"), F.lit(0.90), F.concat(F.lit("retrieval:"), F.format_string("%.2f", F.col("_score"))), none),
        (on_list, F.col("answer"), F.least(F.coalesce(F.nullif("answer_confidence", F.lit(0.0)), F.lit(0.7)), F.lit(0.95)), F.lit("llm-choice"), none),
        (F.col("answer").isNotNull(), F.coalesce("_snapped", "_voted", first), F.lit(0.55), F.lit("llm-choice"), F.lit("classifier returned off-list classpath, snapped to nearest")),
        (F.col("_voted").isNotNull(), F.col("_voted"), F.lit(0.45), F.lit("retrieval-fallback"), F.lit("classifier LLM unavailable, fell back to ranked candidate")),
    ]
    last = (first, F.lit(0.45), F.lit("registry-fallback"), F.lit("classifier LLM unavailable, fell back to ranked candidate"))
    pick = lambda i: _cascade([(r[0], r[i + 1]) for r in rules], last[i])
    out = out.select(*known.columns, "answer_name", pick(0).alias("classpath"), pick(1).alias("classpath_confidence"), pick(2).alias("classpath_provenance"), pick(3).alias("classify_issue"))
    modal = registry.names.groupBy("classpath").agg(F.max_by("product_name", F.struct("n", -F.col("first"))).alias("_modal"))
    chosen = out.filter("classpath is not null").select(F.col("row_id").alias("query_id"), "classpath")
    named = retrieval.modal_name(near.filter(F.col("rank") <= NAMING_NEIGHBOURS), chosen).select(F.col("query_id").alias("row_id"), F.col("product_name").alias("_named"))
    out = out.join(modal, "classpath", "left").join(named.hint("merge"), "row_id", "left").withColumns({"_said": F.trim(F.coalesce("answer_name", F.lit(""))), "_modal": F.coalesce("_modal", F.lit(""))})
    asked = F.col("classpath_provenance") == "llm-choice"
    # a model that was asked for the path names the product too; else it is asked only where nothing else does
    naming = [
        (F.col("classpath").isNull(), F.lit(""), F.lit(None).cast("double"), none),
        (F.col("_named").isNotNull(), F.col("_named"), F.lit(0.8), F.lit("retrieval")),
        (asked & (F.col("_said") != ""), F.col("_said"), F.lit(0.8), F.lit("llm")),
        (asked, F.col("_modal"), F.lit(0.4), F.lit("classpath-modal")),
        ((F.col("_modal") == "") & (F.col("_said") != ""), F.col("_said"), F.lit(0.75), F.lit("llm")),
    ]
    last = (F.col("_modal"), F.lit(0.5), F.lit("classpath-modal"))
    name = lambda i: _cascade([(r[0], r[i + 1]) for r in naming], last[i])
    return out.select(*known.columns, "classpath", "classpath_confidence", "classpath_provenance", name(0).alias("product_name"), name(1).alias("name_confidence"), name(2).alias("name_provenance"), "classify_issue")


def _cascade(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def manufacturer_stage(rows: DataFrame, registry: Registry, answers: DataFrame | None = None) -> DataFrame:
    """O-136. The registry's answer if it is trusted (0.75); else a model's, at 0.9 at most if on the approved list and 0.6 if not; else the registry's all the same. answers: (row_id, answer_brand, answer_confidence)."""
    found = resolve(rows, registry)
    if answers is None:
        return found
    approved = registry.makers.select(F.col("brand").alias("answer_brand"), F.col("manufacturer").alias("_m"))
    out = found.join(answers, "row_id", "left").join(approved, "answer_brand", "left")
    use = (F.col("confidence") < 0.75) & F.col("answer_brand").isNotNull()
    limit = F.when(F.col("_m").isNotNull(), 0.9).otherwise(0.6)
    new = {"brand": F.col("answer_brand"), "manufacturer": F.coalesce("_m", F.lit("")), "confidence": F.least("answer_confidence", limit), "provenance": F.lit("llm")}
    return out.select(*[F.when(use, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in found.columns])


def resolve_attributes(wanted: DataFrame, extracted: DataFrame, evidence: DataFrame, registry: Registry) -> DataFrame:
    """O-140. (row_id, slot, label, value, uom, confidence, source) of each template label: a model's value on the list 0.95, snapped to it at 85 or more 0.85, off it 0.5, free 0.7; a pair of a
    page 0.9; nothing 0. Measures are cleaned, answers in lower case are put in title case, the usual unit fills in. wanted: (row_id, classpath, slot, label); extracted: (row_id, label_key, value, uom); evidence: (row_id, label_key, value, url)."""
    key = ["classpath", "label_key"]
    w = wanted.withColumn("label_key", folded(F.col("label")))
    model = extracted.select("row_id", "label_key", F.col("value").alias("m_value"), F.col("uom").alias("m_uom"))
    pages = evidence.select("row_id", "label_key", F.col("value").alias("p_value"), "url")
    free = registry.free.select(*key, "free_text")
    units = registry.units.groupBy(*key).agg(F.max_by("uom", F.struct("n", -F.col("first"))).alias("usual"))
    exact = registry.values.select(*key, F.col("value").alias("m_value"), F.lit(True).alias("listed"))
    out = w.join(model, ["row_id", "label_key"], "left").join(pages, ["row_id", "label_key"], "left")
    # paths, labels and answers repeat: each different one is looked up once, and rows, which are many, meet what was found in one join
    asked = written(out.select(*key, "m_value").distinct(), "asked")
    known = written(asked.join(free, key, "left").join(units, key, "left").join(exact, [*key, "m_value"], "left"), "known")
    limited = ~F.coalesce("free_text", F.lit(True))
    lost = known.filter(limited & F.col("m_value").isNotNull() & F.col("listed").isNull()).select(*key, "m_value")
    listed = registry.values.select(*key, "value", F.struct(-F.col("n"), "first").alias("priority"))
    snapped = best(lost.withColumnRenamed("m_value", "key"), listed, key, 85.0).select(*key, F.col("key").alias("m_value"), F.struct("value", "score").alias("snap"))
    known = known.join(snapped, [*key, "m_value"], "left")
    known = known.select(*[F.col(c).alias(f"_{c}") for c in (*key, "m_value")], "free_text", "usual", "listed", "snap")
    out = out.join(known, [out[c].eqNullSafe(known[f"_{c}"]) for c in (*key, "m_value")], "left")
    has = F.col("m_value").isNotNull()
    kinds = [
        (has & limited & F.coalesce("listed", F.lit(False)), F.col("m_value"), F.lit(0.95), F.lit("llm+lov-exact")),
        (has & limited & F.col("snap").isNotNull(), F.col("snap.value"), F.lit(0.85), F.concat(F.lit("llm+lov-snap:"), F.col("snap.score").cast("string"))),
        (has & limited, F.col("m_value"), F.lit(0.5), F.lit("llm-offlov")),
        (has, F.col("m_value"), F.lit(0.7), F.lit("llm")),
        (F.col("p_value").isNotNull(), F.col("p_value"), F.lit(0.9), F.concat(F.lit("spec-table:"), "url")),
    ]
    value = _cascade([(k[0], k[1]) for k in kinds], F.lit(None).cast("string"))
    measure = F.lit(False)
    for hint in V.MEASURES:
        measure = measure | F.col("label_key").contains(hint)
    out = out.select("row_id", "slot", "label", value.alias("value"), _cascade([(k[0], k[2]) for k in kinds], F.lit(0.0)).alias("confidence"), _cascade([(k[0], k[3]) for k in kinds], F.lit("unfilled")).alias("source"), F.coalesce(F.nullif("m_uom", F.lit("")), F.when(value.isNotNull(), F.col("usual"))).alias("uom"), measure.alias("measure"))
    answered = F.startswith("source", F.lit("llm"))  # what a page says stays as it says it
    plain = F.when(answered & ~F.col("value").rlike(r"\d") & (F.lower("value") == F.col("value")) & (F.upper("value") != F.col("value")), title_case(F.col("value"))).otherwise(F.col("value"))
    return out.withColumn("value", F.nullif(F.when(F.col("measure"), measure_text(F.col("value"))).otherwise(plain), F.lit(""))).drop("measure")


def plausible_series(rows: DataFrame, values: DataFrame) -> DataFrame:
    """O-084. rows (row_id, classpath, series) with the series where the path's list has it or one at 90 or more; where the path has no list, names that end like a series."""
    own = values.filter("label_key = 'series'").select("classpath", "value")
    asked = rows.withColumn("series", clean(F.col("series"))).filter("series <> ''")
    # equal ones go first, then the highest score, the last in order of the alphabet among equals
    like = best(asked.select("classpath", F.col("series").alias("key")), own.withColumn("priority", F.col("value")), ["classpath"], 90.0, last=True)
    same = own.select("classpath", F.col("value").alias("series"), F.col("value").alias("same")).distinct()
    near = like.select("classpath", F.col("key").alias("series"), F.col("value").alias("near"))
    listed = own.select("classpath").distinct().withColumn("listed", F.lit(True))
    out = rows.withColumn("series", clean(F.col("series"))).join(same, ["classpath", "series"], "left").join(near, ["classpath", "series"], "left").join(listed, "classpath", "left")
    shaped = F.lower("series").rlike(r"(^| )(series|line|collection|family)$") & (F.length("series") > 6)
    found = F.coalesce("same", "near")
    return out.withColumn("series", F.when(found.isNotNull(), found).when(F.col("listed").isNull() & shaped, F.col("series")).otherwise("")).drop("same", "near", "listed")


def source_stage(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """O-149. rows with `mfr_url` (0.7 where only the domain is known) and `asset_names`, gated on how often the brand has each. assets: (brand, domain, prefix, image_rate, rates map)."""
    out = rows.join(assets, "brand", "left")
    stem = F.concat_ws("_", F.coalesce("prefix", slug(F.col("brand"))), slug(F.col("mpn")))
    image = F.when(F.coalesce("image_rate", F.lit(0.0)) >= 0.5, F.create_map(F.lit("Product Image"), F.concat(stem, F.lit(".jpg")))).otherwise(F.create_map().cast("map<string,string>"))
    files = F.map_from_entries(F.transform(F.map_keys(F.map_filter(F.coalesce("rates", F.create_map().cast("map<string,double>")), lambda k, v: (v >= 0.5) & (k != "Product Image"))), lambda k: F.struct(k, F.concat(stem, F.lit("_"), F.regexp_replace(k, "[^A-Za-z0-9]+", "_"), F.lit(".pdf")))))
    names = F.when((slug(F.col("mpn")) == "") | (F.col("brand") == ""), F.create_map().cast("map<string,string>")).otherwise(F.map_concat(image, files))
    deep = F.coalesce("mfr_url", F.lit("")) != ""
    return out.select(*[c for c in rows.columns if c != "mfr_url"], F.when(deep, F.col("mfr_url")).otherwise(F.col("domain")).alias("mfr_url"), F.when(deep, F.lit(0.95)).when(F.col("domain").isNotNull(), 0.7).otherwise(0.0).alias("url_confidence"), names.alias("asset_names"))


def dimension_columns(rows: DataFrame, value: str) -> DataFrame:
    """O-149, O-044. rows with a map of HEIGHT, WIDTH and LENGTH out of a size."""
    return rows.withColumn("dimensions", F.map_from_entries(F.transform(dimensions(F.col(value)), lambda d: F.struct(d["axis"], F.concat_ws(" ", d["value"], d["unit"])))))


def issues(row: dict[str, Column]) -> Column:
    """O-150. What is wrong with a record."""
    missing = [F.when(clean(c) == "", F.lit(f"missing {name}")) for name, c in row.items()]
    return F.array_compact(F.array(*missing))


def validate(rows: DataFrame, makers: DataFrame) -> DataFrame:
    """O-150. rows with texts within their limits and `issues`: what is missing, a mobile text that is short, a brand with another maker than usual, values outside their list (`outside`, an array of labels)."""
    out = rows.join(makers.select(F.col("brand").alias("brand_name"), F.col("manufacturer").alias("_usual")), "brand_name", "left")
    mobile = truncate_clean(F.col("mobile_desc"), 80)
    found = F.concat(
        issues({"Classpath": F.col("classpath"), "BRAND_NAME": F.col("brand_name"), "MANUFACTURER_NAME": F.col("manufacturer_name"), "MANUFACTURER_PART_NUMBER": F.col("mpn")}),
        F.array_compact(F.array(
            F.when((mobile != "") & (F.length(mobile) < 60), F.format_string("MOBILE_DESC is %d chars, below the 60 minimum", F.length(mobile))),
            F.when((F.col("manufacturer_name") != "") & (F.col("_usual") != F.col("manufacturer_name")), F.concat_ws(" ", F.lit("brand/manufacturer mismatch:"), "brand_name")),
        )),
        F.transform("outside", lambda label: F.concat(label, F.lit(" is outside the controlled vocabulary"))),
    )
    return out.withColumn("mobile_desc", mobile).withColumn("issues", found).drop("_usual")


def quoted(c: Column) -> Column:
    """A text in quotes, double ones where it has single ones itself."""
    return F.when(c.contains("'") & ~c.contains('"'), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))


def vocabulary_checked(rows: DataFrame, registry: Registry) -> DataFrame:
    """O-150. (row_id, attributes, found): filled attributes with measures cleaned, values outside their path's list at 0.5 at most, and what is wrong with values and units."""
    key = ["classpath", "label_key"]
    each = rows.select("row_id", "classpath", F.posexplode("attributes").alias("slot", "a")).withColumn("label_key", folded(F.col("a.label")))
    filled = F.trim(F.coalesce(F.col("a.value"), F.lit(""))) != ""
    each = each.withColumn("value", F.when(filled, measure_text(F.col("a.value"))).otherwise(F.col("a.value"))).withColumn("filled", filled)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "first"))
    permitted = registry.values.withColumn("_n", place).filter(F.col("_n") <= PERMITTED_MOST).select(*key, "value", F.lit(True).alias("listed"))
    limited = registry.free.filter("not free_text").select(*key, F.lit(True).alias("limited"))
    usual = registry.units.groupBy(*key).agg(F.max_by("uom", F.struct("n", -F.col("first"))).alias("usual"))
    met = each.join(limited, key, "left").join(usual, key, "left").join(permitted, [*key, "value"], "left")
    checked = F.col("filled") & F.col("limited").isNotNull() & (F.coalesce("classpath", F.lit("")) != "")
    outside = checked & F.col("listed").isNull()
    unit = F.col("filled") & F.col("limited").isNotNull() & (F.coalesce("usual", F.lit("")) != "") & (F.coalesce(F.col("a.uom"), F.lit("")) != "") & (F.col("a.uom") != F.col("usual"))
    wrong = F.array_compact(F.array(
        F.when(outside, F.concat("a.label", F.lit("="), quoted(F.col("value")), F.lit(" is outside the controlled vocabulary"))),
        F.when(unit, F.concat("a.label", F.lit(" unit "), quoted(F.col("a.uom")), F.lit(" differs from approved "), quoted(F.col("usual")))),
    ))
    sure = F.when(outside, F.least(F.col("a.confidence"), F.lit(0.5))).otherwise(F.col("a.confidence"))
    kind = rows.schema["attributes"].dataType.elementType
    new = {"value": F.col("value"), "confidence": sure}
    rebuilt = F.struct(*[new.get(f.name, F.col(f"a.{f.name}")).cast(f.dataType).alias(f.name) for f in kind.fields])
    gathered = met.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("slot", rebuilt.alias("a"), wrong.alias("wrong")))).alias("g"))
    return gathered.select("row_id", F.transform("g", lambda x: x["a"]).alias("attributes"), F.flatten(F.transform("g", lambda x: x["wrong"])).alias("found"))


def validate_all(rows: DataFrame, registry: Registry) -> DataFrame:
    """O-150. Records normalised and within their limits, with what is wrong beside the issues they have: measures in texts and attributes; the invoice line in capitals, abbreviated to its limit; the mobile line;
    identity, on approved spellings and as usual; values and units by path; decimal inches that are left. rows: a record's identity, texts, attributes, provenance (a map) and issues."""
    mark = lambda name, to: F.map_concat(F.map_filter("provenance", lambda k, v: k != name), F.create_map(F.lit(name), to))
    out = canonical(rows, "brand_name", registry.brands.select("key", "brand"), "brand", "_brand")
    out = canonical(out, "manufacturer_name", registry.maker_forms.select("key", "manufacturer"), "manufacturer", "_maker")
    renamed = (F.col("brand_name") != "") & (F.col("_brand") != "") & (F.col("_brand") != F.col("brand_name"))
    was = F.coalesce(F.try_element_at("provenance", F.lit("brand_name")), F.lit(""))
    out = out.withColumn("provenance", F.when(renamed, mark("brand_name", F.concat(was, F.lit("+canonicalised")))).otherwise(F.col("provenance")))
    for column, to in (("brand_name", "_brand"), ("manufacturer_name", "_maker")):
        out = out.withColumn(column, F.when((F.coalesce(column, F.lit("")) != "") & (F.col(to) != ""), F.col(to)).otherwise(F.col(column)))
    out = out.drop("_brand", "_maker").join(registry.makers.select(F.col("brand").alias("brand_name"), F.col("manufacturer").alias("_usual")), "brand_name", "left")
    out = out.join(vocabulary_checked(rows, registry).withColumnsRenamed({"attributes": "_attributes", "found": "_found"}), "row_id", "left")
    # texts last, and by one expression for all of them: the plan above does not carry their rules along
    texts = [c for c in TEXTS if c in rows.columns]
    clean_text = F.transform(F.array(*texts), lambda c: F.when(F.coalesce(c, F.lit("")) != "", measure_text(c)).otherwise(c))
    line = F.when(F.coalesce("invoice_desc", F.lit("")) != "", invoice_line_folded(F.col("invoice_desc"))).otherwise(F.col("invoice_desc"))
    out = out.withColumns({"_texts": clean_text, "_line": line})
    out = out.withColumns({c: F.get("_texts", F.lit(i)) for i, c in enumerate(texts)})
    shortened = F.when(~F.col("_line").eqNullSafe(F.col("invoice_desc")), mark("invoice_desc", F.lit("formula+abbreviated"))).otherwise(F.col("provenance"))
    out = out.withColumns({"provenance": shortened, "invoice_desc": F.upper("_line"), "mobile_desc": truncate_clean(F.col("mobile_desc"), MOBILE_MOST)})
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    said = F.concat_ws("", F.lit("brand/manufacturer mismatch: "), "brand_name", F.lit(" normally maps to "), "_usual", F.lit(", got "), "manufacturer_name")
    found = F.concat(
        F.col("issues"),
        F.array_compact(F.array(
            F.when(length("invoice_desc") > V.INVOICE_LIMIT, F.lit(f"INVOICE_DESC exceeds {V.INVOICE_LIMIT} chars")),
            F.when((length("mobile_desc") > 0) & (length("mobile_desc") < MOBILE_LEAST), F.format_string(f"MOBILE_DESC is %d chars, below the {MOBILE_LEAST} minimum", F.length("mobile_desc"))),
        )),
        issues({"Classpath": F.col("classpath"), "BRAND_NAME": F.col("brand_name"), "MANUFACTURER_NAME": F.col("manufacturer_name"), "MANUFACTURER_PART_NUMBER": F.col("mpn")}),
        F.array_compact(F.array(F.when((F.coalesce("manufacturer_name", F.lit("")) != "") & (F.col("_usual") != F.col("manufacturer_name")), said))),
        F.coalesce("_found", F.array().cast("array<string>")),
        F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")).rlike(r"(?U)\d+\.\d+\s*in\b"), F.lit(f"{c} still contains a decimal inch value")) for c in texts])),
    )
    return out.withColumn("issues", found).withColumn("attributes", F.coalesce("_attributes", "attributes")).drop("_usual", "_attributes", "_found").select(*rows.columns)


def overall(confidence: Column, found: Column) -> Column:
    """O-151. struct(overall, needs_review): the weighted mean of the parts that a record has, less 0.08 for each severe issue, by 0.6 at most."""
    weights = F.create_map(*[x for k, v in V.WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    present = F.map_filter(weights, lambda k, v: F.map_contains_key(confidence, k))
    total = F.aggregate(F.map_entries(present), F.lit(0.0), lambda a, e: a + e["value"] * F.try_element_at(confidence, e["key"]))
    weight = F.aggregate(F.map_values(present), F.lit(0.0), lambda a, v: a + v)
    severe = F.size(F.filter(found, lambda i: i.rlike("|".join(V.SEVERE_WORDS))))
    score = F.when(weight > 0, total / weight).otherwise(0.0) * F.greatest(F.lit(0.4), 1.0 - 0.08 * severe)
    return F.struct(F.bround(score, 3).alias("overall"), ((score < REVIEW_BELOW) | (severe >= SEVERE_MOST)).alias("needs_review"))
