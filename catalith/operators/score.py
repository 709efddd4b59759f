"""Evaluation and reporting (O-089, O-156..O-172, O-194): one pass of conditional sums for each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import fixed_values as V
from catalith.functions.similarity import ratio_column, token_set_column
from catalith.functions.text import cell, compare_key, folded
from catalith.operators.resolve import first_match_join

IDENTITY_PASS, TEXT_PASS, VALUE_PASS = 97, 85, 90
#: From which confidence a band holds.
BANDS = [("high", 0.85), ("medium", 0.65)]


def _share(hits: Column, of: Column) -> Column:
    return F.bround(F.coalesce(hits, F.lit(0)) / F.greatest(of, F.lit(1)), 3)


def unpivot(df: DataFrame, key: str, columns: list[str], value: str) -> DataFrame:
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), cell(F.col(f"`{c}`")).alias(value)) for c in columns])).alias("x")).select(key, "x.*")


def field_pairs(predicted: DataFrame, truth: DataFrame, key: str = "PART_NUMBER", order: str = "row_id", fields: list[str] | None = None) -> DataFrame:
    """(key, field, got, want) of the rows that truth knows; of its duplicates the first."""
    fields = fields or V.SCORED_FIELDS
    first = truth.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in fields]), order).alias("_t")).select(key, "_t.*")
    return unpivot(predicted, key, fields, "got").join(unpivot(first, key, fields, "want"), [key, "field"])


def score_fields(pairs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """O-156. For each field: compared, exact_match, fuzzy_match, mean_similarity, fill_rate, truth_fill_rate. The kernel sees only pairs that differ."""
    both = (F.col("got") != "") & (F.col("want") != "")
    out = pairs.withColumn("exact", both & (F.col("got") == F.col("want")))
    if fuzzy:
        differ = out.filter(both & ~F.col("exact")).select("field", "got", "want").distinct()
        scored = differ.withColumn("similarity", token_set_column(compare_key(F.col("got")), compare_key(F.col("want"))))
        out = out.join(scored, ["field", "got", "want"], "left")
    else:
        out = out.withColumn("similarity", F.lit(None).cast("double"))
    similarity = F.when(F.col("exact"), 100.0).when(both, F.coalesce("similarity", F.lit(0.0)))
    passes = similarity >= F.when(F.col("field").isin(V.IDENTITY_FIELDS), IDENTITY_PASS).otherwise(TEXT_PASS)
    n = F.sum(both.cast("int"))
    return out.groupBy("field").agg(
        n.alias("compared"), _share(F.sum(F.col("exact").cast("int")), n).alias("exact_match"), _share(F.sum(passes.cast("int")), n).alias("fuzzy_match"),
        F.coalesce(F.bround(F.avg(similarity) / 100, 3), F.lit(0.0)).alias("mean_similarity"),
        _share(F.sum((F.col("got") != "").cast("int")), F.count("*")).alias("fill_rate"), _share(F.sum((F.col("want") != "").cast("int")), F.count("*")).alias("truth_fill_rate"),
    )


def headline(fields: DataFrame) -> DataFrame:
    """O-161. Means over the fields that were compared."""
    return fields.filter("compared > 0").agg(F.bround(F.coalesce(F.avg("exact_match"), F.lit(0.0)), 3).alias("mean_exact_match"), F.bround(F.coalesce(F.avg("fuzzy_match"), F.lit(0.0)), 3).alias("mean_fuzzy_match"))


def score_attributes(predicted: DataFrame, truth: DataFrame, key: str = "part_number", fuzzy: bool = True) -> DataFrame:
    """O-157. One row: labels_emitted, label_precision, values_compared, value_accuracy. Both sides: (key, slot, label, value), one row for each attribute.
    Of a truth label that repeats, the last value counts."""
    want = truth.withColumn("label_key", folded(cell(F.col("label")))).filter("label_key <> ''").groupBy(key, "label_key").agg(F.max_by("value", "slot").alias("want"))
    known = truth.select(key).distinct()
    got = predicted.join(known, key, "left_semi").withColumn("label_key", folded(cell(F.col("label")))).filter("label_key <> ''")
    pairs = got.join(want.withColumn("hit", F.lit(1)), [key, "label_key"], "left").select(F.coalesce("hit", F.lit(0)).alias("hit"), cell(F.col("value")).alias("got"), cell(F.col("want")).alias("want"))
    both = (F.col("hit") == 1) & (F.col("got") != "") & (F.col("want") != "")
    near = ratio_column(compare_key(F.col("got")), compare_key(F.col("want"))) >= VALUE_PASS if fuzzy else F.lit(False)
    pairs = pairs.groupBy("hit", "got", "want").count().withColumn("both", both).withColumn("equal", both & ((F.col("got") == F.col("want")) | near))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    emitted, hits, compared, equal = F.coalesce(F.sum("count"), F.lit(0)), total(F.col("hit") == 1), total(F.col("both")), total(F.col("equal"))
    return pairs.agg(emitted.alias("labels_emitted"), _share(hits, emitted).alias("label_precision"), compared.alias("values_compared"), _share(equal, compared).alias("value_accuracy"))


def score_compliance(rows: DataFrame) -> DataFrame:
    """O-158. One row: shares of five house rules over all rows."""
    invoice, mobile = cell(F.col("INVOICE_DESC")), cell(F.col("MOBILE_DESC"))
    blob = F.concat_ws(" ", *[cell(F.col(c)) for c in ("SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MOBILE_DESC")])
    share = lambda c: F.bround(F.coalesce(F.avg(c.cast("int")), F.lit(0.0)), 3)
    return rows.agg(
        share((invoice != "") & (F.length(invoice) <= V.INVOICE_LIMIT)).alias("invoice_within_40_chars"), share((invoice != "") & (invoice == F.upper(invoice))).alias("invoice_all_caps"),
        share((mobile != "") & F.length(mobile).between(V.MOBILE_LEAST, V.MOBILE_MOST)).alias("mobile_within_60_80_chars"),
        share(~blob.rlike(r"(?U)\d(in|ft|mm|cm|lb|oz|psi)\b")).alias("unit_spacing_correct"), share(~blob.rlike(r"(?U)\d+\.\d+\s*in\b")).alias("fractions_not_decimals"),
    )


def score_coverage(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """O-159. One row: cells filled on either side over the columns that both have, without a join of keys."""
    shared = [c for c in predicted.columns if c in truth.columns]
    filled = lambda df: df.agg(F.coalesce(sum((F.sum((cell(F.col(f"`{c}`").cast("string")) != "").cast("long")) for c in shared), F.lit(0)), F.lit(0)).alias("n"))
    ours, theirs = filled(predicted).select(F.col("n").alias("cells_filled"), F.lit(1).alias("k")), filled(truth).select(F.col("n").alias("truth_cells_filled"), F.lit(1).alias("k"))
    return ours.join(theirs, "k").select("cells_filled", "truth_cells_filled", _share(F.col("cells_filled"), F.col("truth_cells_filled")).alias("fill_ratio_vs_truth"))


def score_sourcing(records: DataFrame) -> DataFrame:
    """O-160. One row. records: citations array<struct(kind, source)>, filled long, grounded long, mfr_url."""
    n = F.count("*")
    third = F.filter("citations", lambda c: c["source"] == "third-party")
    slashes = F.length(F.coalesce("mfr_url", F.lit(""))) - F.length(F.replace(F.coalesce("mfr_url", F.lit("")), F.lit("/"), F.lit("")))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sourced, verified = F.size("citations") > 0, F.exists("citations", lambda c: c["kind"] != "editorial")
    out = records.withColumn("citations", F.coalesce("citations", F.array().cast(records.schema["citations"].dataType)))
    return out.agg(
        n.alias("records"), count(sourced).alias("records_with_a_source"), _share(count(sourced), n).alias("sourced_rate"), count(verified).alias("records_with_verified_source"),
        count(F.size("citations")).alias("documents_read"), count(F.size(third)).alias("third_party_documents"), count(F.size(third) > 0).alias("records_supplemented_third_party"),
        count(slashes > 2).alias("deep_product_links"), _share(count(slashes > 2), n).alias("deep_link_rate"), count(F.col("filled")).alias("filled_attribute_values"),
        count(F.col("grounded")).alias("grounded_values"), F.when(count(F.col("filled")) > 0, F.bround(count(F.col("grounded")) / count(F.col("filled")), 3)).otherwise(0.0).alias("grounded_rate"),
    )


def documents_by_kind(records: DataFrame) -> DataFrame:
    """O-160. (kind, documents)."""
    return records.select(F.explode("citations").alias("c")).groupBy(F.coalesce("c.kind", F.lit("other")).alias("kind")).agg(F.count("*").alias("documents"))


def run_summary(records: DataFrame) -> DataFrame:
    """O-162. One row: records, needs_review, review_rate, mean_confidence."""
    review = F.sum(F.col("needs_review").cast("long"))
    return records.agg(F.count("*").alias("records"), review.alias("needs_review"), _share(review, F.count("*")).alias("review_rate"), F.bround(F.avg("confidence"), 3).alias("mean_confidence"))


def cost(usage: DataFrame, rates: DataFrame, replayed_tokens: int = 1200) -> DataFrame:
    """O-163. (model, calls, tokens, cost): tokens spread over models by their share of calls, at the rate of the first pattern that the model's name holds.
    usage: (model, calls, total_tokens); rates: (priority, pattern, input_rate, output_rate, output_share) by million tokens."""
    whole = usage.agg(F.sum("calls").alias("all_calls"), F.max("total_tokens").alias("all_tokens"))
    named = usage.join(rates, F.contains(F.col("model"), F.col("pattern")), "left").groupBy("model", "calls").agg(F.min_by(F.struct("input_rate", "output_rate", "output_share"), "priority").alias("r"))
    out = named.join(F.broadcast(whole))  # one row
    tokens = F.col("all_tokens") * F.col("calls") / F.greatest("all_calls", F.lit(1))
    rate = F.col("r.input_rate") * (1 - F.col("r.output_share")) + F.col("r.output_rate") * F.col("r.output_share")
    return out.select("model", "calls", F.bround(tokens, 3).alias("tokens"), F.bround(F.coalesce(tokens * rate / 1_000_000, F.lit(0.0)), 6).alias("cost"))


def call_counters(calls: DataFrame, kind: str, failed: Column, cached: Column) -> DataFrame:
    """O-164. (kind, calls, cache_hits, live_calls, failures)."""
    n = lambda c: F.sum(c.cast("long"))
    return calls.groupBy(kind).agg(F.count("*").alias("calls"), n(cached).alias("cache_hits"), n(~cached).alias("live_calls"), n(failed).alias("failures"))


def by_family(rows: DataFrame, provenance: str = "provenance", correct: str = "correct") -> DataFrame:
    """O-166. (family, rows, correct, accuracy): accuracy by what stands before the colon of the provenance."""
    n = F.sum(F.col(correct).cast("long"))
    return rows.groupBy(F.element_at(F.split(provenance, ":"), 1).alias("family")).agg(F.count("*").alias("rows"), n.alias("correct"), F.bround(n / F.count("*"), 3).alias("accuracy"))


def coverage_gaps(predicted: DataFrame, truth: DataFrame, key: str, fields: list[str], limit: int = 40) -> DataFrame:
    """O-167. (field, missing): in how many rows truth has a field that the prediction lacks; the report's top rows."""
    pairs = unpivot(predicted, key, fields, "got").join(unpivot(truth, key, fields, "want"), [key, "field"])
    return pairs.filter("got = '' and want <> ''").groupBy("field").agg(F.count("*").alias("missing")).orderBy(F.desc("missing"), "field").limit(limit)


def population(predicted: DataFrame, truth: DataFrame, columns: list[str], derivable: list[str]) -> DataFrame:
    """O-168. (column, ours, theirs, class): populated, blank in both, not derivable, or a gap."""
    count = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (cell(F.col(f"`{c}`")) != "").cast("long").alias("n")) for c in columns])).alias("x")).groupBy("x.column").agg(F.sum("x.n").alias(name))
    kind = F.when(F.col("ours") > 0, "populated").when(F.col("theirs") == 0, "blank in both").when(~F.col("column").isin(derivable), "not derivable").otherwise("gap")
    return count(predicted, "ours").join(count(truth, "theirs"), "column").withColumn("class", kind)


def word_diff(got: Column, want: Column) -> Column:
    """O-169. Each word of `got`, and whether `want` has it."""
    wanted = F.split(F.lower(want), " ")
    return F.transform(F.split(got, " "), lambda w: F.struct(w.alias("word"), F.array_contains(wanted, F.lower(w)).alias("shared")))


def projected(seconds_a_row: float, cost_a_row: float, sizes: list[int], spark) -> DataFrame:
    """O-170. (rows, seconds, cost) of larger catalogues."""
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(int(n)).cast("long") for n in sizes])).alias("rows"))
    return rows.select("rows", F.bround(F.col("rows") * seconds_a_row, 3).alias("seconds"), F.bround(F.col("rows") * cost_a_row, 6).alias("cost"))


def band(confidence: Column) -> Column:
    """O-171."""
    out = F.lit("low")
    for name, least in reversed(BANDS):
        out = F.when(confidence >= least, name).otherwise(out)
    return out


def two_folds(a: DataFrame, b: DataFrame) -> DataFrame:
    """O-172. Two tables of field scores side by side."""
    named = lambda df, tail: df.select("field", *[F.col(c).alias(f"{c}_{tail}") for c in df.columns if c != "field"])
    return named(a, "holdout").join(named(b, "all"), "field", "full")


def percent(c: Column) -> Column:
    """O-194."""
    return F.format_string("%.1f%%", c * 100)


def common_rows(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """O-089. Rows of both sides by key; of duplicates on the right the first."""
    return first_match_join(a, b, key, b.columns[1])
