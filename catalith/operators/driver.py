"""The stages as one chain, and what is shown of its records (O-078, O-087, O-120, O-152, O-164, O-174, O-175, O-184, O-189, O-190, O-195).

A stage is a function from a DataFrame of records to one. What goes wrong costs the row this stage only: the row goes on as it was before, with an issue.

* A stage can say itself, row by row, what went wrong: in a column `failed` that is null where nothing did.
* A stage that cannot be planned counts as failed for all rows.
* A stage that fails while it runs is run again on parts of its input, dealt out by a hash of the key. Parts that succeed are kept; parts that fail are dealt
  out again, with another hash, until one key is left, and that row is marked. `k` rows that fail take some `FAN * k * log(n) / log(FAN)` short jobs,
  and none where nothing fails. Errors that are not a row's, like lost executors or a full disk, are raised as they are.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from catalith.functions import fixed_values as V
from catalith.functions.identifiers import is_allowed, is_reputable
from catalith.operators.registry import Registry
from catalith.operators.resolve import candidates, resolve, template_for
from catalith.session import shared_path

Stage = tuple[str, Callable[[DataFrame], DataFrame]]
Cut = Callable[[DataFrame, str], DataFrame]
SAMPLE_MOST, SEARCH_MOST, LISTED_MOST = 200, 6, 6
#: Parts that a failing input is dealt out to, and parts' tables that are read as one before they are written together.
FAN = 8
#: What tells that an error is the cluster's and not a row's.
CLUSTER = re.compile(r"ExecutorLost|FetchFailed|OutOfMemory|No space left|was cancelled|SparkContext was shut down|Connection refused", re.I)
_LAST_LINE = re.compile(r"^(?:[A-Za-z_]\w*\.)*([A-Za-z_]\w*)(?::|$)")


@dataclass(frozen=True)
class StageRun:
    """What is known of a stage once it has run: its rows, how many failed, seconds, and jobs that were tried."""

    stage: str
    rows: int
    failed: int
    seconds: float
    tries: int


def run(
    records: DataFrame, stages: Sequence[Stage], hook: Callable[[str, str], None] | None = None, key: str = "row_id", cut: Cut | None = None, report: Callable[[StageRun], None] | None = None
) -> DataFrame:
    """O-152. records (row_id, issues, needs_review and more) after all stages, in their order. A stage returns all rows with their key and any columns it sets, and may set `failed`, what kind of failure a row
    had; it must neither add nor drop rows, and what it makes of a row must not depend on the others. cut (records, name): runs and writes down the records after each stage, so that no plan grows with the number of
    stages, a lost executor costs one stage at most, and failures at run time stay with their rows; without it the chain is only planned, and such a failure is the caller's.
    hook: told of each stage as it begins and ends (name, "start" or "end"). report (O-164): told of each stage that has run, from counts that Spark took on the way. What either raises is passed over.
    Rows keep their key, by which input order is restored; a null key is one of its own."""
    for name, stage in stages:
        _tell(hook, name, "start")
        began = time.monotonic()
        if cut:
            records, rows, failed, tries = _executed(records, stage, name, key, cut)
            _tell(report, StageRun(name, rows, failed, time.monotonic() - began, tries))
        else:
            records = _planned(records, stage, name, key).drop(FAILED)
        _tell(hook, name, "end")
    return records


FAILED, DEALT = "_failed", "_dealt"


def _tell(observer: Callable | None, *what) -> None:
    try:
        if observer:
            observer(*what)
    except Exception:  # noqa: BLE001, S110  what observers raise never breaks a run
        pass


def kind_of(error: BaseException) -> str:
    """The name of what was raised; of an error in Python code that Spark ran, the name in the last line of its traceback."""
    if isinstance(error, PythonException):
        lines = [x.strip() for x in str(error).splitlines() if x.strip() and not x.lstrip().startswith(("File ", "at ", "JVM", "^"))]
        names = [m.group(1) for x in lines if (m := _LAST_LINE.match(x)) and m.group(1).endswith(("Error", "Exception", "Iteration", "Interrupt", "Exit", "Warning"))]
        names = [n for n in names if n != "PythonException"]
        return names[-1] if names else "PythonException"
    return type(error).__name__


def _marked(records: DataFrame, failed: Column, kind: Column, name: str) -> DataFrame:
    issue = F.concat(F.lit(f"stage {name} failed: "), kind)
    return records.withColumn("issues", F.when(failed, F.array_append("issues", issue)).otherwise(F.col("issues"))).withColumn("needs_review", F.col("needs_review") | failed)


def _planned(records: DataFrame, stage: Callable[[DataFrame], DataFrame], name: str, key: str) -> DataFrame:
    """What the stage makes of the rows, with FAILED, which tells those that it failed for."""
    try:
        after = stage(records)
        return _joined(records, after, name, key)
    except Exception as error:  # noqa: BLE001  whatever a stage raises is its own
        return _lost(records, name, error)


def _lost(records: DataFrame, name: str, error: BaseException) -> DataFrame:
    return _marked(records, F.lit(True), F.lit(kind_of(error)), name).withColumn(FAILED, F.lit(True))


def _joined(before: DataFrame, after: DataFrame, name: str, key: str) -> DataFrame:
    """What the stage made of each row, or the row as it was where it failed. A stage that cannot fail needs no join."""
    if "failed" not in after.columns:
        return after.withColumn(FAILED, F.lit(False))
    failed = F.col("failed").isNotNull()
    kept = before.select(F.col(key).alias("_key"), F.struct(*before.columns).alias("_was"))
    both = after.join(kept, after[key].eqNullSafe(kept["_key"]))
    shared = [F.when(failed, F.col(f"_was.{c}")).otherwise(F.col(c)).alias(c) if c in before.columns else F.when(~failed, F.col(c)).alias(c) for c in after.columns if c != "failed"]
    return _marked(both.select(*shared, "failed"), failed, F.col("failed"), name).withColumn(FAILED, failed).drop("failed")


def _executed(records: DataFrame, stage: Callable[[DataFrame], DataFrame], name: str, key: str, cut: Cut) -> tuple[DataFrame, int, int, int]:
    """The rows after the stage, written down; how many there are, how many of them failed, and how many jobs that took."""

    def attempt(at: tuple[DataFrame, int]) -> tuple[tuple[DataFrame, int, int] | None, list[DataFrame]]:
        """The part after the stage, or what it is dealt out to."""
        part, depth = at
        try:
            return _cut(_planned(part, stage, name, key), name, cut), []
        except Exception as error:  # noqa: BLE001  whatever a stage raises is its rows'
            if CLUSTER.search(str(error)):
                raise
            parts = _dealt(part, key, depth)
            return (None, parts) if parts else (_cut(_lost(part, name, error), name, cut), [])

    open_, depth, done, tries = [records], 0, [], 0
    while open_:
        # parts of a level are small and apart from each other, so they run side by side
        with ThreadPoolExecutor(FAN) as pool:
            tried = list(pool.map(attempt, [(part, depth) for part in open_]))
        tries, depth = tries + len(open_), depth + 1
        done += [made for made, _ in tried if made]
        open_ = [part for _, parts in tried for part in parts]
    rows, failed, done = sum(n for _, n, _ in done), sum(bad for _, _, bad in done), [made for made, _, _ in done]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done)
    return (whole if len(done) == 1 else cut(whole, name)), rows, failed, tries


def _cut(made: DataFrame, name: str, cut: Cut) -> tuple[DataFrame, int, int]:
    """Write a part down; Spark counts its rows and failures on the way."""
    seen = Observation(f"stage {name}")
    counted = made.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col(FAILED).cast("long")), F.lit(0)).alias("failed"))
    written = cut(counted.drop(FAILED), name)
    return written, seen.get["rows"], seen.get["failed"]


def _dealt(part: DataFrame, key: str, depth: int) -> list[DataFrame]:
    """The part's rows, dealt out by their key and written down by parts, so that each of them, and what it is dealt out to in turn, is read alone; nothing if they have one key."""
    keys = part.agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count(F.when(F.col(key).isNull(), 1)).alias("none"), F.count(F.lit(1)).alias("n")).first()
    if keys.n == keys.none or (keys.a == keys.b and not keys.none):
        return []
    fan, spark = min(FAN, keys.n), part.sparkSession
    at = F.pmod(F.xxhash64(F.lit(depth), F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(fan))
    path = shared_path(spark, "dealt")
    part.withColumn(DEALT, at).write.partitionBy(DEALT).parquet(path)
    held = [r[0] for r in spark.read.schema(f"{DEALT} long").parquet(path).select(DEALT).distinct().collect()]  # the names of at most FAN folders
    return [spark.read.schema(part.schema).parquet(f"{path}/{DEALT}={i}") for i in sorted(held)]


def failures(records: DataFrame) -> DataFrame:
    """O-152. (stage, rows): how many rows each stage failed for, by their issues."""
    issue = records.select(F.explode("issues").alias("issue")).withColumn("stage", F.regexp_extract("issue", r"^stage (\S+) failed: ", 1))
    return issue.filter("stage <> ''").groupBy("stage").agg(F.count("*").alias("rows"))


def usage_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """O-152. (model, calls, cache_hits, live_calls, failures, total_tokens) of this run, from two snapshots of counters that only grow; models without a call go."""
    names = ["calls", "cache_hits", "live_calls", "failures", "total_tokens"]
    old = before.select("model", *[F.col(c).alias(f"_{c}") for c in names])
    out = after.join(old, "model", "left").select("model", *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names])
    return out.filter("calls > 0")


def payload(records: DataFrame) -> DataFrame:
    """O-175. (part_number, sku, input, output, and why) of records, for a reader."""
    has = lambda c: F.col(c) if c in records.columns else F.lit(None)
    given = {"description": "raw_description", "mpn": "raw_mpn", "supplier": "raw_manufacturer", "dept": "dept", "class": "class", "fine": "fine", "brand_hints": "brand_hints"}
    made = ["manufacturer_name", "brand_name", "mpn", "classpath", "product_name", "series", "with_clause", "invoice_desc", "mobile_desc", "short_desc", "long_desc", "retail_desc", "marketing_desc", "mfr_url"]
    rest = ["attributes", "features", "approvals", "extras", "confidence", "provenance", "issues", "needs_review", "citations", "grounded"]
    return records.select(
        "part_number", has("sku").alias("sku"), F.struct(*[has(c).alias(n) for n, c in given.items()]).alias("input"), F.struct(*[has(c).alias(c) for c in made]).alias("output"),
        *[has(c).alias(c) for c in rest], F.coalesce(has("research_note").cast("string"), F.lit("")).alias("research_note"),
    )


def truth(labelled: DataFrame, key: str = "PART_NUMBER", order: str = "row_id") -> DataFrame:
    """O-175. (PART_NUMBER, columns of a labelled row that a reviewer sees): of several rows with one part number the first; null as empty."""
    seen = [c for c in V.TRUTH_COLUMNS if c in labelled.columns]
    first = labelled.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in seen]), order).alias("_r"))
    return first.select(key, *[F.coalesce(F.col(f"_r.`{c}`").cast("string"), F.lit("")).alias(c) for c in seen])


def selected(rows: DataFrame, keys: DataFrame, key: str = "part_number") -> DataFrame:
    """O-078. The rows whose key is listed."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def head_sample(rows: DataFrame, limit: int = 40, order: str = "_row_id") -> DataFrame:
    """O-087. The first rows in input order, 1 to 200 of them, as strings, null as empty."""
    first = rows.orderBy(order).limit(max(1, min(limit, SAMPLE_MOST)))
    return first.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns if c != order])


def coverage_probe(held: DataFrame, registry: Registry) -> DataFrame:
    """O-120. One row: of rows that the fit has not seen, how many have candidate paths, a template for the first of them, and a brand by supplier, hints, part number or words."""
    paths = candidates(held, registry.triples).withColumn("classpath", F.try_element_at("candidates", F.lit(1)))
    found = template_for(paths.filter("classpath is not null").select("row_id", "classpath"), registry.templates, registry.leaves).filter(F.size("labels") > 0).select("row_id", F.lit(True).alias("_template"))
    brands = resolve(held.select("row_id", "supplier", "hints", "mpn", "description"), registry).filter("brand <> ''").select("row_id", F.lit(True).alias("_brand"))
    both = paths.select("row_id", F.col("classpath").isNotNull().alias("_path")).join(found, "row_id", "left").join(brands, "row_id", "left")
    n = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")), F.lit(0))
    return both.agg(F.count("*").alias("rows"), n("_path").alias("with_candidates"), n("_template").alias("with_template"), n("_brand").alias("with_brand"))


def cached_results(records: DataFrame, key: str = "part_number", order: str = "row_id") -> DataFrame:
    """O-189. One result for each part number of a fold, that of the last row with it."""
    return records.groupBy(key).agg(F.max_by(F.struct(*[c for c in records.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def permitted_search(results: DataFrame, permitted: DataFrame, blocked: list[str], document_hosts: list[str], most: int = SEARCH_MOST) -> DataFrame:
    """O-184. (query, url, rank): a query's first results that the policy lets it read, in the order of the search. results: (query, url, at); permitted: (query, permitted), an array of domains."""
    known = results.join(permitted.select("query", "permitted"), "query")
    return _first(known.filter(is_allowed(F.col("url"), F.col("permitted"), blocked, document_hosts)), most)


def third_party_search(results: DataFrame, reputable: list[str], blocked: list[str], shops: list[str], most: int = SEARCH_MOST) -> DataFrame:
    """O-184. The same on reputable third-party domains; an unknown host is none."""
    return _first(results.filter(is_reputable(F.col("url"), reputable, blocked, shops)), most)


def _first(results: DataFrame, most: int) -> DataFrame:
    once = results.groupBy("query", "url").agg(F.min("at").alias("at"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("at", "url"))).filter(F.col("rank") <= most).select("query", "url", "rank")


def readiness(registry: Registry, folds: dict[str, DataFrame], decisions: DataFrame | None = None) -> DataFrame:
    """O-190. (part, name, n): entries of each registry, rows of each fold, decisions, and stages."""
    out = registry.summary().select(F.lit("registry").alias("part"), F.col("registry").alias("name"), F.col("entries").alias("n"))
    for name, rows in folds.items():
        out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit("fold").alias("part"), F.lit(name).alias("name"), "n"))
    if decisions is not None:
        out = out.unionByName(decisions.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("decisions").alias("part"), F.col("status").alias("name"), "n"))
    return out.unionByName(registry.triples.sparkSession.createDataFrame([("stages", "stages", len(V.STAGES))], "part string, name string, n long"))


def knowledge(registry: Registry) -> DataFrame:
    """O-174. (view, key, value): paths, templates, brands and their makers, prefixes, description words and approvals that were learned."""
    view = lambda name, df, key, value: df.select(F.lit(name).alias("view"), F.col(key).cast("string").alias("key"), value.cast("string").alias("value"))
    parts = [
        view("classpaths", registry.triples.select("classpath").distinct(), "classpath", F.lit("")), view("templates", registry.templates, "classpath", F.array_join("labels", ", ")),
        view("brands", registry.makers, "brand", F.col("manufacturer")), view("mpn_prefixes", registry.prefixes, "key", F.col("brand")),
        view("description_tokens", registry.tokens, "key", F.col("brand")), view("approvals", registry.approvals, "token", F.col("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def style_view(styles: DataFrame, templates: DataFrame) -> DataFrame:
    """O-174, O-195. (classpath, surface, rows_learned_from, grammar): of each path with a template, the labels of each surface in their learned order, each with how it is written after its value."""
    known = styles.join(templates.select("classpath"), "classpath", "left_semi")
    shown = F.when(F.coalesce("suffix", F.lit("")) == "", F.col("label_key")).otherwise(F.concat_ws("", "label_key", F.lit("="), "separator", "suffix"))
    rows = known.filter("inclusion >= 0.5").select("classpath", "surface", "rows", F.struct(F.coalesce("rank", F.lit(1e9)).alias("at"), F.col("label_key").alias("label"), shown.alias("shown")).alias("g"))
    return rows.groupBy("classpath", "surface").agg(F.max("rows").alias("rows_learned_from"), F.array_join(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["shown"]), " | ").alias("grammar"))


def samples(values: DataFrame, least: int = 3, most: int = LISTED_MOST) -> DataFrame:
    """O-195. (classpath, label_key, values): the first values, by frequency, of labels that have at least three."""
    order = Window.partitionBy("classpath", "label_key").orderBy(F.desc("n"), "first")
    ranked = values.withColumn("rank", F.row_number().over(order)).withColumn("kinds", F.count("*").over(Window.partitionBy("classpath", "label_key")))
    kept = ranked.filter((F.col("kinds") >= least) & (F.col("rank") <= most))
    return kept.groupBy("classpath", "label_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("values"))
