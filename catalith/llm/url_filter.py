"""URL filter: rules by host and path first, then the ratio of two character language models.

The models are variable-order Markov models of bytes, up to `ORDER` bytes of context, smoothed by Witten-Bell
interpolation down to the uniform distribution: one of accepted, one of rejected URLs. A URL that no rule fits
is scored by the difference of its log-likelihoods in bits, divided by its length, and allowed if the score
reaches a threshold. The threshold is that of least balanced error over all URLs that the rules decide; of equally good ones
the one nearest zero is taken.

The models count all URLs that the rules decide, whole. For the threshold each of them is scored by models that have not seen it: URLs are dealt out to `FOLDS` folds by their
hash, equal ones to the same, and a fold is scored by the counts of the others. Nothing is sampled. Counts are taken by partition, then
summed by window and fold, and stay a distributed table, as do the bits of each different window of all URLs, which joins of windows with their
shorter ends give. Only the bits of the `COMMON` most frequent windows go to the driver and the workers, whatever the size of the corpus; a
URL's other windows are joined with the table. Bits are held as multiples of 2**-32, so that sums don't depend on their order.

Defined cases: a null url and one without `://` have empty host and path, fit no rule and are scored as they
stand, null as empty; an empty string scores 0; where rules of one verdict only have URLs, the other model is
uniform; repeated rows are judged alike; an empty table gives an empty table; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import string
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import written

ORDER, FOLDS = 5, 2
#: Ranges of scores, for each bit a byte, whose totals are summed before the scores within them are.
RANGES = 1_000
#: Windows that a task counts before it hands them on.
COUNTED = 1_000_000
#: Windows whose bits every worker holds, and windows so short that all their counts may be broadcast (at most 256**2).
COMMON, SHORT = 200_000, 2
#: Bits are whole multiples of 1 / FINE.
FINE = 1 << 32
ALLOW, BLOCK = "allow", "block"

Rule = tuple[str, str, str]  # host, path, verdict

_tables: dict[str, dict[bytes, int]] = {}


def calibrate(accepted: list[float], rejected: list[float]) -> float:
    """The threshold of least balanced error."""
    if not accepted or not rejected:
        return 0.0
    points = sorted({*accepted, *rejected})
    tries = [0.0, *((a + b) / 2 for a, b in zip(points, points[1:], strict=False))]
    error = lambda t: sum(s < t for s in accepted) / len(accepted) + sum(s >= t for s in rejected) / len(rejected)
    return min(tries, key=lambda t: (error(t), abs(t)))


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits: struct(rule, verdict), null if none does. Among equally long ones a block goes first."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != BLOCK, r[0]))
    listed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    first = F.try_element_at(fits, F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, url, host, path, rule, verdict): what the rules say."""
    host, path = host_and_path()
    out = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    out = out.withColumn("best", best_rule(rules, F.col("host"), F.col("path")))
    return out.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def windows(text: bytes, order: int = ORDER) -> Iterator[bytes]:
    """Each byte with each context of at most `order` bytes before it."""
    return (text[i - n : i + 1] for i in range(len(text)) for n in range(min(order, i) + 1))


def scored_windows(text: bytes, order: int = ORDER) -> list[bytes]:
    """Each byte with the longest context that it has, of at most `order` bytes."""
    return [text[max(0, i - order) : i + 1] for i in range(len(text))]


def _tallies(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...], of) -> Iterator[pa.RecordBatch]:
    """(kind, window, n), summed while the task goes on. of(url, verdict): a kind and windows."""
    seen = {kind: Counter() for kind in kinds}

    def counted() -> Iterator[pa.RecordBatch]:
        for kind, counts in seen.items():
            if counts:
                yield pa.record_batch({"kind": pa.array([kind] * len(counts)), "window": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})
                counts.clear()

    for batch in batches:
        for url, verdict in zip(batch.column("url").to_pylist(), batch.column("verdict").to_pylist(), strict=True):
            kind, found = of(url.encode(), verdict)
            seen[kind].update(found)
            if len(seen[kind]) > COUNTED:
                yield from counted()
    yield from counted()


def _model_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tallies(batches, (ALLOW, BLOCK), lambda url, verdict: (verdict, windows(url)))


def _scored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tallies(batches, ("",), lambda url, _: ("", scored_windows(url)))


TALLY = "kind string, window binary, n long"


def held_out(rows: DataFrame, most: int) -> Column:
    """A bounded choice of ruled rows, for a look at their scores; `classify` takes all of them."""
    counts = dict(rows.filter(F.col("verdict").isNotNull()).groupBy("verdict").count().collect())
    share = lambda verdict: F.lit(min(0.2, most / max(1, counts.get(verdict, 0))))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    return F.col("verdict").isNotNull() & (draw < F.when(F.col("verdict") == ALLOW, share(ALLOW)).otherwise(share(BLOCK)))


def model(rows: DataFrame) -> DataFrame:
    """(window, allow, block): how often accepted and rejected URLs have each byte with each of its contexts."""
    tally = rows.select("url", "verdict").mapInArrow(_model_rows, TALLY)
    n = lambda verdict: F.coalesce(F.sum(F.when(F.col("kind") == verdict, F.col("n"))), F.lit(0)).alias(verdict)
    return tally.groupBy("window").agg(n(ALLOW), n(BLOCK))


def _ends(c: str | Column, n: Column) -> Column:
    """The last n bytes."""
    return F.substring(c, F.octet_length(c) - n + 1, n)


def bits(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """wanted (window, ...) with `bits`: the log ratio of the models' probabilities of the window's last byte after the others, in units of 1 / FINE.
    Each longer context mixes its counts with the estimate of the one below."""
    context = F.substring("window", F.lit(1), F.octet_length("window") - 1)
    of = lambda v: (F.sum(v).alias(f"total_{v}"), F.sum((F.col(v) > 0).cast("long")).alias(f"kinds_{v}"))
    contexts = written(counts.groupBy(context.alias("context")).agg(*of(ALLOW), *of(BLOCK)), "contexts")
    ends = wanted.select("window", F.explode(F.sequence(F.lit(1), F.octet_length("window"))).alias("length"))
    ends = ends.withColumn("end", _ends(F.col("window"), F.col("length"))).withColumn("context", F.substring("end", F.lit(1), F.octet_length("end") - 1))
    keyed = counts.withColumnRenamed("window", "end")

    def met(part: DataFrame, short: bool) -> DataFrame:
        """Short ends are few and each is that of many windows; all others are joined by shuffle."""
        here = (F.octet_length("end") <= SHORT) if short else (F.octet_length("end") > SHORT)
        there = (F.octet_length("context") < SHORT) if short else (F.octet_length("context") >= SHORT)
        hint = F.broadcast if short else (lambda x: x)
        return part.filter(here).join(hint(keyed.filter(here)), "end", "left").join(hint(contexts.filter(there)), "context", "left")

    chain = met(ends, True).unionByName(met(ends, False))
    parts = ["length", *[f"{c}{v}" for v in (ALLOW, BLOCK) for c in ("", "total_", "kinds_")]]
    chain = chain.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("chain"))

    def probability(v: str) -> Column:
        def longer(p: Column, x: Column) -> Column:
            kinds = x[f"kinds_{v}"]
            return F.when(kinds > 0, (F.coalesce(x[v], F.lit(0)) + kinds * p) / (x[f"total_{v}"] + kinds)).otherwise(p)

        return F.aggregate("chain", F.lit(1 / 256), longer)

    found = chain.select("window", probability(ALLOW).alias("a"), probability(BLOCK).alias("b"))
    found = found.select("window", F.round(F.log2(F.col("a") / F.col("b")) * FINE).cast("long").alias("bits"))
    return wanted.join(found, "window")


def _summed(common: dict[bytes, int]):
    """(number, bits, rest): a URL's sum over its common windows, and its other windows."""
    key = uuid.uuid4().hex
    packed = pa.table({"window": pa.array(list(common), pa.binary()), "bits": pa.array(list(common.values()), pa.int64())})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _tables:
            _tables.clear()
            _tables[key] = dict(zip(packed.column("window").to_pylist(), packed.column("bits").to_pylist(), strict=True))
        get = _tables[key].get
        for batch in batches:
            sums, rest = [], []
            for url in batch.column("url").to_pylist():
                found = [(w, get(w)) for w in scored_windows(url.encode())]
                sums.append(sum(b for _, b in found if b is not None))
                rest.append([w for w, b in found if b is None])
            yield pa.record_batch({"number": batch.column("number"), "bits": pa.array(sums, pa.int64()), "rest": pa.array(rest, pa.list_(pa.binary()))})

    return rows


def scores(rows: DataFrame, table: DataFrame, common: int = COMMON) -> DataFrame:
    """(number, score) of every row (number, url). table: (window, n, bits) of all windows of these URLs."""
    top = table.orderBy(F.desc("n"), "window").limit(common).select("window", "bits").toArrow()
    held = dict(zip(top.column("window").to_pylist(), top.column("bits").to_pylist(), strict=True))
    parts = written(rows.select("number", "url").mapInArrow(_summed(held), "number long, bits long, rest array<binary>"), "sums")
    rest = parts.filter(F.size("rest") > 0).select("number", F.explode("rest").alias("window")).join(table.select("window", F.col("bits").alias("more")), "window")
    rest = rest.groupBy("number").agg(F.sum("more").alias("more"))
    total = (F.col("bits") + F.coalesce("more", F.lit(0))) / FINE
    size = rows.select("number", F.octet_length("url").alias("size"))
    return parts.select("number", "bits").join(rest, "number", "left").join(size, "number").select("number", F.when(F.col("size") > 0, total / F.col("size")).otherwise(0.0).alias("score"))


def _added(parts: list[DataFrame]) -> DataFrame:
    """The counts of several models as one."""
    return reduce(DataFrame.unionByName, parts).groupBy("window").agg(F.sum(ALLOW).alias(ALLOW), F.sum(BLOCK).alias(BLOCK))


def _scored(rows: DataFrame, counts: DataFrame, common: int) -> DataFrame:
    """(number, score) of rows (number, url, verdict) by the models of these counts."""
    wanted = rows.select("url", "verdict").mapInArrow(_scored_rows, TALLY).groupBy("window").agg(F.sum("n").alias("n"))
    return written(scores(rows, written(bits(written(wanted, "windows"), counts), "bits"), common), "scores")


def threshold(scored: DataFrame) -> float:
    """The threshold of least balanced error over all rows (verdict, score), as `calibrate` finds it for lists. Errors are summed up to each range of scores, then to each score within its range;
    there are as many ranges as the scores' bits need, however many rows."""
    n = lambda verdict: F.sum((F.col("verdict") == verdict).cast("long"))
    points = scored.groupBy("score").agg(n(ALLOW).alias("a"), n(BLOCK).alias("b")).withColumn("range", F.floor(F.col("score") * RANGES))
    points = written(points, "points")
    ranges = points.groupBy("range").agg(F.sum("a").alias("in_a"), F.sum("b").alias("in_b"), F.min("score").alias("least"))
    total = ranges.agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b")).first()
    if not total.a or not total.b:
        return 0.0
    along = Window.orderBy("range")
    before = lambda c: F.coalesce(F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("range", before("in_a").alias("before_a"), before("in_b").alias("before_b"), F.lead("least").over(along).alias("after"))
    within = Window.partitionBy("range").orderBy("score")
    met = points.join(ranges, "range").withColumn("next", F.coalesce(F.lead("score").over(within), "after"))
    upto = lambda c: F.col(f"before_{c}") + F.sum(c).over(within)
    tries = met.select(((F.col("score") + F.col("next")) / 2).alias("t"), upto("a").alias("under"), (F.lit(total.b) - upto("b")).alias("over")).filter("t is not null")
    zero = points.agg(F.lit(0.0).alias("t"), F.sum(F.when(F.col("score") < 0, F.col("a")).otherwise(0)).alias("under"), F.sum(F.when(F.col("score") >= 0, F.col("b")).otherwise(0)).alias("over"))
    error = F.col("under") / total.a + F.col("over") / total.b
    return zero.unionByName(tries).orderBy(error, F.abs("t"), "t").first().t


def classify(pages: DataFrame, rules: list[Rule], folds: int = FOLDS, common: int = COMMON) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row. folds: of the ruled URLs, for the threshold; with fewer than two it is zero."""
    rows = judged(pages, rules).withColumn("number", F.monotonically_increasing_id())
    rows = written(rows.withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(max(1, folds)))), "judged")  # from here on a row's number stays
    ruled = [rows.filter(F.col("verdict").isNotNull() & (F.col("fold") == i)) for i in range(max(1, folds))]
    parts = [written(model(r), "model") for r in ruled]
    counts = written(_added(parts), "counts") if len(parts) > 1 else parts[0]
    found = rows.join(_scored(rows, counts, common), "number")
    at = 0.0
    if folds > 1:
        unseen = [_scored(r, written(_added(parts[:i] + parts[i + 1 :]), "others"), common).join(r.select("number", "verdict"), "number") for i, r in enumerate(ruled)]
        at = threshold(reduce(DataFrame.unionByName, unseen))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= at, ALLOW).otherwise(BLOCK))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
