"""Lookup joins against fitted registries (O-088..O-102, O-076, O-131).

Registries grow with brands and paths, not with rows, but nothing bounds them, so no join here is forced to broadcast: Spark
does so by the sizes it sees. Candidates travel as arrays of one key.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.similarity import ratio_column, token_sort_column
from catalith.functions.text import clean, folded, match_key
from catalith.operators.registry import Registry, stem_of, words_of
from catalith.operators.snap import best
from catalith.session import written

SHORT, PREFIX_LEAST, LENGTHS, FLOOR, TEMPLATE_FLOOR, TRUSTED = 3, 6, 0.55, 88.0, 70.0, 0.75
FALLBACK_LIMIT = 25
#: The registries that `resolve` looks things up in, some of them several times.
RESOLVES_BY = ("brands", "suppliers", "prefixes", "tokens", "makers")
#: A floor that is tried before the one that counts: most paths that are like another one are very like it.
TEMPLATE_LEVELS = (85.0,)


def first_match_join(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """O-088. Inner join with the first row of each key of the right side."""
    first = right.groupBy(key).agg(F.min_by(F.struct(*[c for c in right.columns if c != key]), order).alias("_r"))
    return left.join(first, key).select(left["*"], *[F.col(f"_r.{c}").alias(c) for c in right.columns if c not in left.columns])


def _ranked(counts: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    merged = counts.groupBy(*keys, "classpath").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    merged = merged.withColumn("rank", F.row_number().over(order))
    if limit:
        merged = merged.filter(F.col("rank") <= limit)
    return merged.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "classpath"))), lambda x: x["classpath"]).alias("paths"))


def candidates(rows: DataFrame, triples: DataFrame) -> DataFrame:
    """O-090. rows with `candidates` and `level`: paths of the whole triple, else of (dept, class), else of dept; fallbacks give 25 at most."""
    keyed = rows.withColumns({f"_{c}": folded(F.col(c)) for c in ("dept", "class", "fine")})
    for name, keys, limit in (("_3", ["dept", "class", "fine"], None), ("_2", ["dept", "class"], FALLBACK_LIMIT), ("_1", ["dept"], FALLBACK_LIMIT)):
        level = _ranked(triples, keys, limit).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("paths").alias(f"paths{name}"))
        keyed = keyed.join(level, [f"_{k}" for k in keys], "left")
    level = F.when(F.col("paths_3").isNotNull(), 3).when(F.col("paths_2").isNotNull(), 2).when(F.col("paths_1").isNotNull(), 1).otherwise(0)
    found = F.coalesce("paths_3", "paths_2", "paths_1", F.array().cast("array<string>"))
    return keyed.select(*rows.columns, found.alias("candidates"), level.alias("level"))


def by_prefix(rows: DataFrame, prefixes: DataFrame, mpn: str = "mpn", key: str = "row_id") -> DataFrame:
    """O-092. (key, brand, prefix): the brand of the longest known prefix of 2 to 5 characters of a part number. A lookup for each length, so rows are
    neither multiplied nor brought together again."""
    out = rows.select(key, stem_of(F.col(mpn)).alias("_stem"))
    lengths = (5, 4, 3, 2)
    for n in lengths:
        of_length = prefixes.filter(F.length("key") == n).select(F.col("key").alias(f"_p{n}"), F.struct("brand", F.col("key").alias("prefix")).alias(f"_h{n}"))
        out = out.withColumn(f"_p{n}", F.substring("_stem", 1, n)).join(of_length, f"_p{n}", "left")
    return out.select(key, F.coalesce(*[F.col(f"_h{n}") for n in lengths]).alias("h")).filter("h is not null").select(key, "h.*")


def by_token(rows: DataFrame, tokens: DataFrame, description: str = "description", key: str = "row_id") -> DataFrame:
    """O-093. (key, brand, token): the brand of the first description word that is known."""
    tries = rows.select(key, F.posexplode(words_of(F.col(description))).alias("at", "token")).withColumn("word", F.lower("token"))
    hits = tries.join(tokens.select(F.col("key").alias("word"), "brand"), "word")
    return hits.groupBy(key).agg(F.min_by(F.struct("brand", "token"), "at").alias("h")).select(key, "h.*")


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda w: w != "")), " ")


def close_pairs(left: DataFrame, right: DataFrame, floor: float, form: Callable[[Column], Column] = lambda c: c, size: int = 2) -> DataFrame:
    """(key, match): all pairs of left.key and right.match that may score `floor` at least by `ratio`, of what `form` makes of them, and others.

    At that score a name of n letters keeps a common part of share s = floor / 200 of both lengths, so its partner has n * s / (1 - s) to n * (1 - s) / s letters, and it
    loses n * (1 - s / (1 - s)) letters at most. Each lost letter breaks `size` of its grams, so among its rarest ones, more than that many by their number, one at least is its partner's.
    Names meet by such a gram and the partner's length, so a common gram is met by those names alone that have none but common ones. A size at which a name could lose all its grams is an error."""
    s = floor / 200
    keep = s / (1 - s)
    if any(n - size + 1 <= math.floor(n * (1 - keep) * size + 1e-6) for n in range(size, 1_000)) or any(math.floor(n / keep + 1e-6) > n for n in range(1, size)):
        raise ValueError(f"names at {floor} may share no gram of {size} letters")
    grams = lambda c: F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array(c))
    names = right.select("match", form(F.col("match")).alias("_m")).filter("_m <> ''")
    theirs = names.select("match", F.length("_m").alias("length"), F.explode(F.array_distinct(grams(F.col("_m")))).alias("gram"))
    often = theirs.groupBy("gram").agg(F.count("*").alias("often"))
    asked = left.select("key", form(F.col("key")).alias("_k")).filter("_k <> ''").distinct()
    own = asked.select("key", F.length("_k").alias("n"), F.explode(grams(F.col("_k"))).alias("gram")).groupBy("key", "n", "gram").agg(F.count("*").alias("times"))
    own = own.join(often, "gram", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    before = Window.partitionBy("key").orderBy("often", "gram").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.floor(F.col("n") * (1 - keep) * size + 1e-6)
    rare = own.withColumn("before", F.coalesce(F.sum("times").over(before), F.lit(0))).filter((F.col("before") <= lost) & (F.col("often") > 0))
    spans = F.sequence(F.ceil(F.col("n") * keep - 1e-6).cast("int"), F.floor(F.col("n") / keep + 1e-6).cast("int"))
    return rare.select("key", "gram", F.explode(spans).alias("length")).join(theirs, ["gram", "length"]).select("key", "match").distinct()


def one_apart(left: DataFrame, right: DataFrame, form: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(key, match): all pairs of left.key and right.match that are equal in what `form` makes of them, or of which one has a letter more. They meet by equal strings: a name as it is, and without each of its letters."""
    less = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    keys = left.select("key", form(F.col("key")).alias("_f")).filter("_f <> ''")
    names = right.select("match", form(F.col("match")).alias("_f")).filter("_f <> ''")
    longer = keys.select("key", F.explode(F.array_union(F.array("_f"), less(F.col("_f")))).alias("_f")).join(names, "_f")
    shorter = names.select("match", F.explode(F.array_distinct(less(F.col("_f")))).alias("_f")).join(keys, "_f")
    return longer.select("key", "match").unionByName(shorter.select("key", "match")).distinct()


def _alike(pairs: DataFrame) -> DataFrame:
    """(key, match, score): of the pairs, each key's most similar name of comparable length, at the floor or more; the last one among equals."""
    a, b = F.col("key"), F.col("match")
    near = pairs.filter(F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)) >= LENGTHS)
    near = near.withColumn("score", F.greatest(ratio_column(a, b), token_sort_column(a, b))).filter(F.col("score") >= FLOOR)
    return near.groupBy("key").agg(F.max(F.struct("score", "match")).alias("b")).select("key", "b.match", "b.score")


def safe_match(keys: DataFrame, table: DataFrame) -> DataFrame:
    """O-076. (key, match) of `keys.key` in `table.key`: up to three characters only exact; then the longest name of six characters or more
    that one is a whole-word beginning of the other; then the most similar of comparable length, at 88 or more.

    Pairs are not all compared: prefixes meet by equal keys; names that differ by one letter by what is left of them (`one_apart`), and as a pair that differs by two scores n / (n + 1) at most for a key of n letters,
    a key that scores more there is done; only the others meet by their rarest grams (`close_pairs`). Both once as names stand and once with their words in order. Keys, names and what is open are written down, as several steps read them."""
    keys = written(keys.select("key").filter("key <> ''").distinct(), "keys")
    names = written(table.select(F.col("key").alias("match")).filter("match <> ''").distinct(), "names")
    exact = keys.join(names.select(F.col("match").alias("key")), "key").filter(F.length("key") <= SHORT).select("key", F.col("key").alias("match"))
    long = keys.filter(F.length("key") > SHORT)
    starts = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(c, " "))), lambda n: F.array_join(F.slice(F.split(c, " "), 1, n), " ")))
    down = long.select("key", starts(F.col("key")).alias("match")).filter("key <> match").join(names, "match")
    up = names.select("match", starts(F.col("match")).alias("key")).filter("key <> match").join(long, "key")
    prefix = down.select("key", "match").unionByName(up.select("key", "match")).filter(F.length("match") >= PREFIX_LEAST)
    prefix = written(prefix.groupBy("key").agg(F.max_by("match", F.struct(F.length("match"), "match")).alias("match")), "prefix")
    rest = long.join(prefix, "key", "left_anti")
    size = F.greatest(F.length("key"), F.length(sorted_words(F.col("key"))))
    first = _alike(one_apart(rest, names).unionByName(one_apart(rest, names, sorted_words)).distinct())
    first = written(first.filter(F.col("score") > 100 * size / (size + 1) + 1e-9), "first")
    found = exact.unionByName(prefix).unionByName(first.select("key", "match"))
    rest = written(rest.join(first, "key", "left_anti"), "open")
    if not rest.take(1):
        return found
    pairs = close_pairs(rest, names, FLOOR).unionByName(close_pairs(rest, names, FLOOR, sorted_words)).distinct()
    return found.unionByName(_alike(pairs).select("key", "match"))


def canonical(rows: DataFrame, column: str, forms: DataFrame, spelling: str, out: str) -> DataFrame:
    """O-096. rows with `out`: the approved spelling of the column by its key, else by a safe match, else the clean value. forms: (key, spelling)."""
    keyed = rows.withColumn("_key", match_key(F.col(column)))
    missing = keyed.select(F.col("_key").alias("key")).distinct().join(forms.select("key"), "key", "left_anti")
    near = safe_match(missing, forms).join(forms.select(F.col("key").alias("match"), F.col(spelling).alias("near")), "match").select(F.col("key").alias("_key"), "near")
    known = forms.select(F.col("key").alias("_key"), F.col(spelling).alias("exact"))
    return keyed.join(known, "_key", "left").join(near, "_key", "left").withColumn(out, F.coalesce("exact", "near", clean(F.col(column)))).drop("_key", "exact", "near")


def resolve(rows: DataFrame, registry: Registry) -> DataFrame:
    """O-095. rows with `manufacturer`, `brand`, `confidence` and `provenance` by the first rule that answers.

    1 a brand hint that only ever meant one brand; 2 the part number's prefix; 3 an ambiguous hint's usual meaning; 4 a hint by safe match;
    5 the supplier, if trusted; 6 a word of the description; 7 the supplier all the same. rows: row_id, supplier, hints, mpn, description.
    """
    hints = rows.select("row_id", F.posexplode("hints").alias("at", "hint")).withColumn("key", match_key(F.col("hint"))).filter("key <> ''")
    known = hints.join(registry.brands, "key", "left")
    plain = known.filter("not ambiguous").groupBy("row_id").agg(F.min_by("brand", "at").alias("brand"))
    vague = known.filter("ambiguous").groupBy("row_id").agg(F.min_by("brand", "at").alias("brand"))
    # known keys too: a safe match of a known key may still be a longer name
    near = safe_match(hints.select("key"), registry.brands).join(registry.brands.select(F.col("key").alias("match"), "brand"), "match").select("key", "brand")
    near = hints.join(near, "key").groupBy("row_id").agg(F.min_by("brand", "at").alias("brand"))
    supplied = rows.select("row_id", match_key(F.col("supplier")).alias("key")).filter("key <> ''")
    direct = registry.suppliers.withColumnRenamed("supplier_key", "key")
    missing = supplied.select("key").distinct().join(direct.select("key"), "key", "left_anti")
    alias = safe_match(missing, direct.select("key")).select(F.col("key").alias("_k"), F.col("match").alias("key"))
    by_supplier = supplied.join(direct, "key").unionByName(supplied.withColumnRenamed("key", "_k").join(alias, "_k").drop("_k").join(direct, "key"), allowMissingColumns=True)
    answer = lambda df, brand, confidence, provenance: df.select("row_id", F.struct(brand.alias("brand"), F.lit(None).cast("string").alias("own"), confidence.alias("confidence"), provenance.alias("provenance")).alias("r"))
    b = F.col("brand")
    supplier = by_supplier.select("row_id", F.struct(b.alias("brand"), F.col("manufacturer").alias("own"), F.col("confidence"), F.concat(F.lit("supplier:"), F.format_string("%.2f", F.col("share"))).alias("provenance")).alias("r"))
    rules = [
        answer(plain, b, F.lit(0.97), F.lit("brand-exact")),
        answer(by_prefix(rows, registry.prefixes), b, F.lit(0.93), F.concat(F.lit("mpn-prefix:"), "prefix")),
        answer(vague, b, F.lit(0.80), F.lit("brand-exact-ambiguous")),
        answer(near, b, F.lit(0.88), F.lit("brand-fuzzy")),
        supplier.filter(F.col("r.confidence") >= TRUSTED),
        answer(by_token(rows, registry.tokens), b, F.lit(0.84), F.concat(F.lit("desc-token:"), "token")),
        supplier,
    ]
    tries = None
    for rank, rule in enumerate(rules):
        part = rule.withColumn("rank", F.lit(rank))
        tries = part if tries is None else tries.unionByName(part)
    best = tries.groupBy("row_id").agg(F.min_by("r", "rank").alias("r"))
    out = rows.drop("manufacturer", "brand").join(best, "row_id", "left").withColumn("_brand", F.col("r.brand"))
    makers = registry.makers.select(F.col("brand").alias("_brand"), F.col("manufacturer").alias("_maker"))
    out = out.join(makers, "_brand", "left")
    return out.select(
        *[c for c in rows.columns if c not in ("manufacturer", "brand")],
        F.coalesce("r.own", "_maker", F.lit("")).alias("manufacturer"), F.coalesce("_brand", F.lit("")).alias("brand"),
        F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("r.provenance", F.lit("unresolved")).alias("provenance"),
    )


def first_of_two(rows: DataFrame, first: str, second: str, table: DataFrame, key: str, value: str, out: str, default: Column) -> DataFrame:
    """O-100. rows with `out`: the value of the first key, else of the second, else the default."""
    a, b = (table.select(F.col(key).alias(f"_{i}"), F.col(value).alias(f"_v{i}")) for i in (1, 2))
    keyed = rows.withColumn("_1", F.col(first)).withColumn("_2", F.col(second))
    return keyed.join(a, "_1", "left").join(b, "_2", "left").withColumn(out, F.coalesce("_v1", "_v2", default)).drop("_1", "_2", "_v1", "_v2")


def template_for(rows: DataFrame, templates: DataFrame, leaves: DataFrame, path: str = "classpath") -> DataFrame:
    """O-101. rows with `labels`: the path's own template, else that of the path its last node is known by, else the most similar one at 70 or more, else none."""
    own = templates.select(F.col("classpath").alias(path), F.col("labels").alias("_own"))
    leaf = leaves.join(templates, "classpath", "left").select("leaf", F.coalesce("labels", F.array().cast("array<string>")).alias("_leaf"))
    out = rows.withColumn("leaf", F.trim(F.element_at(F.split(path, ">"), -1))).join(own, path, "left").join(leaf, "leaf", "left")
    lost = out.filter("_own is null and _leaf is null").select(F.col(path).alias("_p")).distinct()
    listed = templates.select(F.col("classpath").alias("value"), F.col("classpath").alias("priority"))
    found = best(lost.withColumnRenamed("_p", "key"), listed, [], TEMPLATE_FLOOR, "token_set", last=True, levels=TEMPLATE_LEVELS)
    near = found.join(templates.select(F.col("classpath").alias("value"), F.col("labels").alias("_near")), "value").select(F.col("key").alias(path), "_near")
    return out.join(near, path, "left").select(*rows.columns, F.coalesce("_own", "_leaf", "_near", F.array().cast("array<string>")).alias("labels"))


def header_difference(have: list[str], want: list[str], spark) -> DataFrame:
    """O-102. (header, problem): headers that are missing, added or out of place."""
    listed = lambda names, at: spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"header string, {at} int")
    a, b = listed(have, "have"), listed(want, "want")
    both = a.join(b, "header", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "added").when(F.col("have") != F.col("want"), "misordered")
    return both.select("header", problem.alias("problem"), "have", "want").filter("problem is not null")
