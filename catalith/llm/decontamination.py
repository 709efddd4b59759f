"""Benchmark decontamination by a prefix-filtered set join, by DataFrame and SQL functions only.

Every item gives its windows: so many consecutive words, or all of an item that has fewer. A window occurs in a document only if all of its words do,
so it is enough to look for some necessary ones, its prefix in the order of rarity. That order comes from counting, over all documents, the words that items use.

* Join: a document's words meet the rarest word of each window.
* Position: the window's second rarest word must stand at its distance from there.
* Length: the window must begin and end within the document.
* Verification: the words in that place must equal the window's, one by one.

Distinct windows are broadcast in blocks of `BLOCK` at most; a benchmark with more of them is taken block by block, each with a pass over the documents.
No document's words are shuffled. A marker in front of each text meets a row of its own, so every document comes out of the join once at least, with its number of words.

Defined cases: a null text has no words, and neither has an empty one; an item without words has no windows; an item without an id hits words, but is
not counted or listed; items that repeat an id are one item; repeated documents are judged alike and each has a row; null ids too; where items share a
window all of them are listed; an empty benchmark leaves every document clean, empty documents give an empty table; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import written

WORDS, BLOCK = 10, 100_000
#: Windows in a file of the table of prefixes.
FILE_ROWS = 10_000
#: What separates words of a text in lower case. Upper-case letters, which such a text has no more, are words, so that one can mark its beginning.
SEPARATORS, MARK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "A"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(column: str = "text") -> Column:
    """A marker and the words of a text, A-Z in lower case; the last one may be empty."""
    text = F.coalesce(column, F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))
    return F.split(F.concat(F.lit(f"{MARK} "), low), SEPARATORS)


def windows(items: DataFrame, size: int = WORDS) -> DataFrame:
    """(window, items) of every distinct window: its words and the items that have it."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of().alias("words"))
    words = words.select("item_id", F.filter(F.slice("words", 2, F.size("words")), lambda w: w != "").alias("words")).filter(F.size("words") > 0)
    places = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    each = words.select("item_id", F.posexplode(places).alias("_", "at"), "words").select("item_id", F.slice("words", F.col("at"), size).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item_id").alias("items"))


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, words, at, word): each word of each document, `mark` being two hashes of the row."""
    rows = docs.select("doc_id", F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"), F.col("text").isNull().alias("none")).alias("mark"), words_of().alias("words"))
    return rows.select("doc_id", "mark", "words", F.posexplode_outer("words").alias("at", "word"))  # outer: or Spark would split twice, to leave out empty arrays


def rarity(docs: DataFrame, used: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n) of the used words: how often each occurs in all documents."""
    words = docs.select(words_of().alias("words")).select(F.explode_outer("words").alias("word"))
    counts = [words.join(F.broadcast(part), "word").groupBy("word").agg(F.count("*").alias("n")) for part in blocks(used, "word", block)]
    return used.join(reduce(DataFrame.unionByName, counts), "word", "left").na.fill(0, ["n"])


def blocks(rows: DataFrame, key: str, most: int) -> list[DataFrame]:
    """Rows dealt by a hash into blocks of about `most` at most."""
    n = -(-rows.count() // most) or 1
    return [rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)] if n > 1 else [rows]


def prefixes(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, before, second, ahead, window, items): a window's rarest word with the number of words before it, and the second rarest with its distance."""
    each = found.withColumn("key", F.xxhash64("window")).select("window", "key", "items", F.posexplode("window").alias("before", "word"))
    order = each.join(counts, "word").groupBy("key", "window").agg(F.array_sort(F.collect_list(F.struct("n", "word", "before"))).alias("order"), F.first("items").alias("items"))
    first, second = F.col("order")[0], F.coalesce(F.try_element_at("order", F.lit(2)), F.col("order")[0])
    return order.select(first.word.alias("word"), first.before.alias("before"), second.word.alias("second"), (second.before - first.before).alias("ahead"), "window", "items")


def occurrences(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, mark, n_words, start, size, items) of each window in each document; of size 0 where the marker is the window."""
    words = positions(docs)
    start = F.col("at") - F.col("before")  # the marker is at 0
    near = F.get("words", F.col("at") + F.col("ahead")) == F.col("second")
    inside = (start >= F.when(F.col("word") == MARK, 0).otherwise(1)) & (start + F.col("size") <= F.size("words"))
    met = words.join(F.broadcast(heads.withColumn("size", F.size("window"))), "word")
    met = met.filter(inside).filter(near).filter(F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("size")) == F.col("window"))
    n_words = F.size("words") - 1 - (F.element_at("words", -1) == "").cast("int")
    return met.select("doc_id", "mark", n_words.cast("long").alias("n_words"), start.alias("start"), F.when(F.col("word") == MARK, 0).otherwise(F.col("size")).alias("size"), "items")


def covered(spans: str = "spans") -> Column:
    """How many words lie in spans of (start, size)."""
    return F.expr(f"""aggregate(array_sort({spans}), named_struct('n', 0L, 'end', 0L),
        (s, x) -> named_struct('n', s.n + greatest(x.start + x.size - greatest(s.end, x.start), 0), 'end', greatest(s.end, cast(x.start + x.size AS bigint))), s -> s.n)""")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) of every document; items: the ids of those with a window in it, in order."""
    found = windows(items, size)
    used = found.select(F.explode("window").alias("word")).distinct()
    counts, some = rarity(docs, used, block), used.count() <= block
    heads = written(prefixes(found, F.broadcast(counts) if some else counts), "prefixes", files=1 + found.count() // FILE_ROWS)
    mark, none = F.lit(MARK).alias, F.lit(0).alias
    marker = docs.sparkSession.range(1).select(mark("word"), none("before"), mark("second"), none("ahead"), F.array(F.lit(MARK)).alias("window"), F.array().cast("array<string>").alias("items"))
    parts = [occurrences(docs, part.unionByName(marker) if i == 0 else part) for i, part in enumerate(blocks(heads, "window", block))]
    rows = reduce(DataFrame.unionByName, parts)
    hit = F.when(F.col("size") > 0, F.struct("start", "size"))
    judged = rows.groupBy("doc_id", "mark").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(hit).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("copies"),
    )
    judged = judged.select("doc_id", "n_words", covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.col("copies").cast("int").alias("copies"))
    return judged.withColumn("contaminated", F.col("n_hit") > 0).withColumn("_", F.explode(F.sequence(F.lit(1), "copies"))).drop("_", "copies")
