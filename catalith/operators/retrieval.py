"""Similarity search by TF-IDF over character grams within words (O-097, O-121, O-122, O-123), by built-in expressions; products of blocks by numpy on Arrow.

A word is padded with one space on each side; for n from 3 to 5 all its n-grams count, and a padded word no longer than n
counts once and ends there. Weights are (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), scaled to length one. A query's grams
that no labelled row has are dropped before scaling.

The k best are found with bounds. Grams of at most `HEAVY` rows are met first, by an equi-join; a query's k-th best sum of these is a floor under its k-th best score. What the other grams, each with its greatest
weight, can add at most tells what is left to do:

* less than the floor: no row that shares only those can be among the best. Of the rows found, those that could still reach the floor get their scores completed, row by row.
* the floor or more: the query is open, and meets the rows of the frequent grams too, each dealt out over parts of at most `HEAVY` rows.

So no key of a join holds more than `HEAVY` rows, and results are those of adding up all grams.

Where texts are made of few words, nearly all pairs meet, and by many grams each: more meetings than half the pairs. Then queries and rows are dealt out in blocks of about `BLOCK`, and each pair of blocks is one
product of matrices, over the grams that both have, of which the k best rows of each query go on. That is all pairs, in bounded memory. Scores are ordered by nine digits, equal ones by descending row_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from catalith.functions.text import query_text
from catalith.session import prepare, written

SMALLEST, LARGEST = 3, 5
HEAVY, NEARLY = 2_000, 1e-9
#: Rows of a block, and how many grams of two blocks are multiplied at once.
BLOCK, AT_ONCE = 1_000, 2_000


def grams(c: Column) -> Column:
    """All grams of a text, repeats included."""
    words = F.filter(F.split(F.trim(F.regexp_replace(query_text(c), r"(?U)\s+", " ")), " "), lambda w: w != "")

    def of(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(padded)
        cut = lambda n: F.when(size <= n, F.array(padded)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n))))
        none = F.array().cast("array<string>")
        # a word that was taken whole at n is not taken again at a larger n
        return F.concat(cut(SMALLEST), *[F.when(size <= n - 1, none).otherwise(cut(n)) for n in range(SMALLEST + 1, LARGEST + 1)])

    return F.flatten(F.transform(words, of))


def postings(rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, gram, tf) of the texts."""
    return rows.select(id_column, F.explode(grams(F.col(text))).alias("gram")).groupBy(id_column, "gram").agg(F.count("*").alias("tf"))


def weights(tf: DataFrame, idf: DataFrame, id_column: str) -> DataFrame:
    """(id, gram, weight, df), scaled to length one for each id."""
    raw = tf.join(idf, "gram").withColumn("raw", (1 + F.ln("tf")) * F.col("idf"))
    norm = raw.groupBy(id_column).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, id_column).select(id_column, "gram", (F.col("raw") / F.col("norm")).alias("weight"), "df")


def _best_of_blocks(k: int, query_id: str, own: str, schema: pa.Schema):
    """The k best rows of a block for each query of another one. Both sides: (id, grams, weights), the weights in the order of the grams."""

    def flat(block: pa.Table):
        grams = block["grams"].combine_chunks()
        return np.repeat(np.arange(len(block)), grams.value_lengths().to_numpy()), grams.flatten(), block["weights"].combine_chunks().flatten().to_numpy()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        (a_row, a_gram, a), (b_row, b_gram, b) = flat(left), flat(right)
        known = a_gram.unique()
        known = known.filter(pc.is_in(known, value_set=b_gram.unique()))
        a_col, b_col = (pc.fill_null(pc.index_in(x, value_set=known), -1).to_numpy() for x in (a_gram, b_gram))
        scores = np.zeros((len(left), len(right)))
        for start in range(0, len(known), AT_ONCE):
            sides = []
            for n, row, col, weight in ((len(left), a_row, a_col, a), (len(right), b_row, b_col, b)):
                here = (col >= start) & (col < start + AT_ONCE)
                dense = np.zeros((n, min(AT_ONCE, len(known) - start)))
                dense[row[here], col[here] - start] = weight[here]
                sides.append(dense)
            scores += sides[0] @ sides[1].T
        # equal ones by descending id: columns in that order, and sorts that keep it
        order = pc.sort_indices(right[own], sort_keys=[("", "descending")]).to_numpy()
        scores = scores[:, order]
        nines = np.round(scores, 9)
        last = -np.partition(-nines, min(k, len(right)) - 1, axis=1)[:, min(k, len(right)) - 1]
        at, column = np.nonzero((nines >= last[:, None]) & (scores > 0))
        by = np.lexsort((column, -nines[at, column], at))
        at, column = at[by], column[by]
        first = np.searchsorted(at, at)
        kept = np.arange(len(at)) - first < k
        at, column = at[kept], column[kept]
        return pa.Table.from_arrays([left[query_id].take(pa.array(at)), right[own].take(pa.array(order[column])), pa.array(scores[at, column])], schema=schema)

    return best


class Index:
    """Weighted grams of the labelled rows."""

    def __init__(self, rows: DataFrame, text: str = "text", id_column: str = "row_id"):
        tf = postings(rows, id_column, text)
        total = rows.filter(F.size(grams(F.col(text))) >= 0).agg(F.count("*").alias("rows"))
        df = tf.groupBy("gram").agg(F.count("*").alias("df"))
        # one row of totals beside each gram: a join with a table of exactly one row
        self.idf = df.join(F.broadcast(total)).select("gram", "df", (F.ln((1 + F.col("rows")) / (1 + F.col("df"))) + 1).alias("idf"))
        self.rows, self.id_column = rows, id_column
        self.weights = weights(tf, self.idf, id_column)

    def stored(self) -> Index:
        """The same index with its grams and weights written down, so that searches do not work them out again."""
        self.idf, self.weights = written(self.idf, "grams"), written(self.weights, "weights")
        return self

    def _parts(self, queries: DataFrame, k: int, text: str, query_id: str, heavy: int) -> dict[str, DataFrame]:
        own = self.id_column
        asked = weights(postings(queries, query_id, text), self.idf, query_id).withColumnRenamed("weight", "asked")
        often = F.col("df") > heavy
        light = asked.filter(~often).select(query_id, "gram", "asked").join(self.weights.filter(~often), "gram").groupBy(query_id, own).agg(F.sum(F.col("asked") * F.col("weight")).alias("part"))
        place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("part")))
        floor = light.withColumn("_n", place).filter(F.col("_n") <= k).groupBy(query_id).agg(F.max(F.when(F.col("_n") == k, F.col("part"))).alias("floor"))
        common, frequent = asked.filter(often), self.weights.filter(often)
        most = frequent.groupBy("gram").agg(F.max("weight").alias("most"))
        rest = common.join(most, "gram").groupBy(query_id).agg(F.sum(F.col("asked") * F.col("most")).alias("rest"))
        state = rest.join(floor, query_id, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumn("open", F.col("rest") >= F.col("floor") - NEARLY)
        found = light.join(state, query_id, "left")
        plain = found.filter("open is null").select(query_id, own, F.col("part").alias("score"))  # without frequent grams
        close = found.filter("not open").filter(F.col("part") + F.col("rest") >= F.col("floor") - NEARLY).select(query_id, own, "part")
        more = close.select(query_id, own).join(frequent.select(own, "gram", "weight"), own).join(common.select(query_id, "gram", "asked"), [query_id, "gram"])
        more = more.groupBy(query_id, own).agg(F.sum(F.col("asked") * F.col("weight")).alias("more"))
        completed = close.join(more, [query_id, own], "left").select(query_id, own, (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score"))
        salts = F.floor((F.col("df") - 1) / heavy) + 1
        wide = state.filter("open").select(query_id)
        dealt = common.join(wide, query_id, "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        met = dealt.select(query_id, "gram", "salt", "asked").join(frequent.withColumn("salt", F.pmod(F.xxhash64(own), salts)), ["gram", "salt"]).select(query_id, own, (F.col("asked") * F.col("weight")).alias("part"))
        opened = met.unionByName(light.join(wide, query_id, "left_semi")).groupBy(query_id, own).agg(F.sum("part").alias("score"))
        return {"light": light, "plain": plain, "completed": completed, "opened": opened}

    def _by_blocks(self, asked: DataFrame, k: int, query_id: str, queries: int, rows: int) -> DataFrame:
        """(query_id, row_id, score): the k best rows of each block for each query."""
        own = self.id_column
        theirs = self.weights.withColumnRenamed("weight", "asked")
        counts = [-(-queries // BLOCK), -(-rows // BLOCK)]
        sides = []
        for df, name, mine, other in ((asked, query_id, 0, 1), (theirs, own, 1, 0)):
            packed = df.groupBy(name).agg(F.collect_list(F.struct("gram", "asked")).alias("x"))
            packed = packed.select(name, F.col("x.gram").alias("grams"), F.col("x.asked").alias("weights"), F.pmod(F.xxhash64(name), F.lit(counts[mine])).cast("int").alias(f"_b{mine}"))
            sides.append(packed.withColumn(f"_b{other}", F.explode(F.sequence(F.lit(0), F.lit(counts[other] - 1)))).groupBy("_b0", "_b1"))
        kinds = {c: df.schema[c].dataType for df, c in ((asked, query_id), (theirs, own))}
        schema = pa.schema([*[(n, to_arrow_type(x)) for n, x in kinds.items()], ("score", pa.float64())])
        return sides[0].cogroup(sides[1]).applyInArrow(_best_of_blocks(k, query_id, own, schema), ", ".join([*[f"{n} {x.simpleString()}" for n, x in kinds.items()], "score double"]))

    def neighbours(self, queries: DataFrame, k: int, text: str = "text", query_id: str = "query_id", heavy: int | None = None) -> DataFrame:
        """O-097. (query_id, row_id, score, rank) of the k most similar rows of each query. heavy: the search goes by bounds, with this in place of `HEAVY`; else a short job sees whether blocks are better."""
        scores = None
        if heavy is None:
            prepare(queries.sparkSession)
            asked = written(weights(postings(queries, query_id, text), self.idf, query_id), "asked").withColumnRenamed("weight", "asked")
            met, n = asked.agg(F.coalesce(F.sum("df"), F.lit(0)), F.countDistinct(query_id)).first()
            rows = self.weights.agg(F.countDistinct(self.id_column)).first()[0]
            if 2 * met > n * rows:
                scores = self._by_blocks(asked.select(query_id, "gram", "asked"), k, query_id, n, rows)
        if scores is None:
            parts = self._parts(queries, k, text, query_id, heavy or HEAVY)
            scores = parts["plain"].unionByName(parts["completed"]).unionByName(parts["opened"]).filter("score > 0")
        order = Window.partitionBy(query_id).orderBy(F.desc(F.bround("score", 9)), F.desc(self.id_column))
        return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def work(self, queries: DataFrame, k: int, text: str = "text", query_id: str = "query_id", heavy: int = HEAVY) -> DataFrame:
        """(part, pairs): pairs of query and row that met by rare grams, that got their score completed, and that open queries met."""
        out = None
        for name, part in self._parts(queries, k, text, query_id, heavy).items():
            own = part.agg(F.count(F.lit(1)).alias("pairs")).select(F.lit(name).alias("part"), "pairs")
            out = own if out is None else out.unionByName(own)
        return out


def rank_candidates(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """O-121. (query_id, classpath, votes, rank): summed scores of the neighbours whose path is a candidate. candidates: (query_id, classpath)."""
    votes = found.join(candidates.distinct().hint("merge"), ["query_id", "classpath"]).groupBy("query_id", "classpath").agg(F.sum("score").alias("votes"))
    return votes.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("votes"), "classpath")))


def decide(found: DataFrame, candidates: DataFrame, floor: float = 0.75, margin: float = 0.95) -> DataFrame:
    """O-122. (query_id, classpath, score) where the best neighbour reaches the floor and the best of another path stays below the margin."""
    near = found.join(candidates.distinct().hint("merge"), ["query_id", "classpath"])
    best = near.groupBy("query_id").agg(F.min_by(F.struct("classpath", "score"), "rank").alias("b"))
    rival = near.join(best.hint("merge"), "query_id").groupBy("query_id", "b").agg(F.max(F.when(F.col("classpath") != F.col("b.classpath"), F.col("score"))).alias("rival"))
    kept = rival.filter((F.col("b.score") >= floor) & (F.col("rival").isNull() | (F.col("rival") <= margin * F.col("b.score"))))
    return kept.select("query_id", "b.classpath", "b.score")


def modal_name(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """O-123. (query_id, product_name): the name with the highest summed score among neighbours of the chosen path. chosen: (query_id, classpath)."""
    votes = found.join(chosen.hint("merge"), ["query_id", "classpath"]).filter("product_name <> ''").groupBy("query_id", "product_name").agg(F.sum("score").alias("votes"), F.min("rank").alias("seen"))
    return votes.groupBy("query_id").agg(F.max_by("product_name", F.struct("votes", -F.col("seen"))).alias("product_name"))
