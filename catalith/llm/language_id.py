"""Language identification by compression.

Each language is a zstandard raw-content dictionary of `DICTIONARY_BYTES` of its text. A text, reduced to lower
case letters and spaces, is encoded in blocks of `BLOCK` bytes with each dictionary; the language whose
dictionary gives the fewest bytes is chosen. The choice is rejected when the margin to the next is under
`MARGIN` of the best size. A short text leaves zstandard nothing to save, so it stores it as it is; texts up to
`SHORT` bytes are therefore encoded after a filler that is cheap in every language, with matches from 3 bytes.

The dictionaries are fitted on a bounded sample: at most `SAMPLE_ROWS` different rows for each language, those with the least hash of
id and text; of a row, a slice of `SLICE` characters at a place that this hash gives, or the whole text where it is
no longer; slices are joined in the hash's order and cut at `DICTIONARY_BYTES`, so 30 rows count at least where there are
as many. Copies of a row count once, and a language has one row at least, so none is left out, whatever the length or number of its texts. All dictionaries together
take `ALL_BYTES`: with more than 1,024 values of lang they get shorter, down to `LEAST_DICTIONARY` for 65,536 of them, the most frequent ones; that is many
more than there are codes in use. A worker holds the compressors of `LANGUAGES` languages at once, some MB each, and takes more of them in turn for each batch.
Everything else covers whole texts of all rows. Texts of up to `SHORT` bytes of letters, about a tenth of the documents here, are judged by the codec with the filler, longer ones without.

Defined cases: a null text, and one without letters, is `und` with score 0 and not accepted; languages are
those of the rows one may learn from, a null lang is none, nor is one whose sample has no letter; where sizes tie, as they do for a word or two of few bytes, the language with more rows wins, then the
alphabet, and the choice is not accepted; no languages at all gives `und` everywhere; repeated rows and null ids are
judged like any other; an empty table gives an empty table; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.llm.common import batches_of_documents, remainder

DICTIONARY_BYTES, BLOCK, LEVEL = 64 << 10, 4096, 5
SHORT, SHORT_LEVEL, FILLER = 256, 12, b" " * 64
SAMPLE_ROWS, SLICE, LANGUAGES = 300, 2_000, 1_000
ALL_BYTES = 64 << 20
#: zstandard looks at no dictionary of up to 8 bytes, nor finds what begins in the last 8; shorter ones than this are set between spaces.
LEAST_DICTIONARY = 1_024
MARGIN = 0.003
UNKNOWN = "und"

#: ASCII letters in lower case and all bytes beyond ASCII stay; the rest is space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str | None) -> bytes:
    """The text's letters in lower case, in UTF-8, words joined by one space; empty if it has no letter."""
    if not text:
        return b""
    if not text.isascii() and not any(map(str.isalpha, text)):
        return b""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


class Models:
    """Compressors of all languages, most frequent language first."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.languages = [name for name, _ in dictionaries]
        self.long, self.short = [], []
        for _, content in dictionaries:
            for kind, level in ((self.long, LEVEL), (self.short, SHORT_LEVEL)):
                own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                if kind is self.long:
                    own.precompute_compress(level=level)
                    kind.append(zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False))
                else:
                    how = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), min_match=3, strategy=zstandard.STRATEGY_BTOPT, target_length=64, write_content_size=0)
                    own.precompute_compress(compression_params=how)
                    kind.append(zstandard.ZstdCompressor(compression_params=how, dict_data=own))

    def sizes(self, text: bytes) -> list[int]:
        """Bytes that the text takes in each language."""
        if len(text) <= SHORT:
            return [len(c.compress(FILLER + text)) for c in self.short]
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.long]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the margin is wide enough."""
        return verdict(*best_two([(self.languages, self.sizes)], letters(text)))


def best_two(blocks: list[tuple[list[str], Callable[[bytes], list[int]]]], body: bytes, known: tuple[str | None, int, int] = (None, 0, 0)) -> tuple[str | None, int, int]:
    """The language with the smallest size, that size, and the next (0 if there is none), after more languages."""
    best, size, second = known
    if body:
        for languages, sizes in blocks:
            for name, n in zip(languages, sizes(body), strict=True):
                if best is None or n < size:
                    best, size, second = name, n, size
                elif not second or n < second:
                    second = n
    return best, size, second


def verdict(best: str | None, size: int, second: int) -> tuple[str, float, bool]:
    if best is None:
        return UNKNOWN, 0.0, False
    gap = (second or 2 * size) - size
    # code lengths as odds: each byte that the runner-up takes more halves its share
    return best, 1 / (1 + 2.0 ** -min(gap, 60)), gap > 0 and gap >= MARGIN * size


def _contents(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b" ".join(t for x in slices if (t := letters(x["slice"])))[:most] for slices in batch.column("slices").to_pylist()]
            yield pa.record_batch({"lang": batch.column("lang"), "content": pa.array(texts, pa.binary())})

    return rows


def fit(docs: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, bytes]]:
    """(language, dictionary content), the most frequent language first, from the rows where `learn` holds."""
    mark = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit("sample"))
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", mark.alias("mark"))
    at = F.pmod("mark", F.lit(1_000_000)) / 1_000_000.0
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("mark").alias("different"), F.min(F.struct(at, "mark")).alias("least"))
    counts = counts.orderBy(F.desc("n"), "lang").limit(ALL_BYTES // LEAST_DICTIONARY).collect()
    if not counts:
        return []
    shares = [(r["lang"], min(1.0, 2 * sample_rows / r["different"] + 50 / r["different"]), r["least"]["mark"]) for r in counts]
    known = docs.sparkSession.createDataFrame(shares, "lang string, share double, least long")
    drawn = rows.join(F.broadcast(known), "lang").withColumn("at", at).filter((F.col("at") < F.col("share")) | (F.col("mark") == F.col("least")))
    first = (F.pmod(F.shiftrightunsigned("mark", 24), F.greatest(F.lit(1), F.length("text") - SLICE + 1)) + 1).cast("int")
    sliced = drawn.select("lang", "at", "mark", F.substring("text", first, F.lit(SLICE)).alias("slice")).dropDuplicates(["lang", "mark"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "slice"))  # of some 650 rows of a language
    chosen = sliced.withColumn("place", place).filter(F.col("place") <= sample_rows).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "slice"))).alias("slices"))
    most = max(LEAST_DICTIONARY, min(DICTIONARY_BYTES, ALL_BYTES // len(counts)))
    found = {r["lang"]: bytes(r["content"]) for r in chosen.mapInArrow(_contents(most), "lang string, content binary").collect()}  # ALL_BYTES at most
    content = [(r["lang"], found.get(r["lang"], b"")) for r in counts]
    return [(lang, text if len(text) >= LEAST_DICTIONARY else b" " * 8 + text + b" " * 16) for lang, text in content if text]


def identify(docs: DataFrame, learn: Column | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred, score and accepted, of every row. learn: which rows may teach; all by default."""
    dictionaries = fit(docs, F.lit(True) if learn is None else learn)
    blocks = [dictionaries[i : i + LANGUAGES] for i in range(0, len(dictionaries), LANGUAGES)]
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    text_at = "text" if "text" in carry else "_text"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Models(blocks[0])] if len(blocks) == 1 else None
        for batch in batches_of_documents(batches, text=text_at):
            bodies = [letters(t) for t in batch.column(text_at).to_pylist()]
            sizes = [(None, 0, 0)] * len(bodies)
            for own in models or map(Models, blocks):
                sizes = [best_two([(own.languages, own.sizes)], body, s) for body, s in zip(bodies, sizes, strict=True)]
            found = [verdict(*s) for s in sizes]
            columns = {c: batch.column(c) for c in carry}
            columns["lang_pred"] = pa.array([x[0] for x in found], pa.string())
            columns["score"] = pa.array([x[1] for x in found], pa.float64())
            columns["accepted"] = pa.array([x[2] for x in found], pa.bool_())
            yield pa.record_batch(columns)

    return docs.select(*carry, *([] if "text" in carry else [F.col("text").alias("_text")])).mapInArrow(rows, schema)


def may_teach() -> Column:
    """Rows that the contract lets one learn from: those not held out."""
    return remainder("doc_id", 4) != 2
