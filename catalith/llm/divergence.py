"""Source divergence audit: how far the sources of a language lie apart in their words, and which words set a source apart.

Three passes, each of which meets fewer terms than the one before:

1. A count-min sketch of document frequencies. Every task adds its documents' terms to its own sketch and hands over the cells it touched; tasks'
   cells are summed, cut off at the threshold. A cell holds the documents of all terms that fall into it, so an estimate is never too small.
2. Terms whose estimate stays below the threshold in any row of the sketch are impossible. Tasks drop them before anything is shuffled, count the
   survivors of their documents, and hand over one row for each group and term. The sums are exact, and with them the document frequency: terms
   that the sketch let through by chance go now.
3. Pairs of sources meet term by term in a join of the counts above zero. A term that only one of a pair has, or neither, adds an amount that
   depends on its count alone, so those are added up by count instead of by term.

The sketch has a cell for every `CELL_BYTES` of text, but `MOST_CELLS` at most, as its bits (one for each cell and row: 32 MB at most) go to all
workers. Where a corpus is so large that this sketch fills up, it drops fewer terms, and the exact sums, which are the same, do more of the work.

Probabilities are integers: p = 1 + floor(10^9 (count + 2) / (N + 2V)), over the V kept terms of a language, N being the group's occurrences of
them. The divergence of p and q is floor((p - q)^2 / (p + q)), added up over all kept terms.

Defined cases: a null text, language or source is an empty string; a group without terms has count 0 of each kept term; a language without kept terms
has pairs of value 0 and no term rows; repeated rows and repeated or null ids are documents of their own; ties go by the item's bytes; an empty table
gives an empty table; other columns are not looked at; texts of any length are cut at separators and counted part by part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import batches_of_documents, corpus_bytes, mix, text_bytes, written

LEAST_DOCUMENTS, SHOWN_TERMS, SCALE = 10, 10, 1_000_000_000
SKETCH_ROWS, CELL_BYTES, LEAST_CELLS, MOST_CELLS = 2, 64, 1 << 16, 1 << 27
#: Cells of one row of the sketch table; entries that a task holds before it hands them over; bytes of text that are taken apart at once.
CHUNK, HELD, PART = 1 << 16, 4_000_000, 8_000_000
#: Groups that are broadcast; more are joined. Files of their table.
FEW_GROUPS, FILES = 100_000, 8
CELLS = "chunk int, at binary, n binary"
COUNTS = "lang string, source string, term string, count long, documents long"

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[: 0x41] = _BYTES[0x5B:0x61] = _BYTES[0x7B:0x80] = 0  # not part of a term
_BYTES[0x41:0x5B] += 0x20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def _tokens(data: np.ndarray, begins: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of texts that stand one after the other, and the text that each is of."""
    low = _BYTES[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at_begin = begins[begins < len(data)]
    first[at_begin] = inside[at_begin]
    starts = np.flatnonzero(first)
    before = np.cumsum(inside, dtype=np.int32)
    offsets = np.append(before[starts] - 1, before[-1] if len(before) else 0).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])])
    return terms.dictionary_encode(), np.searchsorted(begins, starts, "right") - 1


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text, cut where no term is."""
    at = 0
    while at < len(data):
        end = min(at + PART, len(data))
        while end < len(data) and _BYTES[data[end]]:
            rest = np.flatnonzero(_BYTES[data[end : end + PART]] == 0)
            end += int(rest[0]) if len(rest) else min(PART, len(data) - end)
        yield data[at:end]
        at = end


def document_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, and for every text and term of it: the text's place, the term's place, and how often it occurs."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if len(whole) > PART and len(texts) == 1:
        found = []
        for part in _parts(whole):
            terms, _ = _tokens(part, np.zeros(1, np.int64))
            codes, n = np.unique(terms.indices.to_numpy(), return_counts=True)
            found.append(pa.table({"term": terms.dictionary.take(pa.array(codes)), "n": n}))
        added = pa.concat_tables(found).group_by("term").aggregate([("n", "sum")])
        return added["term"].combine_chunks(), np.zeros(len(added), np.int64), np.arange(len(added)), added["n_sum"].to_numpy()
    terms, text = _tokens(whole, offsets[:-1] - offsets[0])
    width = max(1, len(terms.dictionary))
    keys, n = np.unique(text * width + terms.indices.to_numpy(), return_counts=True)
    return terms.dictionary, keys // width, keys % width, n


def _hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit number for each name, 0 for an empty one."""
    found = np.zeros(len(names), np.uint64)
    offsets = np.frombuffer(names.buffers()[1] or bytes(4), np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        data = np.frombuffer(names.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
        starts = offsets[filled] - offsets[0]
        place = np.arange(len(data)) - np.repeat(starts, np.diff(offsets)[filled])
        found[filled] = np.add.reduceat(mix((data + np.uint64(1)) * _STEP + place.astype(np.uint64)), starts)
    return found


def _cells(hashes: np.ndarray, language: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each term of a language, in each row of the sketch."""
    key = mix(hashes ^ mix(language))
    return [mix(key ^ seed) & np.uint64(cells - 1) for seed in _SEEDS[:SKETCH_ROWS]]


def _coded(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    found = column.dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each one's numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(n, starts) if len(starts) else n


def _sketched(held: list[np.ndarray], counts: list[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """A task's cells, one row for each chunk that it touched."""
    if not held:
        return
    cells, n = _summed(np.concatenate(held), np.concatenate(counts))
    n = np.minimum(n, most).astype(np.uint16)
    chunk, starts = np.unique(cells // CHUNK, return_index=True)
    at, ends = (cells % CHUNK).astype(np.uint16), [*starts[1:], len(cells)]
    spans = list(zip(starts, ends, strict=True))
    yield pa.record_batch({"chunk": pa.array(chunk.astype(np.int32)), "at": pa.array([at[a:b].tobytes() for a, b in spans], pa.binary()), "n": pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())})


def sketch(docs: DataFrame, cells: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(chunk, bits): for each touched chunk of the sketch, a bit for each cell, set where it counts enough documents."""

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0
        for batch in batches_of_documents(batches, PART):
            names, lang = _coded(batch.column("lang"))
            terms, text, term, _ = document_terms(batch.column("text"))
            width = max(1, len(terms))
            keys, n = np.unique(lang[text] * width + term, return_counts=True)
            for row, cell in enumerate(_cells(_hashes(terms)[keys % width], _hashes(pc.cast(names, pa.binary()))[keys // width], cells)):
                held.append(cell.astype(np.int64) + row * cells)
                counts.append(n)
                size += len(n)
            if size > HELD:
                yield from _sketched(held, counts, least)
                held, counts, size = [], [], 0
        yield from _sketched(held, counts, least)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = None, np.zeros(CHUNK, np.uint16)

        def done() -> pa.RecordBatch:
            return pa.record_batch({"chunk": pa.array([chunk], pa.int32()), "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

        for batch in batches:
            for key, at, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "at", "n")), strict=True):
                if chunk not in (None, key):
                    yield done()
                    total[:] = 0
                chunk, at = key, np.frombuffer(at, np.uint16)
                total[at] = np.minimum(total[at] + np.frombuffer(n, np.uint16), least)  # a cell occurs once in a row
        if chunk is not None:
            yield done()

    parts = docs.mapInArrow(touched, CELLS)
    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merged, "chunk int, bits binary")


def counted(docs: DataFrame, bits: dict[int, bytes], cells: int) -> DataFrame:
    """`COUNTS` by task: occurrences and documents of the terms that the sketch lets through; a row with a null term for each group."""
    table = np.zeros((SKETCH_ROWS * cells + 7) // 8, np.uint8)
    for chunk, part in bits.items():
        part = np.frombuffer(part, np.uint8)[: len(table) - chunk * CHUNK // 8]
        table[chunk * CHUNK // 8 : chunk * CHUNK // 8 + len(part)] = part

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_documents(batches, PART):
            (langs, lang), (sources, source) = _coded(batch.column("lang")), _coded(batch.column("source"))
            terms, text, term, n = document_terms(batch.column("text"))
            width, many = max(1, len(terms)), len(sources)
            # of each language and term, whether it may be kept
            keys, at = np.unique(lang[text] * width + term, return_inverse=True)
            possible = np.ones(len(keys), bool)
            for row, cell in enumerate(_cells(_hashes(terms)[keys % width], _hashes(pc.cast(langs, pa.binary()))[keys // width], cells)):
                place = cell.astype(np.int64) + row * cells
                possible &= (table[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
            left = possible[at]
            text, term, n = text[left], term[left], n[left]
            key, count = _summed((lang[text] * many + source[text]) * width + term, n)
            _, documents = np.unique((lang[text] * many + source[text]) * width + term, return_counts=True)
            group = np.unique(lang * many + source)
            place = np.concatenate([key // width, group])
            yield pa.record_batch({
                "lang": langs.take(pa.array(place // many)),
                "source": sources.take(pa.array(place % many)),
                "term": pa.concat_arrays([pc.cast(terms.take(pa.array(key % width)), pa.string()), pa.nulls(len(group), pa.string())]),
                "count": pa.array(np.append(count, np.zeros(len(group), np.int64)).astype(np.int64)),
                "documents": pa.array(np.append(documents, np.zeros(len(group), np.int64)).astype(np.int64)),
            })

    return docs.mapInArrow(rows, COUNTS)


def probability(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exactly."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0))) div cast(nullif({total} + 2 * {kept}, 0) as decimal(20, 0))")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, shown: int = SHOWN_TERMS, cells: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each source from the others of its language, and the terms it has more of than its language."""
    docs = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text_bytes().alias("text"))
    if cells is None:
        cells = 1 << max(LEAST_CELLS, min(MOST_CELLS, corpus_bytes(docs) // CELL_BYTES)).bit_length() - 1
    bits = {row.chunk: bytes(row.bits) for row in sketch(docs.select("lang", "text"), cells, least).collect()}  # SKETCH_ROWS * MOST_CELLS bits at most
    counts = written(counted(docs, bits, cells).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents")), "counts")

    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("count").alias("lang_count"))
    terms = terms.filter(F.col("documents") >= least).drop("documents")
    found = written(counts.filter("term is not null").drop("documents").join(terms, ["lang", "term"]), "kept")
    by_lang = found.groupBy("lang", "term").agg(F.first("lang_count").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    groups = counts.filter("term is null").select("lang", "source").join(found.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left")
    groups = groups.join(by_lang, "lang", "left").na.fill(0, ["total", "kept", "lang_total"]).withColumn("p0", probability("0", "total", "kept"))
    groups = written(groups, "groups", files=FILES)

    # a group's terms would meet in one task, unless groups are few enough to broadcast; else Spark splits large ones
    cell = found.join(F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups, ["lang", "source"]).withColumn("p", probability("count", "total", "kept"))
    cell = cell.withColumn("q", probability("lang_count", "lang_total", "kept")).select("lang", "source", "term", "count", "p", "p0", "q")
    apart = cell.filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))

    left = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "kept")
    right = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = left.join(right, "lang").filter("a < b")  # as many as the result has, halved
    neither = pairs.select("lang", "a", "b", F.coalesce(F.col("kept") * divergence("a0", "b0"), F.lit(0)).alias("value"))
    alike = cell.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    one = alike.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "p", "n").join(right, "lang").filter("a <> b")
    one = one.withColumn("value", F.col("n") * (divergence("p", "b0") - divergence("a0", "b0"))).select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    x = cell.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    y = cell.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    both = x.join(y, ["lang", "term"]).filter("a < b")
    both = both.select("lang", "a", "b", (divergence("pa", "pb") - divergence("pa", "b0") - divergence("a0", "pb") + divergence("a0", "b0")).alias("value"))
    sums = neither.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    distances = sums.select("lang", sides.alias("side"), "value").select("lang", "side.source", "side.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = distances.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    ranked = ranked.unionByName(apart.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= shown).withColumn("part", F.lit("term")))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
