"""SimHash near-dedup: fingerprints, and their links within a Hamming budget by a binary trie self-join.

A fingerprint has 64 bits. Two that differ in at most `BUDGET` = 3 bits agree on one of four blocks of 16
bits at least, so the walk over pairs of trie nodes is dealt out as 4 x 65,536 subtrees: the trie over the
fingerprints rotated so that block r comes first, below each value of that block, where the walk has spent
nothing of its budget. Within them node pairs are walked level by level; the differing bits add up, and a
pair whose sum exceeds the budget is cut off. Equal fingerprints are one leaf, so groups of copies cost
nothing here, and a subtree returns a spanning forest of its links, never all pairs of a group. A subtree of more than `HEAVY`
fingerprints is dealt out once more in the same way: two of them that differ in at most 3 of the remaining 48 bits agree on one
of four parts of 12 bits.

Defined cases: a null text counts as empty; a text without words has fingerprint zero; texts of fewer than
three words have one shingle; a null doc_id takes part, but a component is named by its least non-null id;
repeated rows each get their row; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.llm.common import batches_of_documents, text_bytes, written
from catalith.llm.components import components

SHINGLE, SEED, BUDGET, BLOCK = 3, 42, 3, 16
#: Bits of the parts into which the rest of a heavy subtree's fingerprints is cut, and when a subtree is heavy.
PART, HEAVY = 12, 500_000
#: Node pairs with so few fingerprint pairs are compared directly.
LEAF_PAIRS = 48
#: Fingerprints that one walk takes, more only if a subtree has more.
CHUNK = 300_000
#: Pairs held at a time.
PAIRS = 2_000_000

_LANES = np.uint64(0x0101010101010101)


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprints of texts, as unsigned integers."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: only A-Z change
        n = len(words)
        if n > shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
            stops, starts = (ends[shingle - 1 :] - 1).tolist(), [0, *ends[: n - shingle].tolist()]
            hashes.extend(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, stops, strict=True)], repeat(seed)))
            counts[i] = n - shingle + 1
        elif n:
            hashes.append(xxhash.xxh64_intdigest(b" ".join(words), seed))
            counts[i] = 1
    return majority(np.array(hashes, np.uint64), counts)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each group of consecutive hashes, the bits that are set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begins = (np.cumsum(counts) - counts)[full]
    # eight byte-wide counters at a time, over pieces of at most 255 hashes
    pieces = [np.arange(b, b + n, 255) for b, n in zip(begins.tolist(), counts[full].tolist(), strict=True)]
    owner_cuts = np.cumsum([0, *map(len, pieces[:-1])])
    cuts = np.concatenate(pieces)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, cuts)
        tally = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner_cuts, axis=0)
        bits = (2 * tally > counts[full][:, None]).astype(np.uint64)
        for byte in range(8):
            out[full] |= bits[:, byte] << np.uint64(8 * byte + shift)
    return out


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of_documents(batches):
        yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "fp": pa.array(fingerprints(batch.column("text").to_pylist()).view(np.int64))})


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of a and b; root[i] is the root of i, the least of its tree."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def trie_links(values: np.ndarray, known_bits: int = BLOCK, budget: int = BUDGET) -> np.ndarray:
    """For sorted distinct 64-bit values: the least place that each is linked to, over links within the budget
    between values that agree on their leading known_bits."""
    n = len(values)
    root = np.arange(n)
    if n < 2:
        return root
    top = values >> np.uint64(64 - known_bits)
    cuts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    ends = np.r_[cuts[1:], n]
    big = ends - cuts > 1
    pairs = np.column_stack([cuts[big], ends[big], cuts[big], ends[big], np.zeros(big.sum(), np.int64)])
    stack = [(64 - known_bits - 1, pairs)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, pairs = stack.pop()
        if not len(pairs):
            continue
        if len(pairs) > PAIRS:
            half = len(pairs) // 2
            stack += [(bit, pairs[:half]), (bit, pairs[half:])]
            continue
        sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        leaf = (sizes <= LEAF_PAIRS) if bit >= 0 else np.ones(len(pairs), bool)
        root = _compare(values, pairs[leaf], sizes[leaf], root, budget)
        pairs = pairs[~leaf]
        if not len(pairs):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        count = ones[bit]
        a, b, c, d, spent = pairs.T
        m, k = b - (count[b] - count[a]), d - (count[d] - count[c])  # where the ones begin
        own = a == c
        kinds = [(a, m, c, k, spent, None), (m, b, k, d, spent, None), (a, m, k, d, spent + 1, None), (m, b, c, k, spent + 1, ~own)]
        below = []
        for p, q, r, s, e, only in kinds:
            keep = (q > p) & (s > r) & (e <= budget) & ~((p == r) & (q - p == 1))
            if only is not None:
                keep &= only
            below.append(np.column_stack([p, q, r, s, e])[keep])
        stack.append((bit - 1, np.concatenate(below)))
    return root


def _compare(values: np.ndarray, pairs: np.ndarray, sizes: np.ndarray, root: np.ndarray, budget: int) -> np.ndarray:
    """Compare all values of small node pairs."""
    at = 0
    while at < len(pairs):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), PAIRS, "right")) + at)
        part, many = pairs[at:stop], sizes[at:stop]
        who = np.repeat(np.arange(len(part)), many)
        inner = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        width = (part[:, 3] - part[:, 2])[who]
        i, j = part[who, 0] + inner // width, part[who, 2] + inner % width
        near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        root = _unite(root, i[near], j[near])
        at = stop
    return root


def _rotated(values: np.ndarray, by: int, width: int = 64) -> np.ndarray:
    """The lowest `width` bits rotated to the left; the bits above stay."""
    if not by % width:
        return values
    low = values & np.uint64(2**width - 1)
    turned = ((low << np.uint64(by)) | (low >> np.uint64(width - by))) & np.uint64(2**width - 1)
    return turned | (values ^ low)


def _turned(values: np.ndarray, r: int, part: int) -> np.ndarray:
    """Block r first, then, in a heavy subtree, the part; part -1: the subtree is whole."""
    values = _rotated(values, BLOCK * r)
    return _rotated(values, PART * part, 64 - BLOCK) if part > 0 else values


def _back(values: np.ndarray, r: int, part: int) -> np.ndarray:
    values = _rotated(values, 64 - BLOCK - PART * part, 64 - BLOCK) if part > 0 else values
    return _rotated(values, 64 - BLOCK * r) if r else values


def _known(part: int) -> int:
    """Leading bits on which a subtree's values agree."""
    return BLOCK if part < 0 else BLOCK + PART


def _subtree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (r, part, fp) sorted by subtree; whole subtrees at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def walk(r: np.ndarray, part: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, p in sorted(set(zip(r.tolist(), part.tolist(), strict=True))):
            values = np.sort(_turned(fp[(r == k) & (part == p)], k, p))
            root = trie_links(values, _known(p))
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.record_batch({c: pa.array(_back(values[at], k, p).view(np.int64)) for c, at in (("a", moved), ("b", root[moved]))})

    for batch in batches:
        held.append((batch.column("r").to_numpy(), batch.column("part").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
        if sum(len(x[0]) for x in held) >= CHUNK:
            r, part, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            k, p = int(r[-1]), int(part[-1])
            top = _turned(fp, k, p) >> np.uint64(64 - _known(p))
            last = (r == k) & (part == p) & (top == top[-1])
            cut = int(np.argmax(last))  # the last subtree may go on in the next batch
            held = [(r[cut:], part[cut:], fp[cut:])]
            if cut:
                yield from walk(r[:cut], part[:cut], fp[:cut])
    if held:
        yield from walk(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(distinct: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(a, b): links that span the components of the distinct fingerprints `fp`."""
    block = lambda r: F.shiftrightunsigned("fp", 64 - BLOCK * (r + 1)).bitwiseAND(2**BLOCK - 1).cast("int")
    dealt = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), block(r).alias("block")) for r in range(64 // BLOCK)])).alias("at"))
    dealt = dealt.select("at.r", "at.block", "fp")
    crowded = dealt.groupBy("r", "block").count().filter(F.col("count") > heavy).select("r", "block", F.lit(True).alias("heavy"))
    dealt = dealt.join(F.broadcast(crowded), ["r", "block"], "left")  # at most 4 * 65,536 subtrees in all
    # a heavy subtree's fingerprints go to a part each, by 12 of the 48 bits that follow their block
    turned = lambda r: F.col("fp") if not r else F.call_function("shiftleft", F.col("fp"), F.lit(BLOCK * r)).bitwiseOR(F.shiftrightunsigned("fp", 64 - BLOCK * r))
    whole = F.when(F.col("r") == 0, turned(0)).when(F.col("r") == 1, turned(1)).when(F.col("r") == 2, turned(2)).otherwise(turned(3))
    bits = lambda p: F.shiftrightunsigned(whole, 64 - BLOCK - PART * (p + 1)).bitwiseAND(2**PART - 1).cast("int")
    parts = F.array(*[F.struct(F.lit(p).alias("part"), bits(p).alias("bits")) for p in range((64 - BLOCK) // PART)])
    split = F.when(F.col("heavy"), parts).otherwise(F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).alias("bits"))))
    dealt = dealt.select("r", "block", "fp", F.explode(split).alias("s")).select("r", "block", "s.part", "s.bits", "fp")
    dealt = dealt.repartition("r", "block", "part", "bits").sortWithinPartitions("r", "block", "part", "bits")
    return dealt.select("r", "part", "fp").mapInArrow(_subtree_links, "a long, b long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The fingerprint of a text's bytes."""
    return pd.Series(fingerprints(text.tolist()).view(np.int64))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    return rooted(docs).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def rooted(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root) of every row; root tells components without any id apart."""
    fps = written(docs.select("doc_id", text_bytes().alias("text")).mapInArrow(_fingerprint_rows, "doc_id long, fp long"), "prints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "root").select("fp", "component_id", "root"), "classes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "root")
