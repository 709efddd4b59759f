"""Approximate nearest neighbours by collision counting.

Vectors are scaled to length one and projected on `PROJECTIONS` random directions. On a direction, the projections of
two vectors at distance g differ by a normal deviate of that spread, so a query's window of half-width t = z * g holds
a vector at distance g with a known probability; z is chosen such that the vector lies within the windows of at least
`THRESHOLD` of all directions with a reserve of `RESERVE` standard deviations.

The first direction orders all vectors: it is cut into ranges of about equal numbers of rows, and a range into blocks of
about `BLOCK_ROWS` rows by a hash of the id, so that a vector with a third of all rows spreads over many blocks. Each block
keeps its vectors sorted by each direction. A query first searches the block that it falls into itself. Virtual
rehashing widens all its windows together by `GROWTH`, and only the new margins are counted; a vector that
reaches the threshold is verified by its true cosine. The search ends once the windows are wide enough for the
k-th best found. Its distance then bounds where nearer vectors can lie on the first direction, within `REACH` standard deviations,
and only the blocks of these ranges are searched further, at once with the windows that the bound asks for.
How far this narrows the search depends on the data: vectors that are all about equally far from each other, as
independent random ones are, meet nearly all blocks; clustered ones meet few. There is no cap on candidates. Equal vectors of a block
are counted and verified once.

Pairs of a query and a covered block are joined on the block's number; the k best of each block are then ranked for each query.

Defined cases: vectors that are null or zero, that hold null or non-finite components, or that are not as long as most
take no part, neither as queries nor as candidates, and so do rows with a null id; finite components may be as
large or small as doubles are, as vectors are scaled by a power of two first; rows that repeat a query's id are not its
candidates, and of several vectors with one query's id the least counts; rows that repeat another id are candidates each; ties go to
the smaller id; with fewer than k candidates all are returned; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import mix, written

PROJECTIONS, THRESHOLD, GROWTH, RESERVE, REACH = 128, 0.5, 1.4, 1.5, 2.2
BLOCK_ROWS, QUERY_ROWS, SEED = 16_384, 1_024, 7
#: Ranges of the first direction, as the driver and each task hold their bounds.
MOST_RANGES = 4_096
FOUND = "query_id long, vec_id long, score double"


def quantile(projections: int, threshold: float = THRESHOLD, reserve: float = RESERVE) -> float:
    """The z for which a normal deviate lies within z often enough to pass the threshold with the reserve."""
    need = math.ceil(threshold * projections)
    passes = lambda p: projections * p - need >= reserve * math.sqrt(projections * p * (1 - p))
    low, high = 0.0, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if passes(math.erf(mid / math.sqrt(2))) else (mid, high)
    return high


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by the power of two that brings its largest component to between a half and one."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def directions(dims: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((projections, dims))


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


class Block:
    """The sorted projections of one block's vectors. `looked_at` counts the cosines that searches worked out."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.vectors, which = np.unique(scaled(vectors), axis=0, return_inverse=True)
        which = which.ravel()
        order = np.lexsort((ids, which))
        self.ids, self.cuts = ids[order], np.searchsorted(which[order], np.arange(len(self.vectors) + 1))
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted_ids, self.vector_of = ids[self.by_id], which[self.by_id]
        self.norms = _norms(self.vectors)
        self.directions, self.z = directions(vectors.shape[1], projections, seed), quantile(projections)
        at = self.directions @ (self.vectors / self.norms[:, None]).T
        self.order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, self.order, axis=1)
        self.looked_at = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its id, and ids and cosines of its k best here; bounds: cosines that k others reach already."""
        queries = scaled(queries)
        norms = _norms(queries)
        at = self.directions @ (queries / norms[:, None]).T
        for i, own in enumerate(query_ids.tolist()):
            yield own, *self._one(own, queries[i], norms[i], at[:, i], -2.0 if bounds is None else float(bounds[i]), k)

    def _one(self, own: int, query: np.ndarray, norm: float, at: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(self.vectors), len(self.directions)
        need = math.ceil(THRESHOLD * m)
        copies = np.diff(self.cuts)
        a, b = np.searchsorted(self.sorted_ids, [own, own + 1] if own < np.iinfo(np.int64).max else [own, own], "left")
        if own == np.iinfo(np.int64).max:
            b = len(self.sorted_ids)
        np.subtract.at(copies, self.vector_of[a:b], 1)  # the query's own rows are no candidates
        counts, cosines = np.zeros(n, np.int64), np.full(n, -np.inf)
        verified = np.zeros(0, np.int64)
        low = high = None
        gap = _gap(bound)
        t = self.z * (gap if bound >= -1 else 0.25)
        while True:
            new_low = [int(r.searchsorted(x - t, "left")) for r, x in zip(self.sorted, at.tolist(), strict=True)]
            new_high = [int(r.searchsorted(x + t, "right")) for r, x in zip(self.sorted, at.tolist(), strict=True)]
            if low is None:
                parts = [r[a:b] for r, a, b in zip(self.order, new_low, new_high, strict=True)]
            else:
                parts = [r[a:b] for r, a, b in zip(self.order, new_low, low, strict=True)] + [r[a:b] for r, a, b in zip(self.order, high, new_high, strict=True)]
            low, high = new_low, new_high
            counts += np.bincount(np.concatenate(parts), minlength=n)
            verified = self._verify(np.flatnonzero(counts >= need), cosines, query, norm, verified)
            gap = _gap(max(bound, self._kth(verified, cosines, copies, k)))
            if t >= self.z * gap or len(verified) == n:
                break
            t = min(t * GROWTH, self.z * gap)
        if bound < -1 and copies[verified].sum() < k:  # too few: look at whatever is left
            verified = self._verify(np.arange(n), cosines, query, norm, verified)
        best = verified[(cosines[verified] >= max(bound, self._kth(verified, cosines, copies, k))) & (copies[verified] > 0)]
        if not len(best):
            return np.zeros(0, np.int64), np.zeros(0)
        members = [self._members(b, own, k) for b in best.tolist()]
        ids, scores = np.concatenate(members), np.repeat(cosines[best], [len(x) for x in members])
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def _verify(self, wanted: np.ndarray, cosines: np.ndarray, query: np.ndarray, norm: float, verified: np.ndarray) -> np.ndarray:
        fresh = wanted[np.isneginf(cosines[wanted])]
        cosines[fresh] = (self.vectors[fresh] @ query) / (self.norms[fresh] * norm)
        self.looked_at += len(fresh)
        return np.concatenate([verified, fresh])

    def _kth(self, verified: np.ndarray, cosines: np.ndarray, copies: np.ndarray, k: int) -> float:
        """The cosine that k candidates reach, -2 if there are fewer."""
        if not len(verified):
            return -2.0
        found = cosines[verified]
        if len(found) > 4 * k:
            near = verified[np.argpartition(-found, 4 * k)[: 4 * k]]
            verified = near if copies[near].sum() >= k else verified
        order = verified[np.argsort(-cosines[verified], kind="stable")]
        at = int(np.searchsorted(np.cumsum(copies[order]), k))
        return float(cosines[order[at]]) if at < len(order) else -2.0

    def _members(self, vector: int, own: int, k: int) -> np.ndarray:
        ids = self.ids[self.cuts[vector] : self.cuts[vector + 1]]
        return ids[ids != own][:k]


def _gap(cosine: float) -> float:
    """The distance of two unit vectors with that cosine."""
    return math.sqrt(max(1e-12, 2 - 2 * max(-1.0, min(1.0, cosine))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column that all have the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units_at(vectors: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Places on the first direction."""
    vectors = scaled(vectors)
    return (vectors @ directions(vectors.shape[1], seed=seed)[0]) / _norms(vectors)


class Ranges:
    """Ranges of the first direction and their blocks."""

    def __init__(self, bounds: list[float], rows: dict[int, int], block_rows: int):
        self.bounds = np.array(bounds, np.float64)
        self.parts = np.array([max(1, math.ceil(rows.get(i, 0) / block_rows)) for i in range(len(bounds) + 1)], np.int64)
        self.begins = np.cumsum(self.parts) - self.parts
        self.blocks = int(self.parts.sum())

    def home(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The block of each row."""
        where = np.searchsorted(self.bounds, at, "right")
        return (self.begins[where] + (mix(ids.view(np.uint64)) % self.parts[where].astype(np.uint64)).astype(np.int64)).astype(np.int32)

    def covered(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First block, and first beyond, of the ranges that a window covers."""
        last = np.searchsorted(self.bounds, high, "right")
        return self.begins[np.searchsorted(self.bounds, low, "right")], self.begins[last] + self.parts[last]


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.record_batch({"at": pa.array(_units_at(_matrix(batch.column("vector"))))})


def _range_rows(bounds: list[float]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.float64)
        for batch in batches:
            kinds, counts = np.unique(np.searchsorted(edges, batch.column("at").to_numpy(), "right"), return_counts=True)
            yield pa.record_batch({"range": pa.array(kinds.astype(np.int32)), "rows": pa.array(counts.astype(np.int64))})

    return rows


PLACED = "block int, id long, bound double, vector binary"


def _placed(ranges: Ranges, width: str, home: bool):
    """Rows by block: of the row itself, or, with the bounds of queries, of all other blocks that their windows cover."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column("id").to_numpy(), _matrix(batch.column("vector"))
            at = _units_at(vectors)
            own = ranges.home(ids, at)
            bound = np.full(len(ids), -2.0) if home else batch.column("bound").to_numpy()
            body = [v.tobytes() for v in vectors.astype(width)]
            if home:
                yield _placed_batch(own, ids, bound, body)
                continue
            reach = REACH * np.array([_gap(x) for x in bound.tolist()])
            for i, (a, b) in enumerate(zip(*ranges.covered(at - reach, at + reach), strict=True)):
                wanted = np.arange(a, b, dtype=np.int32)
                wanted = wanted[wanted != own[i]]
                yield _placed_batch(wanted, np.full(len(wanted), ids[i]), np.full(len(wanted), bound[i]), [body[i]] * len(wanted))

    return rows


def _placed_batch(block: np.ndarray, ids: np.ndarray, bound: np.ndarray, body: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch({"block": pa.array(block, pa.int32()), "id": pa.array(ids, pa.int64()), "bound": pa.array(bound, pa.float64()), "vector": pa.array(body, pa.binary())})


PACKED = "block int, ids binary, bounds binary, vectors binary"


def _pack_rows(most: int | None):
    """Rows sorted by block: one row for each block, or several of at most so many."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, bounds, vectors = None, [], [], []

        def done() -> pa.RecordBatch:
            body = (np.array(ids, np.int64).tobytes(), np.array(bounds, np.float64).tobytes(), b"".join(vectors))
            return pa.record_batch({"block": pa.array([block], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in zip(("ids", "bounds", "vectors"), body, strict=True)}})

        for batch in batches:
            for b, i, bound, v in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "bound", "vector")), strict=True):
                if b != block or (most and len(ids) >= most):
                    if ids:
                        yield done()
                    block, ids, bounds, vectors = b, [], [], []
                ids.append(i)
                bounds.append(bound)
                vectors.append(v)
        if ids:
            yield done()

    return rows


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that may take part, if their length is right."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_column).isNotNull() & F.col(column).isNotNull()).filter(F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(id_column).cast("long").alias("id"), v.alias("vector"))


def _search_rows(k: int, width: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            for number, ids, vectors, query_ids, bounds, queries in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "vectors", "query_ids", "bounds", "queries")), strict=True):
                own = np.frombuffer(ids, np.int64)
                unpack = lambda body, n: np.frombuffer(body, width).astype(np.float64).reshape(n, -1)
                if number != at:
                    at, block = number, Block(own, unpack(vectors, len(own)))
                asked = np.frombuffer(query_ids, np.int64)
                found = list(block.search(asked, unpack(queries, len(asked)), k, np.frombuffer(bounds, np.float64)))
                yield pa.record_batch({
                    "query_id": pa.array(np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64)),
                    "vec_id": pa.array(np.concatenate([i for _, i, _ in found]).astype(np.int64)),
                    "score": pa.array(np.concatenate([s for _, _, s in found]).astype(np.float64)),
                })

    return rows


def _searched(index: DataFrame, queries: DataFrame, blocks: int, k: int, width: str, query_rows: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block for the queries that are placed there."""
    packed = queries.repartition(blocks, "block").sortWithinPartitions("block", "id").mapInArrow(_pack_rows(query_rows), PACKED)
    pairs = index.join(packed.select("block", F.col("ids").alias("query_ids"), "bounds", F.col("vectors").alias("queries")), "block")
    # many more partitions than pairs of a block and a batch of queries, so that few tasks get two
    pairs = pairs.repartition(min(4 * blocks, 20_000), "block", F.xxhash64("query_ids")).sortWithinPartitions("block")
    return pairs.mapInArrow(_search_rows(k, width), FOUND)


def nearest(vectors: DataFrame, asks: Column, k: int = 5, id_column: str = "vec_id", column: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where `asks` holds."""
    width = "<f4" if vectors.schema[column].dataType.simpleString() == "array<float>" else "<f8"
    rows = usable(vectors, id_column, column)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims, total = (sizes["n"], sizes["count"]) if sizes else (0, 0)
    rows = rows.filter(F.size("vector") == dims)
    wanted = max(1, min(MOST_RANGES, math.ceil(total / block_rows)))
    places = written(rows.select("vector").mapInArrow(_project, "at double"), "places")
    shares = [i / wanted for i in range(1, wanted)]
    bounds = sorted(set(places.agg(F.percentile_approx("at", shares, 10_000).alias("b")).first()["b"] or [])) if shares else []
    counts = places.mapInArrow(_range_rows(bounds), "range int, rows long").groupBy("range").agg(F.sum("rows").alias("rows"))
    ranges = Ranges(bounds, dict(counts.collect()), block_rows)  # at most MOST_RANGES rows
    placed = rows.mapInArrow(_placed(ranges, width, True), PLACED)
    index = written(placed.repartition(ranges.blocks, "block").sortWithinPartitions("block", "id").mapInArrow(_pack_rows(None), PACKED).drop("bounds"), "vectors")
    asking = usable(vectors.filter(asks), id_column, column).filter(F.size("vector") == dims).groupBy("id").agg(F.min("vector").alias("vector"))
    found = written(_searched(index, asking.mapInArrow(_placed(ranges, width, True), PLACED), ranges.blocks, k, width, query_rows), "home")
    if ranges.blocks > 1:
        known = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("bound"))
        bounded = asking.join(known, F.col("id") == F.col("query_id"), "left").select("id", "vector", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
        found = found.unionByName(_searched(index, bounded.mapInArrow(_placed(ranges, width, False), PLACED), ranges.blocks, k, width, query_rows))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
