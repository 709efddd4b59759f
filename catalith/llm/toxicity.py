"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts, the rest of the corpus is unlabelled. A linear model over hashed words is
trained in numpy on the risk

    prior * E_P[l(f, +1)] + max(0, E_U[l(f, -1)] - prior * E_P[l(f, -1)])

with the logistic loss l; where the second part falls below zero, the step is taken against it, so
it can't be fitted away. The prior is the share of toxic rows among the labels one may learn from, or what telling words
indicate (see `telling`), whichever is less. Labels of
clean rows serve for nothing else: they are unlabelled text like all other.

Features are the presence of words (lower case, letters only), hashed to `FEATURES` places; a place must occur
in `LEAST_TEXTS` texts of the sample and be told apart by `LEAST_Z` standard errors between positives and unlabelled texts,
others have no weight. Training takes a bounded sample of whole texts by a hash of id and text: about `POSITIVES` toxic
and `UNLABELLED` unlabelled ones, equal rows once. How many of them have a place is counted across the cluster; only places that tell
the kinds apart reach the driver, so the length of a text doesn't matter. Every whole text of all rows is scored.

Defined cases: null and empty texts get the score of the intercept alone; a null doc_id is no label's and is
scored like any other; a doc_id with several labels is toxic if one says so; repeated rows are scored alike; without
positives every score is 0; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import Memo, batches_of_documents, text_bytes, written

FEATURES, LEAST_TEXTS, LEAST_Z = 1 << 18, 4, 5.0
POSITIVES, UNLABELLED = 2_000, 8_000
STEPS, RATE, DECAY = 600, 0.1, 1e-5

#: Letters and bytes beyond ASCII stay, A-Z in lower case; the rest is space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_models: dict[str, Memo] = {}


def place(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) % FEATURES


def words(text: bytes) -> set[bytes]:
    return set(text.translate(_LETTERS).split())


class Model:
    """A sparse linear model: places with a weight, and an intercept."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, intercept: float):
        self.places, self.weights, self.intercept = places.astype(np.int32), weights.astype(np.float64), float(intercept)

    def key(self) -> str:
        return hashlib.sha256(self.places.tobytes() + self.weights.tobytes()).hexdigest()

    def weigh(self) -> Memo:
        """Weights by word, with a memo that this worker keeps."""
        if (key := self.key()) not in _models:
            table = dict(zip(self.places.tolist(), self.weights.tolist(), strict=True))
            _models.clear()
            _models[key] = Memo(lambda word: table.get(place(word), 0.0))
        return _models[key]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        get = self.weigh().__getitem__
        # in a fixed order, so that a text's score never depends on the order of a set
        f = np.array([self.intercept + sum(sorted(map(get, words(t)))) for t in texts])
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all texts in a row, and the text that each belongs to."""
    return np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


Part = tuple[np.ndarray, np.ndarray, int]  # places of all texts in a row, the text that each belongs to, number of texts


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Fit by Adam on the whole sample: texts as arrays of the places that tell the kinds apart."""
    if not positive or not unlabelled:
        return Model(np.zeros(0), np.zeros(0), -40.0)
    parts = [(*_flat(part), len(part)) for part in (positive, unlabelled)]
    used = np.unique(np.concatenate([at for at, _, _ in parts]))
    parts = [(np.searchsorted(used, at), owner, n) for at, owner, n in parts]
    weight = np.zeros(len(used) + 1)  # the last is the intercept
    weight[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, STEPS + 1):
        g = gradient(weight, *parts, prior)
        g[:-1] += DECAY * weight[:-1]
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        rate = RATE * (1 - 0.9 * step / STEPS)
        weight -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(used, weight[:-1], weight[-1])


def _margins(weight: np.ndarray, part: Part) -> np.ndarray:
    at, owner, n = part
    return np.clip(np.bincount(owner, weights=weight[at], minlength=n) + weight[-1], -40, 40)


def risk(weight: np.ndarray, positive: Part, unlabelled: Part, prior: float) -> tuple[float, float]:
    """The two parts of the risk: that of positives, and that of negatives, which may be below zero."""
    fp, fu = _margins(weight, positive), _margins(weight, unlabelled)
    return prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()


def gradient(weight: np.ndarray, positive: Part, unlabelled: Part, prior: float) -> np.ndarray:
    """Of the risk; where its second part is below zero, the step is taken against that part alone."""
    pp, pu = (1 / (1 + np.exp(-_margins(weight, part))) for part in (positive, unlabelled))
    spread = lambda part, d: np.r_[np.bincount(part[0], weights=d[part[1]], minlength=len(weight) - 1), d.sum()] / part[2]
    negative = spread(unlabelled, pu) - prior * spread(positive, pp)
    return prior * spread(positive, pp - 1) + negative if risk(weight, positive, unlabelled, prior)[1] >= 0 else -negative


def telling(a: np.ndarray, b: np.ndarray, n: int, m: int, prior: float) -> tuple[np.ndarray, float]:
    """Which places differ between the two kinds by `LEAST_Z` standard errors of their shares, and are not too rare; and the prior.
    What only positives have is as much rarer in unlabelled text as positives are: the prior is no more than the ratio
    of the shares at the places with the lowest ones. a, b: texts with each place among n positive and m unlabelled ones."""
    share = (a + b) / (n + m)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n + 1 / m))
    keep = (a + b >= LEAST_TEXTS) & (np.abs(a / n - b / m) >= LEAST_Z * error)
    own = keep & (a / n > b / m) & (a >= 10)
    if own.any():
        prior = min(prior, max(0.001, float(np.quantile((b / m)[own] / (a / n)[own], 0.25))))
    return keep, prior


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of_documents(batches):
        places = [np.unique(np.fromiter(map(place, words(t)), np.int32)) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"positive": batch.column("positive"), "draw": batch.column("draw"), "places": pa.array([x.tobytes() for x in places], pa.binary())})


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each kind have each place."""
    counts = {True: np.zeros(FEATURES, np.int64), False: np.zeros(FEATURES, np.int64)}
    for batch in batches:
        for positive, body in zip(batch.column("positive").to_pylist(), batch.column("places").to_pylist(), strict=True):
            counts[positive][np.frombuffer(body, np.int32)] += 1
    for positive, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.record_batch({"positive": pa.array(np.full(len(at), positive)), "place": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})


def _kept_rows(keep: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.frombuffer(x, np.int32) for x in batch.column("places").to_pylist()]
            yield batch.set_column(2, "places", pa.array([p[keep[p]].tobytes() for p in places], pa.binary()))

    return rows


FEATURE_ROWS = "positive boolean, draw long, places binary"


def sample(docs: DataFrame, known: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """(positive, draw, text): bounded samples of both kinds, chosen by a hash of id and text."""
    draw = lambda *c: F.pmod(F.xxhash64(*[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c], F.lit("sample")), F.lit(1 << 40))
    within = lambda wanted, of: F.lit(int((1 << 40) * min(1.0, wanted / max(1, of))))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", text_bytes().alias("text"), draw("doc_id", "text").alias("draw"))
    toxic = known.filter("toxic = 1").select("doc_id")
    # an id may stand at many texts: rows are drawn, by id and hash alone, and then found again
    chosen = texts.drop("text").join(toxic, "doc_id").distinct().orderBy("draw", "doc_id").limit(positives)
    of_toxic = texts.join(F.broadcast(chosen), ["doc_id", "draw"])
    others = texts.filter(F.col("draw") < within(unlabelled, docs.count()))
    both = of_toxic.select(F.lit(True).alias("positive"), "draw", "text").unionByName(others.select(F.lit(False).alias("positive"), "draw", "text"))
    return both.dropDuplicates(["positive", "draw"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """learn: which doc_ids' labels may be used."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).first()
    if not counts["toxic"]:
        return train([], [], 0.5)
    drawn = written(sample(docs, known, positives, unlabelled).mapInArrow(_feature_rows, FEATURE_ROWS), "sample")
    sizes = dict(drawn.groupBy("positive").count().collect())
    if len(sizes) < 2:
        return train([], [], 0.5)
    tallies = {True: np.zeros(FEATURES, np.int64), False: np.zeros(FEATURES, np.int64)}
    found = drawn.mapInArrow(_count_rows, "positive boolean, place int, n long").groupBy("positive", "place").agg(F.sum("n").alias("n")).toArrow()  # 2 * FEATURES rows at most
    for kind, tally in tallies.items():
        part = found.filter(pc.equal(found.column("positive"), kind))
        tally[part.column("place").to_numpy()] = part.column("n").to_numpy()
    keep, prior = telling(tallies[True], tallies[False], sizes[True], sizes[False], min(0.9, max(0.001, counts["toxic"] / counts["n"])))
    rows = drawn.mapInArrow(_kept_rows(keep), FEATURE_ROWS).collect()
    parts = [[np.frombuffer(x, np.int32) for _, x in sorted((r["draw"], bytes(r["places"])) for r in rows if r["positive"] == kind)] for kind in (True, False)]
    return train(*parts, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_documents(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(model.scores(batch.column("text").to_pylist()))})

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
