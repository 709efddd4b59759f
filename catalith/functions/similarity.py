"""Indel similarity and its token forms. The longest common subsequence needs a kernel: bit-parallel, over Python's long integers.

Scores run from 0 to 100. Batches are Arrow batches; pairs that repeat within a batch are scored once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """O-071. 200 * common / total length; two empty strings are equal."""
    total = len(a) + len(b)
    return 200.0 * common_length(a, b) / total if total else 100.0


def _sorted_words(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_sort_ratio(a: str, b: str) -> float:
    """O-072."""
    return ratio(_sorted_words(a), _sorted_words(b))


def token_set_ratio(a: str, b: str) -> float:
    """O-073. 100 if one word set holds the other; else the best of common against common + rest, and of the two sums."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (x <= y or y <= x):
        return 100.0
    shared = " ".join(sorted(both))
    left, right = (" ".join(w for w in (shared, *sorted(rest)) if w) for rest in (x - y, y - x))
    found = ratio(left, right)
    return max(found, ratio(shared, left), ratio(shared, right)) if both else found


def _slide(short: str, long: str) -> float:
    n, best, seen = len(short), 0.0, set(short)
    for start in range(1 - n, len(long)):
        part = long[max(0, start) : start + n]
        if part and (part[-1] in seen or part[0] in seen):
            best = max(best, ratio(short, part))
            if best == 100.0:
                break
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with any stretch of the longer one, stretches at the ends included; both ways round if they are equally long."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    return max(_slide(short, long), _slide(long, short) if len(a) == len(b) else 0.0)


def weighted_ratio(a: str, b: str) -> float:
    """O-074. The best of the scores above, weighed by how different the lengths are."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    whole = ratio(a, b)
    if lengths < 1.5:
        return max(whole, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if lengths <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    tokens = 100.0 if x & y else max(partial_ratio(_sorted_words(a), _sorted_words(b)), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * tokens)


def _scorer(score):
    @F.pandas_udf("double")
    def each(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for pair in zip(left.fillna(""), right.fillna(""), strict=True):
            if pair not in known:
                known[pair] = score(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype=float)

    return each


def ratio_column(a: Column, b: Column) -> Column:
    return _scorer(ratio)(a, b)


def token_sort_column(a: Column, b: Column) -> Column:
    return _scorer(token_sort_ratio)(a, b)


def token_set_column(a: Column, b: Column) -> Column:
    return _scorer(token_set_ratio)(a, b)


def weighted_column(a: Column, b: Column) -> Column:
    return _scorer(weighted_ratio)(a, b)


BEST = T.StructType([T.StructField("choice", T.StringType()), T.StructField("score", T.DoubleType())])


def best_choice(c: Column, choices: list[str], score=weighted_ratio) -> Column:
    """O-075. struct(choice, score) of the choice that scores highest, the first one among equals; null without choices or for null. choices: a vocabulary of known size, which goes to every worker."""

    def one(text: str | None) -> tuple[str, float] | None:
        found = [score(text, x) for x in choices] if text is not None else []
        return (choices[at], found[at]) if found and (at := max(range(len(found)), key=found.__getitem__)) >= 0 else None

    @F.pandas_udf(BEST)
    def each(texts: pd.Series) -> pd.DataFrame:
        known = {t: one(t) for t in texts.unique()}
        return pd.DataFrame([known[t] or (None, None) for t in texts], columns=["choice", "score"])

    return F.when(c.isNotNull(), each(c)) if choices else F.lit(None).cast(BEST)
