"""Fuzzy joins meet by rare grams: they must lose no pair that comparing all of them would find."""

import random

import pytest

from catalith.functions import similarity as M
from catalith.operators import resolve as J


def names(n, seed):
    rng = random.Random(seed)
    parts = ["tool", "works", "milwaukee", "saw", "aa", "aaaa", "brand", "supply", "x", "ltd9", "stanley", "black", "decker"]
    out = set()
    while len(out) < n:
        name = " ".join(rng.choices(parts, k=rng.randrange(1, 4)))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(name) + 1)
            name = name[:at] + rng.choice(["", "q", "e"]) + name[at + rng.randrange(2) :]
        if name.strip():
            out.add(" ".join(name.split()))
    return sorted(out)


def frames(spark, left, right):
    return spark.createDataFrame([(x,) for x in left], "key string"), spark.createDataFrame([(x,) for x in right], "match string")


def test_all_close_pairs_meet(spark):
    left, right = names(150, 1), names(150, 2)
    for floor, form, plain, size in ((88.0, lambda c: c, M.ratio, 2), (88.0, J.sorted_words, M.token_sort_ratio, 2), (70.0, J.sorted_words, M.token_sort_ratio, 1)):
        met = {tuple(r) for r in J.close_pairs(*frames(spark, left, right), floor, form, size).collect()}
        want = {(a, b) for a in left for b in right if plain(a, b) >= floor}
        assert want <= met and (size < 2 or len(met) < len(left) * len(right) / 3)


def test_grams_that_names_may_lose_are_refused(spark):
    with pytest.raises(ValueError, match="share no gram"):
        J.close_pairs(*frames(spark, ["a"], ["b"]), 80.0, size=3)


def plain_match(key, table):
    if len(key) <= 3:
        return key if key in table else None
    starts = lambda a, b: a != b and (a + " ").startswith(b + " ")
    prefix = [t for t in table if len(t) >= 6 and (starts(key, t) or starts(t, key))]
    if prefix:
        return max(prefix, key=lambda t: (len(t), t))
    fuzzy = [(max(M.ratio(key, t), M.token_sort_ratio(key, t)), t) for t in table if len(t) > 1 and min(len(key), len(t)) / max(len(key), len(t)) >= 0.55]
    fuzzy = [x for x in fuzzy if x[0] >= 88]
    return max(fuzzy)[1] if fuzzy else None


def test_safe_match_equals_all_pairs(spark):
    left, right = names(120, 3), names(120, 4)
    found = dict(J.safe_match(spark.createDataFrame([(x,) for x in left], "key string"), spark.createDataFrame([(x,) for x in right], "key string")).collect())
    assert found == {k: m for k in left if (m := plain_match(k, right))}
    assert J.safe_match(*[spark.createDataFrame([], "key string")] * 2).count() == 0


def test_names_by_number_meet_their_own(spark, monkeypatch):
    """Names that all look alike: keys a letter from one of them are settled without the grams, which nearly all names share."""
    left = [f"xsupplier#{i:09d}" for i in range(60)] + [f"supplier#0{i:09d}" for i in range(60)] + ["word supplier#5 b", "zz supplier#000000007"]
    right = [f"supplier#{i:09d}" for i in range(60)] + ["b supplier#5 word", "supplier#000000007 z"]
    tables = [spark.createDataFrame([(x,) for x in names], "key string") for names in (left, right)]
    want = {k: m for k in left if (m := plain_match(k, right))}
    assert dict(J.safe_match(*tables).collect()) == want
    seen = []
    plain = J.close_pairs
    monkeypatch.setattr(J, "close_pairs", lambda asked, *more: seen.append(asked.count()) or plain(asked, *more))
    J.safe_match(tables[0].filter("key like 'xs%'"), tables[1]).collect()
    assert seen == []


def test_templates_of_similar_paths(spark):
    paths = ["tools > hand saws", "kitchen > box sinks", "kitchenware", "a > b"]
    templates = spark.createDataFrame([(p, [str(i)]) for i, p in enumerate(paths)], "classpath string, labels array<string>")
    leaves = spark.createDataFrame([("zzz", "a > b")], "leaf string, classpath string")
    asked = ["tools > hand saw", "kitchenwares", "kitchen > sinks box", "quite another", "tools > hand saws", "q > zzz"]
    found = {r.classpath: list(r.labels) for r in J.template_for(spark.createDataFrame([(i, p) for i, p in enumerate(asked)], "row_id int, classpath string"), templates, leaves).collect()}
    for p in asked[:4]:
        best = max((M.token_set_ratio(p, t), t) for t in paths)
        assert found[p] == ([str(paths.index(best[1]))] if best[0] >= 70 else [])
    assert found["tools > hand saws"] == ["0"] and found["q > zzz"] == ["3"]


def test_longest_prefix(spark):
    rows = spark.createDataFrame([(1, "ab-12345"), (2, "AB9"), (3, "a"), (4, None), (5, "zz1")], "row_id long, mpn string")
    known = spark.createDataFrame([("AB", "x"), ("AB12", "y"), ("AB123", "z"), ("AB9", "w")], "key string, brand string")
    assert {r.row_id: (r.brand, r.prefix) for r in J.by_prefix(rows, known).collect()} == {1: ("z", "AB123"), 2: ("w", "AB9")}
