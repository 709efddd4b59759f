"""Cases that once crashed or lost results, each against a plain version."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from catalith.llm import ann, exact_dedup, language_id, packing, sharding, simhash, substring_dedup, toxicity
from catalith.llm import queries as Q
from tests.llm.test_operators import plain_removal, same_rows, words


def plain_nearest(rows, queries, k):
    """rows: (id, vector) of those that take part."""
    unit = lambda v: (s := np.array(v) / np.abs(v).max()) / math.sqrt((s * s).sum())
    units = [(i, unit(v)) for i, v in rows]
    for q in queries:
        own = unit(min(v for i, v in rows if i == q))
        best = sorted((-round(float(u @ own), 12), i) for i, u in units if i != q)[:k]
        yield q, [i for _, i in best], [-s for s, _ in best]


def nearest(spark, rows, asks, **how):
    df = spark.createDataFrame([(i, [float(x) for x in v], 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, block int, score double")
    found = collections.defaultdict(list)
    for r in ann.nearest(df.repartition(3), asks, **how).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    return found


def test_nearest_takes_tiny_and_huge_components(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) * 10.0 ** rng.choice([-300, -200, 0, 150, 300])).tolist()) for i in range(60)]
    rows += [(100, [1e-200] * 8), (101, [1e200] * 8), (102, [1.0] * 8), (103, [5e-324] * 8), (104, [1e308] * 8)]
    found = nearest(spark, rows, F.col("vec_id") % 50 == 0)
    for q, ids, scores in plain_nearest(rows, [0, 50, 100], 5):
        assert len(found[q]) == len(ids) and np.allclose([s for _, s in found[q]], scores, atol=1e-9)
    assert sorted(i for i, _ in found[100][:4]) == [101, 102, 103, 104]


def test_nearest_with_repeated_ids(spark):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(8).tolist()
    rows = [(50, one)] * 7 + [(i, one) for i in range(51, 57)] + [(i, rng.standard_normal(8).tolist()) for i in range(200, 260)]
    rows += [(200, one), (2**63 - 1, one), (-(2**63), one)]
    found = nearest(spark, rows, F.col("vec_id").isin(50, 200, 2**63 - 1))
    assert [i for i, _ in found[50]] == [-(2**63), 51, 52, 53, 54] and [i for i, _ in found[2**63 - 1]] == [-(2**63), *[50] * 4]
    for q, ids, _ in plain_nearest(rows, [200], 5):
        assert [i for i, _ in found[q]] == ids


def test_nearest_over_several_ranges_and_hot_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 3
    data = np.concatenate([centres[rng.integers(0, 12, 1_500)] + rng.standard_normal((1_500, 16)), np.repeat(centres[:1], 800, axis=0)])
    rows = list(enumerate(data.tolist()))
    found, hits, asked = nearest(spark, rows, F.col("vec_id") % 20 == 0, block_rows=200, query_rows=30), 0, range(0, 2_300, 20)
    for q, ids, scores in plain_nearest(rows, asked, 5):
        assert len(found[q]) == 5
        hits += sum(s >= scores[-1] - 1e-9 for _, s in found[q])
    assert set(found) == set(asked) and hits / (5 * len(asked)) >= 0.9


def test_ranges_cover_what_a_window_reaches():
    ranges = ann.Ranges([-1.0, 0.0, 0.0 + 1e-9, 2.0], {0: 10, 1: 450, 3: 99}, 100)
    assert ranges.parts.tolist() == [1, 5, 1, 1, 1] and ranges.blocks == 9
    a, b = ranges.covered(np.array([-5.0, -0.5, 3.0]), np.array([5.0, -0.4, 4.0]))
    assert a.tolist() == [0, 1, 8] and b.tolist() == [9, 6, 9]
    ids = np.arange(1_000)
    assert set(ranges.home(ids, np.full(1_000, -0.5)).tolist()) == {1, 2, 3, 4, 5}


def test_language_with_short_or_long_texts_only(spark):
    rng = random.Random(3)
    make = lambda parts, n: " ".join("".join(rng.choices(parts, k=3)) for _ in range(n))
    fr, en = ["eau", "les", "aux", "ment", "que"], ["the", "and", "ing", "tion", "her"]
    rows = [(i, make(en, 60), "en") for i in range(10)] + [(i, make(fr, 3_000), "fr") for i in range(10, 20)] + [(20, "你好世界 今天天气很好", "zh"), (21, "...", "xx")]
    rows += [(100, make(fr, 40), None), (101, make(en, 40), None), (102, make(fr, 4), None), (103, "今天天气很好", None), (104, "好", None)]
    df = spark.createDataFrame([(*r, "x", 0.5, True) for r in rows], "doc_id int, text string, lang string, lang_pred string, score double, accepted boolean")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df).collect()}
    assert all(got[i] == "fr" for i in (*range(10, 20), 100, 102)) and all(got[i] == "en" for i in (*range(10), 101))
    assert got[20] == got[103] == "zh" and got[21] == "und" and got[104] in ("en", "fr", "zh")
    alone = language_id.identify(df.filter("lang = 'fr'")).collect()
    assert {r.lang_pred for r in alone} == {"fr"} and len(alone) == 10


def test_language_sizes_equal_plain_compression(spark):
    models = language_id.Models([("a", b"the cat sat on the mat " * 50), ("b", b"der hund lief in den wald " * 50)])
    for n in (language_id.SHORT - 1, language_id.SHORT, language_id.SHORT + 1, 9_000):
        text = (b"the dog sat in the wald " * 400)[:n]
        plain = []
        for content in (b"the cat sat on the mat " * 50, b"der hund lief in den wald " * 50):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            if n <= language_id.SHORT:
                how = zstandard.ZstdCompressionParameters.from_level(language_id.SHORT_LEVEL, dict_size=len(content), min_match=3, strategy=zstandard.STRATEGY_BTOPT, target_length=64, write_content_size=0)
                plain.append(len(zstandard.ZstdCompressor(compression_params=how, dict_data=own).compress(language_id.FILLER + text)))
            else:
                c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=own, write_content_size=False, write_checksum=False)
                plain.append(sum(len(c.compress(text[i : i + language_id.BLOCK])) for i in range(0, n, language_id.BLOCK)))
        assert models.sizes(text) == plain
        lang, score, _ = models.judge(text.decode())
        sizes = models.sizes(language_id.letters(text.decode()))
        assert lang == "ab"[sizes.index(min(sizes))] and score >= 0.5


def test_toxicity_learns_from_long_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join([f"w{rng.randrange(30_000)}" for _ in range(9_000 if i % 3 == 0 else 50)] + ["vile", "foul"] * (i % 3 == 0))) for i in range(180)]
    df = spark.createDataFrame([(*r, False, 1, 0.5, "p") for r in rows], "doc_id int, text string, positive boolean, draw int, score double, places string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(180)], "doc_id int, toxic int, positive int")
    found = {r.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, labels, F.lit(True))).collect()}
    assert all((found[i] >= 0.5) == (i % 3 == 0) for i in range(180))


def test_toxicity_gradient_equals_differences_of_the_plain_risk():
    rng = np.random.default_rng(6)
    positive, unlabelled = ([np.flatnonzero(rng.random(12) < p) for _ in range(n)] for p, n in ((0.5, 30), (0.2, 80)))
    parts = [(*toxicity._flat(x), len(x)) for x in (positive, unlabelled)]

    def plain(w, prior, kind):
        f = lambda x: w[-1] + sum(w[j] for j in x)
        loss = lambda z: math.log(1 + math.exp(-z))
        if kind == "positive":
            return prior * sum(loss(f(x)) for x in positive) / 30
        return sum(loss(-f(x)) for x in unlabelled) / 80 - prior * sum(loss(-f(x)) for x in positive) / 30

    signs = set()
    for prior, scale in ((0.1, 0.5), (0.6, 2.0), (0.9, 3.0), (0.3, 1.0)):
        w = rng.standard_normal(13) * scale
        own, negative = toxicity.risk(w, *parts, prior)
        assert abs(own - plain(w, prior, "positive")) < 1e-9 and abs(negative - plain(w, prior, "negative")) < 1e-9
        signs.add(negative >= 0)
        whole = (lambda v, p=prior: plain(v, p, "positive") + plain(v, p, "negative")) if negative >= 0 else (lambda v, p=prior: -plain(v, p, "negative"))
        g = toxicity.gradient(w, *parts, prior)
        for j in range(13):
            e = np.eye(13)[j] * 1e-6
            assert abs((whole(w + e) - whole(w - e)) / 2e-6 - g[j]) < 1e-5
    assert signs == {True, False}


def test_score_of_a_half_counts_as_toxic(spark):
    model = toxicity.Model(np.zeros(0), np.zeros(0), 0.0)
    assert model.scores([b"any", b""]).tolist() == [0.5, 0.5]


def test_substring_dedup_of_extreme_ids_and_types(spark):
    rows = [(2**63 - 1, words(60, 1)), (2**63 - 2, words(60, 1)), (-(2**63), words(30, 1)), (None, words(60, 1)), (None, words(60, 1)), (None, words(50, 9)), (0, words(50, 10))]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, nul int, keys binary").repartition(3)
    same_rows(substring_dedup.deduplicate(df).withColumn("kept", F.col("kept").cast("string")), [(i, n, r, k.decode()) for i, n, r, k in plain_removal(rows)])
    few = [(1, words(40, 2)), (2, words(40, 2)), (None, words(40, 2))]
    for kind in ("int", "short"):
        out = substring_dedup.deduplicate(spark.createDataFrame(few, f"doc_id {kind}, text string"))
        assert out.schema["doc_id"].dataType.simpleString() in (kind, "small" + kind[1:], "smallint")
        same_rows(out.withColumn("kept", F.col("kept").cast("string")), [(i, n, r, k.decode()) for i, n, r, k in plain_removal(few)])
        assert exact_dedup.classes(spark.createDataFrame(few, f"doc_id {kind}, text string")).filter("keep_id = 1").count() == 3
        assert simhash.classes(spark.createDataFrame(few, f"doc_id {kind}, text string")).filter("component_id = 1").count() == 3


def test_a_passage_of_all_rows_does_not_fill_its_range(spark, monkeypatch):
    passage, largest = words(40, 1), []
    for n in (300, 1_200):
        df = spark.createDataFrame([(i, words(20, i + 5, 10**6) + " " + passage) for i in range(n)], "doc_id long, text string").repartition(4)
        index = substring_dedup.SubstringIndex(spark, 6)
        rows = substring_dedup._addressed(df).mapInArrow(substring_dedup._anchor_rows(6), substring_dedup.PACKED)
        sizes = rows.filter("kind = 0").groupBy("bucket").agg(F.sum(F.length("keys")).alias("b")).collect()
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows.filter("kind = 0").collect()])
        assert np.unique(keys, return_counts=True)[1].max() <= 4  # once for each task
        largest.append(max(r["b"] for r in sizes))
        index.add(df)
        out = substring_dedup.strip(df, substring_dedup.verify(df, index.shared(), 6))
        assert out.filter("n_removed >= 40").count() == n - 1 and out.filter("n_removed > 0").count() == n - 1
    assert largest[1] < 8 * largest[0]


def test_substring_index_lasts_between_sessions(spark, tmp_path):
    batches = [[(9, words(30, 7)), (5, words(40, 8))], [(7, words(30, 8) + " " + words(20, 9))], [(1, words(40, 8)), (2, words(25, 7)), (None, words(40, 8))], [(3, words(25, 7))]]
    frames = [spark.createDataFrame(b, "doc_id long, text string") for b in batches]
    path = str(tmp_path / "index")
    substring_dedup.SubstringIndex(spark, 3, 2, path).add(frames[0])
    for f in frames[1:]:
        substring_dedup.SubstringIndex.opened(spark, path).add(f)
    last = substring_dedup.SubstringIndex.opened(spark, path)
    assert last.version == 6 and len(last.runs) == 2  # four batches and two compactions
    everything = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    out = substring_dedup.strip(everything, substring_dedup.verify(everything, last.shared(), 3)).withColumn("kept", F.col("kept").cast("string"))
    same_rows(out, [(i, n, r, k.decode()) for i, n, r, k in plain_removal([x for b in batches for x in b])])


def test_heavy_subtrees_are_dealt_out_without_loss(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = np.unique(np.array([s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for s in seeds for _ in range(6)], np.uint64))
    root = np.arange(len(near))
    for _ in range(10):
        for a in range(len(near)):
            ok = np.bitwise_count(near ^ near[a]) <= 3
            root[ok] = root[ok].min()
    df = spark.createDataFrame([(int(x),) for x in near.view(np.int64)], "fp long")
    for heavy in (10**9, 3, 0):
        found = simhash.components(simhash.links(df, heavy)).collect()
        name = {int(x): int(x) for x in near.view(np.int64)} | {r.node: r.root for r in found}
        parts = lambda key: sorted(tuple(np.flatnonzero(key == k)) for k in set(key.tolist()))
        assert parts(np.array([name[int(x)] for x in near.view(np.int64)])) == parts(root)


@pytest.mark.parametrize("by", [16, 32, 48])
def test_turned_fingerprints_turn_back(by):
    values = np.random.default_rng(by).integers(0, 2**64, 50, dtype=np.uint64)
    for part in (-1, 0, 1, 2, 3):
        for r in range(4):
            assert (simhash._back(simhash._turned(values, r, part), r, part) == values).all()


def test_rows_without_ids_spread_over_a_hot_atom(spark):
    rows = [(None, "same")] * 300 + [(i, "same") for i in range(100)] + [(5, "other")]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), cell_rows=20)
    assert sorted(r.slot for r in out.filter(f"text_crc32 = {zlib.crc32(b'same')}").collect()) and out.count() == 401
    for s in {r.shard for r in out.collect()}:
        slots = sorted(r.slot for r in out.collect() if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.doc_id for r in out.collect()} == {None, *range(100)}


def test_packing_takes_other_integer_ids(spark):
    path = Q.tokenizer_path(Q.WORD_BPE)
    out = packing.pack(spark.createDataFrame([(1, "some words", 1, "x"), (None, None, 2, None)], "doc_id int, text string, start int, length string"), path).collect()
    assert {r.doc_id for r in out} == {1, None}
