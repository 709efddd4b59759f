"""The samples that models are fitted on are bounded, and no language and no kind of row is lost to copies or repeated ids."""

import random

from pyspark.sql import functions as F

from catalith.llm import language_id, toxicity


def babble(seed, letters, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(n))


def judged(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {(r.doc_id, r.lang): r.lang_pred for r in language_id.identify(docs, carry=("doc_id", "lang")).collect()}


def test_a_language_of_copies_is_learned(spark):
    rows = [(i, babble(i, "abcdefgh", 20), "en") for i in range(300)]
    for seed in range(4):
        copies = [(i, babble(1_000 + seed, "stuvwxyz", 30), "fr") for i in [7] * 900] + [(None, babble(2_000 + seed, "ijklmnop", 30), "de")] * 900
        found = judged(spark, rows + copies)
        assert found[7, "fr"] == "fr" and found[None, "de"] == "de" and all(found[i, "en"] == "en" for i in range(300))


def test_more_languages_than_a_worker_holds(spark, monkeypatch):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = [babble(9_000 + k, alphabet, 40).split() for k in range(13)]
    rows = [(i, " ".join(random.Random(i).choices(words[i % 13], k=150)), f"l{i % 13}") for i in range(130)]
    whole = judged(spark, rows)
    monkeypatch.setattr(language_id, "LANGUAGES", 4)
    assert judged(spark, rows) == whole and all(v == k[1] for k, v in whole.items())
    many = [(i, f"{babble(i, alphabet, 3)}", f"v{i}") for i in range(1_100)]
    monkeypatch.setattr(language_id, "LANGUAGES", 1_000)
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string")
    content = language_id.fit(docs, F.lit(True))
    assert len(content) == 1_100 and all(len(c) <= language_id.ALL_BYTES // 1_100 + 1_024 for _, c in content)


def test_the_sample_of_positives_is_bounded_where_an_id_repeats(spark):
    rows = [(1, f"toxic words {i}") for i in range(3_000)] + [(2, "the same text")] * 500 + [(i, f"clean words {i}") for i in range(3, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    drawn = {r.positive: r["count"] for r in toxicity.sample(docs, known, 100, 400).groupBy("positive").count().collect()}
    assert drawn[True] == 100 and 200 < drawn[False] < 600
    few = toxicity.sample(docs.filter("doc_id = 2"), known, 100, 400).collect()
    assert [r.positive for r in few].count(True) == 1
