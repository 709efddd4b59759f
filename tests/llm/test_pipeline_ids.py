"""The pipeline's dedup stages decide each row by itself, whatever its id."""

import random

import corpus_pipeline


def words(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5_000)}" for _ in range(n))


A, B, C, D, E, F_ = (words(i) for i in range(6))
ROWS = [(1, A), (1, A), (1, B), (2, A), (None, C), (None, C), (None, D), (None, A), (3, E), (3, A), (4, F_), (5, None), (6, "")]
ONE_EACH = sorted([(1, A), (1, B), (None, C), (None, D), (3, E), (4, F_), (5, "")], key=repr)


def stage(spark, run, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
    out = run(spark, docs, "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    return sorted([(r.doc_id, r.text or "") for r in out.collect()], key=repr)


def test_copies_of_null_and_repeated_ids(spark):
    assert stage(spark, corpus_pipeline.drop_copies, ROWS) == ONE_EACH


def test_near_copies_of_null_and_repeated_ids(spark):
    assert stage(spark, corpus_pipeline.drop_near_copies, ROWS) == ONE_EACH
