"""The pipeline's stages on small tables: nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names, against plain versions."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from catalith.llm import queries as Q
from tests.llm.test_operators import plain_fingerprint, plain_removal

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kept boolean, fp long, root long, accepted boolean, _text string, at int, number long, nul boolean, addr long, bucket int"


def words(seed, n=80, size=5_000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


BASE = words(1, 400)
TEXTS = [BASE, BASE, BASE.replace(" ", "\n", 3), BASE.replace("w1", "v1", 1), words(2), words(2, 70), "", None, " ", "a", "one two", words(3, 30_000), words(4), words(5) + " " + words(4), "ünïcödé ß " * 30]
ROWS = [*enumerate(TEXTS, 1), (4, BASE), (None, words(6)), (None, words(6)), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", False, 7, 9, False, "x", 1, 2, True, 3, 4) for i, t in rows], SCHEMA).repartition(3).cache()


def run(spark, stage, rows):
    out = dict(corpus_pipeline.STAGES)[stage](spark, frame(spark, rows), "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    return sorted([(r.doc_id, r.text, r.n_chars) for r in out.collect()], key=repr)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, stage):
    assert dict(corpus_pipeline.STAGES)[stage](spark, frame(spark, []), "").count() == 0


def plain_keep(rows, same):
    """One row of each group of rows that are alike: the least id's, a null id last."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    root = list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            if same(order[i][1], order[j][1]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return [order[r] for r in sorted(set(root))]


def ids(rows):
    return sorted([r[0] for r in rows], key=repr)


def test_exact_copies(spark):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert ids(run(spark, "exact_dedup", ROWS)) == ids(plain_keep(ROWS, lambda a, b: key(a) == key(b)))


def test_near_copies(spark):
    prints = {t: plain_fingerprint(t) for _, t in ROWS}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3
    assert (prints[BASE] ^ prints[TEXTS[3]]).bit_count() <= 3 and ids(run(spark, "simhash_near_dedup", ROWS)) == ids(plain_keep(ROWS, near))


def test_passages(spark):
    want = []
    for (i, t), (_, _, removed, kept) in zip(ROWS, plain_removal(ROWS), strict=True):
        text = kept.decode() if removed else t
        want.append((i, text, None if t is None else len(text)))
    assert run(spark, "substring_dedup", ROWS) == sorted(want, key=repr)


def test_language(spark):
    kinds = {"en": ["the", "and", "ing"], "fr": ["eau", "les", "aux"]}
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices(kinds[lang], k=3)) for _ in range(40)), lang) for i in range(120) for lang in [("en", "fr")[i % 2]]]
    odd = [(1_000, None, "en"), (1_001, "", "fr"), (1_002, "12 34 !", "en"), (1_003, rows[0][1], None), (1_003, rows[0][1], None), (None, rows[1][1], "zz")]
    df = spark.createDataFrame([(i, t, g, "s", 1, 0.5, True) for i, t, g in rows + odd], "doc_id long, text string, lang string, source string, n_chars long, score double, accepted boolean")
    out = corpus_pipeline.identify_language(spark, df, "").collect()
    found = [r.doc_id for r in out]
    assert not {1_000, 1_001, 1_002} & set(found) and found.count(1_003) == 2 and None in found and len(set(found) & set(range(120))) >= 118


def test_packed_ids(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(Q.tokenizer_path(Q.WORD_BPE))
    rows = [(i, t) for i, t in ROWS if i is not None][:15]
    pieces = corpus_pipeline.pack(spark, frame(spark, rows), "").collect()
    for i, t in rows:
        tokens = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i)
        assert [s for s, _, _ in mine] == np.cumsum([0, *[n for _, n, _ in mine]])[:-1].tolist() and sum(n for _, n, _ in mine) == len(tokens)
        assert all(c == zlib.crc32(tokens[s : s + n].tobytes()) for s, n, c in mine)
