"""The registered queries at the smallest scale: SQL where there is some, and the pipeline's stages against plain versions."""

import collections
import os
import re

import pytest

import corpus_pipeline
from catalith.llm import queries as Q
from tests.compare import difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, name):
    assert difference(Q.queries()[name](spark, SF), Q.ORACLE_SQL[name], SF) == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and after
        kept[name] = (before, after)
    before, after = kept["language_id"]
    assert len(after) >= 0.97 * len(before)
    before, after = kept["exact_dedup"]
    first = collections.defaultdict(lambda: float("inf"))
    for r in before.values():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[key] = min(first[key], r.doc_id)
    assert set(after) == set(first.values())
    before, after = kept["substring_dedup"]
    assert set(before) == set(after)
    seen = set()
    for i in sorted(after):
        w = (after[i].text or "").split()
        grams = {" ".join(w[p : p + 13]) for p in range(len(w) - 12)}
        if after[i].text == before[i].text:
            assert not grams & seen  # what is left whole repeats nothing
        w = (before[i].text or "").split()
        seen |= {" ".join(w[p : p + 13]) for p in range(len(w) - 12)}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == len(after)
