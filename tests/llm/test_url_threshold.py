"""The threshold is that of all ruled URLs, each scored by models that have not seen it."""

import random

from catalith.llm import queries as Q
from catalith.llm import url_filter


def test_threshold_of_a_table_is_that_of_lists(spark):
    draw = random.Random(1)
    for shift in (-0.4, 0.0, 0.7):
        rows = [(v, round(draw.gauss(shift + (0.3 if v == "allow" else -0.3), 0.5), 2)) for v in ("allow", "block") for _ in range(400)]
        want = url_filter.calibrate(*[[s for v, s in rows if v == w] for w in ("allow", "block")])
        assert abs(url_filter.threshold(spark.createDataFrame(rows, "verdict string, score double").repartition(3)) - want) < 1e-12
    assert url_filter.threshold(spark.createDataFrame([("allow", 1.0)], "verdict string, score double")) == 0.0


def test_all_ruled_urls_count_for_models_and_threshold(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.{'org' if i % 2 else 'com/de'}/p{i}") for i in range(2_000)] + [(9_000, "http://h.net/x")]
    seen, plain = [], url_filter.threshold
    monkeypatch.setattr(url_filter, "threshold", lambda scored: seen.append(scored.count()) or plain(scored))
    out = {r.page_id: r for r in url_filter.classify(spark.createDataFrame(rows, "page_id long, url string"), Q.URL_RULES).collect()}
    assert seen == [2_000] and len(out) == 2_001
    whole = {r.page_id: r.score for r in url_filter.classify(spark.createDataFrame(rows, "page_id long, url string"), Q.URL_RULES, 0).collect()}
    assert all(out[i].score == whole[i] for i in out)
