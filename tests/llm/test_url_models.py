"""The URL models count every ruled URL, and scores equal those of a plain model."""

import math
from collections import Counter, defaultdict

from catalith.llm import queries as Q
from catalith.llm import url_filter

ROWS = [(i, f"http://h{i % 3}.{'org' if i % 2 else 'com/de'}/p{i}") for i in range(3_000)] + [(9_000, "http://rare.org/" + "zq" * 2_000), (9_001, "http://é.net/x"), (9_001, "http://é.net/x"), (None, None), (9_002, "")]


def plain(counts, url):
    """Bits for each byte, by recursion over ever longer contexts."""
    def p(verdict, window):
        if not window:
            return 1 / 256
        after = {w: n for w, n in counts[verdict].items() if len(w) == len(window) and w[:-1] == window[:-1]}
        below = p(verdict, window[1:])
        return (after.get(window, 0) + len(after) * below) / (sum(after.values()) + len(after)) if after else below

    total = sum(math.log2(p("allow", w) / p("block", w)) for w in (url[max(0, i - 5) : i + 1] for i in range(len(url))))
    return total / len(url) if url else 0.0


def test_models_and_scores(spark):
    pages = spark.createDataFrame([(*r, "h", "p", "r", "v", 1, 2.0) for r in ROWS], "page_id long, url string, host string, path string, rule string, verdict string, number int, score double").repartition(4)
    judged = url_filter.judged(pages, Q.URL_RULES)
    want = defaultdict(Counter)
    for i, url in ROWS:
        if url and ".net" not in url:
            want["allow" if i % 2 or i == 9_000 else "block"].update(url_filter.windows(url.encode()))
    counts = {bytes(r["window"]): (r["allow"], r["block"]) for r in url_filter.model(judged.filter("verdict is not null")).collect()}
    assert counts == {w: (want["allow"][w], want["block"][w]) for w in {*want["allow"], *want["block"]}}
    for common in (200_000, 10):
        out = url_filter.classify(pages, Q.URL_RULES, 0, common).collect()
        assert len(out) == len(ROWS)
        found = {r.page_id: r for r in out}
        for i in (0, 1, 2, 9_000, 9_001, 9_002, None):
            url = dict(ROWS)[i] or ""
            assert abs(found[i].score - plain(want, url.encode())) < 1e-8
            assert found[i].rule is not None or found[i].verdict == ("allow" if found[i].score >= 0 else "block")


def test_held_out_rows_are_bounded_and_not_counted(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string")
    judged = url_filter.judged(pages, Q.URL_RULES)
    apart = url_filter.held_out(judged, 100)
    assert 100 < judged.filter(apart).count() < 320 and judged.filter(apart & judged.verdict.isNull()).count() == 0
    assert url_filter.classify(pages.filter("false"), Q.URL_RULES).count() == 0
