from hypothesis import given, settings
from hypothesis import strategies as st

from catalith.functions import similarity as S

words = st.text("abc ", max_size=12)


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_common_length_is_the_plain_one(a, b):
    assert S.common_length(a, b) == plain_common(a, b)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_scores_are_bounded_and_symmetric(a, b):
    for score in (S.ratio, S.token_sort_ratio, S.token_set_ratio, S.weighted_ratio, S.partial_ratio):
        assert 0 <= score(a, b) <= 100
        assert abs(score(a, b) - score(b, a)) < 1e-9


def test_known_scores():
    assert S.ratio("abcd", "abcd") == 100
    assert S.ratio("", "") == 100
    assert S.token_sort_ratio("new york mets", "mets york new") == 100
    assert S.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert round(S.ratio("this is a test", "this is a test!"), 2) == 96.55
    assert S.partial_ratio("test", "this is a test!") == 100
