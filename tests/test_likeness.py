"""Near texts against all pairs; bounds never lose a pair."""

import difflib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.operators import ledgers
from lorespark.operators.likeness import common_length, counts_of, may_match, near_texts, places_of

SCHEMA = "id long, text string"


def ratio(a, b, autojunk=False):
    return difflib.SequenceMatcher(None, a, b, autojunk).ratio()


def texts(seed, n):
    """Random texts, and edited ones, some of them near."""
    rng, out = random.Random(seed), [None, "", "a", "ab", "ba"]
    words = "the of and cat dog run tree 漢字 über stone river light".split()
    while len(out) < n:
        if len(out) > 20 and rng.random() < 0.6:
            base = list(rng.choice(out) or "abc")
            for _ in range(rng.randrange(0, 2 + len(base) // 8)):
                at = rng.randrange(len(base) + 1)
                base[at : at + rng.choice([0, 1, 1, 3])] = rng.choice(["", "x", "yz"])
            out.append("".join(base))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 20, 60]))))
    return out


@pytest.mark.parametrize(("least", "autojunk", "n"), [(0.85, False, 500), (0.85, True, 250), (0.6, False, 120), (1.0, False, 120)])
def test_all_pairs(spark, least, autojunk, n):
    rows = list(enumerate(texts(3, n)))
    left, right = rows[: n // 2], rows[n // 2 :] + [(10_000, rows[9][1])]
    got = near_texts(spark.createDataFrame(left, SCHEMA).repartition(3), spark.createDataFrame(right, SCHEMA).repartition(3), least, autojunk).collect()
    want = {(i, j): ratio(a, b, autojunk) for i, a in left for j, b in right if a and b and ratio(a, b, autojunk) >= least}
    assert len(got) == len(want) > 3 and {(r[0], r[1]): r[2] for r in got} == want


def test_order_of_the_two_counts(spark):
    pairs = [(a, b) for a, b in (("tide", "diet"), ("abcbdab", "bdcaba")) if ratio(a, b) != ratio(b, a)]
    assert pairs
    for a, b in pairs:
        one, other = (spark.createDataFrame([(1, t)], SCHEMA) for t in (a, b))
        assert near_texts(one, other, 0.1).first()["ratio"] == ratio(a, b) and near_texts(other, one, 0.1).first()["ratio"] == ratio(b, a)


@given(st.text("ab ", max_size=30), st.text("ab ", max_size=30), st.sampled_from([0.3, 0.7, 0.85, 1.0]))
@settings(max_examples=400, deadline=None)
def test_bounds_lose_nothing(a, b, least):
    if a and b and ratio(a, b) >= least:
        assert may_match(counts_of(b), len(b), counts_of(a)[None], np.array([len(a)]), least)[0]
        assert 2 * common_length(places_of(b), len(b), a) >= least * (len(a) + len(b)) - 1e-9


@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
@settings(max_examples=300, deadline=None)
def test_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    assert common_length(places_of(a), len(a), b) == row[-1]


def test_leaks_by_likeness(spark):
    candidates = [(1, "a quick brown fox jumps", 5, "f", True), (2, "a quick brown fox jumped", 1, "f", True), (3, "something else", 6, "g", True), (4, "something else", 7, None, True), (5, "wholly new", None, None, True), (6, "wholly new", 8, None, None)]
    cases = [(1, "a quick brown fox jumps!", 1, "h"), (2, "no", None, "g"), (3, None, 9, None)]
    got = ledgers.example_leaks(spark.createDataFrame(candidates, "candidate_id long, text string, item_id long, family string, reviewed boolean"), spark.createDataFrame(cases, "case_id long, text string, item_id long, family string"), 0.85).collect()
    assert dict(map(tuple, got)) == {1: "near_duplicate", 2: "same_item", 3: "same_family", 4: "eligible", 5: "eligible", 6: "not_reviewed"}


def test_sets_share_near_items(spark):
    rows = [(1, "train", "one two three four five", 1), (2, "test", "one two three four fiv", 2), (3, "test", "other", 3), (4, "train", "other!", 4), (5, "tune", "one two three four five", 0), (6, "train", "other", 5)]
    items = spark.createDataFrame([(i, p, t, place, t, str(i), 1) for i, p, t, place in rows], "id long, part string, text string, place long, input string, family string, label long")
    got = {r["part"]: (r["near_items"], r["shared_input"]) for r in ledgers.set_geometry(items, 0.85).collect()}
    assert got == {"train": (3, 2), "test": (1, 1), "tune": (0, 1)}
