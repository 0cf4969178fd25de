"""Best candidate words through the index of letters, against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from strophe.functions.phonetics import MISMATCH, pair_score
from strophe.operators import matching
from strophe.operators.matching import top_candidates


def coverage(text, heard):
    letters = [c for c in text if c != " "]
    if not heard or not letters:
        return 0.0
    total = 0.0
    for c in letters:  # one by one: sum() would round otherwise
        total += max(pair_score(c, p) for p in heard)
    return total / len(letters)


def by_all_pairs(texts, words, limit):
    out = set()
    for song, pos, text in texts:
        scores = sorted((-coverage(text, w), at) for s, at, w in words if s == song)
        out |= {(song, pos, rank, at, round(-less, 9) + 0.0) for rank, (less, at) in enumerate(scores[:limit], 1)}
    return out


def found(spark, texts, words, **more):
    a = spark.createDataFrame(texts, "song long, pos long, norm string")
    b = spark.createDataFrame(words, "song long, word long, norm string")
    rows = top_candidates(a, b, ["song"], "pos", "norm", "word", **more).collect()
    got = [(r["song"], r["pos"], r["rank"], r["word"], round(r["score"], 9) + 0.0) for r in rows]
    assert len(set(got)) == len(got)
    return set(got)


@pytest.mark.parametrize("limit,hubs", [(3, 8), (1, 1), (5, 2)])
def test_candidates_equal_all_pairs(spark, limit, hubs):
    rng = random.Random(limit)
    few, many = "aeiz", "abcdefghijklmnoprstuvwyжд九 "

    def word(letters, most):
        return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))

    texts, words = [], []
    for song, (letters, most) in enumerate([(few, 3), (many, 9), (many, 4), (few + "ж", 6)]):
        n = (60, 120, 40, 2)[song]
        texts += [(song, i, word(letters, most)) for i in range(30)]
        words += [(song, i * 3, word(letters, most)) for i in range(n)]
    texts += [(7, 0, "alone")]
    assert found(spark, texts, words, limit=limit, hubs=hubs) == by_all_pairs(texts, words, limit)


def test_ties_repeats_and_nothing_in_common(spark):
    words = [(1, i, "ababab") for i in range(9)] + [(2, i, w) for i, w in enumerate(["жж", "", "xx", "q", "жx"])]
    texts = [(1, 0, "ab"), (1, 1, "ab"), (1, 2, "九"), (1, 3, ""), (2, 0, "九"), (2, 1, "x"), (2, 2, " ")]
    assert found(spark, texts, words) == by_all_pairs(texts, words, 3)


def test_no_rows(spark):
    assert found(spark, [], [(1, 0, "a")]) == set() and found(spark, [(1, 0, "a")], []) == set()


def test_pairs_behind_the_bar_are_not_exchanged(spark):
    """The pairs of texts and sets cross no exchange but that of the sets that come before a bar."""
    rng = random.Random(5)
    texts = [(1, i, "".join(rng.choice("abcdefgh") for _ in range(4))) for i in range(40)]
    a = spark.createDataFrame(texts, "song long, pos long, norm string")
    b = spark.createDataFrame([(s, at, w) for s, at, w in texts], "song long, word long, norm string")
    plan = top_candidates(a, b, ["song"], "pos", "norm", "word")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1  # no ranking by lanes
    assert "Aggregate [song, norm, _pool" not in plan and plan.count("Join ") <= 3


def test_sets_are_exchanged_without_the_letters_they_are_listed_under(spark):
    a = spark.createDataFrame([(1, 0, "abc")], "song long, pos long, norm string")
    b = spark.createDataFrame([(1, i, w) for i, w in enumerate(["abd", "zsh", "phk"])], "song long, word long, norm string")
    plan = top_candidates(a, b, ["song"], "pos", "norm", "word")._jdf.queryExecution().executedPlan().toString().splitlines()
    listed = [x for x in plan if "Generate explode(_lists" in x]
    assert listed and not [x for x in listed if "_lists" in x.split("), [")[1]]


def test_letters_are_listed_both_ways_alike(spark):
    letters = "abcdefghijklmnopqrstuvwxyzж"
    rows = spark.createDataFrame([(y,) for y in letters], "y string").select("y", matching._listed_under(F.col("y")).alias("l")).collect()
    for y, listed in rows:
        assert sorted(set(listed)) == sorted(c for c in letters if c == y or pair_score(c, y) > MISMATCH)
