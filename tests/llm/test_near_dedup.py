"""Near de-duplication leaves one document of each group, also where its head is unlike the others."""

import random

import pytest

from strophe.llm import simhash
from strophe.llm.common import prepare


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def hub_and_copies():
    """A text, and three near copies of one another that are unlike it but within six bits of it."""
    for seed in range(10_000):
        rng = random.Random(seed)
        head = [f"w{rng.randint(0, 10**9)}" for _ in range(300)]
        other = list(head)
        for i in rng.sample(range(5, 290, 6), 12):
            other[i] = "changed" + str(i)
        texts = [" ".join(w) for w in (head, other, [*other, "x"], ["y", *other])]
        prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
        if all((prints[0] ^ p).bit_count() <= 6 for p in prints):
            return texts
    raise AssertionError


def test_copies_that_hang_on_an_unlike_head(session):
    texts = hub_and_copies()
    like = lambda i, j: simhash.resemblance(texts[i].encode(), texts[j].encode(), 5)
    assert max(like(0, i) for i in (1, 2, 3)) < 0.8 <= min(like(1, 2), like(1, 3), like(2, 3))
    df = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [0, 1]


def greedy(rows, words=5, similarity=0.8):
    """Along the ids (nulls last, then as read), a row stays unless it resembles one that stays before it."""
    kept = []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if not any(simhash.resemblance((text or "").encode(), (k or "").encode(), words) >= similarity for _, k in kept):
            kept.append((i, text))
    return kept


def families(n, seed):
    """Texts of a few families, each text its family's with some words changed."""
    rng = random.Random(seed)
    heads = [[f"w{rng.randint(0, 999)}" for _ in range(60)] for _ in range(7)]
    rows = []
    for i in range(n):
        words = list(rng.choice(heads))
        for at in rng.sample(range(60), rng.randint(0, 3)):
            words[at] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(words).title() if i % 9 == 0 else " ".join(words)))
    return rows + [(None, rows[3][1]), (None, None), (-1, ""), (10**9, None), (2, rows[5][1])]


@pytest.mark.parametrize("head_rows, salt_rows", [(3, 5), (10, 1000), (1000, 1000)])
def test_rounds_give_the_greedy_choice(session, monkeypatch, head_rows, salt_rows):
    rows = families(160, head_rows)
    # One group of all rows: a closure of fingerprints that says nothing about likeness.
    monkeypatch.setattr(simhash, "near_groups", lambda df, *_: df.select("place", "place").toDF("doc_id", "x").selectExpr("doc_id", "0L as component_id"))
    df = session.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = simhash.keep_one(df, head_rows=head_rows, salt_rows=salt_rows).collect()
    want = greedy(rows)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want))
    assert 7 < len(want) < len(rows)


def test_jobs_do_not_grow_with_a_group(session):
    """Near copies of one text settle in one round of two, however many there are."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    counts = []
    for n in (40, 400):
        rows = [(i, " ".join([*words, f"end{rng.randint(0, 9)}"])) for i in range(n)]
        df = session.createDataFrame(rows, "doc_id long, text string")
        session.sparkContext.setJobGroup(f"near {n}", "count")
        left = simhash.keep_one(df, head_rows=16).collect()
        counts.append(len(session.sparkContext.statusTracker().getJobIdsForGroup(f"near {n}")))
        assert [r.doc_id for r in left] == [0]
    session.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 10 and counts[1] < 120


def test_shingle_sets_stand_for_texts():
    texts = [t or "" for _, t in families(60, 4)] + ["one", "one two three four five six", " ", "a b c d e"]
    for a in texts[::3]:
        for b in texts:
            sets = [simhash.shingle_set(t.encode(), 5) for t in (a, b)]
            want = simhash.resemblance(a.encode(), b.encode(), 5)
            for level in (0.3, 0.8, 1.0):
                assert simhash.alike(*sets, level) == (want >= level)
