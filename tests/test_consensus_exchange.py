"""Votes need one exchange, by the position that is voted on."""

import random
from statistics import median

from pyspark.sql import functions as F

from strophe.operators import consensus as C
from strophe.operators.stats import best_candidate


def test_readings_are_counted_in_one_exchange(spark):
    rng = random.Random(8)
    rows = [
        (k, seat, rng.choice(["a", "b", "c", None]), rng.choice([None, 0.25, 0.5]), float(rng.randint(0, 9)))
        for k in range(200) for seat in rng.sample(range(9), rng.randint(1, 7))
    ]
    df = spark.createDataFrame(rows, "k long, seat long, reading string, score double, mid double").repartition(3)
    out = best_candidate(df, ["k"], "reading", F.col("score"), F.col("mid"), "seat")
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert len([x for x in plan if " Exchange hashpartitioning" in x]) == 1
    want = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        won = min((-sum(r[2] == x[2] for r in own), min(r[1] for r in own if r[2] == x[2]), x[2] or "") for x in own)[2] or None
        own = [r for r in own if r[2] == won]
        mid = median(r[4] for r in own)
        want[k] = min(own, key=lambda r: (1.0 if r[3] is None else -r[3], abs(r[4] - mid), r[1]))
    assert {r.k: (r.k, r.seat, r.reading, r.score, r.mid) for r in out.collect()} == want


def test_words_are_voted_on_unstaged(spark, monkeypatch):
    """The winning words need neither the reference's word beside each of them nor a table of all of them."""
    rows = [(1, run, i, w, float(i), i + 0.5, 0.5) for run, t in enumerate(("one two three", "one too three", "two three")) for i, w in enumerate(t.split())]
    words = spark.createDataFrame(rows, "song long, run long, pos long, word string, start double, end double, score double")
    staged = []
    monkeypatch.setattr(C, "stage", lambda df: staged.append(df.columns) or df.localCheckpoint())
    got = C.consensus_runs(words, ["song"], "run", "pos", "word").orderBy("ref_pos").collect()
    assert [r.word for r in got] == ["one", "two", "three"] and staged == [[*words.columns, "norm"]]
