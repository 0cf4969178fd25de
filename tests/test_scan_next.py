"""Values from the rows after are found in one pass over a block."""

import random

import pytest
from pyspark.sql import functions as F

from strophe.operators.scan import lead, next_seen, ordinal_block, scan


def _scanned(df):
    steps = {"seen": next_seen(F.col("v")), "led": lead(F.col("v"))}
    return scan(df, ["k"], ["n"], ordinal_block("n", 7), **steps)


@pytest.mark.parametrize("seed", [1, 2])
def test_next_equals_a_loop(spark, seed):
    draw = random.Random(seed)
    rows = [(k, n, draw.choice([None, None, n * 10])) for k in range(4) for n in range(draw.randint(1, 60))]
    want = set()
    for k, n, v in rows:
        after = [r[2] for r in rows if r[0] == k and r[1] > n]
        seen = next((x for x in after if x is not None), None)
        want.add((k, n, v, seen, after[0] if after else None))
    found = _scanned(spark.createDataFrame(rows, "k int, n int, v int"))
    assert {tuple(r) for r in found.collect()} == want


def test_no_frame_runs_to_the_end_of_a_block(spark):
    plan = _scanned(spark.range(9).selectExpr("1 AS k", "id AS n", "id AS v"))._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, 1, unboundedfollowing" not in plan
