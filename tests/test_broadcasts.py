"""No side of a join is broadcast by the size of the files it comes from."""

import pytest

from __spark_entry__ import queries
from strophe.session import BROADCASTS, tune, untune


@pytest.mark.parametrize("name", ["unaligned_ends"])
def test_first_plan_broadcasts_nothing(spark, name):
    """Rows generated from small files, and staged rows that compress well, may be very many."""
    plan = queries()[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_limits_are_taken_back(spark):
    untune(spark)
    own = [spark.conf.get(k, None) for k in BROADCASTS]
    tune(spark)
    assert [spark.conf.get(k) for k in BROADCASTS] != own
    untune(spark)
    assert [spark.conf.get(k, None) for k in BROADCASTS] == own
    tune(spark)
