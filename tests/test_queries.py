"""Registered queries against their SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from strophe.plans.registry import CHECKS
from tools.check import duck, rows_of

queries()  # registers them
CHECKED = sorted(CHECKS)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, small, name):
    df = queries()[name](spark, small)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(small).execute(oracle_sql()[name])
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert got == want
    assert got[1]


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 150


def test_entry_gives_rows(spark):
    assert entry(spark).count() > 0
