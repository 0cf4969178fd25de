"""Frames of amplitude 0 count in ``ladder_median_hz``, as in its SQL."""

import datetime

import duckdb
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries


def test_zero_values_count(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    # Ids over 50 have confidences over 0.5; user 1 has a zero among them, user 2 zeros alone.
    rows = [(51, at, 1, "view", 0.0, '{"k": 1}'), (52, at, 1, "view", 4.0, '{"k": 1}'), (53, at, 1, "view", 9.0, '{"k": 1}'),
            (54, at, 1, "view", 10.0, '{"k": 1}'), (60, at, 2, "view", 0.0, '{"k": 1}'), (20, at, 2, "view", 7.0, '{"k": 1}')]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = queries()["ladder_median_hz"](spark, str(tmp_path))
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = base.execute(oracle_sql()["ladder_median_hz"]).fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) == [(1, "view", 6.5), (2, "view", 0.0)]
    assert found.where(F.col("hz").isNull()).count() == 0
