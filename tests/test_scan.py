"""Block-wise scans, percentiles and interval joins, also with one hot key."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strophe.operators import quantiles as Q
from strophe.operators import ranges as R
from strophe.operators import scan as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    # Key 0 holds more than a third of all rows.
    data = []
    for key, n in [(0, 900), (1, 300), (2, 1), (3, 500)]:
        for i in range(n):
            v = None if rng.random() < 0.2 else int(rng.integers(-50, 50))
            data.append((key, i, v))
    return spark.createDataFrame(data, "k long, i long, v long").repartition(5)


def test_scan_equals_plain_windows(rows):
    got = S.scan(
        rows, ["k"], ["i"], S.ordinal_block("i", 64),
        total=S.run_sum(F.col("v")), top=S.run_max(F.col("v")), before=S.max_before(F.col("v")), n=S.position(),
        last=S.last_seen(F.col("v")), prev=S.prev_seen(F.col("v")), nxt=S.next_seen(F.col("v")),
        lag=S.lag(F.col("v")), lead=S.lead(F.col("v")), cnt=S.run_count(F.col("v") > 0),
    )
    w = Window.partitionBy("k").orderBy("i")
    upto, below, above = (
        w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1),
        w.rowsBetween(1, Window.unboundedFollowing),
    )
    want = rows.select(
        "k", "i", "v",
        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("total"), F.max("v").over(upto).alias("top"),
        F.max("v").over(below).alias("before"), F.row_number().over(w).cast("long").alias("n"),
        F.last("v", True).over(upto).alias("last"), F.last("v", True).over(below).alias("prev"),
        F.first("v", True).over(above).alias("nxt"), F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"),
        F.sum(F.when(F.col("v") > 0, 1).otherwise(0)).over(upto).alias("cnt"),
    )
    assert got.count() == rows.count()
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_halo_equals_plain_windows(rows):
    got = S.halo(
        rows, ["k"], "i", 2, {"m": lambda w: F.sum("v").over(w.rowsBetween(-2, 2)), "p": lambda w: F.lag("v", 2).over(w)}, rows=32
    )
    w = Window.partitionBy("k").orderBy("i")
    want = rows.select("k", "i", "v", F.sum("v").over(w.rowsBetween(-2, 2)).alias("m"), F.lag("v", 2).over(w).alias("p"))
    assert got.select(want.columns).exceptAll(want).count() == 0
    assert got.count() == rows.count()


def test_no_window_holds_a_whole_hot_key(rows):
    df = S.scan(rows, ["k"], ["i"], S.ordinal_block("i", 64), n=S.position(), p=S.lag(F.col("v")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    specs = [part.split("specifiedwindowframe")[0] for part in plan.split("windowspecdefinition(")[1:]]
    # Windows over rows are partitioned by key and block; the one over the
    # summaries is ordered by block, one row each.
    assert specs and all("_blk" in spec for spec in specs)
    blocks = df.groupBy("k").agg(F.max("n").alias("n")).collect()
    assert {r.k: r.n for r in blocks} == {0: 900, 1: 300, 2: 1, 3: 500}


def test_percentiles_equal_numpy(rows):
    out = Q.quantiles(
        rows, ["k"], "v", p95=Q.linear("v", 0.95), med=Q.linear("v", 0.5), near=Q.nearest_rank("v", 0.75)
    ).collect()
    for r in out:
        xs = np.array([x.v for x in rows.where(F.col("k") == r.k).collect() if x.v is not None], dtype=float)
        assert r.n == len(xs)
        assert r.p95 == pytest.approx(np.percentile(xs, 95), abs=1e-9)
        assert r.med == pytest.approx(np.median(xs), abs=1e-9)
        assert r.near == sorted(xs)[round((len(xs) - 1) * 0.75)]


def test_overlap_join_equals_nested_loop(spark):
    rng = np.random.default_rng(5)

    def spans(n, tag):
        s = rng.random(n) * 100
        e = s + rng.choice([0.0, 0.5, 3.0, 40.0], n)
        return spark.createDataFrame(
            [(int(k % 3), k, float(a), float(b)) for k, (a, b) in enumerate(zip(s, e))], f"k long, {tag} long, {tag}s double, {tag}e double"
        )

    a, b = spans(80, "a"), spans(90, "b")
    got = R.overlap_join(a, b, ["k"], ("as", "ae"), ("bs", "be"), 2.0)
    want = a.join(b, "k").where("be > `as` AND bs < ae")
    pairs = {(r.a, r.b) for r in got.collect()}
    assert pairs == {(r.a, r.b) for r in want.collect()}
    assert got.count() == len(pairs)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_points_in_intervals_are_closed_and_hashed(spark):
    points = spark.createDataFrame([(1, x / 2) for x in range(20)], "k long, t double")
    intervals = spark.createDataFrame([(1, 7, 1.0, 3.0), (1, 8, 2.5, 2.5)], "k long, id long, s double, e double")
    got = R.points_in_intervals(points, intervals, ["k"], "t", ("s", "e"), 1.0)
    assert sorted((r.id, r.t) for r in got.collect()) == [(7, 1.0), (7, 1.5), (7, 2.0), (7, 2.5), (7, 3.0), (8, 2.5)]
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_one_very_long_interval_among_short_ones(spark):
    rows = [(1, k, float(k), k + 0.5) for k in range(200)] + [(1, 900, -3e9, 3e9)]
    a = spark.createDataFrame(rows, "k long, a long, as double, ae double")
    b = spark.createDataFrame([(1, 7, 10.2, 10.4), (1, 8, -1e9, 50.0)], "k long, b long, bs double, be double")
    got = {(r.a, r.b) for r in R.overlap_join(a, b, ["k"], ("as", "ae"), ("bs", "be"), 1.0).collect()}
    assert got == {(10, 7), (900, 7), (900, 8), *[(k, 8) for k in range(50)]}
    points = spark.createDataFrame([(1, 2e9), (1, 10.5), (1, 10.6)], "k long, t double")
    hits = R.points_in_intervals(points, a, ["k"], "t", ("as", "ae"), 1.0).collect()
    assert sorted((r.a, r.t) for r in hits) == [(10, 10.5), (900, 10.5), (900, 10.6), (900, 2e9)]


def plan_of(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = text.splitlines()
    exchanges = [x for x in lines if " Exchange " in x and "ReusedExchange" not in x]
    return len([x for x in lines if "Scan " in x]), len(exchanges)


def test_a_scan_reads_its_input_once(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    steps = {"n": S.position(), "p": S.lag(F.col("value")), "all": S.total(F.lit(1).cast("long"))}
    df = S.scan(events, ["user_id"], ["event_id"], S.ordinal_block("event_id", 64), **steps)
    reads, exchanges = plan_of(df)
    assert reads == 1 and exchanges <= 3
    sizes = {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    assert all(r["all"] == sizes[r.user_id] for r in df.collect())


def test_quiet_runs_reads_twice_at_most(spark, small):
    from strophe.operators import ordered as O

    events = spark.read.parquet(f"{small}/events.parquet").withColumn("level", F.abs("value"))
    reads, exchanges = plan_of(O.quiet_runs(events, ["user_id"], "event_id", "level", 2, 0.9))
    assert reads <= 2 and exchanges <= 8
