"""The job feed over several batches: late rows, restart, expiry and bounded tails."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from strophe.session import fresh_path
from strophe.streaming import feeds as S

SCHEMA = "job string, ts timestamp, nth long, status string, line string"


def batches(spark, parts, **options):
    folder, path, seen = fresh_path(spark, "jobs"), None, []
    for rows in parts:
        data = spark.createDataFrame([(j, day * 86400.0, n, s, w) for j, day, n, s, w in rows], "job string, at double, nth long, status string, line string")
        data.select("job", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts"), "nth", "status", "line").write.mode("append").parquet(folder)
        stream = S.replay(spark, folder, "*.parquet", spark.createDataFrame([], SCHEMA).schema, per_batch=1000)
        jobs, path = S.job_log(stream, "job", "ts", "nth", "status", "line", "job-log", path=path, **options)
        seen.append({r.job: (r.status, r.seen, list(r.log_tail)) for r in jobs.collect()})
    return seen


def test_late_rows_restart_and_expiry(spark):
    first, second, third, fourth = batches(
        spark,
        [
            [("a", 1.0, 1, "queued", "a1"), ("a", 2.0, 3, "done", "a3"), ("b", 2.0, 1, "queued", "b1"), ("c", 3.0, 1, "queued", "c1"), (None, 3.0, 9, "x", "x")],
            # a2 is late but within the watermark; the line before it is too late.
            [("a", 2.9, 2, "running", "a2"), ("c", 1.0, 0, "lost", "c0"), ("c", 4.0, None, None, None)],
            [("c", 9.5, 3, "done", "c3")],
            [("b", 12.0, 5, "queued", "b5")],
        ],
        tail=2, days=7.0, delay="1 day",
    )
    assert first == {"a": ("done", 2, ["a1", "a3"]), "b": ("queued", 1, ["b1"]), "c": ("queued", 1, ["c1"])}
    assert second == {"a": ("running", 3, ["a3", "a2"]), "b": ("queued", 1, ["b1"]), "c": (None, 2, ["c1", None])}
    assert third == {"a": ("running", 3, ["a3", "a2"]), "b": ("queued", 1, ["b1"]), "c": ("done", 3, [None, "c3"])}
    # The watermark stands at day 11: a (9.9) is over, and so is b, had it not come back in time.
    assert fourth == {"b": ("queued", 2, ["b1", "b5"]), "c": ("done", 3, [None, "c3"])}


def test_long_log_keeps_the_last_lines(spark):
    rows = [("a", 1.0 + n / 1000, n, "running", f"line {n}") for n in range(300)]
    (got,) = batches(spark, [rows])
    assert got["a"][1:] == (300, [f"line {n}" for n in range(100, 300)])


def test_few_calls_to_the_state():
    """A batch of a known job reads and writes its state once and leaves its timer alone."""
    calls, held = [], {}

    class Handle:
        def getValueState(self, name, schema):
            calls.append("open")
            return self

        def get(self):
            calls.append("get")
            return held.get("v")

        def update(self, value):
            calls.append("update")
            held["v"] = value

        def registerTimer(self, at):
            calls.append(f"timer {at}")

    job = S._Job("job", 2, 1000)
    job.init(Handle())
    rows = [Row(at=1_000_000 * n, nth=n, status="s", line=f"l{n}") for n in (3, 1, 2)]
    (got,) = job.handleInputRows(("a",), iter(rows), None)
    assert (got["last_nth"], got["seen"], got["log_tail"]) == (3, 3, ["l2", "l3"])
    assert calls == ["open", "get", "timer 4000", "update"]
    calls.clear()
    (got,) = job.handleInputRows(("a",), iter([Row(at=9_000_000, nth=4, status="t", line="l4")]), None)
    assert (got["last_nth"], got["seen"], got["log_tail"]) == (4, 4, ["l3", "l4"])
    assert calls == ["get", "update"]
