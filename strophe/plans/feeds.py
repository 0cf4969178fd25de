"""Queries that replay the events table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.plans import roles
from strophe.plans.registry import query, table
from strophe.session import fresh_path
from strophe.sources import charts
from strophe.streaming import feeds as S

FAR = "2030-01-01 00:00:00"


def _events(spark, sf, tick=True):
    """Events as a stream, ended by a tick that lets every window close."""
    given = table(spark, sf, "events")
    stream = S.replay(spark, sf, "events.parquet", given.schema).select(
        F.col("user_id").alias("song"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"
    )
    return S.with_tick(stream, "ts", FAR) if tick else stream


@query(
    "stream_rms",
    "WITH " + roles.FRAMES_SQL + """,
    x AS (SELECT song, amp, unnest(range(CAST(floor((t - 172800) / 86400) AS BIGINT) + 1, CAST(floor(t / 86400) AS BIGINT) + 1)) AS d FROM frames)
    SELECT song, d * 86400 AS frame_start, round(sqrt(avg(amp * amp)), 6) AS rms, count(*) AS n FROM x GROUP BY song, d""",
)
def _(spark, sf):
    out = S.finish(S.sliding_rms(_events(spark, sf), "song", "ts", "value", "2 days", "1 day", "1 hour"), "rms")
    return out.where("song IS NOT NULL").select(
        "song", F.unix_seconds("frame_start").alias("frame_start"), F.round("rms", 6).alias("rms"), "n"
    )


@query(
    "stream_sessions",
    "WITH " + roles.FRAMES_SQL + """,
    g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY song ORDER BY t, id) > 43200.0 THEN 1 ELSE 0 END AS o FROM frames),
    s AS (SELECT *, sum(o) OVER (PARTITION BY song ORDER BY t, id) AS k FROM g)
    SELECT song, min(t) AS first, max(t) AS last, count(*) AS n FROM s GROUP BY song, k""",
)
def _(spark, sf):
    out = S.finish(S.sessions(_events(spark, sf), "song", "ts", "12 hours", "1 hour"), "sessions")
    return out.where("song IS NOT NULL").select(
        "song", (F.unix_micros("first") / F.lit(1e6)).alias("first"), (F.unix_micros("last") / F.lit(1e6)).alias("last"), "n"
    )


@query("stream_dedup", "SELECT DISTINCT user_id AS song, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day FROM events")
def _(spark, sf):
    days = _events(spark, sf, tick=False).withColumn("day", F.unix_seconds(F.date_trunc("day", "ts")))
    return S.finish(S.dedup(days, ["song", "day"], "ts", "40 days"), "dedup").select("song", "day")


@query(
    "stream_quiet_runs",
    "WITH " + roles.FRAMES_N_SQL + """,
    q AS (SELECT song, n, t, amp < 60 AS quiet, n - row_number() OVER (PARTITION BY song, amp < 60 ORDER BY n) AS isl, max(n) OVER (PARTITION BY song) AS last FROM framesn),
    r AS (SELECT song, min(t) AS start, max(n) AS e, max(last) AS last, count(*) AS frames FROM q WHERE quiet GROUP BY song, isl HAVING count(*) >= 3)
    SELECT r.song, start, f.t AS end, frames FROM r JOIN framesn f ON f.song = r.song AND f.n = least(e + 1, r.last)""",
)
def _(spark, sf):
    runs = S.quiet_runs(_events(spark, sf), "song", "ts", "value", 60.0, 3, 60 * 86400 * 1000, "1 hour")
    return S.finish(runs, "quiet")


@query(
    "stream_ingest",
    """SELECT o_orderkey AS song, 'Song ' || o_orderkey AS title, o_orderpriority AS artist, 60 + o_orderkey % 120 + 0.0::DOUBLE AS bpm FROM orders""",
)
def _(spark, sf):
    """Chart headers taken in as they arrive, each song once."""
    given = table(spark, sf, "orders")
    stream = S.replay(spark, sf, "orders.parquet", given.schema)
    k = F.col("o_orderkey").cast("string")
    text = F.concat_ws(
        "\n", F.concat(F.lit("#TITLE:Song "), k), F.concat(F.lit("#ARTIST:"), "o_orderpriority"),
        F.concat(F.lit("#BPM:"), (60 + F.col("o_orderkey") % 120).cast("string")), F.lit(": 0 4 60 la"),
    )
    songs = charts.parse_songs(stream.select(F.col("o_orderkey").alias("song"), text.alias("text")))
    return S.ingest(songs.select("song", "title", "artist", "bpm"), ["song"], "ingest")


@query(
    "stream_jobs",
    """SELECT user_id AS song, arg_max(event_type, epoch_us(ts) * 1000 + event_id % 1000) AS status, arg_max(event_id, epoch_us(ts) * 1000 + event_id % 1000) AS last_id FROM events GROUP BY user_id
    HAVING max(epoch_us(ts)) / 1000000.0 >= 1704067200.0 + 30 * 86400.0 - 7 * 86400.0""",
)
def _(spark, sf):
    """Latest status per job, jobs unchanged for a week left out."""
    feed = _events(spark, sf, tick=False).select("song", "ts", F.col("event_type").alias("status"), F.col("event_id").alias("last_id"))
    newest = S.latest_status(feed, ["song"], ["ts", "last_id"], ["ts", "status", "last_id"], "jobs")
    now = F.lit(1704067200.0 + 30 * 86400.0)
    return S.younger_than(newest, "ts", 7, now).select("song", "status", "last_id")


@query(
    "stream_job_log",
    """WITH r AS (SELECT user_id AS song, epoch_us(ts) AS us, event_id AS nth, event_type AS status, event_type || ' ' || event_id AS line,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
    j AS (SELECT song, max(us) AS last_at, max(nth) FILTER (k = 1) AS last_id, max(status) FILTER (k = 1) AS status, count(*) AS seen, string_agg(line, '|' ORDER BY k DESC) FILTER (k <= 20) AS lines FROM r GROUP BY song)
    SELECT * FROM j WHERE last_at + 7 * 86400000000 > (SELECT max(epoch_us(ts)) - 3600000000 FROM events)""",
)
def _(spark, sf):
    """Newest status and last twenty lines of each job still kept, from four batches in order of time."""
    folder = fresh_path(spark, "job-rows")
    given = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = given.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    quarter = F.least(F.lit(3), F.floor((F.unix_micros("ts") - first) * 4 / max(1, last - first)))
    path = None
    for k in range(4):
        # The feed stops and goes on from its checkpoint as each quarter of the rows arrives.
        given.where(quarter == k).write.mode("append").parquet(folder)
        stream = S.replay(spark, folder, "*.parquet", given.schema, per_batch=100_000).select(
            F.col("user_id").alias("song"), "ts", "event_id", F.col("event_type").alias("status"),
            F.concat_ws(" ", "event_type", "event_id").alias("line"),
        )
        jobs, path = S.job_log(stream, "song", "ts", "event_id", "status", "line", "job-log", tail=20, path=path)
    return jobs.select(
        "song", "last_at", F.col("last_nth").alias("last_id"), "status", "seen", F.array_join("log_tail", "|").alias("lines")
    )


@query(
    "stream_chunk_rate",
    "WITH " + roles.FRAMES_SQL + """,
    c AS (SELECT song, CAST(floor(t / 864000) AS BIGINT) * 864000 AS chunk_start, t - lag(t) OVER (PARTITION BY song, floor(t / 864000) ORDER BY t, id) AS gap FROM frames)
    SELECT song, chunk_start, round(86400.0::DOUBLE / median(gap), 6) AS rate FROM c WHERE gap > 0 GROUP BY song, chunk_start""",
)
def _(spark, sf):
    out = S.finish(S.chunk_rates(_events(spark, sf), "song", "ts", "10 days", 86400.0, "1 hour"), "rates")
    return out.where("song IS NOT NULL").select(
        "song", F.unix_seconds("chunk_start").alias("chunk_start"), F.round("rate", 6).alias("rate")
    )
