"""The ordered operators on live feeds, as Structured Streaming queries.

Every function takes and returns a streaming DataFrame, so that source, trigger
and sink stay the caller's choice. ``replay`` and ``finish`` run a feed over
stored rows to its end.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from strophe.session import fresh_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
TABLE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # lists and timers need it
LOG_TAIL, KEPT_DAYS = 200, 7.0


def replay(spark: SparkSession, folder: str, name: str, schema: StructType, per_batch: int = 16) -> DataFrame:
    """Stored parquet files as a stream, some files at a time."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_batch).parquet(folder)
    )


def with_tick(stream: DataFrame, at: str, when: str) -> DataFrame:
    """Add one late row that is null but for its time, so that the watermark passes all others."""
    spark = stream.sparkSession
    path = fresh_path(spark, "tick")
    row = spark.range(1).select(
        *[F.lit(when).cast(f.dataType).alias(f.name) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    )
    row.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def finish(stream: DataFrame, name: str) -> DataFrame:
    """Run an appending stream to its end into a parquet table and read that.

    The file sink commits each batch once, whatever is retried.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    job = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", fresh_path(spark, f"{name}-progress")).option("path", path)
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def upsert(
    stream: DataFrame, name: str, mode: str, save: Callable[[DataFrame, int, str], None], path: str | None = None
) -> str:
    """Run a stream through ``save(batch, batch_id, path)`` to its end; returns the path.

    ``save`` must be able to run twice for a batch id. Given the ``path`` of an
    earlier run, the stream goes on from where that run ended.
    """
    path = path or fresh_path(stream.sparkSession, name)
    job = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-progress")
        .foreachBatch(lambda batch, batch_id: save(batch, batch_id, path)).trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return path


def sliding_rms(
    stream: DataFrame, key: str, at: str, value: str, frame: str, hop: str, delay: str
) -> DataFrame:
    """(key, frame_start, rms, n): root mean square in overlapping time frames."""
    rows = stream.withWatermark(at, delay)
    out = rows.groupBy(key, F.window(at, frame, hop).alias("w")).agg(
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count(F.lit(1)).alias("n")
    )
    return out.select(key, F.col("w.start").alias("frame_start"), "rms", "n")


def sessions(stream: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """(key, first, last, n): stretches without a pause longer than ``gap``."""
    rows = stream.withWatermark(at, delay)
    out = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")
    )
    return out.select(key, "first", "last", "n")


def dedup(stream: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """Rows whose keys were not seen within the watermark; the first arrival stands.

    The batch form keeps the last row instead.
    """
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def chunk_rates(stream: DataFrame, key: str, at: str, chunk: str, unit: float, delay: str) -> DataFrame:
    """(key, chunk_start, rate): inverse of the median gap between onsets of a chunk.

    Holds the onset times of a chunk until it closes; a chunk is a fixed, short
    stretch of one song.
    """
    rows = stream.withWatermark(at, delay).withColumn("_t", F.unix_micros(at) / F.lit(1e6))
    held = rows.groupBy(key, F.window(at, chunk).alias("w")).agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    gaps = F.filter(
        F.zip_with(F.slice("_ts", F.lit(2), F.size("_ts")), F.slice("_ts", F.lit(1), F.greatest(F.size("_ts") - 1, F.lit(0))), lambda b, a: b - a),
        lambda g: g > 0,
    )
    ordered = held.select(key, F.col("w.start").alias("chunk_start"), F.array_sort(gaps).alias("_g")).where(F.size("_g") > 0)
    n = F.size("_g")
    middle = (F.element_at("_g", F.floor((n + 1) / 2).cast("int")) + F.element_at("_g", F.floor(n / 2).cast("int") + 1)) / 2
    return ordered.select(key, "chunk_start", (F.lit(unit) / middle).alias("rate"))


def quiet_runs(
    stream: DataFrame, key: str, at: str, level: str, limit: float, min_frames: int, timeout_ms: int, delay: str
) -> DataFrame:
    """(key, start, end, frames): long runs of frames below ``limit``, as they close.

    Rows wait until the watermark has passed them and are then taken in time
    order. A run ends at the first loud frame; one that hears nothing for
    ``timeout_ms`` ends at its last frame. The state holds the rows still inside
    the watermark and the open run.
    """
    # No filter here: Spark would move it below the watermark, which must see ticks.
    rows = stream.withWatermark(at, delay).select(
        key, at, (F.unix_micros(at) / F.lit(1e6)).alias("t"), F.col(level).cast("double").alias("x")
    )
    types = dict(rows.dtypes)

    def step(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, levels, start, count, last = state.get if state.exists else ([], [], -1.0, 0, -1.0)
        times, levels = list(times), list(levels)
        for batch in batches:
            times += [float(t) for t in batch["t"]]
            levels += [float(x) for x in batch["x"]]
        mark = state.getCurrentWatermarkMs() / 1000.0
        ready = sorted((t, x) for t, x in zip(times, levels) if t < mark)
        waiting = [(t, x) for t, x in zip(times, levels) if t >= mark]
        out = []
        for t, x in ready:
            if x < limit:
                start, count = (t, 1) if count == 0 else (start, count + 1)
            else:
                if count >= min_frames:
                    out.append((*name, start, t, count))
                start, count = -1.0, 0
            last = t
        if count and not waiting and mark >= last + timeout_ms / 1000.0:
            if count >= min_frames:
                out.append((*name, start, last, count))
            start, count = -1.0, 0
        if waiting or count:
            state.update(([t for t, _ in waiting], [x for _, x in waiting], start, count, last))
            due = min([t for t, _ in waiting], default=last + timeout_ms / 1000.0)
            state.setTimeoutTimestamp(int(max(due, mark) * 1000) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "start", "end", "frames"])

    return rows.groupBy(key).applyInPandasWithState(
        step,
        f"{key} {types[key]}, start double, end double, frames bigint",
        "times array<double>, levels array<double>, start double, count bigint, last double",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def ingest(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add rows with new keys to a table, batch by batch; a resumed run skips what is there.

    Each batch writes its own folder, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    keys = list(keys)

    def save(batch: DataFrame, batch_id: int, path: str) -> None:
        fresh = batch.dropDuplicates(keys)
        if batch_id > 0:
            done = spark.read.parquet(path).where(F.col("_batch") < batch_id)
            fresh = fresh.join(done.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    return spark.read.parquet(upsert(stream, name, "append", save)).drop("_batch")


def latest_status(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], name: str
) -> DataFrame:
    """(keys, fields): the newest row of each job, kept up to date batch by batch."""
    spark = stream.sparkSession
    keys, fields = list(keys), list(fields)
    newest = stream.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_v"))

    def save(batch: DataFrame, batch_id: int, path: str) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    table = spark.read.parquet(upsert(newest, name, "update", save))
    last = table.groupBy(*keys).agg(F.max_by("_v", "_batch").alias("_v"))
    return last.select(*keys, "_v.*")


def younger_than(df: DataFrame, at: str, days: float, now: Column) -> DataFrame:
    """Rows whose last change is at most ``days`` before ``now``."""
    return df.where(F.unix_micros(at) / F.lit(1e6) >= now - F.lit(days * 86400.0))


@contextmanager
def table_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in a store that holds lists and timers."""
    held = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, TABLE_STORE)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, held)


class _Job(StatefulProcessor):
    """One job: its newest row, its last log lines, and a timer that ends it."""

    def __init__(self, key: str, tail: int, kept_ms: int):
        self.key, self.tail, self.kept_ms = key, tail, kept_ms

    def init(self, handle) -> None:
        self.handle = handle
        # Each call to the state goes to the JVM and back, so the newest row and the lines are one value.
        self.job = handle.getValueState(
            "job", "at bigint, nth bigint, status string, seen bigint, lines array<struct<at:bigint,nth:bigint,line:string>>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.job.get()
        at, nth, status, seen, last = old if old is not None else (None, None, None, 0, [])
        tail = [(x[0], x[1], x[2]) for x in last]
        heap, top, n = [], None, 0
        for row in rows:
            n += 1
            place = (row["at"], row["nth"])
            if top is None or place > top[:2]:
                top = (*place, row["status"])
            # The earlier of two rows at one place goes first, and the later one when the tail is full.
            entry = (*place, -n, row["line"])
            if len(heap) < self.tail:
                heapq.heappush(heap, entry)
            elif entry[:3] > heap[0][:3]:
                heapq.heapreplace(heap, entry)
        seen += n
        fresh = [(x[0], x[1], x[3]) for x in sorted(heap, key=lambda x: (-x[0], -x[1], -x[2]))]
        tail = sorted([*tail, *fresh], key=lambda x: x[:2])[-self.tail:]
        if at is None or top[:2] > (at, nth):
            if at is None:
                self.handle.registerTimer(top[0] // 1000 + self.kept_ms)
            at, nth, status = top
        self.job.update((at, nth, status, seen, tail))
        yield self._row(key, at, nth, status, seen, [x[2] for x in tail], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, nth, status, seen, _ = self.job.get()
        ends = at // 1000 + self.kept_ms
        if ends > expiredTimerInfo.getExpiryTimeInMs() and ends > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(ends)  # rows have come since it was set
            return
        self.job.clear()
        yield self._row(key, at, nth, status, seen, [], True)

    def _row(self, key, at, nth, status, seen, lines, expired) -> Row:
        return Row(**{
            self.key: key[0], "last_at": at, "last_nth": nth, "status": status, "seen": seen,
            "log_tail": lines, "expired": expired,
        })

    def close(self) -> None:
        pass


def job_log(
    stream: DataFrame, key: str, at: str, nth: str, status: str, line: str, name: str, delay: str = "1 hour",
    tail: int = LOG_TAIL, days: float = KEPT_DAYS, path: str | None = None,
) -> tuple[DataFrame, str]:
    """(key, last_at, last_nth, status, seen, log_tail) of each live job, and the folder of the feed.

    ``last_at`` is in microseconds; ``seen`` counts rows, ``log_tail`` holds the
    last ``tail`` lines by (at, nth), however late they came. Rows older than the
    watermark are left out, as are rows without key or time; a missing number counts as -1. A job ends, and its
    state goes, once the watermark is ``days`` past its newest row; a row that
    comes later begins it anew. State per job: one row and ``tail`` lines. With the
    ``path`` of an earlier run the feed goes on from its checkpoint.
    """
    spark = stream.sparkSession
    types = dict(stream.dtypes)
    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        key, F.col(at).alias("_time"), F.unix_micros(at).alias("at"), F.coalesce(F.col(nth).cast("long"), F.lit(-1)).alias("nth"),
        F.col(status).alias("status"), F.col(line).alias("line"),
    ).withWatermark("_time", delay)
    jobs = rows.groupBy(key).transformWithState(
        _Job(key, tail, int(days * 86_400_000)),
        f"{key} {types[key]}, last_at bigint, last_nth bigint, status string, seen bigint, log_tail array<string>, expired boolean",
        "Update", "EventTime",
    )

    def save(batch: DataFrame, batch_id: int, place: str) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/_batch={batch_id}")

    with table_state(spark):
        path = upsert(jobs, name, "update", save, path)
    fields = [c for c in jobs.columns if c != key]
    table = spark.read.schema(jobs.schema.add("_batch", "long")).parquet(path)
    last = table.groupBy(key).agg(F.max_by(F.struct(*fields), "_batch").alias("_v"))
    return last.select(key, "_v.*").where("NOT expired").drop("expired"), path
