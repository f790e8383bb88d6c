"""Streaming jobs and their batch twins.

Every job is a function from a streaming (or batch) frame to a frame; the batch form defines the
result the stream must reach. `run_available` drives one to the end of the available input.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds after which an unfinished drain is given up.
DRAIN_SECONDS = 600


def metrics(df: DataFrame, ts: str, task: str, version: str, score: str, latency: str, size: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Count, mean score, mean and largest latency per window, task and model version."""
    rows = df.withWatermark(ts, watermark) if watermark and df.isStreaming else df
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w.alias("w"), task, version).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(latency).alias("mean_latency"), F.max(latency).alias("max_latency")
    ).select(F.col("w.start").alias("window_start"), task, version, "n", "mean_score", "mean_latency", "max_latency")


def upsert_sink(df: DataFrame, path: str, checkpoint: str):
    """Write every micro-batch's changed rows under its own `batch=` folder.

    A repeated batch overwrites its folder, so a restart after a lost task or driver adds nothing
    twice. `latest` gives the current table.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key written by `upsert_sink`."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in keys and c != "batch"]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return top.select(*keys, "r.*")


def run_available(query, seconds: int = DRAIN_SECONDS) -> None:
    """Wait until all available input is processed; stop and fail on a timeout."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("stream did not drain")
    if query.exception() is not None:
        raise query.exception()


BREACH = "request_id long, request_type string, deadline timestamp, processed_at timestamp"
#: Transforming with state needs a store that holds more than one value and timers for a key.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of requests; each has one value of state and one timer.
BUCKETS = 4096
#: An unknown time; below all others.
UNKNOWN = -(1 << 63)


def _most(*values):
    """The largest of the values that are known."""
    return max([v for v in values if v is not None], default=None)


class SlaSweep(StatefulProcessor):
    """State of a bucket of requests: type, deadline and processing time (microseconds) by request, and one timer.

    Batches are folded by their largest values, so the order of arrival does not matter. A submitted
    request is due at its deadline. A request that is processed without having been submitted
    (or after its breach was told) is forgotten once the watermark is `retain_ms` beyond that time,
    so the store holds open requests and a bounded stretch of others. The bucket's timer is the first
    time at which one of its requests may be due. Every call to the store costs a round trip and an
    expired timer several, so they are paid by the bucket and not by the request.
    """

    def __init__(self, retain_ms: int) -> None:
        self.retain_ms = retain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("request", "timer long, requests binary")

    def _due(self, deadline: int, done: int) -> int:
        return deadline // 1000 if deadline != UNKNOWN else done // 1000 + self.retain_ms

    def _keep(self, known: dict, timer: int | None, fired: bool = False) -> None:
        """Store the bucket's requests; set its timer anew if one of them is due earlier or it has fired."""
        first = min((self._due(deadline, done) for _, deadline, done in known.values()), default=None)
        if timer is not None and not fired and (first is None or first < timer):
            self.handle.deleteTimer(timer)
        if first is None:
            if timer is not None:
                self.open.clear()
            return
        if timer is None or fired or first < timer:
            self.handle.registerTimer(timer := first)
        self.open.update((timer, pickle.dumps(known, 5)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.open.get()
        timer, known = (None, {}) if state is None else (state[0], pickle.loads(state[1]))
        new: dict[int | None, tuple[str | None, int, int]] = {}
        for frame in rows:
            for request, lost, kind, deadline, done in zip(*(frame[c].tolist() for c in ("id", "lost", "request_type", "deadline", "done"))):
                request = None if lost else request
                was = new.get(request)
                new[request] = (kind, deadline, done) if was is None else (_most(was[0], kind), max(was[1], deadline), max(was[2], done))
        changed = False
        for request, (kind, deadline, done) in new.items():
            was = known.get(request, (None, UNKNOWN, UNKNOWN))
            now = (_most(was[0], kind), max(was[1], deadline), max(was[2], done))
            if now[1] != UNKNOWN and UNKNOWN != now[2] <= now[1]:
                changed |= known.pop(request, None) is not None
            elif (now[1] != UNKNOWN or now[2] != UNKNOWN) and now != was:
                known[request], changed = now, True
        if changed:
            self._keep(known, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.open.get()
        if state is None:
            return
        known, end = pickle.loads(state[1]), timerValues.getCurrentWatermarkInMs()
        due = [r for r, (_, deadline, done) in known.items() if self._due(deadline, done) < end]
        over = [(r, *known.pop(r)) for r in due]
        self._keep(known, state[0], fired=True)
        if told := [r for r in over if r[2] != UNKNOWN]:
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(("request_id", "request_type", "deadline", "done"), zip(*told))})

    def close(self) -> None:
        pass


def sla_breaches_stream(events: DataFrame, delay: str, retain: str = "30 days", buckets: int = BUCKETS) -> DataFrame:
    """One breach per request whose deadline passes while it is unprocessed.

    `events` has (request_id, kind, at, request_type, deadline): kind "submitted" opens a request,
    "processed" closes it. A breach appears as soon as the watermark is beyond the deadline. Time to
    live of state runs on the clock only, so events without a submission are dropped by an event-time
    timer, `retain` after them. Sets the session's state store to the one that this needs. The state
    is kept by the bucket of the request's id (`request_id` in its key), so `buckets` is fixed for
    the life of a checkpoint; a bucket should hold no more than some ten thousand open requests.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    sub = F.col("kind") == "submitted"
    known = lambda c: F.coalesce(F.unix_micros(c), F.lit(UNKNOWN))
    request = F.col("request_id").cast("long")
    shaped = events.withWatermark("at", delay).select(
        F.pmod(F.xxhash64(request), F.lit(buckets)).alias("request_id"), F.coalesce(request, F.lit(0)).alias("id"), request.isNull().alias("lost"), "at",
        F.when(sub, F.col("request_type")).alias("request_type"), known(F.when(sub, F.col("deadline"))).alias("deadline"), known(F.when(~sub, F.col("at"))).alias("done"),
    )
    sweep = SlaSweep(int(pd.Timedelta(retain).total_seconds() * 1000))
    told = shaped.groupBy("request_id").transformWithStateInPandas(sweep, "request_id long, request_type string, deadline long, done long", "Append", "EventTime")
    at = lambda c: F.timestamp_micros(F.nullif(c, F.lit(UNKNOWN)))
    return told.select("request_id", "request_type", at(F.col("deadline")).alias("deadline"), at(F.col("done")).alias("processed_at"))


def sla_breaches_batch(events: DataFrame, delay: str) -> DataFrame:
    """The same breaches from the whole log: deadline before the final watermark and not processed by then."""
    end = events.agg(F.max("at") - F.expr(f"INTERVAL {delay}")).scalar()
    sub = F.col("kind") == "submitted"
    r = events.groupBy("request_id").agg(
        F.max(F.when(sub, F.col("request_type"))).alias("request_type"), F.max(F.when(sub, F.col("deadline"))).alias("deadline"), F.max(F.when(~sub, F.col("at"))).alias("processed_at")
    ).withColumn("_end", end)
    late = F.col("processed_at").isNull() | (F.col("processed_at") > F.col("deadline"))
    return r.where(late & (F.col("deadline") < F.col("_end"))).drop("_end")


def audit_rows(df: DataFrame, key: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Rows with a `dt` partition column, repeated deliveries of a key removed."""
    once = df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key)) if df.isStreaming else df.dropDuplicates(list(key))
    return once.withColumn("dt", F.date_format(ts, "yyyy-MM-dd"))


def audit_sink(df: DataFrame, path: str, checkpoint: str):
    """Append to `dt=` folders; the file sink's log makes each batch visible exactly once."""
    return df.writeStream.outputMode("append").format("parquet").partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Severity patterns of log lines, most severe first.
SEVERITIES = (("critical", r"(?i)\b(fatal|critical|panic)\b"), ("error", r"(?i)\b(error|exception|traceback|failed)\b"), ("warning", r"(?i)\b(warn|warning|deprecated|timeout)\b"))


def severity(line: Column, patterns: Sequence[tuple[str, str]] = SEVERITIES) -> Column:
    out = None
    for name, rx in patterns:
        out = F.when(line.rlike(rx), name) if out is None else out.when(line.rlike(rx), name)
    return out.otherwise("info")


def log_triage(lines: DataFrame, size: str = "1 day", delay: str | None = None, patterns: Sequence[tuple[str, str]] = SEVERITIES) -> DataFrame:
    """Counts per window, severity and message signature (numbers masked) of "yyyy-MM-dd HH:mm:ss message" lines."""
    ts = F.try_to_timestamp(F.substring("value", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    msg = F.trim(F.substring(F.col("value"), 20, 1_000_000_000))
    rows = lines.select(ts.alias("at"), severity(F.col("value"), patterns).alias("severity"), F.regexp_replace(msg, r"\d+", "#").alias("signature")).where("at IS NOT NULL")
    rows = rows.withWatermark("at", delay) if delay and lines.isStreaming else rows
    g = rows.groupBy(F.window("at", size).alias("w"), "severity", "signature").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    return g.select(F.col("w.start").alias("window_start"), "severity", "signature", "n", "first_seen", "last_seen")
