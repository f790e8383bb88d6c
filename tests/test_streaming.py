"""Streams reach the result of their batch twins, also over several micro-batches and after a restart."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyframe.streaming import jobs


@pytest.fixture
def log(spark, tmp_path):
    """Request events delivered in time order over four files."""
    data = []
    for i in range(60):
        opened = f"2024-01-{1 + i // 4:02d} {i % 4 * 6:02d}:00:00"
        data.append((i, "submitted", opened, "t" + str(i % 2)))
        if i % 3:
            data.append((i, "processed", f"2024-01-{min(1 + i // 4 + i % 7, 28):02d} 23:00:00", "t" + str(i % 2)))
    df = spark.createDataFrame(data, "request_id long, kind string, at string, request_type string").withColumn("at", F.to_timestamp("at"))
    df = df.withColumn("deadline", F.when(F.col("kind") == "submitted", F.col("at") + F.expr("INTERVAL 3 DAYS"))).select("request_id", "kind", "at", "request_type", "deadline")
    cuts = ["2000-01-01", "2024-01-05", "2024-01-09", "2024-01-13", "2100-01-01"]
    return df, [df.where((F.col("at") >= a) & (F.col("at") < b)) for a, b in zip(cuts, cuts[1:])], str(tmp_path)


def test_sla_sweep_over_batches(spark, log):
    df, parts, base = log
    src, out, cp = f"{base}/src", f"{base}/out", f"{base}/cp"
    for p in parts:  # one file, one run each: the query is stopped and restarted in between
        p.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        q = jobs.sla_breaches_stream(stream, "1 day").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        jobs.run_available(q, 300)
    got = spark.read.schema(jobs.BREACH).parquet(out)
    want = jobs.sla_breaches_batch(df, "1 day")
    assert rows(got, "request_id", "request_type", "deadline") == rows(want, "request_id", "request_type", "deadline")
    assert got.count() > 5


def test_sla_sweep_forgets_requests_without_submission(spark, tmp_path):
    """Requests processed only, or processed after their breach, leave the state; late closing is told with the breach."""
    rows_in = [
        (1, "submitted", "2024-01-01", "2024-01-03"), (2, "processed", "2024-01-01", None), (3, "submitted", "2024-01-01", "2024-01-20"),
        (3, "submitted", "2024-01-02", "2024-02-20"), (4, None, "2024-01-02", None), (5, "submitted", "2024-01-02", None), (6, "processed", "2024-01-02", None),
        (6, "submitted", "2024-01-01", "2024-01-05"), (9, "submitted", "2024-01-10", "2024-12-01"), (1, "processed", "2024-01-11", None), (9, "processed", "2024-03-10", None),
    ]
    df = spark.createDataFrame(rows_in, "request_id long, kind string, at string, deadline string")
    df = df.select("request_id", "kind", F.to_timestamp("at").alias("at"), F.lit("t").alias("request_type"), F.to_timestamp("deadline").alias("deadline"))
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for lo, hi in (("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-11"), ("2024-01-11", "2024-02-01"), ("2024-02-01", "2025-01-01")):
        df.where((F.col("at") >= lo) & (F.col("at") < hi)).coalesce(1).write.mode("append").parquet(src)
        told = jobs.sla_breaches_stream(spark.readStream.schema(df.schema).parquet(src), "1 day", "20 days")
        jobs.run_available(told.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start(), 300)
    got = spark.read.schema(jobs.BREACH).parquet(out)
    assert rows(got.select("request_id", F.col("deadline").cast("string"))) == [(1, "2024-01-03 00:00:00"), (3, "2024-02-20 00:00:00")]
    left = spark.read.format("statestore").option("path", cp).option("stateVarName", "request").load()
    assert [r[0] for r in left.select("key.request_id").collect()] == []


def test_sla_state_is_kept_by_bucket(spark, log):
    """Many open requests, one of them without an id, share a few values of state and reach the batch result."""
    df, parts, base = log
    lost = df.where("request_id = 3").withColumn("request_id", F.lit(None).cast("long"))
    src, out, cp = f"{base}/src", f"{base}/out", f"{base}/cp"
    whole, first = df.unionByName(lost), parts[0].unionByName(lost.where(F.col("at") < "2024-01-05"))
    sizes = []
    for p in (first, whole.exceptAll(first)):
        p.coalesce(1).write.mode("append").parquet(src)
        told = jobs.sla_breaches_stream(spark.readStream.schema(df.schema).parquet(src), "1 day", buckets=3)
        jobs.run_available(told.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start(), 300)
        sizes.append(spark.read.format("statestore").option("path", cp).option("stateVarName", "request").load().count())
    assert 0 < sizes[0] <= 3 and sizes[1] == 0
    got, want = spark.read.schema(jobs.BREACH).parquet(out), jobs.sla_breaches_batch(whole, "1 day")
    assert rows(got, "request_id", "request_type", "deadline") == rows(want, "request_id", "request_type", "deadline")
    assert got.where("request_id IS NULL").count() == want.where("request_id IS NULL").count()


def test_metrics_restart(spark, tmp_path):
    df = spark.range(400).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("ts"), F.lit("t").alias("task"), (F.col("id") % 2).cast("string").alias("version"), F.rand(1).alias("score"), F.col("id").cast("double").alias("latency"))
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    df.write.parquet(str(tmp_path / "all"))
    full = spark.read.parquet(str(tmp_path / "all"))
    for part in (full.where("latency < 150"), full.where("latency >= 150")):
        part.coalesce(1).write.mode("append").parquet(src)
        q = jobs.upsert_sink(jobs.metrics(spark.readStream.schema(full.schema).parquet(src), "ts", "task", "version", "score", "latency", "1 hour", None, "1 hour"), out, cp)
        jobs.run_available(q, 300)
    keys = ["window_start", "task", "version"]
    want = jobs.metrics(full, "ts", "task", "version", "score", "latency", "1 hour")
    cols = [*keys, "n", "max_latency"]
    assert rows(jobs.latest(spark, out, keys), *cols) == rows(want, *cols)


def test_audit_rows_once(spark, tmp_path):
    df = spark.range(100).select("id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("ts"))
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for _ in range(2):  # everything is delivered twice, in two runs
        df.coalesce(1).write.mode("append").parquet(src)
        jobs.run_available(jobs.audit_sink(jobs.audit_rows(spark.readStream.schema(df.schema).parquet(src), ["id"], "ts", "30 days"), out, cp), 300)
    got = spark.read.schema("id long, ts timestamp, dt string").parquet(out)
    assert got.count() == 100 and got.select("dt").distinct().count() == 5


def test_log_triage_severity(spark):
    lines = spark.createDataFrame([("2024-01-01 00:00:01 ERROR job 12 failed",), ("2024-01-01 00:00:02 ERROR job 99 failed",), ("2024-01-01 10:00:00 all fine",), ("no time",), ("2024-01-01 00:00:03 FATAL error 1",)], "value string")
    got = {(r["severity"], r["signature"]): r["n"] for r in jobs.log_triage(lines).collect()}
    assert got == {("error", "ERROR job # failed"): 2, ("info", "all fine"): 1, ("critical", "FATAL error #"): 1}
