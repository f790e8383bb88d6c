"""Queries: streaming jobs, driven to the end of their input; the SQL states the batch result."""

import uuid

from pyspark.sql import functions as F

from tallyframe.catalog.aggs import REQ, requests, rounded
from tallyframe.catalog.registry import query, table
from tallyframe.plans.session import shared_dir
from tallyframe.streaming import jobs as st


def _fresh(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _prepared(df):
    return df.select(
        "ts", F.col("event_type").alias("task"), F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("version"), F.col("value").alias("score"), (F.col("event_id") % 250).cast("double").alias("latency")
    )


_M = "'v' || (user_id % 2) AS version, count(*) AS n, round(avg(value), 6) AS mean_score, round(avg(event_id % 250), 6) AS mean_latency, max(event_id % 250)::DOUBLE AS max_latency"


def _micros(df, *cols):
    return df.withColumns({c: F.unix_micros(c) for c in cols})


@query("stream_metrics_tumbling", "ST1", f"SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01')) AS window_start, event_type AS task, {_M} FROM events GROUP BY 1, 2, 3")
def _(spark, sf):
    out, cp = _fresh(spark, "metrics"), _fresh(spark, "cp")
    st.run_available(st.upsert_sink(st.metrics(_prepared(event_stream(spark, sf)), "ts", "task", "version", "score", "latency", "6 hours", None, "1 hour"), out, cp))
    got = st.latest(spark, out, ["window_start", "task", "version"])
    return _micros(rounded(got, "mean_score", "mean_latency"), "window_start")


@query(
    "stream_metrics_sliding",
    "ST1",
    f"WITH w AS (SELECT *, unnest([0, 1]) AS k FROM events) SELECT epoch_us(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - to_hours(12 * k)) AS window_start, event_type AS task, {_M} FROM w GROUP BY 1, 2, 3",
)
def _(spark, sf):
    out, cp = _fresh(spark, "metrics"), _fresh(spark, "cp")
    st.run_available(st.upsert_sink(st.metrics(_prepared(event_stream(spark, sf)), "ts", "task", "version", "score", "latency", "1 day", "12 hours", "1 hour"), out, cp))
    got = st.latest(spark, out, ["window_start", "task", "version"])
    return _micros(rounded(got, "mean_score", "mean_latency"), "window_start")


def request_log(spark, sf):
    """Submission and processing events of the requests, as stored files."""
    r = requests(spark, sf)
    opened = r.select("request_id", F.lit("submitted").alias("kind"), F.col("submitted_at").alias("at"), "request_type", F.col("sla_deadline").alias("deadline"))
    closed = r.where("processed_at IS NOT NULL").select("request_id", F.lit("processed").alias("kind"), F.greatest("processed_at", "submitted_at").alias("at"), "request_type", F.lit(None).cast("timestamp").alias("deadline"))
    path = _fresh(spark, "requests")
    opened.unionByName(closed).write.parquet(path)
    return path


@query(
    "stream_sla_breaches",
    "ST2",
    f"""WITH {REQ}, e AS (SELECT request_id, request_type, sla_deadline, CASE WHEN processed_at IS NOT NULL THEN greatest(processed_at, submitted_at) END AS done FROM req), w AS (SELECT greatest((SELECT max(submitted_at) FROM req), (SELECT max(done) FROM e)) - INTERVAL 10 DAY AS wm)
        SELECT request_id, request_type, epoch_us(sla_deadline) AS deadline FROM e CROSS JOIN w WHERE sla_deadline < wm AND (done IS NULL OR done > sla_deadline)""",
)
def _(spark, sf):
    path = request_log(spark, sf)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = _fresh(spark, "breaches")
    q = st.sla_breaches_stream(stream, "10 days").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", _fresh(spark, "cp")).trigger(availableNow=True).start()
    st.run_available(q)
    return _micros(spark.read.schema(st.BREACH).parquet(out).drop("processed_at"), "deadline")


@query(
    "batch_sla_breaches",
    "ST2",
    f"""WITH {REQ}, e AS (SELECT request_id, request_type, sla_deadline, CASE WHEN processed_at IS NOT NULL THEN greatest(processed_at, submitted_at) END AS done FROM req), w AS (SELECT greatest((SELECT max(submitted_at) FROM req), (SELECT max(done) FROM e)) - INTERVAL 10 DAY AS wm)
        SELECT request_id, request_type, epoch_us(sla_deadline) AS deadline FROM e CROSS JOIN w WHERE sla_deadline < wm AND (done IS NULL OR done > sla_deadline)""",
)
def _(spark, sf):
    log = spark.read.parquet(request_log(spark, sf))
    return _micros(st.sla_breaches_batch(log, "10 days").drop("processed_at"), "deadline")


@query("stream_audit_rows", "ST3 S5", "SELECT event_id, user_id, value, strftime(ts, '%Y-%m-%d') AS dt FROM events")
def _(spark, sf):
    src = _fresh(spark, "deliveries")
    e = table(spark, sf, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    e.unionByName(e.where("event_id % 3 = 0")).write.parquet(src)  # a third is delivered twice
    out = _fresh(spark, "audit")
    stream = spark.readStream.schema(e.schema).parquet(src)
    st.run_available(st.audit_sink(st.audit_rows(stream, ["event_id"], "ts", "30 days"), out, _fresh(spark, "cp")))
    return spark.read.schema("event_id long, user_id long, value double, dt string").parquet(out)


def log_lines(spark, sf):
    t = F.col("event_type")
    word = F.when(t == "error", "ERROR request failed").when(t == "view", "WARN timeout").when(t == "signup", "FATAL panic").otherwise("INFO done")
    lines = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), word, F.concat(F.lit("user "), F.col("user_id").cast("string")), F.concat(F.lit("code "), (F.col("event_id") % 3).cast("string")))
    path = _fresh(spark, "logs")
    table(spark, sf, "events").select(lines.alias("value")).write.text(path)
    return path


_LOGSQL = """WITH l AS (SELECT date_trunc('second', ts) AS at_, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' WHEN 'signup' THEN 'critical' ELSE 'info' END AS severity, CASE event_type WHEN 'error' THEN 'ERROR request failed' WHEN 'view' THEN 'WARN timeout' WHEN 'signup' THEN 'FATAL panic' ELSE 'INFO done' END || ' user # code #' AS signature FROM events)
  SELECT epoch_us(date_trunc('day', at_)::TIMESTAMP) AS window_start, severity, signature, count(*) AS n, epoch_us(min(at_)) AS first_seen, epoch_us(max(at_)) AS last_seen FROM l GROUP BY 1, 2, 3"""


@query("stream_log_triage", "ST4", _LOGSQL)
def _(spark, sf):
    path, out = log_lines(spark, sf), _fresh(spark, "triage")
    st.run_available(st.upsert_sink(st.log_triage(spark.readStream.text(path), "1 day", "2 days"), out, _fresh(spark, "cp")))
    return _micros(st.latest(spark, out, ["window_start", "severity", "signature"]), "window_start", "first_seen", "last_seen")


@query("batch_log_triage", "ST4", _LOGSQL)
def _(spark, sf):
    return _micros(st.log_triage(spark.read.text(log_lines(spark, sf))), "window_start", "first_seen", "last_seen")
