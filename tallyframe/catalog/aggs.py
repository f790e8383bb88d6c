"""Queries: aggregations and the flagship feature table."""

from pyspark.sql import functions as F

from tallyframe.catalog.registry import TXN, query, table, transactions
from tallyframe.functions.profile import column_stats
from tallyframe.operators import aggs as a
from tallyframe.operators import joins as j
from tallyframe.operators import normalise as n
from tallyframe.plans.session import written

_SUMMARY = """s AS (SELECT user_id, count(*) AS txn_count, sum(amount) AS txn_total, avg(amount) AS txn_mean, coalesce(stddev_samp(amount), 0) AS txn_std,
  max(amount) AS txn_max, min(amount) AS txn_min, max(day) AS last_date, count(DISTINCT merchant) AS n_merchants, count(DISTINCT channel) AS n_states,
  avg(CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END) AS error_rate FROM txn GROUP BY 1)"""


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def summary(spark, sf):
    return a.txn_summary(transactions(spark, sf), "user_id", "amount", "day", "merchant", "channel", F.col("status") == "F")


@query(
    "txn_summary",
    "A1",
    f"""WITH {TXN}, {_SUMMARY} SELECT user_id, txn_count, round(txn_total, 4) AS txn_total, round(txn_mean * txn_count, 2) AS mean_times_n, round(txn_std, 4) AS txn_std, txn_max, txn_min,
       CAST(last_date AS VARCHAR) AS last_date, n_merchants, n_states, round(error_rate, 6) AS error_rate FROM s""",
)
def _(spark, sf):
    out = rounded(rounded(summary(spark, sf), "txn_total", "txn_std", digits=4), "error_rate").withColumn("last_date", F.col("last_date").cast("string"))
    # a mean of cent amounts is compared as mean * count, which has no rounding ties
    return out.withColumn("mean_times_n", F.round(F.col("txn_mean") * F.col("txn_count"), 2)).drop("txn_mean")


@query(
    "rfm_block",
    "A2",
    f"""WITH {TXN}, {_SUMMARY} SELECT c_custkey AS user_id, c_mktsegment, coalesce(date_diff('day', last_date, DATE '2002-01-01'), 9999)::INTEGER AS recency, coalesce(txn_count, 0) AS frequency,
       round(coalesce(txn_total, 0), 4) AS monetary, round(coalesce(txn_mean * txn_count, 0), 2) AS mean_times_n FROM customer LEFT JOIN s ON user_id = c_custkey""",
)
def _(spark, sf):
    users = table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")
    out = rounded(a.rfm(users, summary(spark, sf), "user_id", "2002-01-01", ["c_mktsegment"]), "monetary", digits=4)
    return out.withColumn("mean_times_n", F.round(F.col("avg_amount") * F.col("frequency"), 2)).drop("avg_amount")


_TOPS = "tops AS (SELECT mcc, row_number() OVER (ORDER BY count(*) DESC, mcc) AS r FROM txn GROUP BY 1)"


@query(
    "category_shares",
    "A3",
    f"""WITH {TXN}, {_TOPS} SELECT user_id, """
    + ", ".join(f"round(sum(CASE WHEN r = {i} THEN amount ELSE 0 END) / greatest(sum(amount), 1e-8), 6) AS share_{i}" for i in range(1, 13))
    + " FROM txn JOIN tops USING (mcc) GROUP BY 1",
)
def _(spark, sf):
    out = a.category_shares(transactions(spark, sf, part=True), "user_id", "mcc", "amount", 12)
    return rounded(out, *[f"share_{i}" for i in range(1, 13)])


@query(
    "monthly_pivot",
    "A4",
    f"WITH {TXN} SELECT user_id, "
    + ", ".join(f"count(*) FILTER (month(day) = {i}) AS cnt_{i:02d}, round(coalesce(sum(amount) FILTER (month(day) = {i}), 0), 4) AS amt_{i:02d}" for i in range(1, 13))
    + " FROM txn GROUP BY 1",
)
def _(spark, sf):
    return rounded(a.monthly_pivot(transactions(spark, sf), "user_id", "day", "amount"), *[f"amt_{i:02d}" for i in range(1, 13)], digits=4)


@query(
    "trailing_months",
    "A5",
    f"WITH {TXN}, b AS (SELECT *, (SELECT year(max(day)) * 12 + month(max(day)) FROM txn) - (year(day) * 12 + month(day)) AS ago FROM txn) SELECT user_id, "
    + ", ".join(f"count(*) FILTER (ago = {i}) AS cnt_m{i}, round(coalesce(sum(amount) FILTER (ago = {i}), 0), 4) AS amt_m{i}" for i in range(12))
    + " FROM b GROUP BY 1",
)
def _(spark, sf):
    return rounded(a.trailing_months(transactions(spark, sf), "user_id", "day", "amount"), *[f"amt_m{i}" for i in range(12)], digits=4)


_Q = ", ".join(f"round(coalesce(sum(amount) FILTER (quarter(day) = {i}), 0), 4) AS amt_q{i}" for i in range(1, 5))


@query(
    "quarterly_totals",
    "A6",
    f"""WITH {TXN} SELECT 'all' AS scope, user_id, {_Q} FROM txn GROUP BY 2
        UNION ALL SELECT 'latest_year', user_id, {_Q} FROM txn WHERE year(day) = (SELECT max(year(day)) FROM txn) GROUP BY 2""",
)
def _(spark, sf):
    t = transactions(spark, sf)
    full = a.quarterly(t, "user_id", "day", "amount").select(F.lit("all").alias("scope"), "*")
    last = a.quarterly(t, "user_id", "day", "amount", True).select(F.lit("latest_year").alias("scope"), "*")
    return rounded(full.unionByName(last), *[f"amt_q{i}" for i in range(1, 5)], digits=4)


@query(
    "ratio_bundle",
    "A7",
    """SELECT user_id, round(avg(CASE WHEN isodow(ts) <= 5 THEN 1.0 ELSE 0.0 END), 6) AS weekday, round(avg(CASE WHEN isodow(ts) > 5 THEN 1.0 ELSE 0.0 END), 6) AS weekend, """
    + ", ".join(f"round(avg(CASE WHEN hour(ts) // 4 = {i} THEN 1.0 ELSE 0.0 END), 6) AS h{i * 4:02d}_{i * 4 + 4:02d}" for i in range(6))
    + """, round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6) AS view_share, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors FROM events GROUP BY 1""",
)
def _(spark, sf):
    shares = {**a.time_predicates("ts"), "view_share": F.col("event_type") == "view"}
    return rounded(a.ratio_bundle(table(spark, sf, "events"), "user_id", shares, {"errors": F.col("event_type") == "error"}), *shares)


_DIV = """per AS (SELECT user_id, mcc, sum(amount) AS amt FROM txn GROUP BY 1, 2), sh AS (SELECT user_id, mcc, amt / greatest(sum(amt) OVER (PARTITION BY user_id), 1e-8) AS p FROM per),
  rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, mcc) AS r FROM sh),
  d AS (SELECT user_id, count(*) AS n_categories, round(-sum(p * ln(greatest(p, 1e-15))), 6) AS entropy, round(sum(p * p), 6) AS hhi, round(sum(CASE WHEN r <= 3 THEN p ELSE 0 END), 6) AS top3_share FROM rk GROUP BY 1)"""


@query("diversity", "A8 J8", f"WITH {TXN}, {_DIV} SELECT * FROM d")
def _(spark, sf):
    return rounded(a.diversity(transactions(spark, sf, part=True), "user_id", "mcc", "amount"), "entropy", "hhi", "top3_share")


@query(
    "hierarchy_counts",
    "A9",
    f"""WITH {TXN}, x AS (SELECT brand || '|' || channel AS pair, row_number() OVER (ORDER BY count(*) DESC, brand || '|' || channel) AS r FROM txn GROUP BY 1)
       SELECT user_id, sum(CASE WHEN mcc BETWEEN 1 AND 15 THEN 1 ELSE 0 END)::BIGINT AS grp_low, sum(CASE WHEN mcc BETWEEN 16 AND 40 THEN 1 ELSE 0 END)::BIGINT AS grp_mid,
         count(*) FILTER (channel = 'A') AS "ch_A", count(*) FILTER (channel = 'N') AS "ch_N", count(*) FILTER (channel = 'R') AS "ch_R", """
    + ", ".join(f"round(count(*) FILTER (r = {i}) / count(*), 6) AS cross_{i}" for i in range(1, 8))
    + " FROM txn JOIN x ON pair = brand || '|' || channel GROUP BY 1",
)
def _(spark, sf):
    t = transactions(spark, sf, part=True)
    out = a.hierarchy_counts(t, "user_id", {"low": F.col("mcc").between(1, 15), "mid": F.col("mcc").between(16, 40)}, "channel", ["A", "N", "R"], "brand")
    return rounded(out, *[f"cross_{i}" for i in range(1, 8)])


@query(
    "anomaly_counts",
    "A10 J8",
    f"""WITH {TXN}, l AS (SELECT avg(amount) + 1.5 * stddev_samp(amount) AS t FROM txn) SELECT user_id, year(day) * 100 + month(day) AS ym, count(*) AS n, sum(CASE WHEN abs(amount) > (SELECT t FROM l) THEN 1 ELSE 0 END)::BIGINT AS anomalies FROM txn GROUP BY 1, 2""",
)
def _(spark, sf):
    t = transactions(spark, sf).withColumn("ym", (F.year("day") * 100 + F.month("day")).cast("long"))
    return a.anomaly_counts(t, ["user_id", "ym"], "amount", 1.5)


@query(
    "monthly_trend",
    "A11",
    f"""WITH {TXN}, m AS (SELECT user_id, year(day) * 100 + month(day) AS ym, count(*) AS cnt, sum(amount) AS amt, row_number() OVER (PARTITION BY user_id ORDER BY year(day) * 100 + month(day) DESC) AS r FROM txn GROUP BY 1, 2)
       SELECT user_id, count(*) AS n_months, (max(ym) - min(ym))::INTEGER AS span_months, """
    + ", ".join(f"round(avg(amt) FILTER (r <= {k}), 6) AS amt_{k}m, round(avg(cnt) FILTER (r <= {k}), 6) AS cnt_{k}m" for k in (3, 6, 12))
    + ", round(coalesce(regr_slope(amt, ym), 0), 4) AS trend_slope FROM m GROUP BY 1",
)
def _(spark, sf):
    out = a.monthly_trend(transactions(spark, sf), "user_id", "day", "amount")
    return rounded(rounded(out, "trend_slope", digits=4), *[f"{c}_{k}m" for c in ("amt", "cnt") for k in (3, 6, 12)])


@query(
    "dense_month_trend",
    "A11",
    f"""WITH {TXN}, p AS (SELECT user_id, date_diff('day', min(day), max(day))::INTEGER AS span_days, [{', '.join(f"coalesce(sum(amount) FILTER (month(day) = {i}), 0)" for i in range(1, 13))}] AS v FROM txn GROUP BY 1)
       SELECT user_id, span_days, round(list_sum(list_slice(v, 10, 12)) / 3, 4) AS last3, round(list_sum(list_slice(v, 1, 2)) / 2, 4) AS feb6, round(list_sum(v) / 12, 4) AS last12,
         round(list_sum(list_transform(v, lambda y, i: (i - 6.5) * y)) / 143, 4) AS slope, len(list_filter(v, lambda y: y > 0))::INTEGER AS active_months FROM p""",
)
def _(spark, sf):
    out = a.dense_month_trend(transactions(spark, sf), "user_id", "day", "amount")
    return out.select(
        "user_id", "span_days", F.round(F.get("roll_3", F.lit(11)), 4).alias("last3"), F.round(F.get("roll_6", F.lit(1)), 4).alias("feb6"),
        F.round(F.get("roll_12", F.lit(11)), 4).alias("last12"), F.round("slope", 4).alias("slope"), "active_months",
    )


@query(
    "mode_per_group",
    "A12",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, (hour(ts) // 3)::INTEGER AS slot, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT user_id, event_type_mode, slot_mode FROM (SELECT user_id, event_type AS event_type_mode FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1)
       JOIN (SELECT user_id, slot AS slot_mode FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, slot) = 1) USING (user_id)""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("slot", F.floor(F.hour("ts") / 3).cast("int"))
    return a.mode_per_group(e, "user_id", "event_type").join(a.mode_per_group(e, "user_id", "slot"), "user_id")


@query("top_category", "A13", f"WITH {TXN} SELECT user_id, mcc, count(*) AS cnt FROM txn GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, mcc) = 1")
def _(spark, sf):
    return a.top1(transactions(spark, sf, part=True), "user_id", "mcc")


@query(
    "median_gap",
    "A14",
    f"""WITH {TXN}, g AS (SELECT user_id, date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS gap FROM txn) SELECT user_id, round(median(gap), 6) AS median_gap FROM g WHERE gap IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    return rounded(a.median_gap(transactions(spark, sf), "user_id", "day"), "median_gap")


@query(
    "merchant_hhi",
    "A15",
    f"""WITH {TXN}, m AS (SELECT user_id, merchant, sum(amount) AS amt FROM txn GROUP BY 1, 2), s AS (SELECT user_id, amt / greatest(sum(amt) OVER (PARTITION BY user_id), 1e-8) AS p FROM m) SELECT user_id, round(sum(p * p), 6) AS hhi FROM s GROUP BY 1""",
)
def _(spark, sf):
    return rounded(a.hhi(transactions(spark, sf), "user_id", "merchant", "amount"), "hhi")


@query("counts_by_type", "A16 O1", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def _(spark, sf):
    return a.counts_by(table(spark, sf, "events"), "event_type")


_SEG = "count(*) AS n, " + ", ".join(f"round(sum({c}), 2) AS sum_{c}, round(avg({c}), 4) AS avg_{c}, round(stddev_samp({c}), 4) AS std_{c}" for c in ("l_extendedprice", "l_quantity"))


def _seg(df):
    out = rounded(df, "sum_l_extendedprice", "sum_l_quantity", digits=2)
    return rounded(out, *[f"{s}_{c}" for s in ("avg", "std") for c in ("l_extendedprice", "l_quantity")], digits=4)


@query("segment_stats", "A17", f"SELECT l_returnflag, {_SEG} FROM lineitem GROUP BY 1")
def _(spark, sf):
    return _seg(a.segment_stats(table(spark, sf, "lineitem"), "l_returnflag", ["l_extendedprice", "l_quantity"]))


@query("segment_stats_filtered", "A17", f"SELECT l_returnflag, {_SEG} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1")
def _(spark, sf):
    return _seg(a.segment_stats(table(spark, sf, "lineitem"), "l_returnflag", ["l_extendedprice", "l_quantity"], "l_shipdate >= TIMESTAMP_NTZ '1999-01-01'"))


@query(
    "column_stats",
    "A18",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::BIGINT AS nulls, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, 0::DOUBLE AS null_pct FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_suppkey")
    ),
)
def _(spark, sf):
    return rounded(column_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_suppkey"]), "mean", "std", digits=4)


@query(
    "label_distribution",
    "A18",
    """SELECT 'quality' AS label, quality::VARCHAR AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY 2
       UNION ALL SELECT 'toxic', toxic::VARCHAR, count(*), round(count(*) / (SELECT count(*) FROM labels), 6) FROM labels GROUP BY 2""",
)
def _(spark, sf):
    return rounded(a.label_distribution(table(spark, sf, "labels"), ["quality", "toxic"]), "share")


@query(
    "persona_distributions",
    "A20",
    f"""WITH t AS (SELECT user_id % 4 AS persona, event_type, hour(ts) AS h, month(ts) AS m, ln(greatest(abs(value), 0.01)) AS la FROM events),
       u AS (SELECT persona, 'category' AS kind, event_type AS slot, la FROM t UNION ALL SELECT persona, 'hour', h::VARCHAR, la FROM t UNION ALL SELECT persona, 'month', m::VARCHAR, la FROM t)
       SELECT persona, kind, slot, count(*) AS n, round(avg(la), 6) AS log_mean, round(coalesce(stddev_samp(la), 0), 6) AS log_std, round(count(*) / sum(count(*)) OVER (PARTITION BY persona, kind), 6) AS share FROM u GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 4).alias("persona"), "event_type", "value", F.hour("ts").alias("h"), "ts")
    return rounded(a.persona_distributions(e, "persona", "event_type", "value", "h", "ts"), "log_mean", "log_std", "share")


_V = """v AS (SELECT strftime(ts, '%Y-%m-%d') AS period, CASE event_type WHEN 'error' THEN 'reject' WHEN 'view' THEN 'revise' ELSE 'pass' END AS verdict, 'task' || (user_id % 3) AS task, CASE WHEN value > 20 THEN 'L2' ELSE 'L1' END AS layer FROM events)"""


def verdicts(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("period"),
        F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "view", "revise").otherwise("pass").alias("verdict"),
        F.concat(F.lit("task"), (F.col("user_id") % 3).cast("string")).alias("task"),
        F.when(F.col("value") > 20, "L2").otherwise("L1").alias("layer"),
    )


@query(
    "verdict_rollup",
    "A21",
    f"""WITH {_V} SELECT period, task, layer, count(*) AS total, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'revise') AS revise, count(*) FILTER (verdict = 'reject') AS reject,
       round(count(*) FILTER (verdict = 'pass') / count(*), 6) AS pass_rate, round(count(*) FILTER (verdict = 'reject') / count(*), 6) AS reject_rate FROM v GROUP BY GROUPING SETS ((period), (period, task), (period, layer))""",
)
def _(spark, sf):
    return rounded(a.verdict_rollup(verdicts(spark, sf), "period", "task", "layer", "verdict"), "pass_rate", "reject_rate")


REQ = """req AS (SELECT o_orderkey AS request_id, o_orderpriority AS request_type, o_orderdate AS submitted_at, o_orderdate + INTERVAL 60 DAY AS sla_deadline,
  CASE o_orderstatus WHEN 'F' THEN 'processed' ELSE 'pending' END AS status, CASE WHEN o_orderstatus = 'F' THEN p END AS processed_at
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def requests(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("p"))
    o = table(spark, sf, "orders").join(p, "o_orderkey", "left")
    done = F.col("o_orderstatus") == "F"
    day = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("request_type"), day.alias("submitted_at"),
        (day + F.expr("INTERVAL 60 DAYS")).alias("sla_deadline"), F.when(done, "processed").otherwise("pending").alias("status"),
        F.when(done, F.col("p").cast("timestamp")).alias("processed_at"),
    )


@query(
    "sla_report",
    "A22",
    f"""WITH {REQ}, s AS (SELECT request_type, CASE WHEN status = 'processed' AND processed_at IS NOT NULL THEN (CASE WHEN processed_at <= sla_deadline THEN 'on_time' ELSE 'late' END)
         WHEN status = 'pending' AND TIMESTAMP '2000-06-01' > sla_deadline THEN 'breached_pending' WHEN status = 'pending' AND TIMESTAMP '2000-06-01' >= sla_deadline - INTERVAL 7 DAY THEN 'approaching' END AS st
       FROM req WHERE submitted_at BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-05-01')
       SELECT request_type, count(*) AS total, count(*) FILTER (st = 'on_time') AS on_time, count(*) FILTER (st = 'late') AS late, count(*) FILTER (st = 'breached_pending') AS breached_pending, count(*) FILTER (st = 'approaching') AS approaching
       FROM s GROUP BY ROLLUP (request_type)""",
)
def _(spark, sf):
    return a.sla_report(requests(spark, sf), "1999-01-01", "2000-05-01", "2000-06-01")


@query(
    "metric_summary",
    "A23",
    """WITH m AS (SELECT CASE user_id % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'multiclass' ELSE 'regression' END AS task_type, 't' || (user_id % 9) AS task, CASE event_type WHEN 'view' THEN 'auc' WHEN 'click' THEN 'accuracy' WHEN 'error' THEN 'mae' WHEN 'signup' THEN 'f1_macro' ELSE 'ndcg@3' END AS metric, value FROM events)
       SELECT task_type, metric, round(avg(value), 6) AS avg_value, count(DISTINCT task) AS n_tasks FROM m WHERE (task_type = 'binary' AND metric IN ('auc', 'accuracy')) OR (task_type = 'multiclass' AND metric IN ('f1_macro', 'accuracy', 'ndcg@3')) OR (task_type = 'regression' AND metric = 'mae') GROUP BY 1, 2""",
)
def _(spark, sf):
    k = F.col("user_id") % 3
    m = table(spark, sf, "events").select(
        F.when(k == 0, "binary").when(k == 1, "multiclass").otherwise("regression").alias("task_type"),
        F.concat(F.lit("t"), (F.col("user_id") % 9).cast("string")).alias("task"),
        F.when(F.col("event_type") == "view", "auc").when(F.col("event_type") == "click", "accuracy").when(F.col("event_type") == "error", "mae").when(F.col("event_type") == "signup", "f1_macro").otherwise("ndcg@3").alias("metric"),
        "value",
    )
    return rounded(a.summarise_metrics(m), "avg_value")


_FEATS = ["recency", "frequency", "monetary", "avg_amount", "n_categories", "entropy", "hhi", "top3_share"]


@query(
    "customer_features",
    "A1 A2 A8 J2 N3",
    f"""WITH {TXN}, {_SUMMARY}, {_DIV}, b AS (SELECT c_custkey AS user_id, coalesce(date_diff('day', last_date, DATE '2002-01-01'), 9999)::DOUBLE AS recency, coalesce(txn_count, 0)::DOUBLE AS frequency,
         coalesce(txn_total, 0) AS monetary, coalesce(txn_mean, 0) AS avg_amount, n_categories::DOUBLE AS n_categories, entropy, hhi, top3_share FROM customer LEFT JOIN s ON s.user_id = c_custkey LEFT JOIN d ON d.user_id = c_custkey)
       SELECT user_id, """
    + ", ".join(f"round((coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / CASE WHEN stddev_samp(coalesce({c}, 0)) OVER () > 1e-10 THEN stddev_samp(coalesce({c}, 0)) OVER () ELSE 1 END, 4) AS {c}" for c in _FEATS)
    + " FROM b",
)
def _(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    t = written(transactions(spark, sf, part=True).select("user_id", "amount", "day", "merchant", "channel", "status", "mcc"))
    s = a.txn_summary(t, "user_id", "amount", "day", "merchant", "channel", F.col("status") == "F")
    base = a.rfm(users, s, "user_id", "2002-01-01")
    feats = j.glue([base, rounded(a.diversity(t, "user_id", "mcc", "amount"), "entropy", "hhi", "top3_share")], "user_id", check=False)
    feats = written(feats)  # the feature stage ends in a file: fitting and scaling read it back
    fit = n.normalize_fit(feats, _FEATS, cfg=n.NormaliserConfig(log_copies=False))
    return rounded(n.normalize_transform(feats, fit, keep=["user_id"]), *_FEATS, digits=4)
