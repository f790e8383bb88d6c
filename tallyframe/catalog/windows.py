"""Queries: ordered per-entity features."""

import numpy as np
from pyspark.sql import functions as F

from tallyframe.catalog.aggs import _V, rounded, verdicts
from tallyframe.catalog.registry import TXN, query, table, transactions
from tallyframe.operators import aggs as a
from tallyframe.operators import hidden
from tallyframe.operators import windows as w
from tallyframe.operators.latent import HmmModel

ORD = ["ts", "event_id"]
W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def events(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", "ts", "value", "event_type")


@query("recent_k_events", "W1", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS recency FROM events QUALIFY recency <= 20")
def _(spark, sf):
    return w.recent_k(events(spark, sf), ["user_id"], ORD, 20).select("user_id", "event_id", "recency")


@query(
    "spend_change",
    "W2",
    f"""WITH {TXN}, q AS (SELECT user_id, year(day) * 4 + quarter(day) AS win, sum(amount) AS spend FROM txn GROUP BY 1, 2), l AS (SELECT *, lag(spend) OVER (PARTITION BY user_id ORDER BY win) AS prev FROM q)
       SELECT user_id, win::INTEGER AS win, round(CASE WHEN prev IS NULL OR prev = 0 THEN 0 ELSE (spend - prev) / prev END, 6) AS change FROM l""",
)
def _(spark, sf):
    t = transactions(spark, sf).groupBy("user_id", (F.year("day") * 4 + F.quarter("day")).alias("win")).agg(F.sum("amount").alias("spend"))
    return rounded(w.lag_ratio(t, ["user_id"], ["win"], "spend", "spend"), "change").drop("spend")


@query(
    "rolling_row_stats",
    "W3",
    "SELECT event_id, "
    + ", ".join(
        f"round(avg(value) OVER w{k}, 6) AS value_roll{k}_mean, round(coalesce(stddev_samp(value) OVER w{k}, 0), 6) AS value_roll{k}_std, min(value) OVER w{k} AS value_roll{k}_min, max(value) OVER w{k} AS value_roll{k}_max"
        for k in (3, 7)
    )
    + " FROM events WINDOW "
    + ", ".join(f"w{k} AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (3, 7)),
)
def _(spark, sf):
    out = w.rolling_rows(events(spark, sf), ["user_id"], ORD, ["value"], [3, 7])
    out = rounded(out, *[f"value_roll{k}_{s}" for k in (3, 7) for s in ("mean", "std")])
    return out.drop("user_id", "ts", "value", "event_type")


@query(
    "rolling_slope",
    "W4",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
       SELECT event_id, round(CASE WHEN rn = 1 THEN 0 ELSE regr_slope(value, rn) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END, 6) AS slope FROM r""",
)
def _(spark, sf):
    return rounded(w.rolling_slope(events(spark, sf), ["user_id"], ORD, "value", 7, "slope"), "slope").select("event_id", "slope")


@query(
    "velocity_acceleration",
    "W5 W8",
    f"""SELECT event_id, round(coalesce(value - lag(value) OVER w, 0), 6) AS value_velocity, round(coalesce(value - 2 * lag(value) OVER w + lag(value, 2) OVER w, 0), 6) AS value_acceleration,
       round(coalesce((value - lag(value, 7) OVER w) / 7, 0), 6) AS value_vel7 FROM events WINDOW w AS {W}""",
)
def _(spark, sf):
    d = w.derivatives(events(spark, sf), ["user_id"], ORD, "value")
    out = w.step_velocity(d, ["user_id"], ORD, "value", [7])
    return rounded(out, "value_velocity", "value_acceleration", "value_vel7").drop("user_id", "ts", "value", "event_type")


_RN = "r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@query(
    "ewm_halflife",
    "W6",
    f"""WITH {_RN} SELECT a.event_id, round(sum(b.value * pow(0.5, (a.rn - b.rn) / 5.0)) / sum(pow(0.5, (a.rn - b.rn) / 5.0)), 6) AS value_recency FROM r a JOIN r b ON a.user_id = b.user_id AND b.rn <= a.rn GROUP BY 1""",
)
def _(spark, sf):
    return rounded(w.ewm(events(spark, sf), ["user_id"], ORD, "value", 5.0), "value_recency").select("event_id", "value_recency")


@query(
    "ema_decays",
    "W7",
    f"""WITH {_RN} SELECT a.event_id, round(sum(b.value * (CASE WHEN b.rn = 1 THEN 1 ELSE 1 / 3.0 END) * pow(2 / 3.0, a.rn - b.rn)), 6) AS value_ema_fast,
       round(sum(b.value * (CASE WHEN b.rn = 1 THEN 1 ELSE 1 / 21.0 END) * pow(20 / 21.0, a.rn - b.rn)), 6) AS value_ema_slow FROM r a JOIN r b ON a.user_id = b.user_id AND b.rn <= a.rn GROUP BY 1""",
)
def _(spark, sf):
    out = w.ema(events(spark, sf), ["user_id"], ORD, "value", {"fast": 1 / 3, "slow": 1 / 21})
    return rounded(out, "value_ema_fast", "value_ema_slow").select("event_id", "value_ema_fast", "value_ema_slow")


@query(
    "period_attention",
    "W9",
    """WITH a AS (SELECT event_id, """
    + ", ".join(f"avg(abs(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW) AS a{p}" for p in (7, 30, 90))
    + """ FROM events), m AS (SELECT *, greatest(a7, a30, a90) AS g FROM a)
       SELECT event_id, round(exp(a7 - g) / (exp(a7 - g) + exp(a30 - g) + exp(a90 - g)), 6) AS value_att7, round(exp(a30 - g) / (exp(a7 - g) + exp(a30 - g) + exp(a90 - g)), 6) AS value_att30,
         round(exp(a90 - g) / (exp(a7 - g) + exp(a30 - g) + exp(a90 - g)), 6) AS value_att90 FROM m""",
)
def _(spark, sf):
    out = rounded(w.period_attention(events(spark, sf), ["user_id"], ORD, "value"), "value_att7", "value_att30", "value_att90")
    return out.drop("user_id", "ts", "value", "event_type")


def _tc(lag):
    size = max(2 * lag, 10)
    return f"""(SELECT event_id, s, len(s) AS n, list_sum(list_transform(s, lambda v: v * v)) / len(s) AS var,
      CASE WHEN len(s) > {lag} THEN list_sum(list_transform(list_zip(s[{lag + 1}:], s[:len(s) - {lag}]), lambda z: z[1] * z[2])) / (len(s) - {lag}) END AS cov
      FROM (SELECT event_id, list(value - m) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS s FROM events CROSS JOIN (SELECT avg(value) AS m FROM events)))"""


@query(
    "time_constants",
    "W10",
    f"""SELECT a.event_id, round(least(1 / (1 - abs(CASE WHEN a.n > 1 AND a.var > 1e-10 THEN a.cov / a.var ELSE 0 END) + 1e-6), 100), 4) AS value_tc1_,
       round(CASE WHEN 1 - abs(CASE WHEN b.n > 7 AND b.var > 1e-10 THEN b.cov / b.var ELSE 0 END) + 1e-6 <= 0 THEN 0 ELSE least(1 / (1 - abs(CASE WHEN b.n > 7 AND b.var > 1e-10 THEN b.cov / b.var ELSE 0 END) + 1e-6), 100) END, 4) AS value_tc7
       FROM {_tc(1)} a JOIN {_tc(7)} b USING (event_id)""".replace(
        "round(least(1 / (1 - abs(CASE WHEN a.n > 1 AND a.var > 1e-10 THEN a.cov / a.var ELSE 0 END) + 1e-6), 100), 4) AS value_tc1_",
        "round(CASE WHEN 1 - abs(CASE WHEN a.n > 1 AND a.var > 1e-10 THEN a.cov / a.var ELSE 0 END) + 1e-6 <= 0 THEN 0 ELSE least(1 / (1 - abs(CASE WHEN a.n > 1 AND a.var > 1e-10 THEN a.cov / a.var ELSE 0 END) + 1e-6), 100) END, 4) AS value_tc1",
    ),
)
def _(spark, sf):
    out = w.time_constants(events(spark, sf), ["user_id"], ORD, "value", [1, 7])
    return rounded(out, "value_tc1", "value_tc7", digits=4).drop("user_id", "ts", "value", "event_type")


@query("day_offset", "W12", f"WITH {TXN} SELECT user_id, order_id, line, item, date_diff('day', day, max(day) OVER (PARTITION BY user_id))::INTEGER AS day_offset FROM txn")
def _(spark, sf):
    t = transactions(spark, sf).select("user_id", "order_id", "line", "item", "day")
    return w.day_offset(t, ["user_id"], "day").drop("day")


@query(
    "consecutive_critical_days",
    "W13",
    """WITH d AS (SELECT user_id, ts::DATE AS day, max(value) < 120 AS critical FROM events GROUP BY 1, 2), b AS (SELECT user_id, max(day) FILTER (NOT critical) AS broken FROM d GROUP BY 1)
       SELECT user_id, sum(CASE WHEN broken IS NULL OR day > broken THEN 1 ELSE 0 END)::BIGINT AS run_length, CASE WHEN sum(CASE WHEN broken IS NULL OR day > broken THEN 1 ELSE 0 END) >= 3 THEN 1 ELSE 0 END AS triggered FROM d JOIN b USING (user_id) GROUP BY 1""",
)
def _(spark, sf):
    d = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg((F.max("value") < 120).alias("critical"))
    return w.consecutive_run(d, ["user_id"], "day", "critical", 3)


@query(
    "reject_trend_alert",
    "W14",
    f"""WITH {_V}, p AS (SELECT task, period, count(*) FILTER (verdict = 'reject') / count(*) AS rr, count(*) FILTER (verdict = 'pass') / count(*) AS pr FROM v GROUP BY 1, 2),
       k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY period DESC) AS r, lag(rr) OVER (PARTITION BY task ORDER BY period) AS prev FROM p),
       s AS (SELECT task, count(*) AS n, max(rr) FILTER (r = 1) AS last_, max(pr) FILTER (r = 1) AS lp, arg_max(rr, r) AS first_, bool_and(rr > prev) FILTER (r < (SELECT least(7, max(r)) FROM k k2 WHERE k2.task = k.task)) AS up FROM k WHERE r <= 7 GROUP BY 1)
       SELECT task, n::INTEGER AS periods, round(last_ - first_, 6) AS rise, CASE WHEN n >= 3 AND up AND last_ - first_ >= 0.02 THEN 'rising' WHEN n >= 2 AND lp < 0.95 THEN 'low_pass_rate' ELSE 'none' END AS alert FROM s""".replace(
        "bool_and(rr > prev) FILTER (r < (SELECT least(7, max(r)) FROM k k2 WHERE k2.task = k.task))", "bool_and(rr > prev) FILTER (r < 7)"
    ),
)
def _(spark, sf):
    r = a.verdict_rollup(verdicts(spark, sf), "period", "task", "layer", "verdict").where("task IS NOT NULL AND layer IS NULL")
    return rounded(w.trend_alert(r, ["task"], "period", "reject_rate", "pass_rate"), "rise")


@query(
    "sliding_windows",
    "W15",
    """WITH b AS (SELECT min(ts::DATE) AS lo, max(ts::DATE) AS hi FROM events), s AS (SELECT unnest(generate_series(0, date_diff('day', lo, hi))) AS k, lo, hi FROM b), st AS (SELECT (k // 3)::INTEGER AS win_id, lo + k::INTEGER AS win_start FROM s WHERE k % 3 = 0 AND lo + k::INTEGER + 7 <= hi)
       SELECT user_id, win_id, CAST(win_start AS VARCHAR) AS win_start, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN st ON ts::DATE >= win_start AND ts::DATE < win_start + 7 GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    out = w.sliding_windows(events(spark, sf), "ts", 7, 3).groupBy("user_id", "win_id", F.col("win_start").cast("string").alias("win_start"))
    return rounded(out.agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


#: A fixed two-state model: start, transitions, means and variances.
_HMM = HmmModel(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([[20.0], [60.0]]), np.array([[900.0], [2500.0]]))
_DENSITY = "exp(-0.5 * (value - {0}) * (value - {0}) / {1}) / sqrt({1})"


@query(
    "hidden_state_posteriors",
    "G7",
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n,
         coalesce({_DENSITY.format(20.0, 900.0)}, 1) AS b0, coalesce({_DENSITY.format(60.0, 2500.0)}, 1) AS b1 FROM events),
       f(user_id, pos, p) AS (SELECT user_id, pos, 0.6::DOUBLE * b0 / (0.6 * b0 + 0.4 * b1) FROM s WHERE pos = 0
         UNION ALL SELECT s.user_id, s.pos, (f.p * 0.9 + (1 - f.p) * 0.3) * b0 / ((f.p * 0.9 + (1 - f.p) * 0.3) * b0 + (f.p * 0.1 + (1 - f.p) * 0.7) * b1) FROM f JOIN s ON s.user_id = f.user_id AND s.pos = f.pos + 1),
       r(user_id, pos, q) AS (SELECT user_id, pos, 0.5::DOUBLE FROM s WHERE pos = n - 1
         UNION ALL SELECT s.user_id, s.pos - 1, (0.9 * b0 * r.q + 0.1 * b1 * (1 - r.q)) / (0.9 * b0 * r.q + 0.1 * b1 * (1 - r.q) + 0.3 * b0 * r.q + 0.7 * b1 * (1 - r.q)) FROM r JOIN s ON s.user_id = r.user_id AND s.pos = r.pos WHERE s.pos > 0)
       SELECT user_id, pos, round(p * q / (p * q + (1 - p) * (1 - q)), 6) AS first_state FROM f JOIN r USING (user_id, pos)""",
)
def _(spark, sf):
    """Probability of the first state at every event of every user, histories cut into segments of 7 steps."""
    segs = hidden.segments(events(spark, sf), ["user_id"], ORD, ["value"], 7)
    out = hidden.posteriors(segs, _HMM, fan=4)
    return out.select("user_id", "pos", F.round(F.get("probs", F.lit(0)), 6).alias("first_state"))
