"""Queries: history lists and labels derived from them."""

from pyspark.sql import functions as F

from tallyframe.catalog.aggs import rounded
from tallyframe.catalog.registry import TXN, query, table, transactions
from tallyframe.functions.stats import md5_int
from tallyframe.operators import aggs as a
from tallyframe.operators import labels as lb
from tallyframe.operators import prep as p
from tallyframe.operators import sequences as s
from tallyframe.plans.session import written

ORDER = ["day", "amount", "order_id", "line", "item"]
HIST = f"""{TXN}, h AS (SELECT user_id, list(amount ORDER BY day, amount, order_id, line, item) AS amounts, list(mcc ORDER BY day, amount, order_id, line, item) AS codes,
  list(date_diff('day', DATE '1995-01-01', day) ORDER BY day, amount, order_id, line, item) AS days FROM txn GROUP BY 1)"""


def history(spark, sf, **cut):
    t = transactions(spark, sf, part=True)
    d = F.datediff("day", F.lit("1995-01-01").cast("date"))
    return s.collect_sequences(t, "user_id", ORDER, {"amounts": "amount", "codes": "mcc", "days": d}, **cut)


def unfolded(df, col, name="value"):
    keys = [c for c in df.columns if c != col]
    return df.select(*keys, F.posexplode(col).alias("pos", name))


@query("event_lists", "Q6", f"WITH {HIST} SELECT user_id, 0::BIGINT AS segment, (unnest(generate_series(1, len(amounts))) - 1)::INTEGER AS pos, unnest(amounts) AS amount, unnest(codes) AS code FROM h")
def _(spark, sf):
    h = history(spark, sf)
    z = F.arrays_zip("amounts", "codes")
    out = h.select("user_id", "segment", F.posexplode(z).alias("pos", "z"))
    return out.select("user_id", "segment", "pos", F.col("z.amounts").alias("amount"), F.col("z.codes").alias("code"))


@query(
    "event_lists_segmented",
    "Q6",
    f"""WITH {TXN}, r AS (SELECT user_id, amount, (row_number() OVER (PARTITION BY user_id ORDER BY day DESC, amount DESC, order_id DESC, line DESC, item DESC) - 1) // 16 AS segment FROM txn)
        SELECT user_id, segment, count(*)::INTEGER AS n, round(sum(amount), 2) AS total FROM r GROUP BY 1, 2""",
)
def _(spark, sf):
    h = history(spark, sf, segment_rows=16)
    total = F.aggregate("amounts", F.lit(0.0), lambda x, y: x + y)
    return h.select("user_id", "segment", F.size("amounts").alias("n"), F.round(total, 2).alias("total"))


@query(
    "lag_features",
    "Q1",
    f"""WITH {HIST}, l AS (SELECT user_id, list_reverse(list_slice(amounts, 1, greatest(len(amounts) - 1, 0))) AS v FROM h), g AS (SELECT unnest(generate_series(0, 59))::INTEGER AS pos)
        SELECT user_id, pos, round(coalesce(v[pos + 1], -1), 2) AS value FROM l CROSS JOIN g""",
)
def _(spark, sf):
    out = s.lag_features(history(spark, sf, newest=61), {"amounts": -1.0}, 60, 1, keep=["user_id"])
    return rounded(unfolded(out, "lag_amounts"), "value", digits=2)


@query(
    "densified_columns",
    "Q2",
    f"WITH {HIST} SELECT user_id, " + ", ".join(f"CASE WHEN len(codes) - {6 - i} > 0 THEN codes[len(codes) - {6 - i}] ELSE -1 END AS code_{i:03d}" for i in range(1, 7)) + " FROM h",
)
def _(spark, sf):
    return s.densify(history(spark, sf, newest=6), [s.Densify("codes", "code", 6, -1, "int")], keep=["user_id"])


_E = "e AS (SELECT user_id, list(epoch_us(ts) // 1000000 ORDER BY ts, event_id) AS t FROM events GROUP BY 1)"


def _pos(i):
    return f"(CASE WHEN len(t) - {4 - i} > 0 THEN t[len(t) - {4 - i}] ELSE 0 END)"


@query(
    "densified_time_features",
    "Q3",
    f"WITH {_E}, d AS (SELECT user_id, {', '.join(f'{_pos(i)} AS t_{i:03d}' for i in range(1, 5))} FROM e) SELECT user_id, "
    + ", ".join(
        f"t_{i:03d}, "
        + (f"CASE WHEN t_{i:03d} <> 0 AND t_{i - 1:03d} <> 0 THEN t_{i:03d} - t_{i - 1:03d} ELSE 0 END AS t_tdelta_{i:03d}, " if i > 1 else "0::BIGINT AS t_tdelta_001, ")
        + f"CASE WHEN t_{i:03d} <> 0 THEN hour(to_timestamp(t_{i:03d}) AT TIME ZONE 'UTC') ELSE 0 END::INTEGER AS t_hour_{i:03d}, CASE WHEN t_{i:03d} <> 0 THEN dayofweek(to_timestamp(t_{i:03d}) AT TIME ZONE 'UTC') ELSE 0 END::INTEGER AS t_dow_{i:03d}, "
        f"CASE WHEN t_{i:03d} <> 0 AND dayofweek(to_timestamp(t_{i:03d}) AT TIME ZONE 'UTC') IN (0, 6) THEN 1 ELSE 0 END AS t_weekend_{i:03d}, CASE WHEN t_{i:03d} <> 0 THEN {i} ELSE 0 END AS t_cumcount_{i:03d}"
        for i in range(1, 5)
    )
    + " FROM d",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    h = s.collect_sequences(e, "user_id", ["ts", "event_id"], {"t": F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)}, newest=4)
    spec = s.Densify("t", "t", 4, 0, "bigint")
    return s.densify_time(s.densify(h, [spec], keep=["user_id"]), spec)


def _w(n):
    f = f"list_filter(list_zip(a, d), lambda q: dmax - q[2] <= {n})"
    v = f"list_transform({f}, lambda q: q[1])"
    return f"""round(coalesce(list_sum({v}), 0), 6) AS roll_w{n}d_sum, round(coalesce(list_avg({v}), 0), 6) AS roll_w{n}d_mean, round(coalesce(CASE WHEN len({v}) > 1 THEN list_stddev_samp({v}) ELSE 0 END, 0), 6) AS roll_w{n}d_std,
      coalesce(len({v}), 0)::DOUBLE AS roll_w{n}d_count, coalesce(len(list_distinct(list_transform({f}, lambda q: q[2]))), 0)::DOUBLE AS roll_w{n}d_days_active"""


@query(
    "rolling_list_stats",
    "Q4",
    f"""WITH {HIST}, c AS (SELECT user_id, list_slice(amounts, 1, greatest(len(amounts) - 1, 0)) AS a, list_slice(days, 1, greatest(len(days) - 1, 0)) AS d FROM h), m AS (SELECT *, list_max(d) AS dmax FROM c)
        SELECT user_id, {_w(30)}, {_w(180)} FROM m""",
)
def _(spark, sf):
    out = s.rolling_list_stats(history(spark, sf), "amounts", "days", [30, 180], truncate_last=1)
    out = rounded(out, *[f"roll_w{n}d_{m}" for n in (30, 180) for m in ("sum", "mean", "std")])
    return out.drop("segment", "amounts", "codes", "days")


@query(
    "multihot_top_codes",
    "Q5",
    f"""WITH {HIST}, tops AS (SELECT c AS mcc, row_number() OVER (ORDER BY count(*) DESC, c) AS r FROM (SELECT unnest(codes) AS c FROM h) GROUP BY 1), x AS (SELECT user_id, unnest(codes) AS mcc FROM h)
        SELECT user_id, """
    + ", ".join(f"max(CASE WHEN r = {i} THEN 1 ELSE 0 END)::DOUBLE AS bin_top{i:02d}, sum(CASE WHEN r = {i} THEN 1 ELSE 0 END)::DOUBLE AS cnt_top{i:02d}" for i in range(1, 9))
    + ", sum(CASE WHEN r > 8 THEN 1 ELSE 0 END)::DOUBLE AS bin_others FROM x JOIN tops USING (mcc) GROUP BY 1",
)
def _(spark, sf):
    h = history(spark, sf)
    vocab = s.multihot_fit(h, "codes", 8)
    out = s.multihot_transform(h, "codes", vocab, prefix="bin")
    return s.multihot_transform(out, "codes", vocab, binary=False, others=False, prefix="cnt").drop("segment", "amounts", "codes", "days")




def cells(df, col, *keys):
    keys = keys or ("user_id",)
    steps = df.select(*keys, F.posexplode(col).alias("pos", "row"))
    return steps.select(*keys, "pos", F.posexplode("row").alias("feature", "value"))


@query(
    "padded_matrix",
    "Q7",
    f"""WITH {HIST}, g AS (SELECT unnest(generate_series(0, 29))::INTEGER AS pos), c AS (SELECT user_id, CASE WHEN len(amounts) > 1 THEN amounts[:len(amounts) - 1] ELSE amounts END AS a, CASE WHEN len(codes) > 1 THEN codes[:len(codes) - 1] ELSE codes END AS k FROM h)
        SELECT user_id, pos, 0 AS feature, coalesce(a[pos + 1], 0) AS value FROM c CROSS JOIN g UNION ALL SELECT user_id, pos, 1, coalesce(k[pos + 1], 0)::DOUBLE FROM c CROSS JOIN g""",
)
def _(spark, sf):
    return cells(s.to_matrix(history(spark, sf, oldest=31), ["amounts", "codes"], 30, 1), "matrix")


@query(
    "time_window_matrix",
    "Q8",
    f"""WITH {TXN}, k AS (SELECT *, max(day) OVER (PARTITION BY user_id) AS top FROM txn), f AS (SELECT user_id, list(amount ORDER BY day, amount, order_id, line, item) AS a FROM k WHERE day >= top - 400 GROUP BY 1),
        c AS (SELECT user_id, CASE WHEN len(a) > 8 THEN a[len(a) - 7:] ELSE a END AS last_, a[:8] AS first_ FROM f), g AS (SELECT unnest(generate_series(0, 7))::INTEGER AS pos)
        SELECT user_id, 'last' AS keep, pos, 0 AS feature, coalesce(last_[pos + 1], 0) AS value FROM c CROSS JOIN g UNION ALL SELECT user_id, 'first', pos, 0, coalesce(first_[pos + 1], 0) FROM c CROSS JOIN g""",
)
def _(spark, sf):
    h = history(spark, sf).withColumn("dates", F.transform("days", lambda d: F.date_add(F.lit("1995-01-01").cast("date"), d)))
    for keep in ("last", "first"):  # both matrices in one pass over the histories
        h = s.to_matrix_time_based(h, ["amounts"], 8, 400, "dates", keep=keep, name=keep)
    both = h.select("user_id", F.explode(F.array(*[F.struct(F.lit(k).alias("keep"), F.col(k).alias("matrix")) for k in ("last", "first")])).alias("m"))
    return cells(both.select("user_id", "m.*"), "matrix", "user_id", "keep").select("user_id", "keep", "pos", "feature", "value")


@query("tail_matrix", "Q8", f"WITH {HIST}, g AS (SELECT unnest(generate_series(0, 9))::INTEGER AS pos), c AS (SELECT user_id, CASE WHEN len(amounts) > 10 THEN amounts[len(amounts) - 9:] ELSE amounts END AS a FROM h) SELECT user_id, pos, 0 AS feature, coalesce(a[pos + 1], 0) AS value FROM c CROSS JOIN g")
def _(spark, sf):
    return cells(s.to_matrix_time_based(history(spark, sf, newest=10), ["amounts"], 10, 90), "matrix")


@query(
    "event_encoder",
    "Q9 W1",
    """WITH st AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events), tops AS (SELECT code, row_number() OVER (ORDER BY count(*) DESC, code) AS rk FROM (SELECT event_id % 97 AS code FROM events) GROUP BY 1 QUALIFY rk <= 60),
       r AS (SELECT user_id, ts, event_id, (value - m) / sd AS z, event_type, event_id % 97 AS code, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events CROSS JOIN st QUALIFY rn <= 40),
       l AS (SELECT r.*, coalesce(rk, 0) AS rk, lag(ts::DATE) OVER w AS pd, lag(z) OVER w AS pz FROM r LEFT JOIN tops USING (code) WINDOW w AS (PARTITION BY user_id ORDER BY rn))
       SELECT user_id, (rn - 1)::INTEGER AS pos, round(z, 6) AS f0, round(hour(ts) / 24, 6) AS f1, round(dayofweek(ts) / 7, 6) AS f2, round(month(ts) / 12, 6) AS f3, CASE WHEN dayofweek(ts) IN (0, 6) THEN 1.0 ELSE 0.0 END::DOUBLE AS f4,
         (CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 1 END / 2)::DOUBLE AS f5, round(rk / 60, 6) AS f6, (event_type = 'error')::INTEGER::DOUBLE AS f7,
         round(ln(1 + abs(coalesce(date_diff('day', pd, ts::DATE), 0))), 6) AS f8, round(coalesce(z - pz, 0), 6) AS f9 FROM l""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.col("value").alias("amount"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), F.col("event_type").alias("channel"),
        (F.col("event_id") % 97).alias("mcc"), (F.col("event_type") == "error").cast("int").alias("error"),
    )
    enc = s.encode_events(e, ["ts", "event_id"], {"view": 0.0, "click": 1.0, "purchase": 2.0}, 40)
    rows = enc.select("user_id", "seq_length", F.posexplode("steps").alias("pos", "v")).where("pos < seq_length")
    return rows.select("user_id", "pos", *[F.round(F.get("v", F.lit(i)), 6).alias(f"f{i}") for i in range(10)])


@query("even_day_offsets", "Q10", f"WITH {HIST}, o AS (SELECT user_id, len(amounts) AS n, unnest(generate_series(0, len(amounts) - 1)) AS i FROM h) SELECT user_id, i::INTEGER AS pos, round((n - 1 - i) * 360 / greatest(n - 1, 1))::INTEGER AS value FROM o")
def _(spark, sf):
    return unfolded(s.even_offsets(history(spark, sf), "amounts").select("user_id", "day_offset"), "day_offset")


@query("perturbed_donor_histories", "")
def _(spark, sf):
    h = history(spark, sf).withColumn("target", (md5_int(F.col("user_id")) % 60 + 5).cast("int"))
    return s.perturb_sequences(h, "user_id", "amounts", "codes", "days", "target").select("user_id", "target", F.size("amounts").alias("n"), "amounts", "codes", "days")


PRIOS = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "low": "5-LOW"}
_SNAP = "snap AS (SELECT o_custkey AS user_id, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS ym, " + ", ".join(f"max(CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END) AS {k}" for k, v in PRIOS.items()) + " FROM orders GROUP BY 1, 2)"


def snapshots(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("user_id"), a.month_index("o_orderdate").alias("ym")).agg(*[F.max((F.col("o_orderpriority") == v).cast("int")).alias(k) for k, v in PRIOS.items()])


def holdings(spark, sf):
    return s.holdings_sequences(snapshots(spark, sf), "user_id", "ym", list(PRIOS))


_P = list(PRIOS)
_SUM = " + ".join(_P)
_ACQ = " + ".join(f"greatest({k} - lag({k}) OVER w, 0)" for k in _P)
_CHU = " + ".join(f"greatest(lag({k}) OVER w - {k}, 0)" for k in _P)


@query(
    "holdings_history",
    "Q12",
    f"""WITH {_SNAP}, x AS (SELECT user_id, ym, {_SUM} AS np, CASE WHEN row_number() OVER w > 1 THEN {_ACQ} END AS acq, CASE WHEN row_number() OVER w > 1 THEN {_CHU} END AS chu, {", ".join(_P)} FROM snap WINDOW w AS (PARTITION BY user_id ORDER BY ym))
        SELECT user_id, count(*)::INTEGER AS months_observed, sum(coalesce(acq, 0))::INTEGER AS total_acquisitions, sum(coalesce(chu, 0))::INTEGER AS total_churns, ({" + ".join(f"max({k})" for k in _P)})::INTEGER AS product_diversity,
          string_agg(np::VARCHAR, ',' ORDER BY ym) AS counts, string_agg(urgent::VARCHAR, ',' ORDER BY ym) AS urgent, coalesce(string_agg(acq::VARCHAR, ',' ORDER BY ym), '0') AS acquisitions, coalesce(string_agg(chu::VARCHAR, ',' ORDER BY ym), '0') AS churns FROM x GROUP BY 1""",
)
def _(spark, sf):
    h = holdings(spark, sf)
    txt = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return h.select(
        "user_id", "months_observed", "total_acquisitions", "total_churns", "product_diversity",
        txt("seq_num_products").alias("counts"), txt("seq_urgent").alias("urgent"), txt("seq_acquisitions").alias("acquisitions"), txt("seq_churns").alias("churns"),
    )


@query(
    "history_labels",
    "L12 L13 L14",
    f"""WITH {_SNAP}, h AS (SELECT user_id, list({_SUM} ORDER BY ym) AS c, {", ".join(f"list({k} ORDER BY ym) AS {k}" for k in _P)} FROM snap GROUP BY 1)
        SELECT user_id, {" || ".join(f"CASE WHEN len(c) >= 2 AND {k}[-1] = 1 AND {k}[-2] = 0 THEN '{i};' ELSE '' END" for i, k in enumerate(_P))} AS nba,
          CASE WHEN len(c) >= 3 AND c[-1] < list_avg(c[:len(c) - 1]) * 0.7 THEN 1 ELSE 0 END AS churn_signal,
          round(CASE WHEN len(c) >= 2 AND list_avg(c) > 0 THEN 1 - least(list_stddev_pop(c) / list_avg(c), 1) ELSE 1 END, 6) AS stability FROM h""",
)
def _(spark, sf):
    out = lb.derive_labels(
        holdings(spark, sf),
        {
            "nba": {"type": "nba_from_history", "source": [f"seq_{k}" for k in PRIOS]},
            "churn_signal": {"type": "churn_signal", "source": "seq_num_products"},
            "stability": {"type": "product_stability", "source": "seq_num_products"},
        },
    )
    nba = F.array_join(F.transform("nba", lambda i: F.concat(i.cast("string"), F.lit(";"))), "")
    return out.select("user_id", nba.alias("nba"), "churn_signal", F.round("stability", 6).alias("stability"))


LABELS = {
    "l_direct": {"type": "direct", "source": "balance"},
    "l_bucket": {"type": "bucket", "source": "balance", "boundaries": [1000, 5000, 8000], "sentinel": 1863.84, "sentinel_class": 9},
    "l_string": {"type": "string_map", "source": "segment", "map": {"BUILDING": 0, "MACHINERY": 1, "HOUSEHOLD": 2}, "default": 3},
    "l_num": {"type": "string_map", "source": "nation", "map": {"a": 0, "b": 7}},
    "l_first": {"type": "list_first", "source": "codes", "default": -1},
    "l_group": {"type": "list_first_group", "source": "codes", "group_map": {1: [1, 2, 3, 4, 5], 2: list(range(6, 30))}, "default": 0},
    "l_length": {"type": "list_length", "source": "codes"},
    "l_hit": {"type": "list_intersect", "source": "codes", "indices": [7, 13]},
    "l_sum": {"type": "weighted_sum", "source": ["balance", "nation", "absent"], "weights": [0.5, 2.0, 1.0]},
    "l_norm": {"type": "weighted_sum", "source": ["balance", "nation"], "weights": [0.7, 0.3], "normalize": True},
    "l_last": {"type": "sequence_last", "source": "codes"},
    "l_last_top": {"type": "sequence_last", "source": "codes", "top_k": 10, "default": -1},
    "l_trend": {"type": "sequence_diversity_trend", "source": "codes"},
    "l_shift": {"type": "sequence_mode_shift", "source": "codes"},
    "l_absent": {"type": "sequence_last", "source": "nowhere"},
    "l_log": {"type": "winsor_log", "source": "balance", "q": 0.9},
}


@query(
    "label_bundle",
    "L1 L2 L3 L4 L5 L6 L7 L8 L9 L10 L11 L16",
    f"""WITH {HIST}, b AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_acctbal END AS balance, c_nationkey AS nation, c_mktsegment AS segment, codes FROM customer LEFT JOIN h ON user_id = c_custkey),
       x AS (SELECT max(balance) AS mb, max(nation) AS mn, quantile_cont(balance, 0.9) AS q FROM b),
       tops AS (SELECT codes[-1] AS last_, row_number() OVER (ORDER BY count(*) DESC, codes[-1]) - 1 AS r FROM b WHERE codes IS NOT NULL GROUP BY 1 QUALIFY r < 10),
       hv AS (SELECT user_id, unnest(codes[:len(codes) // 2]) AS v, 1 AS half FROM b WHERE len(codes) >= 4 UNION ALL SELECT user_id, unnest(codes[len(codes) // 2 + 1:]), 2 FROM b WHERE len(codes) >= 4),
       md AS (SELECT user_id, half, v FROM hv GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY user_id, half ORDER BY count(*) DESC, v) = 1),
       sh AS (SELECT user_id, (max(v) FILTER (half = 1) <> max(v) FILTER (half = 2))::INTEGER AS shift FROM md GROUP BY 1)
       SELECT user_id, round(coalesce(balance, 0), 2) AS l_direct, CASE WHEN balance IS NULL OR balance = 1863.84 THEN 9 WHEN balance < 1000 THEN 0 WHEN balance < 5000 THEN 1 WHEN balance < 8000 THEN 2 ELSE 3 END AS l_bucket,
         CASE segment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 2 ELSE 3 END AS l_string, least(nation, 7)::INTEGER AS l_num, coalesce(codes[1], -1)::INTEGER AS l_first,
         CASE WHEN codes[1] BETWEEN 1 AND 5 THEN 1 WHEN codes[1] BETWEEN 6 AND 29 THEN 2 ELSE 0 END AS l_group, coalesce(len(codes), 0)::INTEGER AS l_length,
         CASE WHEN list_contains(codes, 7) OR list_contains(codes, 13) THEN 1 ELSE 0 END AS l_hit, round(0.5 * coalesce(balance, 0) + 2.0 * nation, 4) AS l_sum, round(0.7 * coalesce(balance, 0) / mb + 0.3 * nation / mn, 6) AS l_norm,
         coalesce(codes[-1], -1)::INTEGER AS l_last, coalesce(r, -1)::INTEGER AS l_last_top,
         round(CASE WHEN codes IS NULL OR len(codes) < 4 THEN 0 ELSE len(list_distinct(codes[len(codes) // 2 + 1:])) / greatest(len(list_distinct(codes[:len(codes) // 2])), 1) - 1 END, 6) AS l_trend,
         coalesce(shift, 0) AS l_shift, -1 AS l_absent, CASE WHEN coalesce(balance, 0) <= -1 THEN 0 ELSE round(ln(1 + least(coalesce(balance, 0), q)), 6) END AS l_log
       FROM b CROSS JOIN x LEFT JOIN tops ON tops.last_ = codes[-1] LEFT JOIN sh USING (user_id)""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 50 != 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    frame = written(c.join(history(spark, sf).select("user_id", "codes"), "user_id", "left"))  # fitted rules read it again
    out = lb.derive_labels(frame, LABELS)
    out = out.withColumns({"l_direct": F.round(F.coalesce("l_direct", F.lit(0.0)), 2), "l_log": F.coalesce("l_log", F.lit(0.0)), "l_sum": F.round("l_sum", 4)})
    return rounded(out, "l_norm", "l_trend", "l_log").select("user_id", *LABELS)


@query(
    "leak_guard_truncate",
    "P4",
    f"""WITH {HIST} SELECT user_id, len(CASE WHEN len(codes) > 2 THEN codes[:len(codes) - 2] ELSE codes END)::INTEGER AS n, (CASE WHEN len(codes) > 2 THEN codes[len(codes) - 2] ELSE codes[-1] END)::INTEGER AS last_code FROM h""",
)
def _(spark, sf):
    h = history(spark, sf).withColumn("last_code", F.get("codes", F.size("codes") - 1))
    out = p.truncate_and_recompute(h, ["codes"], 2, {"last_code": "codes"})
    return out.select("user_id", F.size("codes").alias("n"), "last_code")


@query(
    "list_set_operations",
    "U2 J9",
    f"""WITH {HIST}, g AS (SELECT user_id, codes[:len(codes) // 2] AS x, codes[len(codes) // 2 + 1:] AS y FROM h)
        SELECT user_id, list_has_any(x, y)::INTEGER AS overlap, len(list_distinct(x || y))::INTEGER AS distinct_n, len(list_distinct(list_filter(y, lambda v: NOT list_contains(x, v))))::INTEGER AS new_n FROM g""",
)
def _(spark, sf):
    from tallyframe.functions.lists import halves

    x, y = halves("codes")
    h = history(spark, sf).select("user_id", x.alias("x"), y.alias("y"))
    return h.select("user_id", F.arrays_overlap("x", "y").cast("int").alias("overlap"), F.size(F.array_distinct(F.concat("x", "y"))).alias("distinct_n"), F.size(F.array_except("y", "x")).alias("new_n"))


@query(
    "sequence_profile",
    "A19",
    f"""WITH {HIST}, l AS (SELECT len(codes) AS n FROM customer LEFT JOIN h ON user_id = c_custkey), q AS (SELECT quantile_cont(n, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM l),
        w AS (SELECT count(*)::DOUBLE AS n, avg(n) AS mean, stddev_samp(n) AS std, min(n)::DOUBLE AS min, max(n)::DOUBLE AS max, sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END)::DOUBLE AS null_count,
          100.0 * count(*) FILTER (n <= 20) / count(*) AS pct_cold, 100.0 * count(*) FILTER (n > 60) / count(*) AS pct_heavy, 100.0 * count(*) FILTER (n = 0) / count(*) AS pct_empty,
          100.0 * count(*) FILTER (n <= 30) / count(*) AS full_30, 100.0 * sum(least(n, 30)) / sum(n) AS events_30 FROM l)
        SELECT metric, round(value, 4) AS value FROM (UNPIVOT w ON n, mean, std, min, max, null_count, pct_cold, pct_heavy, pct_empty, full_30, events_30 INTO NAME metric VALUE value)
        UNION ALL SELECT unnest(['p10', 'p25', 'p50', 'p75', 'p90', 'p95', 'p99']), round(unnest(q), 4) FROM q""",
)
def _(spark, sf):
    h = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(history(spark, sf), "user_id", "left")
    return rounded(a.sequence_profile(h, "codes", [30], 20, 60), "value", digits=4)


@query(
    "element_coverage",
    "A19",
    f"""WITH {TXN}, c AS (SELECT mcc, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, mcc) AS r FROM txn GROUP BY 1)
        SELECT count(*) AS unique_values, sum(n)::BIGINT AS total_events, round(100.0 * sum(n) FILTER (r <= 5) / sum(n), 6) AS top_5_pct, round(100.0 * sum(n) FILTER (r <= 20) / sum(n), 6) AS top_20_pct FROM c""",
)
def _(spark, sf):
    return rounded(a.element_coverage(history(spark, sf), "codes", [5, 20]), "top_5_pct", "top_20_pct")


@query(
    "interval_distribution",
    "A19",
    f"""WITH {TXN}, d AS (SELECT date_diff('day', DATE '1995-01-01', day)::DOUBLE AS d FROM txn), q AS (SELECT quantile_cont(d, [0.1, 0.5, 0.9, 0.99]) AS q FROM d)
        SELECT count(*) AS n, round(avg(d), 4) AS mean, round(stddev_samp(d), 4) AS std, min(d) AS min, max(d) AS max, any_value(q[1]) AS p10, any_value(q[2]) AS p50, any_value(q[3]) AS p90, any_value(q[4]) AS p99 FROM d CROSS JOIN q""",
)
def _(spark, sf):
    return rounded(a.interval_distribution(history(spark, sf), "days"), "mean", "std", digits=4)


_MAJOR = {0: range(1, 11), 1: range(11, 26), 2: range(26, 41)}


@query(
    "card_label_bundle",
    "L15 L16 A12 A13 A14 A15",
    f"""WITH {TXN}, t AS (SELECT *, (line % 8)::INTEGER AS slot, (status = 'F')::INTEGER AS fraud FROM txn),
       core AS (SELECT user_id, avg(fraud) AS fr, max(day) AS ld, sum(amount) AS total FROM t GROUP BY 1), mc AS (SELECT user_id, month(day) AS m, count(*) AS c FROM t GROUP BY 1, 2),
       eng AS (SELECT user_id, sum(c * (m - 6.5)) / 143 AS slope FROM mc GROUP BY 1),
       tc AS (SELECT user_id, channel FROM t GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, channel) = 1),
       tsl AS (SELECT user_id, slot FROM t GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, slot) = 1),
       tm AS (SELECT user_id, mcc FROM t GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, mcc) = 1),
       tb AS (SELECT user_id, brand FROM t GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, brand) = 1),
       g AS (SELECT user_id, date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS gap FROM t), mg AS (SELECT user_id, median(gap) AS gap FROM g WHERE gap IS NOT NULL GROUP BY 1),
       ms AS (SELECT user_id, merchant, sum(amount) AS amt FROM t GROUP BY 1, 2), sp AS (SELECT user_id, amt / greatest(sum(amt) OVER (PARTITION BY user_id), 1e-8) AS p FROM ms), hh AS (SELECT user_id, sum(p * p) AS hhi FROM sp GROUP BY 1),
       u AS (SELECT c_custkey AS user_id, 18 + c_nationkey * 2 AS age, abs(c_acctbal) * 100 AS lim FROM customer),
       b AS (SELECT u.user_id, (coalesce(fr, 0) > (SELECT median(fr) FROM core))::INTEGER AS label_is_fraud, coalesce((ld >= DATE '2001-11-04' - 90)::INTEGER, 0) AS wt, least(greatest(floor((age - 20) / 10), 0), 4)::INTEGER AS label_life_stage,
           coalesce(total, 0) AS total, coalesce(total, 0) / greatest(lim, 1) AS bu, coalesce(slope, 0) AS slope, CASE channel WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS label_channel, coalesce(slot, 0) AS label_timing,
           CASE WHEN mcc BETWEEN 1 AND 10 THEN 0 WHEN mcc BETWEEN 11 AND 25 THEN 1 WHEN mcc BETWEEN 26 AND 40 THEN 2 ELSE 7 END AS label_nba, (coalesce(mcc, 0) % 15)::INTEGER AS label_spending_category,
           CASE WHEN coalesce(gap, 999) <= 10 THEN 0 WHEN coalesce(gap, 999) <= 20 THEN 1 WHEN coalesce(gap, 999) <= 35 THEN 2 ELSE 3 END AS label_consumption_cycle, coalesce(hhi, 0) AS hhi, CASE brand WHEN 'Brand#2' THEN 1 WHEN 'Brand#3' THEN 2 ELSE 0 END AS label_brand
         FROM u LEFT JOIN core USING (user_id) LEFT JOIN eng USING (user_id) LEFT JOIN tc USING (user_id) LEFT JOIN tsl USING (user_id) LEFT JOIN tm USING (user_id) LEFT JOIN mg USING (user_id) LEFT JOIN hh USING (user_id) LEFT JOIN tb USING (user_id)),
       q AS (SELECT quantile_cont(total, 0.995) AS a, quantile_cont(total / 12, 0.995) AS s FROM b)
       SELECT user_id, label_is_fraud, wt AS label_will_transact, 1 - wt AS label_churn, wt AS label_retention, label_life_stage, round(ln(1 + least(total, a)), 6) AS label_ltv, round(bu, 6) AS label_balance_util, round(slope, 6) AS label_engagement,
         label_channel, label_timing, label_nba, label_spending_category, label_consumption_cycle, round(ln(1 + least(total / 12, s)), 6) AS label_spending_amount, round(hhi, 6) AS label_merchant_affinity, label_brand FROM b CROSS JOIN q""",
)
def _(spark, sf):
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") * 2 + 18).alias("age"), (F.abs("c_acctbal") * 100).alias("credit_limit"))
    t = written(transactions(spark, sf, part=True)).withColumns({"slot": (F.col("line") % 8).cast("int"), "fraud": (F.col("status") == "F").cast("int")})
    out = lb.card_labels(u, t, "2001-11-04", ["A", "N", "R"], ["Brand#1", "Brand#2", "Brand#3"], {k: list(v) for k, v in _MAJOR.items()})
    return rounded(out, "label_ltv", "label_balance_util", "label_engagement", "label_spending_amount", "label_merchant_affinity")


@query(
    "future_window_labels",
    "L17 J5 J9 A13",
    f"""WITH {TXN}, w AS (SELECT i AS win_id, (SELECT min(day) FROM txn) + (i * 90)::INTEGER AS ws, (SELECT min(day) FROM txn) + (i * 90 + 179)::INTEGER AS we FROM (SELECT unnest(range((SELECT date_diff('day', min(day), max(day)) // 90 + 1 FROM txn))) AS i) r),
       past AS (SELECT DISTINCT user_id, win_id, mcc FROM txn JOIN w ON day BETWEEN ws AND we), f AS (SELECT user_id, win_id, mcc, sum(amount) AS s, count(*) AS n FROM txn JOIN w ON day BETWEEN we + 1 AND we + 30 GROUP BY 1, 2, 3)
       SELECT user_id, win_id, round(sum(s), 2) AS label_spend, sum(n)::BIGINT AS label_txn_count, arg_max(mcc, (n, -mcc)) AS label_top, max(CASE WHEN (user_id, win_id, mcc) IN (SELECT (user_id, win_id, mcc) FROM past) THEN 0 ELSE 1 END) AS has_new FROM f GROUP BY 1, 2""",
)
def _(spark, sf):
    t = transactions(spark, sf, part=True).select("user_id", "day", "amount", "mcc")
    first, last = t.agg(F.min("day"), F.max("day")).first()
    w = spark.range((last - first).days // 90 + 1).select(F.col("id").alias("win_id"), F.date_add(F.lit(first), (F.col("id") * 90).cast("int")).alias("win_start"))
    w = w.withColumn("win_end", F.date_add("win_start", 179))
    return rounded(lb.future_labels(t, w), "label_spend", digits=2)
