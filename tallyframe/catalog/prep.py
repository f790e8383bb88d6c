"""Queries: column selection, cleaning, scaling and encoding."""

from pyspark.sql import functions as F

from tallyframe.catalog.registry import query, table
from tallyframe.operators import normalise as n
from tallyframe.operators import prep as p


@query(
    "column_filter",
    "P1",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\" FROM lineitem HAVING count(DISTINCT {c}) >= 12" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey")),
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("flag", (F.col("l_quantity") > 10).cast("int"))
    cols = p.resolve_columns(df, p.ColumnFilter(exclude_binary=True, min_nunique=12, include_prefix=["l_", "flag"], exclude_prefix=["l_line"], exclude=["l_orderkey", "l_partkey"]))
    return spark.createDataFrame([(c,) for c in sorted(cols)], "column string")


@query(
    "classify_axes",
    "P8",
    """SELECT * FROM (VALUES ('doc_id', 'state'), ('quality', 'item'), ('toxic', 'item')) t("column", axis)
       WHERE (SELECT bool_and(quality IN (0, 1) AND toxic IN (0, 1)) FROM labels)
       UNION ALL SELECT 'embedding', 'snapshot' UNION ALL SELECT 'label', 'hierarchy'
       UNION ALL SELECT 'vec_id', 'state'""",
)
def _(spark, sf):
    a = p.classify_axes(table(spark, sf, "labels"))
    return a.unionByName(p.classify_axes(table(spark, sf, "embeddings"), {"hierarchy": ["label"]}))


@query(
    "preprocess_columns",
    "P2",
    """WITH m AS (SELECT median(c_acctbal) AS med FROM customer),
       codes AS (SELECT val, row_number() OVER (ORDER BY val) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS val FROM customer)),
       mode_ AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 1)
       SELECT c_custkey, coalesce(nullif(c_acctbal, 1863.84), med) AS c_acctbal,
         coalesce(nullif(customer.c_nationkey, 2), mode_.c_nationkey) AS c_nationkey, code::INTEGER AS c_mktsegment, c_name
       FROM customer, m, mode_ JOIN codes ON val = c_mktsegment""".replace("FROM customer, m, mode_ JOIN codes ON val = c_mktsegment", "FROM customer JOIN codes ON val = c_mktsegment CROSS JOIN m CROSS JOIN mode_"),
)
def _(spark, sf):
    return p.preprocess(
        table(spark, sf, "customer"),
        sentinels={"c_acctbal": 1863.84, "c_nationkey": 2},
        impute={"c_acctbal": "median", "c_nationkey": "mode"},
        exclude=["c_name", "c_custkey"],
    )


@query(
    "clip_and_flag",
    "P3",
    """SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 1 ELSE 0 END AS nation_unknown,
       CASE WHEN c_nationkey = 7 THEN 3 ELSE least(greatest(c_nationkey, 3), 20) END AS c_nationkey FROM customer""",
)
def _(spark, sf):
    return p.clip_and_flag(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 7, 3, 20, "nation_unknown")


@query(
    "item_universe",
    "P5",
    """SELECT 'campaign' AS kind, o_orderkey AS item_id, o_orderpriority AS name, o_orderstatus AS detail FROM orders
       WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) <= DATE '1998-06-01'
         AND (o_orderkey % 10 = 0 OR CAST(o_orderdate AS DATE) + 30 >= DATE '1998-06-01')
       UNION ALL SELECT 'product', p_partkey, p_name, p_type FROM part WHERE p_size <= 25""",
)
def _(spark, sf):
    day = F.to_date("o_orderdate")
    campaigns = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("campaign_id"),
        F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderstatus") == "O", "active").otherwise("paused").alias("status"),
        day.alias("start_date"),
        F.when(F.col("o_orderkey") % 10 != 0, F.date_add(day, 30)).alias("end_date"),
        F.col("o_orderstatus").alias("target_segments"),
    )
    products = table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), (F.col("p_size") <= 25).alias("active")
    )
    return p.item_universe(campaigns, products, "1998-06-01")


@query(
    "recent_error_events",
    "P6",
    "SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' AND event_type IN ('error', 'signup') ORDER BY ts DESC",
)
def _(spark, sf):
    e = p.recent_events(table(spark, sf, "events"), "2024-01-15 12:00:00", "ts", ["error", "signup"])
    return e.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query(
    "customer_audit_trail",
    "P7",
    "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS dt FROM events WHERE user_id = 8 AND strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-03' AND '2024-01-20'",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("dt"))
    return p.customer_audit(e, 8, "2024-01-03", "2024-01-20", "user_id")


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "normaliser_classes",
    "N1",
    """SELECT * FROM (VALUES ('doc_id', 'categorical'), ('prob_x', 'probability'), ('quality', 'binary'), ('score', 'continuous'), ('toxic', 'binary')) t("column", class)
       WHERE (SELECT count(*) FROM labels) > 0""",
)
def _(spark, sf):
    df = table(spark, sf, "labels").withColumn("prob_x", F.col("doc_id") / 7).withColumn("score", F.col("doc_id") * 1.5)
    cls = n.classify_columns(df, df.columns)
    return spark.createDataFrame(sorted(cls.items()), "column string, class string")


@query(
    "column_moments",
    "N2",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurt, round(min({c}), 6) AS min FROM {t}"
        for t, cs in (("lineitem", _LI), ("events", ["value"]))
        for c in cs
    ),
)
def _(spark, sf):
    out = n.moments(table(spark, sf, "lineitem"), _LI).unionByName(n.moments(table(spark, sf, "events"), ["value"]))
    return out.select("column", *[F.round(c, 6).alias(c) for c in ("skew", "kurt", "min")])


@query(
    "power_law_fit",
    "N2",
    """WITH r AS (SELECT ln(value) AS lv, ln(row_number() OVER (ORDER BY value DESC)) AS lr, row_number() OVER (ORDER BY value DESC) AS rk, count(*) OVER () AS n
         FROM events WHERE value > 0)
       SELECT 'value' AS "column", round(corr(lv, lr) ** 2, 6) AS r2 FROM r WHERE rk <= greatest(50, n // 2)""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    return spark.createDataFrame([("value", round(n.loglog_r2(e, "value"), 6))], "column string, r2 double")


@query(
    "normalise_train_only",
    "N3",
    """WITH f AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_samp(l_extendedprice) AS sp
         FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')
       SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_extendedprice - mp) / sp, 6) AS l_extendedprice,
         (CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END)::DOUBLE AS open_flag FROM lineitem CROSS JOIN f""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("open_flag", (F.col("l_linestatus") == "F").cast("int"))
    fit = n.normalize_fit(df, ["l_quantity", "l_extendedprice", "open_flag"], "l_shipdate < TIMESTAMP_NTZ '1999-01-01'")
    out = n.normalize_transform(df, fit, keep=["l_orderkey", "l_linenumber", "l_partkey"])
    return out.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice")})


@query(
    "scale_zscore_minmax_log",
    "N4 N5 N6",
    """WITH f AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, min(c_nationkey) AS a, max(c_nationkey) AS b FROM customer)
       SELECT c_custkey, round(greatest(least((c_acctbal - m) / s, 1.5), -1.5), 6) AS c_acctbal,
         round((c_nationkey - a) / (b - a) * 2 - 1, 6) AS c_nationkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS c_acctbal_log
       FROM customer CROSS JOIN f""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    out = n.log_transform(c, ["c_acctbal"], keep_raw=True)
    out = n.standard_scale(out, n.fit_standard(c, ["c_acctbal"]), 1.5)
    out = n.minmax_scale(out, n.fit_minmax(c, ["c_nationkey"]), -1, 1)
    return out.withColumns({x: F.round(x, 6) for x in ("c_acctbal", "c_nationkey", "c_acctbal_log")})


@query(
    "quantile_uniform",
    "N7",
    """WITH g AS (SELECT quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS q FROM events)
       SELECT event_id, round(CASE WHEN value <= q[1] THEN 0 WHEN value >= q[5] THEN 1
         WHEN value < q[2] THEN 0.25 * (value - q[1]) / (q[2] - q[1]) WHEN value < q[3] THEN 0.25 + 0.25 * (value - q[2]) / (q[3] - q[2])
         WHEN value < q[4] THEN 0.5 + 0.25 * (value - q[3]) / (q[4] - q[3]) ELSE 0.75 + 0.25 * (value - q[4]) / (q[5] - q[4]) END, 6) AS u
       FROM events CROSS JOIN g""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("value").alias("u"))
    return n.quantile_transform(e, n.fit_quantiles(e, ["u"], 5)).withColumn("u", F.round("u", 6))


@query("quantile_normal", "N7")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("value").alias("z"))
    return n.quantile_transform(e, n.fit_quantiles(e, ["z"], 100), normal=True)


@query(
    "null_fill",
    "N8",
    """WITH b AS (SELECT event_id, CASE WHEN value <= 30 THEN value END AS a, CASE WHEN user_id % 3 > 0 THEN user_id END AS u, CASE WHEN event_id % 2 = 0 THEN value END AS k FROM events),
       f AS (SELECT avg(a) AS m, median(k) AS d FROM b), o AS (SELECT u AS mu FROM b WHERE u IS NOT NULL GROUP BY u ORDER BY count(*) DESC, u LIMIT 1)
       SELECT event_id, round(coalesce(a, m), 6) AS a, coalesce(u, mu) AS u, round(coalesce(k, d), 6) AS k FROM b CROSS JOIN f CROSS JOIN o""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("value") <= 30, F.col("value")).alias("a"),
        F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("u"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("k"),
    )
    out = n.null_fill(e, n.fit_null_fill(e, {"a": "mean", "u": "mode", "k": "median"}))
    return out.withColumns({"a": F.round("a", 6), "k": F.round("k", 6)})


@query(
    "label_encode",
    "F-ENC1 W16",
    """WITH m AS (SELECT val, row_number() OVER (ORDER BY val) - 1 AS code FROM (SELECT DISTINCT coalesce(p_brand, 'nan') AS val FROM part WHERE p_size < 20)),
       t AS (SELECT val, row_number() OVER (ORDER BY val) - 1 AS code FROM (SELECT DISTINCT p_type AS val FROM part WHERE p_size < 20))
       SELECT p_partkey, coalesce(m.code, -1)::INTEGER AS p_brand, coalesce(t.code, -1)::INTEGER AS p_type FROM part
       LEFT JOIN m ON m.val = p_brand LEFT JOIN t ON t.val = p_type""",
)
def _(spark, sf):
    return n.label_encode(table(spark, sf, "part"), ["p_brand", "p_type"], "p_size < 20").select("p_partkey", "p_brand", "p_type")


@query(
    "hash_encode",
    "F-ENC2",
    """SELECT c_custkey, (('0x' || md5(c_name))::HUGEINT_ % 1000) AS bin FROM customer""".replace(
        "('0x' || md5(c_name))::HUGEINT_ % 1000",
        "((((((('0x' || substr(md5(c_name), 1, 8))::BIGINT % 1000) * 296 + ('0x' || substr(md5(c_name), 9, 8))::BIGINT) % 1000) * 296 + ('0x' || substr(md5(c_name), 17, 8))::BIGINT) % 1000) * 296 + ('0x' || substr(md5(c_name), 25, 8))::BIGINT) % 1000",
    ),
)
def _(spark, sf):
    return n.hash_encode(table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("bin")), ["bin"], 1000)


@query(
    "code_levels",
    "F-MCC",
    """SELECT p_partkey, CASE WHEN p_size IN (1, 5, 9) THEN 3 WHEN p_size IN (2, 40) THEN 4 WHEN p_size BETWEEN 1 AND 20 THEN 1 WHEN p_size BETWEEN 21 AND 45 THEN 2 ELSE 0 END AS l1 FROM part""",
)
def _(spark, sf):
    lvl = n.code_level("p_size", {3: [1, 5, 9], 4: [2, 40]}, [(1, 20, 1), (21, 45, 2)])
    return table(spark, sf, "part").select("p_partkey", lvl.alias("l1"))


@query(
    "segments",
    "F-SEG",
    """WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
       b AS (SELECT c_custkey, 18 + c_nationkey * 2 AS age, c_acctbal AS income, coalesce(n, 0) AS act FROM customer LEFT JOIN o ON o_custkey = c_custkey),
       i AS (SELECT quantile_cont(income, [0.25, 0.5, 0.75]) AS q FROM b WHERE income > 0), a AS (SELECT quantile_cont(act, [0.25, 0.5, 0.75]) AS q FROM b)
       SELECT c_custkey, CASE WHEN age < 25 THEN 1 WHEN age < 35 THEN 2 WHEN age < 45 THEN 3 WHEN age < 55 THEN 4 WHEN age < 65 THEN 5 ELSE 6 END AS seg_age,
         CASE WHEN income <= 0 OR income < i.q[1] THEN 1 WHEN income < i.q[2] THEN 2 WHEN income < i.q[3] THEN 3 ELSE 4 END AS seg_income,
         CASE WHEN act < a.q[1] THEN 1 WHEN act < a.q[2] THEN 2 WHEN act < a.q[3] THEN 3 ELSE 4 END AS seg_activity
       FROM b CROSS JOIN i CROSS JOIN a""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).count()
    b = table(spark, sf, "customer").join(o, "c_custkey", "left").select(
        "c_custkey", (F.col("c_nationkey") * 2 + 18).alias("age"), F.col("c_acctbal").alias("income"), F.coalesce("count", F.lit(0)).alias("act")
    )
    return n.segment(b, "age", "income", "act").select("c_custkey", "seg_age", "seg_income", "seg_activity")
