"""Queries: sources and sinks."""

import uuid

from pyspark.sql import functions as F

from tallyframe.catalog.registry import query, table
from tallyframe.plans.session import shared_dir, written
from tallyframe.sources import tables as t
from tallyframe.sources import versions as v


def _fresh(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "read_parquet_columns",
    "S1",
    """SELECT l_orderkey, l_extendedprice FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 25""",
)
def _(spark, sf):
    return t.read_parquet(
        spark,
        f"{sf}/lineitem.parquet",
        ["l_orderkey", "l_extendedprice"],
        "l_shipdate >= TIMESTAMP_NTZ '1998-01-01' AND l_quantity > 25",
    )


@query("csv_round_trip", "S2 S4", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    src = table(spark, sf, "customer")
    path = _fresh(spark, "csv")
    src.write.option("header", True).csv(path)
    return t.read_csv(spark, path, src.schema)


@query(
    "csv_money_to_typed",
    "S3",
    """SELECT s_suppkey, s_name, s_acctbal AS balance, round(s_acctbal / 10000, 6) AS share,
              CAST(CAST(TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey AS INTEGER) % 300) AS DATE) AS VARCHAR) AS opened,
              CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 0 END AS active
       FROM supplier""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier")
    cents = F.format_number(F.abs("s_acctbal"), 2)
    raw = s.select(
        "s_suppkey",
        "s_name",
        F.concat(F.when(F.col("s_acctbal") < 0, "-").otherwise(""), F.lit("$"), cents).alias("balance"),
        F.concat(F.format_number(F.col("s_acctbal") / 100, 4), F.lit("%")).alias("share"),
        F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), F.pmod("s_suppkey", F.lit(300)).cast("int")), "yyyy/MM/dd").alias("opened"),
        F.when(F.col("s_nationkey") % 2 == 0, "YES").otherwise("No").alias("active"),
    )
    path = _fresh(spark, "rawcsv")
    raw.write.option("header", True).csv(path)
    back = t.read_csv(spark, path, "s_suppkey string, s_name string, balance string, share string, opened string, active string")
    back = back.withColumn("share", F.regexp_replace("share", ",", ""))
    typed = t.to_typed(
        back,
        {"s_suppkey": "bigint", "balance": "money", "share": "percent", "opened": t.Cast("date", "yyyy/MM/dd"), "active": "flag"},
    )
    return typed.withColumn("share", F.round("share", 6)).withColumn("opened", F.col("opened").cast("string"))


@query(
    "partitioned_audit_append",
    "S4 S5",
    """SELECT event_id, user_id, value, strftime(ts, '%Y-%m-%d') AS dt FROM events
       WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-12'""",
)
def _(spark, sf):
    path = _fresh(spark, "audit")
    e = table(spark, sf, "events").select("event_id", "user_id", "value", "ts")
    t.append_partitioned(e.where("event_type <> 'error'"), path, "ts")
    t.append_partitioned(e.join(table(spark, sf, "events").where("event_type = 'error'").select("event_id"), "event_id", "left_semi"), path, "ts")
    back = spark.read.schema("event_id long, user_id long, value double, dt string").parquet(path)
    return back.where("dt BETWEEN '2024-01-05' AND '2024-01-12'")


@query(
    "metric_archive_append_read",
    "S6",
    "SELECT event_type AS feature, count(*) AS n, round(avg(value), 6) AS psi FROM events GROUP BY 1",
)
def _(spark, sf):
    path = _fresh(spark, "metrics")
    schema = "feature string, n long, psi double"
    assert t.read_rows(spark, path, schema).isEmpty()
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("feature")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("psi"))
    t.append_rows(rows, path)
    return t.read_rows(spark, path, schema)


@query(
    "sql_views_parameterised",
    "S7",
    """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders JOIN customer
       ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000 GROUP BY 1""",
)
def _(spark, sf):
    t.register_views(spark, {"v_orders": f"{sf}/orders.parquet", "v_customer": f"{sf}/customer.parquet", "v_absent": f"{sf}/absent.parquet"})
    return spark.sql(
        """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 4) AS total
           FROM v_orders JOIN v_customer ON o_custkey = c_custkey
           WHERE c_mktsegment = :segment AND o_totalprice > :floor GROUP BY o_orderpriority""",
        args={"segment": "BUILDING", "floor": 100000},
    )


@query("stage_checkpoint_resume", "S8", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1")
def _(spark, sf):
    folder = _fresh(spark, "stages")
    agg = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))
    t.checkpoint(agg, folder, "totals")
    return t.checkpoint(agg, folder, "totals")


@query(
    "sentinels_to_null",
    "S9",
    """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
       CASE WHEN c_nationkey >= 0 THEN c_nationkey END AS c_nationkey, c_mktsegment FROM customer""",
)
def _(spark, sf):
    return t.null_sentinels(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"), 0, exclude=["c_custkey"])


def _stats_sql(tbl, cols, numeric, where="TRUE"):
    parts = []
    for c in cols:
        num = f"round(coalesce(avg({c}), 0), 6) AS mean, round(coalesce(stddev_samp({c}), 0), 6) AS std" if c in numeric else "0.0::DOUBLE AS mean, 0.0::DOUBLE AS std"
        parts.append(f"SELECT '{c}' AS \"column\", count(*) AS row_count, {num}, round(100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS null_pct FROM {tbl} WHERE {where}")
    return " UNION ALL ".join(parts)


_CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]


@query("version_profile", "S10", f"SELECT *, 'v1' AS version, 5 AS column_count FROM ({_stats_sql('customer', _CUST, _NUM)})")
def _(spark, sf):
    return v.profile_version(table(spark, sf, "customer"), "v1").drop("schema_hash")


_A = _stats_sql("customer", _CUST, _NUM, "c_nationkey < 12")
_B = _stats_sql("customer", _CUST[:4], _NUM, "c_nationkey >= 8")


@query(
    "version_diff",
    "S11",
    f"""WITH a AS ({_A}), b AS ({_B} UNION ALL SELECT 'extra', count(*), round(avg(c_acctbal * 2), 6), round(stddev_samp(c_acctbal * 2), 6), 0 FROM customer WHERE c_nationkey >= 8)
    SELECT coalesce(a."column", b."column") AS "column",
      CASE WHEN a."column" IS NULL THEN 'added' WHEN b."column" IS NULL THEN 'removed' ELSE 'shared' END AS status,
      round(b.mean - a.mean, 6) AS mean_delta, round(b.std - a.std, 6) AS std_delta, round(b.null_pct - a.null_pct, 6) AS null_pct_delta,
      (SELECT max(row_count) FROM b) - (SELECT max(row_count) FROM a) AS row_count_delta, 0 AS column_count_delta, 1 AS schema_changed
    FROM a FULL JOIN b ON a."column" = b."column" """,
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    a = v.profile_version(c.where("c_nationkey < 12"), "v1")
    b = v.profile_version(c.where("c_nationkey >= 8").drop("c_mktsegment").withColumn("extra", F.col("c_acctbal") * 2), "v2")
    return v.diff_versions(a, b)


@query(
    "version_states",
    "S10 S11",
    f"""WITH a AS ({_stats_sql('customer', _CUST, _NUM, 'c_nationkey < 12')}), b AS ({_stats_sql('customer', _CUST, _NUM)})
    SELECT "column", b.row_count, b.mean, b.std, b.null_pct, 0 AS read_again, b.row_count - a.row_count AS row_count_delta, round(b.mean - a.mean, 6) AS mean_delta FROM a JOIN b USING ("column")""",
)
def _(spark, sf):
    """States of the first version are kept; the second version, with more partitions, is read in these alone."""
    home = _fresh(spark, "versions")
    c = table(spark, sf, "customer").withColumn("region", F.floor(F.col("c_nationkey") / 4).cast("int"))
    c.where("c_nationkey < 12").write.partitionBy("region").parquet(home)
    first = written(v.refresh_states(spark.read.parquet(home), "region", _CUST))
    c.where("c_nationkey >= 12").write.partitionBy("region").mode("append").parquet(home)
    data = spark.read.parquet(home)
    second = written(v.refresh_states(data, "region", _CUST, first))
    again = second.join(first.select("region", "column", F.col("files").alias("before")), ["region", "column"]).where("files <> before").groupBy("column").agg(F.count(F.lit(1)).alias("read_again"))
    a, b = (v.profile_states(s, data, n) for s, n in ((first, "v1"), (second, "v2")))
    out = b.join(again, "column", "left").join(v.diff_versions(a, b).select("column", "row_count_delta", "mean_delta"), "column")
    return out.select("column", "row_count", "mean", "std", "null_pct", F.coalesce("read_again", F.lit(0)).cast("int").alias("read_again"), "row_count_delta", "mean_delta")


@query(
    "attach_embeddings",
    "S13",
    """SELECT doc_id, round(list_sum(list_transform(coalesce(embedding, []), lambda x: abs(x::DOUBLE))), 4) AS l1, (CASE WHEN embedding IS NULL THEN 64 ELSE len(embedding) END)::INTEGER AS dim
       FROM documents LEFT JOIN embeddings ON doc_id = vec_id""".replace("round(list_sum", "coalesce(round(list_sum").replace(", 4) AS l1", ", 4), 0) AS l1"),
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"))
    out = t.attach_embeddings(docs, table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", 64)
    l1 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x))
    return out.select(F.col("vec_id").alias("doc_id"), F.round(l1, 4).alias("l1"), F.size("embedding").alias("dim"))
