"""Queries: joins."""

from pyspark.sql import functions as F

from tallyframe.catalog.registry import TXN, query, table, transactions
from tallyframe.operators import joins as j


@query(
    "join_kinds",
    "J1",
    """WITH s AS (SELECT s_nationkey AS k, count(*) AS ns FROM supplier GROUP BY 1), c AS (SELECT c_nationkey + 3 AS k, count(*) AS nc FROM customer GROUP BY 1)
       SELECT 'inner' AS how, count(*) AS n, sum(ns + nc)::BIGINT AS total FROM s JOIN c USING (k)
       UNION ALL SELECT 'left', count(*), sum(ns + coalesce(nc, 0))::BIGINT FROM s LEFT JOIN c USING (k)
       UNION ALL SELECT 'right', count(*), sum(coalesce(ns, 0) + nc)::BIGINT FROM s RIGHT JOIN c USING (k)
       UNION ALL SELECT 'outer', count(*), sum(coalesce(ns, 0) + coalesce(nc, 0))::BIGINT FROM s FULL JOIN c USING (k)""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("ns"))
    c = table(spark, sf, "customer").groupBy((F.col("c_nationkey") + 3).alias("k")).agg(F.count("*").alias("nc"))
    out = None
    for how in ("inner", "left", "right", "outer"):
        r = s.join(c, "k", how).agg(F.count("*").alias("n"), F.sum(F.coalesce("ns", F.lit(0)) + F.coalesce("nc", F.lit(0))).alias("total"))
        r = r.select(F.lit(how).alias("how"), "n", "total")
        out = r if out is None else out.unionByName(r)
    return out


@query(
    "glue_feature_blocks",
    "J2 DQ8",
    """SELECT c_custkey, c_acctbal, n_orders, total, last_status FROM customer
       LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
       LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1) b ON b.o_custkey = c_custkey""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    a = o.groupBy("c_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    b = j.latest_per_key(o.select("c_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["c_custkey"], ["o_orderdate", "o_orderkey"])
    return j.glue([table(spark, sf, "customer").select("c_custkey", "c_acctbal"), a, b.select("c_custkey", F.col("o_orderstatus").alias("last_status"))], "c_custkey")


@query("unmatched_customers", "J3", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey + 40 * c_nationkey)")
def _(spark, sf):
    """All orders count; a customer's key is moved by its nation, so that many keys have no order."""
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    c = table(spark, sf, "customer").withColumn("key", F.col("c_custkey") + 40 * F.col("c_nationkey"))
    return c.join(m, "key", "left_anti").select("c_custkey", "c_name")


@query(
    "latest_snapshot",
    "J4",
    "SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority")
    return j.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "interval_join",
    "J5",
    f"""WITH {TXN}, w AS (SELECT c_custkey AS user_id, DATE '1997-01-01' + (c_custkey % 365)::INTEGER AS lo, DATE '1997-01-01' + (c_custkey % 365)::INTEGER + 89 AS hi FROM customer)
       SELECT user_id, count(*) AS n, round(sum(amount), 2) AS spend FROM txn JOIN w USING (user_id) WHERE day BETWEEN lo AND hi GROUP BY 1""",
)
def _(spark, sf):
    lo = F.date_add(F.lit("1997-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int"))
    w = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), lo.alias("lo"), F.date_add(lo, 89).alias("hi"))
    hit = j.interval_join(transactions(spark, sf).select("user_id", "day", "amount"), w, "day", "lo", "hi", ["user_id"])
    return hit.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("spend"))


@query(
    "dense_month_panel",
    "J6",
    """WITH f AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS ym, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2), m AS (SELECT unnest(generate_series((SELECT min(ym) FROM f), (SELECT max(ym) FROM f))) AS ym)
       SELECT c_custkey, m.ym::INTEGER AS ym, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM customer CROSS JOIN m LEFT JOIN f ON f.o_custkey = c_custkey AND f.ym = m.ym""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    ym = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    lo, hi = o.agg(F.min(ym), F.max(ym)).first()
    f = o.groupBy(F.col("o_custkey").alias("c_custkey"), ym.alias("ym")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return j.dense_panel(table(spark, sf, "customer"), f, "c_custkey", "ym", F.sequence(F.lit(lo), F.lit(hi)), {"n": 0, "total": 0.0})


@query(
    "dimension_join_counts",
    "J7",
    f"WITH {TXN} SELECT user_id, brand, channel, count(*) AS n, round(sum(amount), 2) AS spend FROM txn GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return transactions(spark, sf, part=True).groupBy("user_id", "brand", "channel").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("spend"))


@query(
    "new_category_flag",
    "J9",
    f"""WITH {TXN}, a AS (SELECT user_id, list(DISTINCT mcc) AS a FROM txn WHERE day < DATE '1998-01-01' GROUP BY 1), b AS (SELECT user_id, list(DISTINCT mcc) AS b FROM txn WHERE day >= DATE '1998-01-01' AND day < DATE '1998-07-01' GROUP BY 1)
       SELECT user_id, CASE WHEN b IS NULL THEN 0 WHEN len(list_filter(b, lambda x: NOT list_contains(coalesce(a, []), x))) > 0 THEN 1 ELSE 0 END AS has_new FROM a FULL JOIN b USING (user_id)""",
)
def _(spark, sf):
    t = transactions(spark, sf, part=True)
    a = t.where("day < DATE '1998-01-01'").groupBy("user_id").agg(F.collect_set("mcc").alias("a"))
    b = t.where("day >= DATE '1998-01-01' AND day < DATE '1998-07-01'").groupBy("user_id").agg(F.collect_set("mcc").alias("b"))
    return a.join(b, "user_id", "full_outer").select("user_id", j.new_elements(F.col("a"), F.col("b")).alias("has_new"))


_FACTS = """facts AS (SELECT o_orderkey AS fact_id, o_custkey AS entity_id, o_orderpriority AS value, o_orderdate AS valid_from,
  lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"""


def _facts(spark, sf):
    from pyspark.sql import Window

    from tallyframe.plans.skew import lookback

    o = table(spark, sf, "orders").withColumns({"_d": -F.unix_micros(F.col("o_orderdate").cast("timestamp")), "_k": -F.col("o_orderkey")})

    def build(f, by):  # newest first, so the next order's date is one row back
        return f.withColumn("nxt", F.lag("o_orderdate").over(Window.partitionBy(*by).orderBy("_d", "_k")))

    o = lookback(o, ["o_custkey"], ["_d", "_k"], 1, build)
    return o.select(
        F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("entity_id"), F.lit("priority").alias("attribute"), F.col("o_orderpriority").alias("value"),
        F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.col("nxt").cast("timestamp").alias("valid_to"),
    )


@query("facts_snapshot", "J10", f"WITH {_FACTS} SELECT fact_id, entity_id, value FROM facts WHERE valid_from <= TIMESTAMP '1998-03-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-03-01')")
def _(spark, sf):
    return j.snapshot_at(_facts(spark, sf), "1998-03-01").select("fact_id", "entity_id", "value")


@query(
    "asof_last_order",
    "J10",
    f"""WITH {TXN}, o AS (SELECT o_custkey AS user_id, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2),
       l AS (SELECT DISTINCT user_id, day FROM txn)
       SELECT l.user_id, CAST(l.day AS VARCHAR) AS day, coalesce(o.o_orderkey, -1) AS o_orderkey, o.o_totalprice FROM l ASOF LEFT JOIN o ON l.user_id = o.user_id AND l.day >= o.o_orderdate""",
)
def _(spark, sf):
    left = transactions(spark, sf).select("user_id", F.col("day").cast("timestamp").alias("at")).distinct()
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderkey", "o_totalprice")
    out = j.asof_join(left, o, ["user_id"], "at", "o_orderdate", ["o_orderkey", "o_totalprice"])
    return out.select("user_id", F.col("at").cast("date").cast("string").alias("day"), F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), "o_totalprice")


@query(
    "fact_timeline_expire",
    "J11",
    f"""WITH {_FACTS} SELECT fact_id, entity_id, value, epoch(valid_from)::BIGINT AS f, coalesce(epoch(CASE WHEN value = '5-LOW' AND valid_to IS NULL THEN TIMESTAMP '2002-01-01' ELSE valid_to END)::BIGINT, -1) AS t FROM facts""",
)
def _(spark, sf):
    facts = _facts(spark, sf)
    out = j.expire(facts, facts.where("value = '5-LOW'"), "2002-01-01")
    out = j.timeline(out, attribute="priority")
    return out.select("fact_id", "entity_id", "value", F.unix_seconds("valid_from").alias("f"), F.coalesce(F.unix_seconds("valid_to"), F.lit(-1)).alias("t"))


def _pool_sql(cols):
    return f"SELECT {', '.join(cols) or '1 AS one'}, s_suppkey, row_number() OVER ({'PARTITION BY ' + ', '.join(cols) if cols else ''} ORDER BY s_suppkey) - 1 AS idx, count(*) OVER ({'PARTITION BY ' + ', '.join(cols) if cols else ''}) AS n FROM pool"


@query(
    "donor_matching",
    "J12 W11",
    f"""WITH pool AS (SELECT s_suppkey, s_nationkey % 5 AS age, (s_acctbal > 5000)::INTEGER AS inc, (s_suppkey % 3)::INTEGER AS act FROM supplier),
       t AS (SELECT c_custkey, c_nationkey % 6 AS age, (c_acctbal > 5000)::INTEGER AS inc, (c_custkey % 4)::INTEGER AS act, ('0x' || substr(md5(c_custkey || ':42'), 1, 8))::BIGINT AS h FROM customer),
       p1 AS ({_pool_sql(['age', 'inc', 'act'])}), p2 AS ({_pool_sql(['age', 'inc'])}), p3 AS ({_pool_sql(['age'])}), p4 AS ({_pool_sql([])}),
       m1 AS (SELECT c_custkey, s_suppkey, 1 AS match_level FROM t JOIN p1 ON t.age = p1.age AND t.inc = p1.inc AND t.act = p1.act AND h % n = idx),
       m2 AS (SELECT c_custkey, s_suppkey, 2 FROM t JOIN p2 ON t.age = p2.age AND t.inc = p2.inc AND h % n = idx WHERE c_custkey NOT IN (SELECT c_custkey FROM m1)),
       m3 AS (SELECT c_custkey, s_suppkey, 3 FROM t JOIN p3 ON t.age = p3.age AND h % n = idx WHERE c_custkey NOT IN (SELECT c_custkey FROM m1 UNION SELECT c_custkey FROM m2)),
       m4 AS (SELECT c_custkey, s_suppkey, 4 FROM t JOIN p4 ON h % n = idx WHERE c_custkey NOT IN (SELECT c_custkey FROM m1 UNION SELECT c_custkey FROM m2 UNION SELECT c_custkey FROM m3))
       SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4""",
)
def _(spark, sf):
    pool = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("age"), (F.col("s_acctbal") > 5000).cast("int").alias("inc"), (F.col("s_suppkey") % 3).cast("int").alias("act"))
    t = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 6).alias("age"), (F.col("c_acctbal") > 5000).cast("int").alias("inc"), (F.col("c_custkey") % 4).cast("int").alias("act"))
    return j.match_donors(t, pool, "c_custkey", "s_suppkey", [["age", "inc", "act"], ["age", "inc"], ["age"], []])


BANDS = [(0.0, 2000.0, "low"), (2000.0, 5000.0, "middle"), (5000.0, 8000.0, "high")]


@query("band_lookup", "J13", "SELECT c_custkey, CASE WHEN c_acctbal < 2000 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS band FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", j.band_lookup("c_acctbal", BANDS).alias("band"))


PREFIXES = [("small ", "stock", "size", "goods"), ("red", "paint", "colour", "goods"), ("re", "other", "misc", "rest"), ("blue b", "paint", "colour", "goods")]
_LINEAGE = """traced AS (SELECT p_partkey, p_name AS feature, CASE WHEN p_name LIKE 'small %' THEN 'small ' WHEN p_name LIKE 'red%' THEN 'red' WHEN p_name LIKE 're%' THEN 're' WHEN p_name LIKE 'blue b%' THEN 'blue b' END AS matched_prefix FROM part)"""


@query(
    "prefix_lineage",
    "J14",
    f"""WITH {_LINEAGE} SELECT p_partkey, feature, matched_prefix, CASE matched_prefix WHEN 'small ' THEN 'stock' WHEN 'red' THEN 'paint' WHEN 're' THEN 'other' WHEN 'blue b' THEN 'paint' END AS source_table,
       CASE WHEN matched_prefix IS NULL THEN 'unmapped' ELSE 'mapped' END AS status FROM traced""",
)
def _(spark, sf):
    f = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("feature"))
    return j.trace_lineage(f, PREFIXES).drop("source_column", "data_group")


_NAMES = "n AS (SELECT p_partkey, p_brand || '_' || p_name || '_' || p_partkey AS feature, p_brand AS source_table FROM part), m AS (SELECT left(feature, 3 + p_partkey % 12) AS prefix, p_partkey AS ord, source_table FROM n WHERE source_table <> 'Brand#11')"


@query(
    "lineage_prefix_table",
    "J14",
    f"""WITH {_NAMES}, h AS (SELECT n.p_partkey, min_by(prefix, ord) AS first_prefix, arg_max(prefix, length(prefix)) AS longest_prefix, min_by(m.source_table, ord) AS source_table FROM n JOIN m ON starts_with(n.feature, m.prefix) GROUP BY 1)
        SELECT p_partkey, first_prefix, h.source_table, longest_prefix, CASE WHEN first_prefix IS NULL THEN 'unmapped' ELSE 'mapped' END AS status FROM n LEFT JOIN h USING (p_partkey)""",
)
def _(spark, sf):
    """A map of prefixes as a table: the first in map order, and the longest."""
    part = table(spark, sf, "part")
    n = part.select("p_partkey", F.concat_ws("_", "p_brand", "p_name", F.col("p_partkey").cast("string")).alias("feature"), F.col("p_brand").alias("source_table"))
    cut = F.expr("left(feature, CAST(3 + p_partkey % 12 AS INT))").alias("prefix")
    m = n.where("source_table <> 'Brand#11'").select(cut, F.col("p_partkey").alias("ord"), "source_table")
    first = j.trace_prefixes(n.drop("source_table"), m, ["source_table"]).withColumnRenamed("matched_prefix", "first_prefix")
    out = j.trace_prefixes(first.withColumnRenamed("status", "s"), m, [], order=None)
    return out.select("p_partkey", "first_prefix", "source_table", F.col("matched_prefix").alias("longest_prefix"), F.col("s").alias("status"))


@query("lineage_coverage", "J14", f"WITH {_LINEAGE} SELECT count(*) AS total, count(matched_prefix) AS mapped, round(count(matched_prefix) / count(*), 4) AS coverage FROM traced")
def _(spark, sf):
    return j.lineage_coverage(j.trace_lineage(table(spark, sf, "part").select(F.col("p_name").alias("feature")), PREFIXES))


@query("feature_lookup", "J15", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def _(spark, sf):
    users = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return j.lookup(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), users, "c_custkey")


@query(
    "cascade_lookup",
    "J16",
    """WITH l3 AS (SELECT p_brand, p_type, 'bt:' || p_brand || p_type AS text FROM part WHERE p_size = 7 GROUP BY ALL), l2 AS (SELECT p_brand, 'b:' || p_brand AS text FROM part WHERE p_size = 50 AND p_retailprice > 950 GROUP BY ALL), l1 AS (SELECT p_type, 't:' || p_type AS text FROM part WHERE p_type <> 'SMALL' GROUP BY ALL)
       SELECT p_partkey, coalesce(l3.text, l2.text, l1.text, 'none') AS text, CASE WHEN l3.text IS NOT NULL THEN 'exact' WHEN l2.text IS NOT NULL THEN 'brand' WHEN l1.text IS NOT NULL THEN 'type' ELSE 'fallback' END AS level
       FROM part LEFT JOIN l3 USING (p_brand, p_type) LEFT JOIN l2 USING (p_brand) LEFT JOIN l1 USING (p_type)""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    l3 = p.where("p_size = 7").select("p_brand", "p_type", F.concat(F.lit("bt:"), "p_brand", "p_type").alias("text")).distinct()
    l2 = p.where("p_size = 50 AND p_retailprice > 950").select("p_brand", F.concat(F.lit("b:"), "p_brand").alias("text")).distinct()
    l1 = p.where("p_type <> 'SMALL'").select("p_type", F.concat(F.lit("t:"), "p_type").alias("text")).distinct()
    out = j.cascade_lookup(p.select("p_partkey", "p_brand", "p_type"), [("exact", ["p_brand", "p_type"], l3), ("brand", ["p_brand"], l2), ("type", ["p_type"], l1)], "text", "none")
    return out.select("p_partkey", "text", "level")


@query(
    "customer_context",
    "J17",
    """WITH c AS (SELECT c_custkey, c_custkey AS p_partkey, c_mktsegment FROM customer),
       l AS (SELECT o_custkey, string_agg(o_orderkey || '/' || o_orderpriority, ';' ORDER BY o_orderdate DESC, o_orderkey DESC) AS consultations, count(*) AS n
             FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3) GROUP BY 1)
       SELECT c_custkey, p_name, p_brand, c_mktsegment AS segment, coalesce(consultations, '') AS consultations, coalesce(n, 0)::INTEGER AS n_consultations
       FROM c LEFT JOIN part USING (p_partkey) LEFT JOIN l ON o_custkey = c_custkey""",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    out = j.assemble_context(
        c.select("c_custkey", F.col("c_custkey").alias("p_partkey")),
        table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"),
        table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"),
        c.select("c_custkey", F.col("c_mktsegment").alias("segment")),
        "c_custkey", "p_partkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderpriority"],
    )
    text = F.array_join(F.transform("consultations", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit("/"), x["o_orderpriority"])), ";")
    return out.select("c_custkey", "p_name", "p_brand", "segment", F.coalesce(text, F.lit("")).alias("consultations"), "n_consultations")
