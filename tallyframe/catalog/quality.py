"""Queries: splits, leakage, contracts, value checks and drift."""

from pyspark.sql import functions as F

from tallyframe.catalog.aggs import rounded
from tallyframe.catalog.registry import PRED, TXN, predictions, query, table, transactions, unit
from tallyframe.catalog.sequences import HIST, history
from tallyframe.operators import drift as d
from tallyframe.operators import quality as q
from tallyframe.operators import splits as sp
from tallyframe.sources.tables import SourceSpec


def day(df, col):
    return df.withColumn(col, F.col(col).cast("string"))


_T1 = """b AS (SELECT min(o_orderdate::DATE) AS lo, date_diff('day', min(o_orderdate::DATE), max(o_orderdate::DATE)) AS span FROM orders),
  c AS (SELECT lo + floor(span * 0.7)::INTEGER AS te, lo + floor(span * 0.7)::INTEGER + 7 AS vs, lo + floor(span * 0.7)::INTEGER + 7 + floor(span * 0.15)::INTEGER AS ve FROM b),
  s AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE WHEN o_orderdate::DATE <= te THEN 'train' WHEN o_orderdate::DATE BETWEEN vs AND ve THEN 'val' WHEN o_orderdate::DATE >= ve + 7 THEN 'test' END AS _split FROM orders CROSS JOIN c)"""


@query("temporal_split", "T1", f"WITH {_T1} SELECT o_orderkey, coalesce(_split, 'gap') AS _split FROM s")
def _(spark, sf):
    out = sp.temporal_split(table(spark, sf, "orders"), "o_orderdate")
    return out.select("o_orderkey", F.coalesce("_split", F.lit("gap")).alias("_split"))


@query(
    "quantile_split",
    "T2",
    """WITH c AS (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.7) AS a, quantile_cont(epoch_us(ts)::DOUBLE, 0.85) AS b FROM events), n AS (SELECT quantile_cont(value, 0.7) AS a, quantile_cont(value, 0.85) AS b FROM events)
       SELECT event_id, CASE WHEN epoch_us(ts) < c.a - 86400000000 THEN 'train' WHEN epoch_us(ts) < c.b - 86400000000 AND epoch_us(ts) >= c.a THEN 'val' WHEN epoch_us(ts) >= c.b THEN 'test' ELSE 'gap' END AS by_time,
         CASE WHEN value < n.a THEN 'train' WHEN value < n.b THEN 'val' ELSE 'test' END AS by_value FROM events CROSS JOIN c CROSS JOIN n""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    out = sp.quantile_split(e, "ts", gap=1, name="by_time")
    out = sp.quantile_split(out, "value", name="by_value")
    return out.select("event_id", F.coalesce("by_time", F.lit("gap")).alias("by_time"), "by_value")


@query("hash_split", "T3", f"SELECT c_custkey, CASE WHEN {unit('c_custkey || chr(58) || 42')} < 0.8 THEN 'train' WHEN {unit('c_custkey || chr(58) || 42')} < 0.9 THEN 'val' ELSE 'test' END AS _split FROM customer")
def _(spark, sf):
    return sp.hash_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query(
    "task_validation_masks",
    "T4",
    f"""WITH c AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE, 0.9) AS cut FROM orders)
        SELECT o_orderkey, {unit("o_orderkey || ':42'")} < 0.1 AS val_churn, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) >= cut AS val_nba FROM orders CROSS JOIN c""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return sp.task_val_mask(o, {"churn": "random", "nba": "latest"}, "o_orderkey", "o_orderdate").drop("o_orderdate")


_LF, _LY = ["l_quantity", "l_extendedprice", "l_discount", "dup"], ["y_price", "y_tax"]
_LC = "WITH b AS (SELECT *, l_extendedprice * 2 + 1 AS dup, l_extendedprice AS y_price, l_tax AS y_tax FROM lineitem) "


@query(
    "leakage_correlation",
    "T5",
    _LC + " UNION ALL ".join(f"SELECT '{f}' AS feature, '{y}' AS label, round(corr({f}, {y}), 6) AS corr, count(*) AS n, CASE WHEN abs(corr({f}, {y})) >= 0.95 THEN 1 ELSE 0 END AS leak FROM b" for y in _LY for f in _LF),
)
def _(spark, sf):
    x = F.col("l_extendedprice")
    b = table(spark, sf, "lineitem").withColumns({"dup": x * 2 + 1, "y_price": x, "y_tax": F.col("l_tax")})
    return rounded(sp.leakage_corr(b, _LF, _LY), "corr")


_GAPS = "WITH b AS (SELECT CASE WHEN l_linenumber <> 2 THEN l_quantity END AS f1, CASE WHEN l_returnflag <> 'A' THEN l_extendedprice + 1e6 END AS f2, l_discount AS f3, 7.0::DOUBLE AS f4, CASE WHEN l_linestatus = 'O' THEN l_extendedprice END AS y1, CASE WHEN l_linenumber > 1 THEN l_quantity * l_discount END AS y2 FROM lineitem) "


@query(
    "leakage_correlation_gaps",
    "T5",
    _GAPS + " UNION ALL ".join(f"SELECT '{f}' AS feature, '{y}' AS label, {'NULL::DOUBLE' if f == 'f4' else f'round(corr({f}, {y}), 6)'} AS corr, count(*) FILTER ({f} IS NOT NULL AND {y} IS NOT NULL) AS n, {0 if f == 'f4' else f'CASE WHEN abs(corr({f}, {y})) >= 0.95 THEN 1 ELSE 0 END'} AS leak FROM b" for y in ("y1", "y2") for f in ("f1", "f2", "f3", "f4")),
)
def _(spark, sf):
    """Columns with gaps of their own, a shifted copy of a label and a constant."""
    q, price, disc, line = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber"))
    cols = {
        "f1": F.when(line != 2, q), "f2": F.when(F.col("l_returnflag") != "A", price + 1e6), "f3": disc, "f4": F.lit(7.0),
        "y1": F.when(F.col("l_linestatus") == "O", price), "y2": F.when(line > 1, q * disc),
    }
    return rounded(sp.leakage_corr(table(spark, sf, "lineitem").withColumns(cols), ["f1", "f2", "f3", "f4"], ["y1", "y2"]), "corr")


@query("leakage_sequence_length", "T6", f"WITH {HIST} SELECT 'codes' AS \"column\", max(len(codes))::INTEGER AS max_len, CASE WHEN max(len(codes)) > 16 THEN 1 ELSE 0 END AS leak FROM h")
def _(spark, sf):
    return sp.leakage_seq_len(history(spark, sf), ["codes"])


@query(
    "leakage_snapshot",
    "T7",
    f"""WITH {HIST}, s AS (SELECT codes, codes[-1] AS last_, CASE WHEN user_id % 2 = 0 THEN codes[-2] ELSE codes[1] END AS other FROM h)
        SELECT 'last_' AS "column", count(*) FILTER (len(codes) >= 2) AS n, round(avg((last_ = codes[-1])::INTEGER) FILTER (len(codes) >= 2), 6) AS match_last, round(avg((last_ = codes[-2])::INTEGER) FILTER (len(codes) >= 2), 6) AS match_prev, 1 AS leak FROM s
        UNION ALL SELECT 'other', count(*) FILTER (len(codes) >= 2 AND other IS NOT NULL), round(avg((other = codes[-1])::INTEGER) FILTER (len(codes) >= 2), 6), round(avg((other = codes[-2])::INTEGER) FILTER (len(codes) >= 2), 6), 0 FROM s""",
)
def _(spark, sf):
    h = history(spark, sf)
    n = F.size("codes")
    h = h.withColumns({"last_": F.get("codes", n - 1), "other": F.when(F.col("user_id") % 2 == 0, F.get("codes", n - 2)).otherwise(F.get("codes", F.lit(0)))})
    return rounded(sp.leakage_snapshot(h, {"last_": "codes", "other": "codes"}), "match_last", "match_prev")


@query(
    "split_integrity",
    "T8",
    f"""WITH {_T1}, e AS (SELECT max(d) FILTER (_split = 'train') AS train_max, min(d) FILTER (_split = 'val') AS val_min, max(d) FILTER (_split = 'val') AS val_max, min(d) FILTER (_split = 'test') AS test_min FROM s)
        SELECT CAST(train_max AS VARCHAR) AS train_max, CAST(val_min AS VARCHAR) AS val_min, CAST(val_max AS VARCHAR) AS val_max, CAST(test_min AS VARCHAR) AS test_min, (train_max >= val_min)::INTEGER AS overlap_train_val, (val_max >= test_min)::INTEGER AS overlap_val_test FROM e""",
)
def _(spark, sf):
    out = sp.split_integrity(sp.temporal_split(table(spark, sf, "orders"), "o_orderdate"), "o_orderdate")
    for c in ("train_max", "val_min", "val_max", "test_min"):
        out = day(out, c)
    return out


SPEC = SourceSpec(
    "customer",
    {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "double", "c_acctbal": "string", "c_segment": "string"},
    required=["c_custkey"],
    nullable=["c_segment"],
    rows=(1, 10),
)


@query(
    "source_contract",
    "DQ1",
    """SELECT 'contract_missing' AS "check", 'c_segment' AS "column", 'FAIL' AS status, 0 AS value WHERE (SELECT count(*) FROM customer) > 10
       UNION ALL SELECT 'contract_new', 'c_mktsegment', 'WARN', 0 UNION ALL SELECT 'contract_type', 'c_acctbal', 'FAIL', 0
       UNION ALL SELECT 'contract_rows', 'all', 'WARN', count(*) FROM customer""",
)
def _(spark, sf):
    out = q.check_contract(table(spark, sf, "customer"), SPEC)
    return out.select("check", F.coalesce("column", F.lit("all")).alias("column"), "status", F.coalesce("value", F.lit(0.0)).cast("long").alias("value"))


@query(
    "schema_check",
    "DQ2",
    """SELECT 'schema_extra_columns' AS "check", 'c_mktsegment' AS "column", 'WARN' AS status WHERE (SELECT count(c_mktsegment) FROM customer) > 0 UNION ALL SELECT 'schema_columns', 'c_zip', 'FAIL' UNION ALL SELECT 'schema_type', 'c_name', 'WARN'""",
)
def _(spark, sf):
    spec = SourceSpec("customer", {"c_custkey": "bigint", "c_name": "double", "c_nationkey": "int", "c_acctbal": "double", "c_zip": "string"})
    return q.check_schema(table(spark, sf, "customer"), spec).select("check", "column", "status")


_NULLED = "n AS (SELECT event_id, CASE WHEN value > 2 THEN value END AS value, CASE WHEN user_id % 10 > 6 THEN user_id END AS user_id FROM events)"


def nulled(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(F.col("value") > 2, F.col("value")).alias("value"), F.when(F.col("user_id") % 10 > 6, F.col("user_id")).alias("user_id"))


@query(
    "null_ratios",
    "DQ3",
    f"""WITH {_NULLED}, r AS (SELECT 'event_id' AS "column", avg((event_id IS NULL)::INTEGER) AS v, 0.0 AS t FROM n UNION ALL SELECT 'value', avg((value IS NULL)::INTEGER), 0.0 FROM n UNION ALL SELECT 'user_id', avg((user_id IS NULL)::INTEGER), 0.5 FROM n)
        SELECT 'null_ratio' AS "check", "column", CASE WHEN v <= t THEN 'PASS' WHEN t = 0 THEN 'FAIL' ELSE 'WARN' END AS status, round(v, 6) AS value, t::DOUBLE AS threshold FROM r""",
)
def _(spark, sf):
    return rounded(q.check_nulls(nulled(spark, sf), ["event_id", "value"]), "value")


@query(
    "value_ranges",
    "DQ4",
    """SELECT 'value_range_min' AS "check", 'l_quantity' AS "column", CASE WHEN min(l_quantity) < 5 THEN 'FAIL' ELSE 'PASS' END AS status, min(l_quantity) AS value, 5::DOUBLE AS threshold FROM lineitem
       UNION ALL SELECT 'value_range_max', 'l_discount', CASE WHEN max(l_discount) > 0.5 THEN 'FAIL' ELSE 'PASS' END, max(l_discount), 0.5 FROM lineitem
       UNION ALL SELECT 'value_range_allowed', 'l_returnflag', CASE WHEN count(*) FILTER (l_returnflag NOT IN ('A', 'N')) > 0 THEN 'FAIL' ELSE 'PASS' END, (count(*) FILTER (l_returnflag NOT IN ('A', 'N')))::DOUBLE, 0 FROM lineitem""",
)
def _(spark, sf):
    return q.check_ranges(table(spark, sf, "lineitem"), {"l_quantity": (5, None), "l_discount": (None, 0.5)}, {"l_returnflag": ["A", "N"]})


def _pii_sql(tbl, cols, all_cols):
    parts = []
    for c in cols:
        for name, (rx, m) in q.PII_PATTERNS.items():
            rx = rx.replace("'", "''")
            parts.append(f"SELECT '{c}' AS \"column\", '{name}' AS pattern, round(avg(regexp_matches({c}, '{rx}')::INTEGER), 6) AS match_ratio, (avg(regexp_matches({c}, '{rx}')::INTEGER) >= {m})::INTEGER AS detected FROM {tbl}")
    parts += [f"SELECT '{c}', 'column_name', 1, 1" for c in all_cols]
    return " UNION ALL ".join(parts)


@query("pii_scan", "DQ5", _pii_sql("documents", ["text", "lang", "source"], []))
def _(spark, sf):
    return rounded(q.scan_pii(table(spark, sf, "documents")), "match_ratio")


@query("pii_scan_names", "DQ5", _pii_sql("customer", ["c_name", "c_mktsegment"], ["c_name"]))
def _(spark, sf):
    return rounded(q.scan_pii(table(spark, sf, "customer")), "match_ratio")


@query("degenerate_columns", "DQ6", "SELECT 'zero' AS \"column\", 'all_zero' AS kind WHERE (SELECT count(*) FROM part) > 0 UNION ALL SELECT 'fixed', 'constant' UNION ALL SELECT 'missing', 'constant'")
def _(spark, sf):
    p = table(spark, sf, "part").withColumns({"zero": F.lit(0), "fixed": F.lit("x"), "missing": F.lit(None).cast("double"), "half": F.when(F.col("p_size") > 25, 1)})
    return q.degenerate_columns(p)


@query("duplicate_keys", "DQ8", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    from tallyframe.operators.joins import duplicate_keys

    return duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _edges(col, expr):
    """bins of `col` by the sorted list `expr` of inner edges: number of edges <= value."""
    return f"len(list_filter({expr}, lambda e: e <= {col}))"


_REF = "ref AS (SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01'), cur AS (SELECT l_quantity, l_extendedprice * 1.1 AS l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01')"


def ref_cur(spark, sf):
    li = table(spark, sf, "lineitem")
    old = F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz")
    ref = li.where(old).select("l_quantity", "l_extendedprice")
    return ref, li.where(~old).select("l_quantity", (F.col("l_extendedprice") * 1.1).alias("l_extendedprice"))


def _psi_sql(cols, inner, share):
    parts = []
    for c in cols:
        parts.append(
            f"""SELECT '{c}' AS feature, round(sum(({share('coalesce(k, 0)', 'cn')} - {share('coalesce(r, 0)', 'rn')}) * ln({share('coalesce(k, 0)', 'cn')} / {share('coalesce(r, 0)', 'rn')})), 6) AS psi FROM
            (SELECT {_edges(c, inner(c))} AS b, count(*) AS r FROM ref GROUP BY 1) x FULL JOIN (SELECT {_edges(c, inner(c))} AS b, count(*) AS k FROM cur GROUP BY 1) y ON x.b = y.b
            CROSS JOIN (SELECT (SELECT count(*) FROM ref) AS rn, (SELECT count(*) FROM cur) AS cn)"""
        )
    return " UNION ALL ".join(parts)


@query(
    "psi_quantile_bins",
    "M1",
    f"WITH {_REF} " + _psi_sql(["l_quantity", "l_extendedprice"], lambda c: f"(SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) FROM ref)", lambda k, n: f"({k} / {n} + 1e-6)"),
)
def _(spark, sf):
    return rounded(d.psi_quantile(*ref_cur(spark, sf), ["l_quantity", "l_extendedprice"]), "psi")


def _width(c):
    lo, hi = f"(SELECT least((SELECT min({c}) FROM ref), (SELECT min({c}) FROM cur)))", f"(SELECT greatest((SELECT max({c}) FROM ref), (SELECT max({c}) FROM cur)))"
    return f"[{', '.join(f'{lo} + ({hi} - {lo}) * {i} / 10' for i in range(1, 10))}]"


_WIDTH = f"WITH {_REF} " + _psi_sql(["l_quantity", "l_extendedprice"], _width, lambda k, n: f"greatest({k} / {n}, 1e-4)")


@query("psi_equal_width", "M2", _WIDTH)
def _(spark, sf):
    return rounded(d.psi_width(*ref_cur(spark, sf), ["l_quantity", "l_extendedprice"]), "psi")


@query(
    "psi_unit_interval",
    "M3",
    f"WITH {PRED}, ref AS (SELECT s1 AS s FROM pred WHERE version = 'v1'), cur AS (SELECT s2 AS s FROM pred WHERE version = 'v2') "
    + _psi_sql(["s"], lambda c: "[1 / 10, 2 / 10, 3 / 10, 4 / 10, 5 / 10, 6 / 10, 7 / 10, 8 / 10, 9 / 10]", lambda k, n: f"greatest({k} / {n}, 1e-7)"),
)
def _(spark, sf):
    p = predictions(spark, sf)
    return rounded(d.psi_unit(p.where("version = 'v1'").select(F.col("s1").alias("s")), p.where("version = 'v2'").select(F.col("s2").alias("s")), ["s"]), "psi")


@query(
    "drift_report",
    "M4",
    f"SELECT feature, psi, CASE WHEN psi >= 0.25 THEN 'critical' WHEN psi >= 0.1 THEN 'warning' ELSE 'normal' END AS severity FROM ({_WIDTH})",
)
def _(spark, sf):
    return rounded(d.drift_report(d.psi_width(*ref_cur(spark, sf), ["l_quantity", "l_extendedprice"])), "psi")


@query(
    "drift_summary",
    "M4",
    f"""SELECT count(*) AS total_features, count(*) FILTER (psi >= 0.1 AND psi < 0.25) AS warning_count, count(*) FILTER (psi >= 0.25) AS critical_count, max(psi) AS max_psi, round(avg(psi), 5) AS avg_psi, (max(psi) >= 0.1)::INTEGER AS drift_detected FROM ({_WIDTH})""",
)
def _(spark, sf):
    out = d.drift_summary(d.drift_report(d.psi_width(*ref_cur(spark, sf), ["l_quantity", "l_extendedprice"])))
    return rounded(rounded(out, "max_psi"), "avg_psi", digits=5)


_P5 = f"""WITH {PRED}, ref AS (SELECT s1 AS s FROM pred), cur AS (SELECT s2 AS s FROM pred), c AS (SELECT least(greatest(s1, 1e-10), 1 - 1e-10) AS p, least(greatest(s2, 1e-10), 1 - 1e-10) AS q, y, s1, s2 FROM pred),
  m AS (SELECT *, (p + q) / 2 AS m FROM c), rk AS (SELECT y, rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / 2 AS r1, rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / 2 AS r2 FROM pred),
  a AS (SELECT corr(r1, r2) AS rho, abs((sum(r2) FILTER (y = 1) - sum(r1) FILTER (y = 1)) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))) AS auc_shift FROM rk),
  x AS ({_psi_sql(["s"], lambda c: "[1 / 10, 2 / 10, 3 / 10, 4 / 10, 5 / 10, 6 / 10, 7 / 10, 8 / 10, 9 / 10]", lambda k, n: f"greatest({k} / {n}, 1e-7)")})
  SELECT round(avg((p * ln(p / m) + (1 - p) * ln((1 - p) / (1 - m)) + q * ln(q / m) + (1 - q) * ln((1 - q) / (1 - m))) / 2), 6) AS jsd, round(abs(avg(s2) - avg(s1)), 6) AS mean_shift, any_value(psi) AS psi, round(any_value(rho), 6) AS rank_correlation, round(any_value(auc_shift), 6) AS auc_shift
  FROM m CROSS JOIN a CROSS JOIN x"""


@query(
    "prediction_drift",
    "M5",
    f"SELECT *, concat_ws(',', CASE WHEN psi > 0.2 THEN 'psi' END, CASE WHEN jsd > 0.1 THEN 'jsd' END, CASE WHEN mean_shift > 0.1 THEN 'mean_shift' END, CASE WHEN rank_correlation < 0.95 THEN 'rank_correlation' END, CASE WHEN auc_shift > 0.05 THEN 'auc_shift' END) AS alerts FROM ({_P5})",
)
def _(spark, sf):
    p = predictions(spark, sf)
    out = d.prediction_drift(p.select("id", F.col("s1").alias("s")), p.select("id", F.col("s2").alias("s"), "y"), "id", "s", "y")
    return rounded(out, "jsd", "mean_shift", "psi", "rank_correlation", "auc_shift")


@query(
    "quality_gate",
    "DQ7",
    f"""WITH {_NULLED}, p AS (SELECT max(psi) AS m FROM ({_WIDTH})), a AS (SELECT (avg((value IS NULL)::INTEGER) > 0)::BIGINT AS cf, (avg((user_id IS NULL)::INTEGER) > 0.5)::BIGINT AS w FROM n),
        g AS (SELECT 'all' AS scope, cf AS critical_fails, 0::BIGINT AS other_fails, w AS warnings, m AS max_psi FROM a CROSS JOIN p UNION ALL SELECT 'nullable', 0, 0, w, m FROM a CROSS JOIN p)
        SELECT *, CASE WHEN critical_fails > 0 OR max_psi > 0.2 THEN 'FAIL' WHEN other_fails > 0 OR warnings > 0 OR max_psi > 0.1 THEN 'WARN' ELSE 'PASS' END AS verdict FROM g""",
)
def _(spark, sf):
    checks = q.check_nulls(nulled(spark, sf), ["event_id", "value"])
    psi = rounded(d.psi_width(*ref_cur(spark, sf), ["l_quantity", "l_extendedprice"]), "psi")
    full = q.gate(checks, psi).select(F.lit("all").alias("scope"), "*")
    return full.unionByName(q.gate(checks.where("column <> 'value'"), psi).select(F.lit("nullable").alias("scope"), "*"))


@query(
    "feature_label_overlap",
    "U3",
    "SELECT 'l_discount' AS shared, count(l_discount) AS n FROM lineitem UNION ALL SELECT 'l_quantity', count(l_quantity) FROM lineitem",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    features = li.select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    labels = li.select("l_orderkey", "l_discount", "l_quantity", "l_returnflag")
    shared = sp.column_overlap(features, labels, "l_orderkey")
    counted = features.agg(*[F.count(c).alias(c) for c in shared])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("shared"), F.col(c).alias("n")) for c in shared])).alias("x")).select("x.*")
