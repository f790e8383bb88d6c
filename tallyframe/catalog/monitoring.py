"""Queries: fairness, concentration, model monitoring and risk tables."""

from pyspark.sql import functions as F

from tallyframe.catalog.aggs import rounded
from tallyframe.catalog.registry import PRED, predictions, query, table, unit
from tallyframe.functions.stats import md5_unit
from tallyframe.operators import drift as d
from tallyframe.operators import fairness as f
from tallyframe.operators import monitoring as m

REC = """rec AS (SELECT o_orderkey AS id, c_mktsegment AS segment, CASE WHEN c_nationkey < 8 THEN 'north' WHEN c_nationkey < 16 THEN 'south' ELSE 'east' END AS region, o_custkey AS customer, o_orderpriority AS item,
  (o_totalprice > 150000 + c_nationkey * 8000)::INTEGER AS recommended, (o_orderstatus = 'F')::INTEGER AS actual FROM orders JOIN customer ON c_custkey = o_custkey)"""


def recommendations(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n = F.col("c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        F.col("c_mktsegment").alias("segment"),
        F.when(n < 8, "north").when(n < 16, "south").otherwise("east").alias("region"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("item"),
        (F.col("o_totalprice") > 150000 + n * 8000).cast("int").alias("recommended"),
        (F.col("o_orderstatus") == "F").cast("int").alias("actual"),
    )


PAIRS = [("north", "south"), ("north", "east"), ("south", "east"), ("north", "absent")]
_FAIR = f"""{REC}, g AS (SELECT region AS g, count(*) AS n, avg(recommended) AS rate, avg(recommended) FILTER (actual = 1) AS tpr FROM rec GROUP BY 1),
  pr AS (SELECT * FROM (VALUES ('north', 'south'), ('north', 'east'), ('south', 'east'), ('north', 'absent')) t(privileged, unprivileged)),
  fm AS (SELECT 'region' AS attribute, privileged, unprivileged, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 1 WHEN a.rate = 0 THEN 0 ELSE round(b.rate / a.rate, 6) END AS di,
    round(coalesce(b.rate, 0) - coalesce(a.rate, 0), 6) AS spd, round(coalesce(b.tpr, 0) - coalesce(a.tpr, 0), 6) AS eod FROM pr LEFT JOIN g a ON a.g = privileged LEFT JOIN g b ON b.g = unprivileged)"""


def measures(spark, sf):
    return f.fairness(recommendations(spark, sf), "region", PAIRS, actual="actual")


@query("fairness_pairs", "M6", f"WITH {_FAIR} SELECT * FROM fm")
def _(spark, sf):
    return measures(spark, sf)


_REPORT = """rp AS (SELECT attribute, min(di) AS min_di, max(di) AS max_di, arg_max(spd, abs(spd)) AS worst_spd, arg_max(eod, abs(eod)) AS worst_eod, count(*) AS pairs FROM fm GROUP BY 1),
  fr AS (SELECT *, concat_ws(',', CASE WHEN min_di < 0.8 THEN 'di_low' END, CASE WHEN max_di > 1.25 THEN 'di_high' END, CASE WHEN abs(worst_spd) > 0.1 THEN 'spd' END, CASE WHEN abs(worst_eod) > 0.1 THEN 'eod' END) AS violations FROM rp)"""


@query("fairness_report", "M7", f"WITH {_FAIR}, {_REPORT} SELECT *, (violations = '')::INTEGER AS is_fair FROM fr")
def _(spark, sf):
    return f.fairness_report(measures(spark, sf))


@query(
    "intersectional_fairness",
    "M8",
    f"""WITH {REC}, o AS (SELECT avg(recommended) AS r FROM rec), s AS (SELECT segment, avg(recommended) AS r FROM rec GROUP BY 1), g AS (SELECT region, avg(recommended) AS r FROM rec GROUP BY 1),
        x AS (SELECT rec.segment AS a, rec.region AS b, count(*) AS n, avg(recommended) / any_value(o.r) AS di, any_value(s.r) / any_value(o.r) AS di_a, any_value(g.r) / any_value(o.r) AS di_b FROM rec CROSS JOIN o JOIN s ON s.segment = rec.segment JOIN g ON g.region = rec.region
              WHERE rec.segment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND rec.region IN ('south', 'east') GROUP BY 1, 2 HAVING count(*) >= 30)
        SELECT a, b, n, round(di, 4) AS di, round(di_a, 4) AS di_a, round(di_b, 4) AS di_b, (di < 0.9)::INTEGER AS violation, (di < 0.9 AND round(di_a, 4) >= 0.9 AND round(di_b, 4) >= 0.9)::INTEGER AS hidden FROM x""",
)
def _(spark, sf):
    return f.intersectional(recommendations(spark, sf), "segment", "region", ["BUILDING", "MACHINERY", "FURNITURE"], ["south", "east"], limit=0.9)


@query(
    "bias_by_stage",
    "M9",
    f"""WITH {REC}, st AS (SELECT 0 AS stage_no, 'model' AS stage, region, recommended AS r FROM rec UNION ALL SELECT 1, 'filter', region, (recommended = 1 AND id % 3 > 0)::INTEGER FROM rec UNION ALL SELECT 2, 'top_k', region, (recommended = 1 AND id % 3 > 0 AND (region <> 'east' OR id % 2 = 0))::INTEGER FROM rec),
        g AS (SELECT stage_no, stage, count(*) FILTER (region = 'east') AS subgroup_size, avg(r) FILTER (region = 'east') AS s, avg(r) AS a FROM st GROUP BY 1, 2),
        dd AS (SELECT stage_no, stage, subgroup_size, round(s / a, 4) AS di, round(s, 4) AS subgroup_rate, round(a, 4) AS overall_rate, round(coalesce(round(s / a, 4) - lag(round(s / a, 4)) OVER (ORDER BY stage_no), 0), 4) AS delta FROM g)
        SELECT *, (stage_no = (SELECT arg_min(stage_no, (delta, stage_no)) FROM dd) AND (SELECT min(delta) FROM dd) < 0)::INTEGER AS is_worst FROM dd""",
)
def _(spark, sf):
    r = recommendations(spark, sf)
    keep = (F.col("recommended") == 1) & (F.col("id") % 3 > 0)
    stages = [
        ("model", r.select("id", "recommended")),
        ("filter", r.select("id", keep.alias("recommended"))),
        ("top_k", r.select("id", (keep & ((F.col("region") != "east") | (F.col("id") % 2 == 0))).alias("recommended"))),
    ]
    return f.bias_by_stage(r.select("id", "region"), stages, "id", "region", "east")


_HERD = """c AS (SELECT {item} AS item, count(*)::DOUBLE AS n FROM {src} GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS u FROM c), k AS (SELECT *, row_number() OVER (ORDER BY n) AS i, row_number() OVER (ORDER BY n DESC, item) AS r FROM c),
  h AS (SELECT any_value(t)::BIGINT AS total, any_value(u) AS unique_items, -sum(n / t * log2(n / t)) AS e, sum((n / t) ** 2) AS h, sum(n) FILTER (r <= 3) / any_value(t) AS top, sum((2 * i - u - 1) * n) / any_value(u * t) AS g FROM k CROSS JOIN t),
  z AS (SELECT *, e / log2(unique_items) AS nn, 0.3 * h + 0.3 * (1 - e / log2(unique_items)) + 0.2 * top + 0.2 * g AS risk_ FROM h),
  y AS (SELECT total, unique_items, round(e, 4) AS entropy, round(nn, 4) AS normalised_entropy, round(h, 4) AS hhi, round(top, 4) AS top3_share, round(g, 4) AS gini, round(least(risk_, 1), 4) AS risk FROM z),
  v AS (SELECT *, (hhi > {hhi})::INTEGER + (normalised_entropy < 0.5)::INTEGER + (top3_share > 0.6)::INTEGER + (gini > {gini})::INTEGER AS violations FROM y)
  SELECT *, CASE violations WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity, (violations >= 2)::INTEGER AS is_herding FROM v"""


@query("herding_items", "M10", "WITH " + _HERD.format(item="l_partkey::VARCHAR", src="lineitem", hhi=0.25, gini=0.7))
def _(spark, sf):
    return f.herding(table(spark, sf, "lineitem"), "l_partkey")


@query("herding_few_items", "M10 G4", "WITH " + _HERD.format(item="o_orderstatus", src="orders", hhi=0.25, gini=0.1))
def _(spark, sf):
    return f.herding(table(spark, sf, "orders"), "o_orderstatus", {"max_gini": 0.1})


@query("task_herding", "M11", f"WITH {PRED} SELECT task, round(avg(CASE WHEN task = 't1' THEN s1 ELSE s1 * 0.3 END), 6) AS avg_ratio, (avg(CASE WHEN task = 't1' THEN s1 ELSE s1 * 0.3 END) > 0.3)::INTEGER AS dominant FROM pred GROUP BY 1")
def _(spark, sf):
    p = predictions(spark, sf).withColumn("ratio", F.when(F.col("task") == "t1", F.col("s1")).otherwise(F.col("s1") * 0.3))
    return rounded(f.task_herding(p, "task", "ratio", 0.3), "avg_ratio")


#: Standard normal distribution function in SQL: power series through the log-gamma function.
def phi(z: str) -> str:
    return (
        f"(0.5 + exp(-(({z}) * ({z})) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(160), lambda k: "
        f"exp((2 * k + 1) * ln(greatest({z}, 1e-12)) - ((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi()))))))"
    )


def pvalue(s1, n1, s0, n0):
    pool = f"(({s1} + {s0}) / ({n1} + {n0}))"
    z = f"abs(({s1} / {n1} - {s0} / {n0}) / sqrt({pool} * (1 - {pool}) * (1.0 / {n1} + 1.0 / {n0})))"
    return f"2 * (1 - {phi(z)})"


_CC = f"""g AS (SELECT task, count(*) FILTER (version = 'v1') AS champion_n, count(*) FILTER (version = 'v2') AS challenger_n, sum(x) FILTER (version = 'v1') AS s0, sum(x) FILTER (version = 'v2') AS s1 FROM (SELECT task, version, CASE WHEN version = 'v2' AND task = 't1' THEN least(s1 + 0.04, 1) ELSE s1 END AS x FROM pred) GROUP BY 1),
  c AS (SELECT *, s0 / champion_n AS champion_mean, s1 / challenger_n AS challenger_mean, {pvalue("s1", "challenger_n", "s0", "champion_n")} AS p FROM g)"""


@query(
    "champion_challenger",
    "M12",
    f"""WITH {PRED}, {_CC} SELECT task, champion_n, challenger_n, round(champion_mean, 6) AS champion_mean, round(challenger_mean, 6) AS challenger_mean, round((challenger_mean - champion_mean) / champion_mean, 6) AS lift, round(p, 6) AS p_value, (p < 0.05)::INTEGER AS significant,
        CASE WHEN p < 0.05 AND challenger_mean > champion_mean THEN 'promote' WHEN p < 0.05 THEN 'keep' ELSE 'wait' END AS action FROM c""",
)
def _(spark, sf):
    p = predictions(spark, sf)
    p = p.withColumn("score", F.when((F.col("version") == "v2") & (F.col("task") == "t1"), F.least(F.col("s1") + 0.04, F.lit(1.0))).otherwise(F.col("s1")))
    return rounded(m.champion_challenger(p, "v1", "v2"), "champion_mean", "challenger_mean", "lift", "p_value")


@query(
    "version_stats",
    "M13",
    f"""WITH {PRED}, o AS (SELECT version, task, s1, row_number() OVER (PARTITION BY version, task ORDER BY s1) - 1 AS i, count(*) OVER (PARTITION BY version, task) AS n FROM pred)
        SELECT version, task, count(*) AS n, round(avg(s1), 6) AS mean, round(stddev_samp(s1), 6) AS std, max(s1) FILTER (i = floor(n * 50 / 100)) AS p50, max(s1) FILTER (i = floor(n * 95 / 100)) AS p95, max(s1) FILTER (i = floor(n * 99 / 100)) AS p99 FROM o GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(m.version_stats(predictions(spark, sf), ["version", "task"], "s1"), "mean", "std")




@query(
    "retrain_decision",
    "M14",
    f"""WITH {PRED}, w AS (SELECT greatest(min(value), 0) AS lo, max(value) AS hi FROM events), e AS (SELECT list_transform(range(1, 10), lambda i: lo + (hi - lo) * i / 10) AS e FROM w),
        b AS (SELECT len(list_filter(e, lambda t: t <= value)) AS b, count(*) FILTER (day(ts) <= 15) AS r, count(*) FILTER (day(ts) > 15) AS k FROM events CROSS JOIN e GROUP BY 1), t AS (SELECT sum(r) AS rn, sum(k) AS kn FROM b),
        p AS (SELECT sum((greatest(k / kn, 1e-4) - greatest(r / rn, 1e-4)) * ln(greatest(k / kn, 1e-4) / greatest(r / rn, 1e-4))) AS psi FROM b CROSS JOIN t),
        s AS (SELECT avg(s1) FILTER (version = 'v1') AS m0, avg(s1) FILTER (version = 'v2') AS m1 FROM pred), l AS (SELECT max(ts) AS last_ FROM events WHERE event_type = 'signup'),
        x AS (SELECT round(psi, 6) AS max_psi, (psi >= 0.25)::BIGINT AS critical_features, (epoch_us(TIMESTAMP '2024-03-01') // 1000000 - epoch_us(last_) // 1000000) // 86400 AS days_since_train, round((m1 - m0) / m0, 6) AS lift FROM p CROSS JOIN s CROSS JOIN l)
        SELECT *, concat_ws(',', CASE WHEN critical_features > 0 THEN 'drift' END, CASE WHEN lift > 0.02 THEN 'challenger' END, CASE WHEN days_since_train >= 30 THEN 'stale' END) AS reasons,
          (critical_features > 0 OR lift > 0.02 OR days_since_train >= 30)::INTEGER AS retrain FROM x""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    early = F.dayofmonth("ts") <= 15
    psi = d.psi_width(e.where(early), e.where(~early), ["value"])
    log = predictions(spark, sf).select("version", F.col("s1").alias("score"))
    trains = e.where("event_type = 'signup'").select(F.col("ts").alias("trained_at"))
    return rounded(m.retrain_decision(psi, log, trains, "v1", "v2", "2024-03-01"), "max_psi", "lift")


@query(
    "latent_guardrail",
    "M15",
    """WITH x AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v, label FROM embeddings), st AS (SELECT i, avg(v) AS m, stddev_pop(v) + 1e-6 AS s FROM x WHERE label < 5 GROUP BY 1),
       sc AS (SELECT vec_id, any_value(label) AS label, sum(((v - m) / s) ** 2) AS score FROM x JOIN st USING (i) GROUP BY 1), t AS (SELECT quantile_cont(score, 0.95) AS t FROM sc WHERE label < 5)
       SELECT vec_id, round(score, 4) AS score, (score > t)::INTEGER AS outlier FROM sc CROSS JOIN t""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    fit = m.guardrail_fit(e.where("label < 5"), "embedding")
    return rounded(m.guardrail_score(e, "embedding", fit).select("vec_id", "score", "outlier"), "score", digits=4)


_DIMS = ["d1", "d2", "d3"]


@query(
    "risk_grades",
    "M16",
    f"""WITH b AS (SELECT o_custkey AS model, o_orderkey AS seq, {unit("o_orderkey || ':d1'")} AS d1, {unit("o_orderkey || ':d2'")} AS d2, {unit("o_orderkey || ':d3'")} AS d3 FROM orders), s AS (SELECT model, seq, round(0.5 * d1 + 0.3 * d2 + 0.2 * d3, 4) AS risk_total FROM b),
        g AS (SELECT *, CASE WHEN risk_total >= 0.7 THEN 'high' WHEN risk_total >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level FROM s), l AS (SELECT *, lag(risk_level) OVER (PARTITION BY model ORDER BY seq) AS prev_level FROM g)
        SELECT model, seq, risk_total, risk_level, prev_level, coalesce((prev_level <> risk_level)::INTEGER, 0) AS level_change FROM l""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("model"), F.col("o_orderkey").alias("seq"))
    o = o.withColumns({x: md5_unit(F.concat(F.col("seq").cast("string"), F.lit(f":{x}"))) for x in _DIMS})
    out = m.risk_score(o, {"d1": 0.5, "d2": 0.3, "d3": 0.2}, [("high", 0.7), ("medium", 0.4)], "low")
    return m.grade_history(out, "model", "seq", "risk_level").drop(*_DIMS)


def _u(tag):
    return unit(f"l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':{tag}'")


@query(
    "task_risk_assessment",
    "M16",
    f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 7 > 0 THEN l_linenumber END AS v, CASE WHEN l_orderkey % 7 > 0 THEN {_u('di')} * 1.5 END AS di, {_u('auc')} AS auc, l_quantity > 25 AS drift, l_discount AS deg, {_u('cov')} AS cov, l_returnflag = 'A' AS ex, l_linestatus = 'F' AS card FROM lineitem),
        s AS (SELECT *, CASE WHEN v IS NULL THEN 0.5 ELSE least(least(v * 0.15, 0.6) + CASE WHEN di < 0.8 OR di > 1.25 THEN 0.3 ELSE 0 END, 1) END AS fairness_risk,
          greatest(0.5 - CASE WHEN ex THEN 0.2 ELSE 0 END - CASE WHEN cov > 0.8 THEN 0.15 WHEN cov > 0.5 THEN 0.1 ELSE 0 END - CASE WHEN card THEN 0.1 ELSE 0 END, 0) AS transparency_risk,
          least(CASE WHEN auc < 0.6 THEN 0.5 WHEN auc < 0.7 THEN 0.3 WHEN auc < 0.8 THEN 0.15 ELSE 0 END + CASE WHEN drift THEN 0.25 ELSE 0 END + least(deg, 0.3), 1) AS accuracy_risk,
          0.6 - CASE WHEN ex THEN 0.2 ELSE 0 END - 0.1 AS security_risk, 0.6 - least(cov * 0.3, 0.3) - CASE WHEN card THEN 0.15 ELSE 0 END AS oversight_risk FROM b),
        t AS (SELECT l_orderkey, l_linenumber, l_partkey, fairness_risk::DOUBLE AS f, transparency_risk::DOUBLE AS tr, accuracy_risk::DOUBLE AS a, security_risk::DOUBLE AS s, oversight_risk::DOUBLE AS o FROM s)
        SELECT l_orderkey, l_linenumber, l_partkey, round(f, 6) AS fairness_risk, round(tr, 6) AS transparency_risk, round(a, 6) AS accuracy_risk, round(s, 6) AS security_risk, round(o, 6) AS oversight_risk,
          CASE WHEN f * 0.2 + tr * 0.2 + a * 0.2 + s * 0.2 + o * 0.2 >= 0.4 THEN 1 ELSE 0 END AS limited FROM t""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")

    def draw(tag):
        return md5_unit(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.lit(tag)))

    known = F.col("l_orderkey") % 7 > 0
    b = li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(known, F.col("l_linenumber")).alias("violation_count"), F.when(known, draw("di") * 1.5).alias("di_value"), F.lit(None).cast("double").alias("spd_value"),
        (F.col("l_returnflag") == "A").alias("has_explanations"), draw("cov").alias("explanation_coverage"), (F.col("l_linestatus") == "F").alias("model_card_exists"),
        draw("auc").alias("auc"), (F.col("l_quantity") > 25).alias("drift_detected"), F.col("l_discount").alias("degradation"),
        (F.col("l_returnflag") == "A").alias("input_validation"), F.lit(None).cast("boolean").alias("encryption_enabled"), F.lit("moderate").alias("access_control"),
        draw("cov").alias("human_review_rate"), (F.col("l_linestatus") == "F").alias("alert_configured"), F.lit(None).cast("boolean").alias("kill_switch"),
    )
    dims = list(m.TASK_RISK_WEIGHTS)
    out = m.task_risk_dimensions(b).select("l_orderkey", "l_linenumber", "l_partkey", *dims)
    total = sum((F.col(x) * 0.2 for x in dims[1:]), F.col(dims[0]) * 0.2)
    return rounded(out.withColumn("limited", (total >= 0.4).cast("int")), *dims)


@query(
    "metadata_risk_dimensions",
    "M16",
    """WITH b AS (SELECT c_custkey AS model, c_acctbal / 10000 AS pii_ratio, CASE WHEN c_nationkey > 4 THEN c_nationkey / 25 END AS hr, abs(c_acctbal) * 1000 AS cc FROM customer)
       SELECT model, round(least(greatest(pii_ratio, 0), 1), 6) AS data_sensitivity, round(CASE WHEN hr IS NULL THEN 0.5 ELSE 1 - hr END, 6) AS automation_level, round(least(log10(greatest(cc, 1) + 1) / log10(1000001), 1), 6) AS scope_of_impact, 0.5::DOUBLE AS model_complexity FROM b""",
)
def _(spark, sf):
    b = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("model"), (F.col("c_acctbal") / 10000).alias("pii_ratio"), F.when(F.col("c_nationkey") > 4, F.col("c_nationkey") / 25).alias("human_review_fraction"), (F.abs("c_acctbal") * 1000).alias("customer_count")
    )
    out = m.metadata_dimensions(b).select("model", "data_sensitivity", "automation_level", "scope_of_impact", "model_complexity")
    return rounded(out, "data_sensitivity", "automation_level", "scope_of_impact")


@query(
    "data_minimisation",
    "M16",
    """SELECT p_brand, round(avg(CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.3 ELSE 0 END + CASE WHEN p_size * 10 <= 90 THEN 0.2 WHEN p_size * 10 <= 365 THEN 0.1 ELSE 0 END), 4)::DOUBLE AS minimisation FROM part GROUP BY 1""",
)
def _(spark, sf):
    inv = table(spark, sf, "part").select("p_brand", (F.col("p_size") % 2 == 0).alias("anonymized"), (F.col("p_size") % 3 == 0).alias("encrypted"), (F.col("p_size") * 10).alias("retention_days"))
    return m.minimisation_score(inv, "p_brand")


@query(
    "model_metadata_rollup",
    "M17",
    """WITH k AS (SELECT DISTINCT p_brand FROM part), a AS (SELECT p_brand, avg((p_size % 4 <> 0)::INTEGER) AS pii_ratio FROM part GROUP BY 1),
       dd AS (SELECT p_brand, p_partkey, CASE WHEN p_size = 13 THEN NULL ELSE p_retailprice / 1000 END AS v FROM part),
       e AS (SELECT p_brand, min(CASE WHEN v > 0 THEN least(v, 1 / v) ELSE 0 END) AS di FROM dd WHERE v IS NOT NULL GROUP BY 1), r AS (SELECT p_brand, count(*) FILTER (p_size > 45) / count(*) AS hr FROM part GROUP BY 1)
       SELECT p_brand, round(CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) THEN 0.25 ELSE pii_ratio END, 6) AS pii_ratio, round(di, 6) AS disparate_impact_min, round(hr, 6) AS human_review_fraction
       FROM k LEFT JOIN a USING (p_brand) LEFT JOIN e USING (p_brand) LEFT JOIN r USING (p_brand)""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    src = [
        m.lineage_metadata(p.select("p_brand", (F.col("p_size") % 4 == 0).alias("pseudonymized")), "p_brand"),
        m.fairness_metadata(p.select("p_brand", F.col("p_partkey").alias("recorded_at"), F.col("p_partkey").cast("string").alias("attribute"), F.when(F.col("p_size") != 13, F.col("p_retailprice") / 1000).alias("disparate_impact")), "p_brand"),
        m.review_metadata(p.where("p_size > 45"), p, "p_brand"),
        p.where("p_size = 1").select("p_brand", F.lit(0.25).alias("pii_ratio")).distinct(),
    ]
    return rounded(m.model_metadata(p, "p_brand", src), "pii_ratio", "disparate_impact_min", "human_review_fraction")


INC = f"""inc AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS period, CASE event_type WHEN 'error' THEN 'security_alert' WHEN 'view' THEN 'fairness_violation' WHEN 'click' THEN 'drift_warning' WHEN 'signup' THEN 'model_rollback' ELSE 'custom' END AS event_type,
  {unit("event_id || ':di'")} AS di_value, CASE WHEN user_id % 4 = 0 THEN 'major' WHEN user_id % 4 = 1 THEN 'weird' END AS severity, CASE user_id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' ELSE 'closed' END AS status, value AS resolution_hours FROM events),
  ci AS (SELECT *, CASE WHEN event_type = 'security_alert' THEN 'critical' WHEN event_type = 'fairness_violation' AND di_value < 0.6 THEN 'critical' WHEN event_type = 'fairness_violation' AND di_value < 0.8 THEN 'major' WHEN event_type = 'fairness_violation' THEN 'minor'
    WHEN event_type = 'model_rollback' THEN 'major' WHEN event_type = 'drift_warning' THEN 'minor' WHEN severity = 'major' THEN 'major' ELSE 'minor' END AS incident_severity FROM inc)"""


def incidents(spark, sf):
    e = table(spark, sf, "events")
    t, k, s = F.col("event_type"), F.col("user_id") % 4, F.col("user_id") % 3
    return m.classify_incidents(
        e.select(
            "event_id",
            F.date_format("ts", "yyyy-MM-dd").alias("period"),
            F.when(t == "error", "security_alert").when(t == "view", "fairness_violation").when(t == "click", "drift_warning").when(t == "signup", "model_rollback").otherwise("custom").alias("event_type"),
            md5_unit(F.concat(F.col("event_id").cast("string"), F.lit(":di"))).alias("di_value"),
            F.when(k == 0, "major").when(k == 1, "weird").alias("severity"),
            F.when(s == 0, "resolved").when(s == 1, "open").otherwise("closed").alias("status"),
            F.col("value").alias("resolution_hours"),
        )
    )


@query(
    "incident_table",
    "M19",
    f"""WITH {INC} SELECT period, incident_severity, count(*) AS total, count(*) FILTER (status IN ('resolved', 'closed')) AS resolved, count(*) FILTER (status = 'open') AS open, round(avg(resolution_hours) FILTER (status IN ('resolved', 'closed')), 9) AS avg_resolution_hours
        FROM ci GROUP BY GROUPING SETS ((period, incident_severity), (period))""",
)
def _(spark, sf):
    return rounded(m.incident_table(incidents(spark, sf), "period"), "avg_resolution_hours", digits=9)


@query(
    "disclosure_tables",
    "M18",
    f"""WITH {INC}, {_FAIR}, {_REPORT} SELECT 'performance' AS section, 't' || (user_id % 3) AS item, event_type AS measure, round(avg(value), 6) AS value, '2024-01' AS period FROM events GROUP BY 2, 3
        UNION ALL SELECT 'fairness', attribute, 'min_di', min_di, '2024-01' FROM fr UNION ALL SELECT 'fairness', attribute, 'is_fair', (violations = '')::INTEGER, '2024-01' FROM fr
        UNION ALL SELECT 'incidents', incident_severity, 'count', count(*), '2024-01' FROM ci GROUP BY 2 UNION ALL SELECT 'incidents', 'all', 'resolution_rate', round(avg((status IN ('resolved', 'closed'))::INTEGER), 6), '2024-01' FROM ci
        UNION ALL SELECT 'incidents', 'all', 'avg_resolution_hours', round(avg(resolution_hours) FILTER (status IN ('resolved', 'closed')), 6), '2024-01' FROM ci
        UNION ALL SELECT 'customers', CASE WHEN event_type = 'error' THEN 'opt_out' ELSE 'opt_in' END, 'count', count(*), '2024-01' FROM events GROUP BY 2""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    metrics = e.select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("task"), F.col("event_type").alias("metric"), "value")
    actions = e.select(F.when(F.col("event_type") == "error", "opt_out").otherwise("opt_in").alias("action"))
    return rounded(m.disclosure_tables("2024-01", metrics, f.fairness_report(measures(spark, sf)), incidents(spark, sf), actions), "value")
