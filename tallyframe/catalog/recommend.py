"""Queries: ranking, filters, rules, fallbacks and search."""

from pyspark.sql import functions as F

from tallyframe.catalog.aggs import rounded
from tallyframe.catalog.registry import query, table, unit
from tallyframe.functions.stats import md5_unit
from tallyframe.operators import neighbours as nb
from tallyframe.operators import recommend as r
from tallyframe.operators import search as s
from tallyframe.plans.session import spread, written

#: Candidates: every order line is one (customer, item) offer with context derived from its keys.
_K = "l_orderkey || ':' || l_partkey || ':' || l_linenumber"
CAND = f"""cand AS (SELECT o_custkey AS customer_id, l_partkey AS item_id, l_orderkey AS oid, l_linenumber AS line, CASE WHEN l_suppkey % 10 > 0 THEN {unit(_K + " || ':ctr'")} END AS ctr, {unit(_K + " || ':cvr'")} AS cvr, CASE WHEN l_suppkey % 7 > 0 THEN {unit(_K + " || ':nba'")} END AS nba,
  CASE o_custkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'other' END AS segment, (o_orderkey % 3 = 0) AS flare, {unit("o_custkey || ':util'")} AS limit_util, {unit("o_custkey || ':churn'")} AS churn_prob,
  (o_custkey % 5)::INTEGER AS n_messages_7d, CASE l_returnflag WHEN 'A' THEN 'app_push' WHEN 'N' THEN 'email' ELSE 'sms' END AS channel, {unit("o_custkey || ':eng'")} AS engagement_score,
  CASE WHEN l_partkey % 9 > 0 THEN (l_partkey % 5 + 1)::INTEGER END AS item_risk_level, CASE WHEN o_custkey % 13 > 0 THEN (o_custkey % 5 + 1)::INTEGER END AS customer_risk_tolerance, (20 + o_custkey % 60)::INTEGER AS customer_age, (o_custkey % 50 * 1500000)::DOUBLE AS customer_income,
  l_discount > 0.08 AS owned FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def candidates(spark, sf):
    li, o = spread(table(spark, sf, "lineitem")), table(spark, sf, "orders")
    d = li.join(o, li.l_orderkey == o.o_orderkey)
    cust, part, sup = F.col("o_custkey"), F.col("l_partkey"), F.col("l_suppkey")
    base = F.concat_ws(":", F.col("l_orderkey").cast("string"), part.cast("string"), F.col("l_linenumber").cast("string"))

    def line(tag):
        return md5_unit(F.concat(base, F.lit(f":{tag}")))

    def per_customer(tag):
        return md5_unit(F.concat(cust.cast("string"), F.lit(f":{tag}")))

    owned = F.when(F.col("l_discount") > 0.08, F.array(part)).otherwise(F.array().cast("array<bigint>"))
    return d.select(
        cust.alias("customer_id"), part.alias("item_id"), F.col("l_orderkey").alias("oid"), F.col("l_linenumber").alias("line"),
        F.when(sup % 10 > 0, line("ctr")).alias("ctr"), line("cvr").alias("cvr"), F.when(sup % 7 > 0, line("nba")).alias("nba"),
        F.when(cust % 4 == 0, "high").when(cust % 4 == 1, "medium").when(cust % 4 == 2, "low").otherwise("other").alias("segment"),
        (F.col("o_orderkey") % 3 == 0).alias("flare"), per_customer("util").alias("limit_util"), per_customer("churn").alias("churn_prob"), (cust % 5).cast("int").alias("n_messages_7d"),
        F.when(F.col("l_returnflag") == "A", "app_push").when(F.col("l_returnflag") == "N", "email").otherwise("sms").alias("channel"), per_customer("eng").alias("engagement_score"),
        F.when(part % 9 > 0, (part % 5 + 1).cast("int")).alias("item_risk_level"), F.when(cust % 13 > 0, (cust % 5 + 1).cast("int")).alias("customer_risk_tolerance"),
        (cust % 60 + 20).cast("int").alias("customer_age"), (cust % 50 * 1500000).cast("double").alias("customer_income"), owned.alias("owned_products"),
    )


KEYS = ["customer_id", "item_id", "oid", "line"]
CFG = r.CompositeConfig({"ctr": 0.3, "cvr": 0.4, "nba": 0.3}, {"high": {"cvr": 1.4, "nba": 2.0}}, [("limit_util", 0.5, "ctr", 1.2)])
_W = {
    "ctr": "0.3 * CASE WHEN limit_util > 0.5 THEN 1.2 ELSE 1 END",
    "cvr": "0.4 * CASE WHEN segment = 'high' THEN 1.4 ELSE 1 END",
    "nba": "0.3 * CASE WHEN segment = 'high' THEN 1.5 ELSE 1 END",
}
_NUM = " + ".join(f"coalesce({w} * {t}, 0)" for t, w in _W.items())
_DEN = " + ".join(f"CASE WHEN {t} IS NULL THEN 0 ELSE {w} END" for t, w in _W.items())
SCORED = f"""sc AS (SELECT *, ({_NUM}) / ({_DEN}) AS s_task, CASE segment WHEN 'high' THEN 1.2 WHEN 'medium' THEN 1.0 WHEN 'low' THEN 0.8 ELSE 1 END AS w_modifier, 1 + 0.15 * flare::INTEGER AS v_velocity,
    least(CASE WHEN limit_util > 0.8 THEN 0.3 ELSE 0 END + CASE WHEN churn_prob > 0.3 THEN 0.5 ELSE 0 END + CASE WHEN n_messages_7d > 3 THEN 0.2 ELSE 0 END, 1) AS risk_penalty,
    pow(0.85, n_messages_7d * CASE channel WHEN 'app_push' THEN 1.0 WHEN 'email' THEN 0.7 ELSE 0.9 END) AS fatigue_factor, 1 + 0.15 * engagement_score AS engagement_boost FROM cand),
  fin AS (SELECT *, s_task * w_modifier * v_velocity * greatest(1 - risk_penalty, 0) * fatigue_factor * engagement_boost AS score FROM sc),
  flt AS (SELECT *, CASE WHEN n_messages_7d >= 3 THEN 'fatigue_count' WHEN pow(CASE channel WHEN 'app_push' THEN 0.85 WHEN 'email' THEN 0.4 ELSE 0.9 END, n_messages_7d) < 0.2 THEN 'fatigue_score'
      WHEN score < 0.1 THEN 'eligibility_score' WHEN churn_prob > 0.7 THEN 'eligibility_churn'
      WHEN item_risk_level IS NOT NULL AND customer_risk_tolerance IS NULL THEN 'suitability_unassessed' WHEN item_risk_level > customer_risk_tolerance THEN 'suitability_risk'
      WHEN item_risk_level IS NOT NULL AND customer_age >= 65 AND item_risk_level > 2 THEN 'suitability_senior' WHEN item_risk_level IS NOT NULL AND customer_income < 30000000 AND item_risk_level > 3 THEN 'suitability_income'
      WHEN owned THEN 'owned_product' END AS reject_reason FROM fin)"""


def stored_candidates(spark, sf):
    """The candidate table as a stage result: its drawn columns are computed once, not inside every filter."""
    return written(candidates(spark, sf))


def chain():
    return [r.filter_fatigue(decay={"app_push": 0.85, "email": 0.4}, default=0.9), r.filter_eligibility(), r.filter_suitability(), r.filter_owned()]


@query("weighted_score", "R1", f"WITH {CAND} SELECT customer_id, item_id, oid, line, round((coalesce(0.5 * ctr, 0) + 0.2 * cvr + coalesce(0.3 * nba, 0)) / (CASE WHEN ctr IS NULL THEN 0 ELSE 0.5 END + 0.2 + CASE WHEN nba IS NULL THEN 0 ELSE 0.3 END), 6) AS score FROM cand")
def _(spark, sf):
    return rounded(r.weighted_score(candidates(spark, sf), {"ctr": 0.5, "cvr": 0.2, "nba": 0.3}), "score").select(*KEYS, "score")


@query(
    "composite_score",
    "R2",
    f"WITH {CAND}, {SCORED} SELECT customer_id, item_id, oid, line, round(s_task, 6) AS s_task, round(risk_penalty, 6) AS risk_penalty, round(fatigue_factor, 6) AS fatigue_factor, round(score, 6) AS score FROM fin",
)
def _(spark, sf):
    out = r.composite_score(candidates(spark, sf), CFG)
    return rounded(out, "s_task", "risk_penalty", "fatigue_factor", "score").select(*KEYS, "s_task", "risk_penalty", "fatigue_factor", "score")


@query("filter_reasons", "R3 R4 R5 R6 R7", f"WITH {CAND}, {SCORED} SELECT customer_id, item_id, oid, line, coalesce(reject_reason, '') AS reject_reason FROM flt")
def _(spark, sf):
    out = r.apply_filters(r.composite_score(candidates(spark, sf), CFG), chain())
    return out.select(*KEYS, F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


@query("filter_pass_rates", "R7", f"WITH {CAND}, {SCORED} SELECT coalesce(reject_reason, 'passed') AS reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM flt), 6) AS share FROM flt GROUP BY 1")
def _(spark, sf):
    return rounded(r.pass_rates(r.apply_filters(r.composite_score(candidates(spark, sf), CFG), chain())), "share")


@query(
    "filter_owned_anti_join",
    "R6",
    """WITH l AS (SELECT o_custkey AS customer_id, l_partkey AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT DISTINCT customer_id, (item_id * 7 + 3) % (SELECT count(*) FROM part) AS item_id FROM l)
       SELECT customer_id, item_id FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.customer_id = c.customer_id AND l.item_id = c.item_id)""",
)
def _(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    owned = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("item_id"))
    n = table(spark, sf, "part").count()
    offered = owned.select("customer_id", ((F.col("item_id") * 7 + 3) % n).alias("item_id")).distinct()
    return offered.join(owned, ["customer_id", "item_id"], "left_anti")


@query(
    "top_k_offers",
    "O3",
    f"WITH {CAND}, b AS (SELECT customer_id, item_id, max(cvr) AS score FROM cand GROUP BY 1, 2) SELECT customer_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM b WHERE score >= 0.2 QUALIFY rank <= 3",
)
def _(spark, sf):
    b = candidates(spark, sf).groupBy("customer_id", "item_id").agg(F.max("cvr").alias("score"))
    return rounded(r.top_k(b, "customer_id", "score", "item_id", 3, 0.2), "score")


@query(
    "recommendations",
    "R8 O3 R15",
    f"""WITH {CAND}, {SCORED}, b AS (SELECT customer_id, item_id, arg_max(oid, (score, -oid, -line)) AS oid, max(score) AS score FROM flt WHERE reject_reason IS NULL GROUP BY 1, 2)
        SELECT customer_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM b QUALIFY rank <= 3""",
)
def _(spark, sf):
    c = stored_candidates(spark, sf)
    scored = r.apply_filters(r.composite_score(c, CFG), chain()).where(F.col("reject_reason").isNull())
    best = scored.groupBy("customer_id", "item_id").agg(F.max("score").alias("score"))
    return rounded(r.top_k(best, "customer_id", "score", "item_id", 3), "score")


@query(
    "recommend_all_customers",
    "R8",
    f"""WITH {CAND}, {SCORED} SELECT customer_id, item_id, oid, round(score, 6) AS score, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, oid)::INTEGER AS rank, CASE WHEN s_task >= 0.7 THEN 'strong interest' ELSE 'general fit' END AS reason FROM flt WHERE reject_reason IS NULL QUALIFY rank <= 2""",
)
def _(spark, sf):
    out = r.recommend(stored_candidates(spark, sf), CFG, chain(), "customer_id", "oid", 2, [("reason", F.when(F.col("s_task") >= 0.7, "strong interest").otherwise("general fit"))])
    return rounded(out, "score").select("customer_id", "item_id", "oid", "score", "rank", "reason")


_F = """f AS (SELECT c_custkey, (c_custkey % 90)::INTEGER AS recency_days, (c_nationkey - 12) / 10 AS frequency_trend, (c_nationkey % 7 - 4) / 10 AS monetary_change_pct, (c_custkey % 40) / 100 AS mcc_entropy_change, (c_custkey % 6)::INTEGER AS num_products, (c_custkey % 2)::INTEGER AS prod_card, c_acctbal * 8 AS balance,
  (c_custkey % 30)::INTEGER AS monthly_freq, c_acctbal * 5 + c_nationkey * 400 AS monthly_spend, CASE WHEN c_custkey % 11 > 0 THEN (c_custkey % 5 + 1)::INTEGER END AS risk_grade, (c_custkey % 100)::DOUBLE AS asset_percentile, (c_custkey % 8)::INTEGER AS tenure_months, (c_custkey % 3 = 0)::INTEGER AS salary_deposit_flag, (c_custkey % 4 > 0)::INTEGER AS is_primary_bank,
  (c_custkey % 60) / 100 AS interbank_transfer_pct, (c_custkey % 9)::INTEGER AS credit_grade, (c_custkey % 80) / 100 AS dti, (c_custkey % 20) / 100 AS foreign_txn_pct, (c_custkey % 100)::DOUBLE AS card_spend_percentile, (c_custkey % 3)::INTEGER AS num_cards, (c_custkey % 120)::INTEGER AS days_since_last_txn, (c_nationkey - 12) / 10 AS balance_change_pct,
  (c_custkey % 100)::DOUBLE AS clv_percentile, (c_custkey % 50)::INTEGER AS top_mcc_code, (c_custkey % 30) / 10 AS mcc_entropy_recent, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 20) / 10 END AS mcc_entropy_prior FROM customer)"""


def rule_features(spark, sf):
    k, n, b = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    cols = {
        "recency_days": (k % 90).cast("int"), "frequency_trend": (n - 12) / 10, "monetary_change_pct": (n % 7 - 4) / 10, "mcc_entropy_change": (k % 40) / 100, "num_products": (k % 6).cast("int"), "prod_card": (k % 2).cast("int"),
        "balance": b * 8, "monthly_freq": (k % 30).cast("int"), "monthly_spend": b * 5 + n * 400, "risk_grade": F.when(k % 11 > 0, (k % 5 + 1).cast("int")), "asset_percentile": (k % 100).cast("double"), "tenure_months": (k % 8).cast("int"),
        "salary_deposit_flag": (k % 3 == 0).cast("int"), "is_primary_bank": (k % 4 > 0).cast("int"), "interbank_transfer_pct": (k % 60) / 100, "credit_grade": (k % 9).cast("int"), "dti": (k % 80) / 100, "foreign_txn_pct": (k % 20) / 100,
        "card_spend_percentile": (k % 100).cast("double"), "num_cards": (k % 3).cast("int"), "days_since_last_txn": (k % 120).cast("int"), "balance_change_pct": (n - 12) / 10, "clv_percentile": (k % 100).cast("double"), "top_mcc_code": (k % 50).cast("int"),
        "mcc_entropy_recent": (k % 30) / 10, "mcc_entropy_prior": F.when(k % 2 == 0, (k % 20) / 10),
    }
    return table(spark, sf, "customer").select("c_custkey", *[v.alias(c) for c, v in cols.items()])


_RULE_SQL = {
    "churn_signal": ("(sig >= 2)::INTEGER", "0.4 + 0.15 * sig", "churn_rfm_decay"),
    "top_mcc_shift": ("(abs(mcc_entropy_change) >= 0.15)::INTEGER", "0.5 + least(0.35, abs(mcc_entropy_change) * 2)", "top_mcc_entropy"),
    "nba_primary": ("CASE WHEN greatest(num_products, prod_card) < 2 THEN 1 ELSE least(greatest(num_products, prod_card), 4) + 1 END", "0.55", "nba_adjacency_matrix"),
    "segment_prediction": ("CASE WHEN pts >= 5 THEN 0 WHEN pts >= 3 THEN 1 WHEN pts >= 1 THEN 2 ELSE 3 END", "0.5", "segment_3axis"),
    "will_acquire_deposits": ("(surplus >= 0.3)::INTEGER", "0.4 + 0.3 * least(1, surplus)", "deposits_surplus_ratio"),
    "will_acquire_accounts": ("(acc >= 2)::INTEGER", "0.4 + 0.15 * least(acc, 3)", "accounts_pattern"),
    "will_acquire_lending": ("(credit_grade <= 4 AND dti < 0.4)::INTEGER", "CASE WHEN credit_grade <= 4 AND dti < 0.4 THEN 0.6 ELSE 0.7 END", "lending_credit_dti"),
    "will_acquire_payments": ("(foreign_txn_pct >= 0.1 OR (card_spend_percentile >= 70 AND num_cards <= 1))::INTEGER", "CASE WHEN foreign_txn_pct >= 0.1 OR (card_spend_percentile >= 70 AND num_cards <= 1) THEN 0.65 ELSE 0.6 END", "payments_spend_foreign"),
    "product_stability": ("round(least(greatest(CASE WHEN days_since_last_txn >= 90 THEN 0.3 + balance_change_pct * 0.1 WHEN days_since_last_txn >= 60 THEN 0.55 + balance_change_pct * 0.1 WHEN days_since_last_txn >= 30 THEN 0.75 + balance_change_pct * 0.05 ELSE 0.92 + balance_change_pct * 0.02 END, 0), 1), 4)", "0.5", "stability_dormancy"),
    "cross_sell_count": ("greatest(CASE WHEN clv_percentile >= 80 THEN 4 WHEN clv_percentile >= 40 THEN 3 WHEN clv_percentile >= 20 THEN 2 ELSE 1 END - num_products, 0)", "0.5", "cross_sell_clv_tier"),
    "next_mcc": ("top_mcc_code", "0.45", "next_mcc_frequency"),
    "mcc_diversity_trend": ("round(mcc_entropy_recent - coalesce(mcc_entropy_prior, mcc_entropy_recent), 4)", "0.4", "diversity_entropy_trend"),
}
_INV = "(risk_grade >= 3 AND asset_percentile >= 30)"


@query(
    "rule_predictions",
    "R9",
    f"""WITH {_F}, g AS (SELECT *, (recency_days > 30)::INTEGER + (frequency_trend < 0)::INTEGER + (monetary_change_pct < -0.2)::INTEGER AS sig,
          CASE WHEN balance >= 50000 THEN 2 WHEN balance >= 10000 THEN 1 ELSE 0 END + CASE WHEN monthly_freq >= 20 THEN 2 WHEN monthly_freq >= 5 THEN 1 ELSE 0 END + CASE WHEN num_products >= 4 THEN 2 WHEN num_products >= 2 THEN 1 ELSE 0 END AS pts,
          CASE WHEN balance > 0 THEN greatest((balance - monthly_spend) / balance, 0) ELSE 0 END AS surplus, (tenure_months * 30 <= 90)::INTEGER + 2 * (salary_deposit_flag = 1 AND is_primary_bank = 0)::INTEGER + (interbank_transfer_pct >= 0.3)::INTEGER AS acc FROM f) """
    + " UNION ALL ".join(f"SELECT c_custkey, '{t}' AS task, round(({p})::DOUBLE, 4) AS prediction, round(({c})::DOUBLE, 6) AS confidence, '{n}' AS rule FROM g" for t, (p, c, n) in _RULE_SQL.items())
    + f""" UNION ALL SELECT c_custkey, 'will_acquire_investments', CASE WHEN risk_grade IS NULL OR risk_grade < 3 THEN 0 ELSE {_INV}::INTEGER END, CASE WHEN risk_grade IS NULL OR risk_grade < 3 THEN 1 WHEN {_INV} THEN 0.55 ELSE 0.7 END,
          CASE WHEN risk_grade IS NULL THEN 'suitability_unassessed' WHEN risk_grade < 3 THEN 'suitability_block' ELSE 'investments_risk_asset' END FROM g""",
)
def _(spark, sf):
    out = r.rule_predict(rule_features(spark, sf), "c_custkey", list(r.RULES), {"will_acquire_investments": 3})
    return rounded(rounded(out.drop("contributing"), "confidence"), "prediction", digits=4)


@query(
    "layer_routing",
    "R10",
    """WITH t AS (SELECT p_partkey AS task, CASE p_partkey % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'multiclass' ELSE 'regression' END AS tt, p_size > 5 AS m FROM part),
       c AS (SELECT l_partkey AS task, bool_and(CASE WHEN l_returnflag = 'A' THEN l_discount <= 0.07 ELSE l_quantity >= 10 END) AS a, bool_or(CASE WHEN l_returnflag = 'A' THEN l_discount <= 0.07 ELSE l_quantity >= 10 END) AS o FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1)
       SELECT task, tt AS task_type, m AS has_model, CASE WHEN m AND p_retailprice / 1500 >= CASE tt WHEN 'binary' THEN 0.6 WHEN 'multiclass' THEN 2.0 ELSE 0.05 END AND coalesce(a, FALSE) THEN 1 WHEN m AND coalesce(o, TRUE) THEN 2 WHEN task IN (1, 2, 3, 40) THEN 3 ELSE 4 END AS layer
       FROM t JOIN part ON p_partkey = task LEFT JOIN c USING (task)""",
)
def _(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    k = F.col("p_partkey") % 3
    tasks = p.select(F.col("p_partkey").alias("task"), F.when(k == 0, "binary").when(k == 1, "multiclass").otherwise("regression").alias("task_type"), (F.col("p_size") > 5).alias("has_model"))
    gap = F.col("l_returnflag") == "A"
    checks = li.select(F.col("l_partkey").alias("task"), F.when(gap, "auc_gap").when(F.col("l_returnflag") == "N", "agreement").otherwise("other").alias("metric"), F.when(gap, F.col("l_discount")).otherwise(F.col("l_quantity")).alias("value"), (~gap).alias("higher_is_better"))
    teacher = p.select(F.col("p_partkey").alias("task"), (F.col("p_retailprice") / 1500).alias("quality"))
    return r.route(tasks, checks, teacher, {"auc_gap": 0.07, "agreement": 10.0}, [1, 2, 3, 40])


@query(
    "cold_start_defaults",
    "R11",
    """WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'web' WHEN 'click' THEN 'App' WHEN 'error' THEN 'branch' ELSE 'x' END AS ch, CASE WHEN user_id % 5 = 0 THEN '0' WHEN user_id % 5 = 1 THEN 'coldstart' END AS seg FROM events),
       p AS (SELECT *, (isodow(ts) - 1) * 4 + hour(ts) // 6 AS slot FROM e), z AS (SELECT sum(exp(-0.5 * pow(least(i, 28 - i) / 3.0, 2))) AS z FROM range(28) t(i))
       SELECT event_id, CASE WHEN seg = '0' THEN 'ANONYMOUS' ELSE 'COLDSTART' END AS class, 0.05::DOUBLE AS pred_ctr, CASE ch WHEN 'web' THEN 0.05 WHEN 'App' THEN 0.9 WHEN 'branch' THEN 0.05 ELSE 0.333333 END::DOUBLE AS pred_app, slot::INTEGER AS slot, round(1 / z, 6) AS at_slot,
         round(exp(-0.5 * pow(least(abs(3 - slot), 28 - abs(3 - slot)) / 3.0, 2)) / z, 6) AS at_3, 0.22::DOUBLE AS first_action, (SELECT string_agg(k::VARCHAR, ',' ORDER BY n DESC, k) FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, k LIMIT 5)) AS popular FROM p CROSS JOIN z""",
)
def _(spark, sf):
    t = F.col("event_type")
    e = table(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.when(t == "view", "web").when(t == "click", "App").when(t == "error", "branch").otherwise("x").alias("channel"), F.when(F.col("user_id") % 5 == 0, "0").when(F.col("user_id") % 5 == 1, "coldstart").alias("segment")
    )
    pop = [x["l_partkey"] for x in r.popularity(table(spark, sf, "lineitem"), "l_partkey", 5).collect()]
    out = r.cold_start(e.withColumn("class", r.cold_start_class()), "channel", "ts", {"ltv": 12.5}, {"life_stage": 6}, pop)
    slot = (F.weekday("ts") * 4 + F.floor(F.hour("ts") / 6)).cast("int")
    return out.select(
        "event_id", "class", "pred_ctr", F.get("pred_channel", F.lit(0)).alias("pred_app"), slot.alias("slot"), F.get("pred_timing", slot).alias("at_slot"), F.get("pred_timing", F.lit(3)).alias("at_3"), F.get("pred_nba", F.lit(0)).alias("first_action"), F.array_join("candidates", ",").alias("popular")
    )


@query("popular_items", "R12 O2", "SELECT l_partkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_partkey)::INTEGER AS rank FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 15")
def _(spark, sf):
    return r.popularity(table(spark, sf, "lineitem"), "l_partkey", 15, F.col("l_returnflag") == "A")


@query(
    "contactable_customers",
    "R13 J4",
    """WITH q AS (SELECT event_id, user_id AS customer_id, CASE event_id % 3 WHEN 0 THEN 'sms' WHEN 1 THEN 'email' ELSE 'push' END AS channel, ts AS at_ FROM events), c AS (SELECT o_custkey AS customer_id, CASE o_orderkey % 3 WHEN 0 THEN 'sms' WHEN 1 THEN 'email' ELSE 'push' END AS channel, o_orderdate AS d, o_orderkey, o_orderstatus <> 'F' AS ok, o_orderdate + INTERVAL 9 YEAR AS until_ FROM orders),
       l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY customer_id, channel ORDER BY d DESC, o_orderkey DESC) = 1), dnc AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
       w AS (SELECT event_id, CASE WHEN customer_id IN (SELECT c_custkey FROM dnc) THEN 'customer_on_dnc_list' WHEN channel <> 'email' AND (hour(at_ + INTERVAL 9 HOUR) >= 21 OR hour(at_ + INTERVAL 9 HOUR) < 8) THEN 'nighttime_restriction' WHEN NOT coalesce(ok, FALSE) OR until_ < at_ THEN 'no_active_consent' ELSE '' END AS reason FROM q LEFT JOIN l USING (customer_id, channel))
       SELECT event_id, reason, (reason = '')::INTEGER AS contactable FROM w""",
)
def _(spark, sf):
    def ch(c):
        return F.when(F.col(c) % 3 == 0, "sms").when(F.col(c) % 3 == 1, "email").otherwise("push").alias("channel")

    q = table(spark, sf, "events").select("event_id", F.col("user_id").alias("customer_id"), ch("event_id"), F.col("ts").alias("at"))
    o = table(spark, sf, "orders")
    consent = o.select(
        F.col("o_custkey").alias("customer_id"), ch("o_orderkey"), F.struct("o_orderdate", "o_orderkey").alias("recorded_at"), (F.col("o_orderstatus") != "F").alias("consented"), F.add_months("o_orderdate", 108).cast("timestamp").alias("expires_at")
    )
    dnc = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("customer_id"))
    return r.contactable(q, consent, dnc, exempt=["email"]).select("event_id", "reason", "contactable")


@query(
    "review_triage",
    "R16",
    f"""WITH t AS (SELECT event_id, CASE WHEN value > 60 THEN 3 WHEN value > 40 THEN 2 ELSE 1 END AS tier, {unit("event_id || ':42'")} AS u FROM events), q AS (SELECT tier, (tier >= 2 OR u < 0.05)::INTEGER AS queued FROM t)
        SELECT coalesce(tier, 0)::INTEGER AS tier, count(*) AS total, sum(queued)::BIGINT AS queued, round(avg(queued), 6) AS human_share FROM q GROUP BY ROLLUP (tier)""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("tier", F.when(F.col("value") > 60, 3).when(F.col("value") > 40, 2).otherwise(1))
    out = rounded(r.review_summary(r.review_triage(e, "event_id", "tier"), "tier"), "human_share")
    return out.withColumn("tier", F.coalesce("tier", F.lit(0)))


TEMPLATES = {c: f"Chosen for your {c.replace('_', ' ')}." for c in r.CATEGORIES}
_CAT = "CASE WHEN {0} LIKE 'spend\\_%' ESCAPE '\\' THEN 'spending_pattern' WHEN {0} LIKE 'card\\_%' ESCAPE '\\' THEN 'portfolio' WHEN {0} LIKE 'risk\\_%' ESCAPE '\\' THEN 'risk' ELSE ['spending_pattern', 'frequency_pattern', 'life_stage', 'benefit_match', 'portfolio', 'risk'][(((((('0x' || substr(md5({0}), 1, 8))::BIGINT % 6 * 4 + ('0x' || substr(md5({0}), 9, 8))::BIGINT) % 6 * 4 + ('0x' || substr(md5({0}), 17, 8))::BIGINT) % 6 * 4 + ('0x' || substr(md5({0}), 25, 8))::BIGINT) % 6) + 1)::INTEGER] END"
_FE = "fe AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'spend_' WHEN 1 THEN 'card_' ELSE 'x_' END || p_type AS f1, 'risk_' || p_brand AS f2, p_name AS f3 FROM part)"


@query(
    "template_reasons",
    "R15 J14",
    f"""WITH {_FE}, c AS (SELECT p_partkey, {_CAT.format('f1')} AS c1, {_CAT.format('f2')} AS c2, {_CAT.format('f3')} AS c3 FROM fe), x AS (SELECT *, concat_ws(', ', CASE WHEN c2 <> c1 THEN c2 END, CASE WHEN c3 <> c1 AND c3 <> c2 THEN c3 END) AS aux FROM c)
        SELECT p_partkey, c1 AS category, 'Chosen for your ' || replace(c1, '_', ' ') || '.' || CASE WHEN aux <> '' THEN ' Also: ' || aux || '.' ELSE '' END AS reason FROM x""",
)
def _(spark, sf):
    k = F.col("p_partkey") % 3
    f1 = F.concat(F.when(k == 0, "spend_").when(k == 1, "card_").otherwise("x_"), F.col("p_type"))
    p = table(spark, sf, "part").select("p_partkey", F.array(f1, F.concat(F.lit("risk_"), "p_brand"), F.col("p_name")).alias("feats"))
    return r.template_reasons(p, "feats", TEMPLATES, "Also:", "Chosen from your data.", 3).drop("feats")


@query(
    "reason_categories",
    "R15",
    f"""WITH {_FE}, c AS (SELECT {_CAT.format('f1')} AS category FROM fe), a AS (SELECT unnest(['spending_pattern', 'frequency_pattern', 'life_stage', 'benefit_match', 'portfolio', 'risk']) AS category) SELECT a.category, count(c.category) AS n FROM a LEFT JOIN c USING (category) GROUP BY 1""",
)
def _(spark, sf):
    k = F.col("p_partkey") % 3
    f1 = F.concat(F.when(k == 0, "spend_").when(k == 1, "card_").otherwise("x_"), F.col("p_type"))
    return r.category_distribution(table(spark, sf, "part").select(r.feature_category(f1).alias("category")))


@query(
    "case_search_decayed",
    "R14 G8",
    """WITH q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings), c AS (SELECT vec_id, embedding AS v, exp(-(vec_id % 200) * ln(2) / 90) AS w FROM embeddings),
       p AS (SELECT qid, vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) / sqrt(list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[]) * list_dot_product(c.v::DOUBLE[], c.v::DOUBLE[])) * w AS s FROM q CROSS JOIN c WHERE qid <> vec_id)
       SELECT qid, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id)::INTEGER AS rank FROM p QUALIFY rank <= 5""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    day = F.date_sub(F.lit("2024-06-01").cast("date"), F.col("vec_id").cast("int") % 200).cast("timestamp")
    corpus = s.age_decay(e.withColumn("at", day), "at", "2024-06-01", 90.0)
    out = s.knn(e.select(F.col("vec_id").alias("qid"), "embedding"), corpus, "qid", "vec_id", "embedding", 5, "decay")
    return rounded(out, "similarity")


_NEAR = """SELECT q.vec_id, c.vec_id AS match, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS s
       FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0"""


@query(
    "indexed_neighbours_all_cells",
    "R14 G8",
    f"""SELECT vec_id, match, round(s, 6) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, match)::INTEGER AS rank FROM ({_NEAR}) QUALIFY rank <= 10""",
)
def _(spark, sf):
    """Looking into all cells, the index answers exactly."""
    e = table(spark, sf, "embeddings")
    index = nb.build(e, "vec_id", "embedding")
    return rounded(nb.search(index, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, len(index.centres)), "similarity")


@query(
    "neighbour_index_recall",
    "R14 G8",
    f"""SELECT count(DISTINCT vec_id) AS queries, count(*) AS links, true AS recall_reached FROM (SELECT vec_id, match FROM ({_NEAR}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, match) <= 10)""",
)
def _(spark, sf):
    """Recall of the tuned index against the exact search, 0.9 or more, for every twentieth row against all rows."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = written(s.knn(q, e, "qid", "vec_id", "embedding", 10))
    told = nb.recall(nb.indexed_knn(q, e, "qid", "vec_id", "embedding", 10), exact, "qid", "vec_id")
    return told.select("queries", "links", (F.col("recall") >= 0.9).alias("recall_reached"))


_OFFERS = """o AS (SELECT DISTINCT o_custkey AS customer_id, l_partkey % (SELECT count(*) FROM embeddings) AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey), sc AS (SELECT customer_id, item_id, {u} AS score, v FROM o JOIN (SELECT vec_id, list_transform(e, lambda x: x / z) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS z FROM embeddings)) ON vec_id = item_id)"""


def offers(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "item_id")
    d = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("customer_id"), (F.col("l_partkey") % e.count()).alias("item_id")).distinct()
    sc = md5_unit(F.concat_ws(":", F.col("customer_id").cast("string"), F.col("item_id").cast("string")))
    pairs = written(d.withColumn("score", sc))  # read twice: for the largest group and for the ranking
    return pairs.join(e, "item_id").select("customer_id", "item_id", "score", "embedding")


def _cos(x, y):
    """Cosine of two vectors of unit length."""
    return f"list_dot_product({x}, {y})"


_MMR_BASE = f"""{_OFFERS.format(u=unit("customer_id || ':' || item_id"))}, n AS (SELECT *, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS rel FROM sc WINDOW w AS (PARTITION BY customer_id)),
  r1 AS (SELECT customer_id, item_id, v, score, 0.7 * rel AS mmr FROM n QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY 0.7 * rel DESC, score DESC, item_id) = 1),
  m2 AS (SELECT n.*, greatest({_cos('n.v', 'r1.v')}, 0) AS ms FROM n JOIN r1 USING (customer_id) WHERE n.item_id <> r1.item_id),
  r2 AS (SELECT customer_id, item_id, v, score, 0.7 * rel - (1 - 0.7) * ms AS mmr FROM m2 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY 0.7 * rel - (1 - 0.7) * ms DESC, score DESC, item_id) = 1),
  m3 AS (SELECT m2.* REPLACE (greatest(ms, {_cos('m2.v', 'r2.v')}) AS ms) FROM m2 JOIN r2 USING (customer_id) WHERE m2.item_id <> r2.item_id),
  r3 AS (SELECT customer_id, item_id, v, score, 0.7 * rel - (1 - 0.7) * ms AS mmr FROM m3 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY 0.7 * rel - (1 - 0.7) * ms DESC, score DESC, item_id) = 1)"""


@query(
    "diverse_offers_mmr",
    "O4",
    f"WITH {_MMR_BASE} SELECT customer_id, item_id, round(score, 6) AS score, round(mmr, 6) AS mmr, rank FROM (SELECT *, 1 AS rank FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3)",
)
def _(spark, sf):
    return rounded(s.mmr(offers(spark, sf), "customer_id", "item_id", "score", "embedding", 3), "score", "mmr")


def _det3(a, b, c, x, y, z):
    """Determinant of a symmetric 3 x 3 matrix with diagonal a, b, c and off-diagonal x (ab), y (ac), z (bc)."""
    return f"({a} * ({b} * {c} - {z} * {z}) - {x} * ({x} * {c} - {z} * {y}) + {y} * ({x} * {z} - {b} * {y}))"


_DPP = f"""{_OFFERS.format(u=unit("customer_id || ':' || item_id"))}, p AS (SELECT *, row_number() OVER w AS r, 0.7 * score / (max(score) OVER (PARTITION BY customer_id) + 1e-12) + (1 - 0.7) AS q FROM sc WINDOW w AS (PARTITION BY customer_id ORDER BY score DESC, item_id)),
  a1 AS (SELECT * FROM p WHERE r = 1),
  g2 AS (SELECT p.*, a1.q * p.q * {_cos('a1.v', 'p.v')} AS k1, a1.q * a1.q + 1e-8 AS d1 FROM p JOIN a1 USING (customer_id) WHERE p.r > 1),
  a2 AS (SELECT * FROM g2 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY d1 * (q * q + 1e-8) - k1 * k1 DESC, r) = 1),
  g3 AS (SELECT g2.*, {_det3('g2.d1', '(a2.q * a2.q + 1e-8)', '(g2.q * g2.q + 1e-8)', 'a2.k1', 'g2.k1', f"(a2.q * g2.q * {_cos('a2.v', 'g2.v')})")} AS det FROM g2 JOIN a2 USING (customer_id) WHERE g2.r <> a2.r),
  a3 AS (SELECT * FROM g3 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY det DESC, r) = 1)"""


@query(
    "diverse_offers_dpp",
    "O5",
    f"WITH {_DPP} SELECT customer_id, item_id, round(score, 6) AS score, 1 AS rank FROM a1 UNION ALL SELECT customer_id, item_id, round(score, 6), 2 FROM a2 UNION ALL SELECT customer_id, item_id, round(score, 6), 3 FROM a3",
)
def _(spark, sf):
    return rounded(s.dpp(offers(spark, sf), "customer_id", "item_id", "score", "embedding", 3), "score")


@query("distinct_pairs", "O6", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey").distinct()


@query("union_by_name", "U1", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, sf):
    a_ = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return a_.unionByName(table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
