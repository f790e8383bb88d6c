"""Queries: interpretable scores, latent features and graphs."""

from pyspark.sql import functions as F

from tallyframe.catalog.aggs import rounded
from tallyframe.catalog.registry import TXN, query, table, transactions
from tallyframe.catalog.sequences import history
from tallyframe.operators import aggs as a
from tallyframe.operators import generators as g
from tallyframe.operators import learners as ln
from tallyframe.operators import latent as lt
from tallyframe.operators import normalise as n
from tallyframe.operators import ranks
from tallyframe.plans.session import written

MONTHS = [f"amt_{i:02d}" for i in range(1, 13)]
_PIV = "piv AS (SELECT user_id, " + ", ".join(f"coalesce(sum(amount) FILTER (month(day) = {i}), 0) AS amt_{i:02d}" for i in range(1, 13)) + " FROM txn GROUP BY 1)"


def pivot(spark, sf):
    return a.monthly_pivot(transactions(spark, sf), "user_id", "day", "amount").select("user_id", *MONTHS)


_I = "[" + ", ".join(MONTHS) + "]"
_FFT = "greatest(" + ", ".join(
    f"sqrt(pow(list_sum(list_transform({_I}, lambda x, i: x * cos(2 * pi() * {k} * (i - 1) / 6))), 2) + pow(list_sum(list_transform({_I}, lambda x, i: x * sin(2 * pi() * {k} * (i - 1) / 6))), 2))" for k in (1, 2, 3)
) + ")"


@query(
    "economics_scores",
    "G1",
    f"""WITH {TXN}, {_PIV}, b AS (SELECT user_id, {_I} AS inc, list_sum({_I}) AS i, amt_07 + amt_08 + amt_09 AS s, amt_10, amt_11, amt_12, amt_01, amt_06, (amt_01 + amt_02 + amt_03) / 3 AS h1, (amt_04 + amt_05 + amt_06) / 3 AS h2, {_FFT} AS fft,
         (amt_11 <> 0)::INTEGER AS inv, len(list_filter({_I} || [amt_07, amt_08, amt_09, amt_11], lambda x: x <> 0)) AS cnt, len(list_filter({_I} || [amt_07, amt_08, amt_09, amt_10, amt_11, amt_12], lambda x: x <> 0)) AS cnt_all, (amt_12 <> 0)::INTEGER AS dig FROM piv), m AS (SELECT avg(i) AS mi, avg(s) AS ms FROM b)
        SELECT user_id, round(CASE WHEN i <> 0 THEN list_stddev_pop(inc) / (i / 6) ELSE 0 END, 6) AS eco_salary_stability_index, round((amt_06 - amt_01) / 6, 4) AS eco_income_trend_slope, round(fft, 3) AS eco_income_seasonality,
          round(CASE WHEN i > 0 THEN -list_sum(list_transform(inc, lambda x: CASE WHEN x > 0 THEN x / i * ln(x / i) ELSE 0 END)) ELSE 0 END, 6) AS eco_income_diversification, round(CASE WHEN i <> 0 THEN (i - 0.5 * s) / i ELSE 0 END, 6) AS eco_disposable_income_ratio,
          round(CASE WHEN i <> 0 THEN greatest(i - s, 0) / i ELSE 0 END, 6) AS eco_savings_rate, round(CASE WHEN h1 <> 0 THEN (h2 - h1) / h1 ELSE 0 END, 6) AS eco_income_growth_rate, round((s - ms) / (i - mi), 4) AS eco_spending_elasticity, round(s / ms, 6) AS eco_budget_adherence,
          round(CASE WHEN i <> 0 THEN amt_10 / i ELSE 0 END, 6) AS eco_financial_stress_index, round(CASE WHEN cnt > 0 THEN inv / cnt ELSE 0 END, 6) AS eco_investment_propensity, round(CASE WHEN cnt_all > 0 THEN dig / cnt_all ELSE 0 END, 6) AS eco_digital_payment_ratio,
          CASE WHEN i - s > 1e-12 THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN inv > 0 THEN 0.5 ELSE 0 END::DOUBLE AS eco_financial_planning_score FROM b CROSS JOIN m""",
)
def _(spark, sf):
    p = pivot(spark, sf)
    out = g.economics(p, MONTHS, MONTHS[6:9], [MONTHS[9]], [MONTHS[11]], [MONTHS[9]], [MONTHS[10]], [MONTHS[11]], [MONTHS[9]], MONTHS)
    out = rounded(out, *[f"eco_{c}" for c in ("salary_stability_index", "income_diversification", "disposable_income_ratio", "savings_rate", "income_growth_rate", "budget_adherence", "financial_stress_index", "investment_propensity", "digital_payment_ratio")])
    out = rounded(rounded(out, "eco_income_trend_slope", "eco_spending_elasticity", digits=4), "eco_income_seasonality", digits=3)
    return out.drop(*MONTHS, "eco_income_volatility", "eco_liquidity_ratio", "eco_debt_service_ratio", "eco_cash_preference_index")


@query(
    "cyclical_time",
    "G2",
    """SELECT event_id, """
    + ", ".join(f"round({f}(2 * pi() * {e} / {m}), 6) AS cyc_{p}_{f}" for p, e, m in (("hour", "hour(ts)", 24), ("dayofweek", "(isodow(ts) - 1)", 7), ("month", "(month(ts) - 1)", 12), ("quarter", "(quarter(ts) - 1)", 4)) for f in ("sin", "cos"))
    + " FROM events",
)
def _(spark, sf):
    out = g.cyclical(table(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")
    # 0.0 + x turns a negative zero into a plain one
    return out.select("event_id", *[(F.round(c, 6) + 0.0).alias(c) for c in out.columns if c != "event_id"])


PARENTS = [0, 0, 1, 1, 2, 3, 3, 4]
L1 = lambda: F.when(F.col("mcc") <= 40, F.floor((F.col("mcc") - 1) / 8)).otherwise(-1)
L2 = lambda: F.when(F.col("mcc") <= 40, F.floor((F.col("mcc") - 1) / 5)).otherwise(-1)


@query(
    "merchant_hierarchy",
    "G3 G4",
    f"""WITH {TXN}, pr AS (SELECT [0, 0, 1, 1, 2, 3, 3, 4] AS p), e AS (SELECT user_id, mcc, amount, date_diff('day', DATE '1995-01-01', day) AS d, CASE WHEN mcc <= 40 THEN (mcc - 1) // 8 END AS a, CASE WHEN mcc <= 40 THEN (mcc - 1) // 5 END AS b FROM txn),
        w AS (SELECT *, amount * exp(-(max(d) OVER (PARTITION BY user_id) - d) / 180.0) AS w, row_number() OVER (PARTITION BY user_id ORDER BY amount) AS rk FROM e),
        x AS (SELECT w.*, 0.8 * cos(2 * pi() * a / 5) AS x1, 0.8 * sin(2 * pi() * a / 5) AS y1, 0.5 * cos(2 * pi() * p[b::INTEGER + 1] / 5) AS x2, 0.5 * sin(2 * pi() * p[b::INTEGER + 1] / 5) AS y2, least(a, 3) AS qq FROM w CROSS JOIN pr),
        s AS (SELECT user_id, count(*) AS n, count(DISTINCT mcc) AS nc, max(d) AS top, sum(w) AS wt, coalesce(sum(w * x1) / sum(w) FILTER (a IS NOT NULL), 0) AS l1_x, coalesce(sum(w * y1) / sum(w) FILTER (a IS NOT NULL), 0) AS l1_y, coalesce(sum(w * x2) / sum(w) FILTER (b IS NOT NULL), 0) AS l2_x, coalesce(sum(w * y2) / sum(w) FILTER (b IS NOT NULL), 0) AS l2_y,
          2 * sum(rk * amount) / (count(*) * sum(amount)) - (count(*) + 1) / count(*) AS gini, """
    + ", ".join(f"coalesce(sqrt(pow(sum(w * x1) FILTER (qq = {i}) / sum(w) FILTER (qq = {i}), 2) + pow(sum(w * y1) FILTER (qq = {i}) / sum(w) FILTER (qq = {i}), 2)) * sum(w) FILTER (qq = {i}) / sum(w), 0) AS sp{i + 1}" for i in range(4))
    + """ FROM x GROUP BY 1)
        SELECT user_id, round(l1_x, 6) AS l1_x, round(l1_y, 6) AS l1_y, round(sqrt(l1_x ** 2 + l1_y ** 2), 6) AS l1_radius, round(l2_x, 6) AS l2_x, round(l2_y, 6) AS l2_y, round(ln(1 + nc) / ln(501), 6) AS code_breadth, round(CASE WHEN n > 1 THEN (n - nc) / (n - 1) ELSE 0 END, 6) AS revisit_rate, round(CASE WHEN top > 0 THEN least(greatest(1 - top / (top + 1e-8), 0), 1) ELSE 0 END, 6) AS recency,
          round(least(greatest(gini, 0), 1), 6) AS spend_gini, round(least(greatest(((l1_x * l2_x + l1_y * l2_y) / ((sqrt(l1_x ** 2 + l1_y ** 2) + 1e-8) * (sqrt(l2_x ** 2 + l2_y ** 2) + 1e-8)) + 1) / 2, 0), 1), 5) AS coherence, round(sp1, 6) AS spread_1, round(sp2, 6) AS spread_2, round(sp3, 6) AS spread_3, round(sp4, 6) AS spread_4 FROM s""",
)
def _(spark, sf):
    t = written(transactions(spark, sf, part=True).select("user_id", "mcc", "amount", "day")).withColumn("d", F.datediff("day", F.lit("1995-01-01").cast("date")))
    out = g.merchant_hierarchy(t, "user_id", "mcc", "amount", "d", L1(), L2(), PARENTS, 5)
    cols = [c for c in out.columns if c not in ("user_id", "l1_angle", "l2_angle", "l2_radius")]
    out = out.select("user_id", *[(F.round(c, 5 if c == "coherence" else 6) + 0.0).alias(c) for c in cols])
    return out


@query("merchant_class_embedding", "G3")
def _(spark, sf):
    t = transactions(spark, sf, part=True).withColumn("cls", F.floor((F.col("mcc") - 1) / 5).cast("int"))
    return lt.merchant_svd(t.groupBy("user_id", "cls").agg(F.sum("amount").alias("w")), "user_id", "cls", "w", 10, 4)


@query(
    "spend_gini",
    "G4",
    f"""WITH {TXN}, r AS (SELECT user_id, amount, row_number() OVER (PARTITION BY user_id ORDER BY amount) AS rk FROM txn) SELECT user_id, round(2 * sum(rk * amount) / (count(*) * sum(amount)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY 1""",
)
def _(spark, sf):
    return rounded(ranks.gini(transactions(spark, sf), ["user_id"], "amount"), "gini")


_V12 = "[" + ", ".join(MONTHS) + "]"


@query(
    "bandit_row_scores",
    "G5",
    f"""WITH {TXN}, {_PIV} SELECT user_id, round(len(list_filter({_V12}, lambda x: x <> 0)) / 12, 6) AS bandit_exploration, round(CASE WHEN list_sum({_V12}) > 1e-10 THEN list_max({_V12}) / list_sum({_V12}) ELSE 0 END, 6) AS bandit_exploitation,
        round(list_avg({_V12}) + list_stddev_pop({_V12}), 4) AS bandit_ucb, round(list_max({_V12}) - list_avg({_V12}), 4) AS bandit_regret FROM piv""",
)
def _(spark, sf):
    out = g.bandit_scores(pivot(spark, sf), MONTHS).drop(*MONTHS)
    return rounded(rounded(out, "bandit_exploration", "bandit_exploitation"), "bandit_ucb", "bandit_regret", digits=4)


@query("gmm_soft_clusters", "G6")
def _(spark, sf):
    p = written(pivot(spark, sf))  # read by every pass of the fit
    cols = MONTHS
    return ln.gmm_transform(p, cols, ln.gmm_fit(p, cols, 3), 3).select("user_id", "cluster", "probs", "entropy")


@query("hmm_states", "G7")
def _(spark, sf):
    h = history(spark, sf)
    steps = F.transform(F.arrays_zip("amounts", "codes"), lambda z: F.array(F.log1p(z["amounts"]), z["codes"].cast("double") / 50))
    seqs = written(h.select("user_id", "segment", steps.alias("steps")))  # read once per fitting round
    return lt.hmm_decode(seqs, ["user_id", "segment"], "steps", lt.hmm_fit(seqs, "steps", 3, 2, rounds=4))


_KNN = """c AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  k AS (SELECT src, dst FROM c QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 4), e AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k UNION SELECT vec_id, vec_id FROM embeddings), dg AS (SELECT src, count(*) AS deg FROM e GROUP BY 1),
  ed AS (SELECT e.src, e.dst, 1 / sqrt(x.deg * y.deg) AS w FROM e JOIN dg x ON x.src = e.src JOIN dg y ON y.src = e.dst)"""


@query("knn_similarity_graph", "G8", f"WITH {_KNN} SELECT src, dst, round(w, 6) AS w FROM ed")
def _(spark, sf):
    return rounded(lt.knn_graph(table(spark, sf, "embeddings"), "vec_id", "embedding", 4), "w")


@query(
    "graph_propagation",
    "G8",
    f"""WITH {_KNN}, x AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT src, d, sum(w * x) AS x FROM ed JOIN x ON x.vec_id = ed.dst GROUP BY 1, 2), m AS (SELECT x.vec_id, x.d, (x.x + p.x) / 2 AS x FROM x JOIN p ON p.src = x.vec_id AND p.d = x.d),
        nn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM m GROUP BY 1), th AS (SELECT vec_id, n, (exp(n) - 1) / (exp(n) + 1) AS t FROM nn)
        SELECT vec_id, round(t, 6) AS embedding_norm, round(0.5 * ln((1 + least(t, 0.999)) / (1 - least(t, 0.999))), 6) AS embedding_depth, round((SELECT sum(x) FROM m WHERE m.vec_id = th.vec_id) / n * t, 6) AS coord_sum FROM th""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    out = lt.poincare(lt.propagate(lt.knn_graph(e, "vec_id", "embedding", 4), e, "vec_id", "embedding", 1), "embedding")
    out = out.withColumn("coord_sum", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)).drop("embedding")
    return rounded(out, "embedding_norm", "embedding_depth", "coord_sum")


def cloud(spark, sf):
    t = transactions(spark, sf, part=True)
    return t.select("user_id", "order_id", "line", "item", (F.col("amount") / 10000).alias("x"), (F.col("mcc") / 10).alias("y"), F.month("day").cast("double").alias("z"))


@query("entity_persistence", "G9")
def _(spark, sf):
    return lt.h0_persistence(cloud(spark, sf), "user_id", ["x", "y", "z"], ["order_id", "line", "item"])


@query("population_persistence", "G10")
def _(spark, sf):
    return lt.global_h0(cloud(spark, sf), "user_id", ["x", "y", "z"])


@query(
    "window_transitions",
    "G11",
    """WITH q AS (SELECT user_id, (day(ts) - 1) // 5 AS win, count(*) AS n, quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS q FROM events GROUP BY 1, 2), l AS (SELECT *, lag(q) OVER w AS p FROM q WINDOW w AS (PARTITION BY user_id ORDER BY win)),
       d AS (SELECT *, (abs(q[1] - p[1]) + abs(q[2] - p[2]) + abs(q[3] - p[3]) + abs(q[4] - p[4]) + abs(q[5] - p[5])) / 5 AS m, (q[5] - q[1]) - (p[5] - p[1]) AS t FROM l), b AS (SELECT avg(m) AS base FROM d),
       r AS (SELECT *, sum((m IS NOT NULL)::INTEGER) OVER w AS seen, sum((m > 15)::INTEGER) OVER w AS big FROM d WINDOW w AS (PARTITION BY user_id ORDER BY win))
       SELECT user_id, win::INTEGER AS win, n, round(m, 6) AS magnitude, sign(t)::DOUBLE AS direction, round(1 / (1 + exp(-m / base + 2)), 6) AS probability, round(big / seen, 6) AS frequency, round(1 - exp(-least(n, 10) / 10), 6) AS confidence FROM r CROSS JOIN b WHERE m IS NOT NULL""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.floor((F.dayofmonth("ts") - 1) / 5).cast("int").alias("win"), "value")
    return rounded(g.phase_transition(e, ["user_id"], "win", "value", 10, 15.0, 5), "magnitude", "probability", "frequency", "confidence")


@query(
    "saturation_scores",
    "G12",
    f"""WITH {TXN}, {_PIV}, s AS (SELECT *, list_avg({_V12}) AS s, list_stddev_pop({_V12}) AS v FROM piv), f AS (SELECT 1 / regr_slope(s / v, s) AS vmax, regr_intercept(s / v, s) / regr_slope(s / v, s) AS km0 FROM s WHERE s > 0 AND v > 0), k AS (SELECT vmax, greatest(km0, 1e-6) AS km FROM f)
        SELECT user_id, round(vmax * s / (km + s + 1e-10), 2) AS kin_adoption_velocity, round(s / (km + s + 1e-10), 6) AS kin_saturation_ratio, round(least(greatest(km / (s + 1e-10), 0), 10), 6) AS kin_half_saturation_time FROM s CROSS JOIN k""",
)
def _(spark, sf):
    from tallyframe.functions.stats import array_mean, array_std

    p = pivot(spark, sf)
    v = F.array(*MONTHS)
    vmax, km = g.saturation_fit(p.select(array_mean(v).alias("s"), array_std(v).alias("v")), "s", "v")
    out = g.saturation(p, MONTHS, vmax, km).drop(*MONTHS)
    return rounded(rounded(out, "kin_adoption_velocity", digits=2), "kin_saturation_ratio", "kin_half_saturation_time")


_WV = "[" + ", ".join(f"{m} / 100000" for m in MONTHS) + "]"
_FR, _PH = [0.1 + 0.15 * i for i in range(12)], [0.5 * i for i in range(12)]
_RE = " + ".join(f"abs(v[{i + 1}]) * cos({f} * v[{i + 1}] + {p})" for i, (f, p) in enumerate(zip(_FR, _PH)))
_IM = _RE.replace("cos(", "sin(")


def _mag(k):
    return f"sqrt(pow(list_sum(list_transform(v, lambda x, i: x * cos(2 * pi() * {k} * (i - 1) / 12))), 2) + pow(list_sum(list_transform(v, lambda x, i: x * sin(2 * pi() * {k} * (i - 1) / 12))), 2))"


@query(
    "wave_interference",
    "G13",
    f"""WITH {TXN}, {_PIV}, b AS (SELECT user_id, {_WV} AS v FROM piv), c AS (SELECT user_id, list_sum(v) AS t, {_RE} AS re, {_IM} AS im, [{', '.join(_mag(k) for k in range(1, 7))}] AS m FROM b), d AS (SELECT *, sqrt(re * re + im * im) AS amp, list_sum(list_transform(m, lambda x: x * x)) AS pw FROM c)
        SELECT user_id, round(amp, 6) AS wave_amplitude, round(atan2(im, re), 5) AS wave_phase, round(CASE WHEN t > 0 THEN amp / t ELSE 0 END, 6) AS wave_constructive, round(CASE WHEN t > 0 THEN 1 - amp / t ELSE 0 END, 6) AS wave_destructive, round(list_position(list_transform(m, lambda x: round(x, 6)), round(list_max(m), 6)) / 12, 6) AS wave_dominant_frequency,
          round(CASE WHEN pw > 0 THEN list_sum(list_transform(m, lambda x: -x * x / pw * ln(x * x / pw + 1e-12))) ELSE 0 END, 5) AS wave_spectral_entropy FROM d""",
)
def _(spark, sf):
    p = pivot(spark, sf).select("user_id", *[(F.col(c) / 100000).alias(c) for c in MONTHS])
    out = g.interference(p, MONTHS, _FR, _PH).drop(*MONTHS)
    out = rounded(rounded(out, "wave_amplitude", "wave_constructive", "wave_destructive", "wave_dominant_frequency"), "wave_phase", "wave_spectral_entropy", digits=5)
    return out.select("user_id", *[(F.col(c) + 0.0).alias(c) for c in out.columns if c != "user_id"])


@query(
    "repeat_event_scores",
    "G14",
    f"""WITH {TXN}, {_PIV}, b AS (SELECT user_id, {_V12} AS v, [{', '.join(f'abs({b} - {a})' for a, b in zip(MONTHS, MONTHS[1:]))}] AS d FROM piv),
        k AS (SELECT user_id, v, d, list_transform(range(50), lambda i: list_min(v) + (list_max(v) - list_min(v)) * i / 49) AS gr FROM b),
        p AS (SELECT *, list_transform(gr, lambda z: list_sum(list_transform(v, lambda x: exp(-0.5 * pow((z - x) / 20000, 2)))) / (12 * 20000 * sqrt(2 * pi()))) AS dn FROM k)
        SELECT user_id, round(list_avg(v) / 50000, 9) AS rep_flag, round(list_avg(d) * 1.5, 5) AS rep_boost, round(CASE WHEN list_avg(d) > 0 THEN list_stddev_pop(d) / list_avg(d) ELSE 0 END, 6) AS rep_clustering, round(pow(0.85, 12), 9) AS rep_decay, round(list_max(dn) * 1000, 6) AS rep_peak FROM p""",
)
def _(spark, sf):
    out = g.repeat_event_scores(pivot(spark, sf), MONTHS, 50000.0, 20000.0)
    out = out.select("user_id", F.round("rep_flag", 9).alias("rep_flag"), F.round("rep_boost", 5).alias("rep_boost"), F.round("rep_clustering", 6).alias("rep_clustering"), F.round("rep_decay", 9).alias("rep_decay"), F.round(F.col("rep_peak_density") * 1000, 6).alias("rep_peak"))
    return out


@query(
    "domain_interpretation",
    "G15 J13",
    f"""WITH {TXN}, {_PIV}, b AS (SELECT user_id, list_transform({_V12}, lambda x: least(x / 100000, 1)) AS a, list_transform([amt_07, amt_08, amt_09, amt_10, amt_11, amt_12], lambda x: least(x / 200000, 1)) AS b FROM piv)
        SELECT user_id, round(list_avg(a), 4) AS early_score, round(greatest(1 - list_stddev_pop(a), 0), 4) AS early_confidence, CASE WHEN list_avg(a) < 0.3 THEN 'low' WHEN list_avg(a) < 0.6 THEN 'mid' ELSE 'high' END AS early_label,
          round(list_avg(b), 4) AS late_score, round(greatest(1 - list_stddev_pop(b), 0), 4) AS late_confidence, CASE WHEN list_avg(b) < 0.5 THEN 'low' ELSE 'high' END AS late_label FROM b""",
)
def _(spark, sf):
    p = pivot(spark, sf)
    p = p.select("user_id", *[F.least(F.col(c) / scale, F.lit(1.0)).alias(f"{name}_{c}") for name, scale, months in (("early", 100000, MONTHS), ("late", 200000, MONTHS[6:])) for c in months])
    bands = {"early": [(0.0, 0.3, "low"), (0.3, 0.6, "mid"), (0.6, 1.0, "high")], "late": [(0.0, 0.5, "low"), (0.5, 1.0, "high")]}
    domains = {"early": [f"early_{c}" for c in MONTHS], "late": [f"late_{c}" for c in MONTHS[6:]]}
    return g.interpret_domains(p, domains, bands).drop(*domains["early"], *domains["late"])


@query(
    "rule_facts",
    "G16",
    "SELECT p_partkey, concat_ws('|', CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice < 950 AND p_type = 'SMALL' THEN 'cheap small' END, CASE WHEN p_brand LIKE '%1' THEN 'first line' END) AS facts FROM part",
)
def _(spark, sf):
    rules = [("large", "p_size > 40", ["p_size"]), ("absent", "weight > 2", ["weight"]), ("cheap small", "p_retailprice < 950 AND p_type = 'SMALL'", ["p_retailprice", "p_type"]), ("first line", "p_brand LIKE '%1'", ["p_brand"])]
    return g.extract_facts(table(spark, sf, "part"), rules).select("p_partkey", F.array_join("facts", "|").alias("facts"))


@query(
    "context_richness",
    "G17",
    """WITH o AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS tp, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01') AS rc, date_diff('day', max(o_orderdate)::DATE, DATE '2001-11-04') AS ld FROM orders GROUP BY 1)
       SELECT c_custkey, CASE WHEN coalesce(tp, 0) >= 4 AND coalesce(rc, 0) >= 1 THEN 'rich' WHEN coalesce(ld, 999) <= 180 THEN 'moderate' ELSE 'sparse' END AS richness, CASE WHEN coalesce(tp, 0) >= 4 AND coalesce(rc, 0) >= 1 THEN 0 WHEN coalesce(ld, 999) <= 180 THEN 1 ELSE 2 END AS priority FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_distinct("o_orderpriority").alias("total_products"), F.sum((F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).cast("int")).alias("recent_consultation_count"),
        F.datediff(F.lit("2001-11-04").cast("date"), F.max(F.to_date("o_orderdate"))).alias("last_transaction_days"),
    )
    c = table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return g.classify_richness(c, products_min=4).select("c_custkey", "richness", "priority")


@query(
    "adoption_curve",
    "G19",
    """WITH f AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events), z AS (SELECT event_id, (value - m) / s AS z FROM events CROSS JOIN f)
       SELECT event_id, round(1 / (1 + exp(-z)), 6) AS sir_infected, round(1 / (1 + exp(-(z - 1))), 6) AS sir_recovered, round(least(greatest(1 - 1 / (1 + exp(-z)) - 1 / (1 + exp(-(z - 1))), 0), 1), 6) AS sir_susceptible, round(ln(4) / 0.3, 6) AS sir_peak_time FROM z""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    m, s = n.fit_standard(e, ["value"])["value"]
    out = g.sir_scores(e, "value", m, s).drop("value", "sir_r0", "sir_duration")
    return rounded(out, "sir_infected", "sir_recovered", "sir_susceptible", "sir_peak_time")


@query(
    "feature_group_ranges",
    "G18",
    f"""WITH {TXN}, {_PIV} SELECT 'winter' AS name, 0 AS first, 3 AS last, round(sum(amt_12 + amt_01 + amt_02), 2) AS total FROM piv UNION ALL SELECT 'summer', 3, 6, round(sum(amt_06 + amt_07 + amt_08), 2) FROM piv""",
)
def _(spark, sf):
    p = pivot(spark, sf).drop("user_id")
    groups = {"winter": ["amt_12", "amt_01", "amt_02"], "summer": ["amt_06", "amt_07", "amt_08"]}
    columns = g.order_by_group(p.columns, groups)
    ranges = g.group_ranges(columns, groups)
    sums = p.select(columns).agg(*[F.sum(c).alias(c) for c in columns])
    total = lambda lo, hi: F.round(sum((F.col(c) for c in columns[lo + 1 : hi]), F.col(columns[lo])), 2)
    rows = [F.struct(F.lit(k).alias("name"), F.lit(lo).alias("first"), F.lit(hi).alias("last"), total(lo, hi).alias("total")) for k, (lo, hi) in ranges.items()]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
