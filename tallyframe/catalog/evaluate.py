"""Queries: metrics, off-policy estimates, uplift, experiments, distillation checks, explanations."""

from pyspark.sql import functions as F

from tallyframe.catalog.aggs import rounded
from tallyframe.catalog.monitoring import phi
from tallyframe.catalog.registry import PRED, predictions, query, table, unit
from tallyframe.functions.stats import md5_unit
from tallyframe.operators import evaluate as e
from tallyframe.operators import learners as ln


def draw(key, tag):
    return md5_unit(F.concat(F.col(key).cast("string"), F.lit(f":{tag}")))


_AUC = "(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))"
_RANK = "rank() OVER (PARTITION BY task ORDER BY {0}) + (count(*) OVER (PARTITION BY task, {0}) - 1) / 2"


@query(
    "binary_metrics",
    "E1",
    f"""WITH {PRED}, r AS (SELECT *, {_RANK.format('s1')} AS r, s1 >= 0.5 AS h, sum(y) OVER (PARTITION BY task ORDER BY s1 DESC) AS ctp, count(*) OVER (PARTITION BY task ORDER BY s1 DESC) AS ca, greatest(least(s1, 1 - 1e-15), 1e-15) AS q FROM pred)
        SELECT task, round({_AUC}, 6) AS auc_roc, round(sum(y * ctp / ca) / sum(y), 6) AS auc_pr, round(2 * count(*) FILTER (h AND y = 1) / (count(*) FILTER (h) + sum(y)), 6) AS f1, round(count(*) FILTER (h AND y = 1) / count(*) FILTER (h), 6) AS precision,
          round(count(*) FILTER (h AND y = 1) / sum(y), 6) AS recall, round(-avg(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss FROM r GROUP BY 1""",
)
def _(spark, sf):
    return rounded(e.binary_metrics(predictions(spark, sf), "y", "s1", ["task"]), "auc_roc", "auc_pr", "f1", "precision", "recall", "log_loss")


_MC = f"""mc AS (SELECT event_id AS id, [floor({unit("event_id || ':p0'")} * 1000) / 1000, floor({unit("event_id || ':p1'")} * 1000) / 1000, floor({unit("event_id || ':p2'")} * 1000) / 1000, floor({unit("event_id || ':p3'")} * 1000) / 1000] AS p,
  CASE WHEN event_id % 11 = 0 THEN -1 WHEN {unit("event_id || ':ok'")} < 0.5 THEN (event_id % 4)::INTEGER ELSE floor({unit("event_id || ':yy'")} * 4)::INTEGER END AS y FROM events)"""


def multiclass(spark, sf):
    probs = F.array(*[F.floor(draw("event_id", f"p{i}") * 1000) / 1000 for i in range(4)])
    y = F.when(F.col("event_id") % 11 == 0, -1).when(draw("event_id", "ok") < 0.5, (F.col("event_id") % 4).cast("int")).otherwise(F.floor(draw("event_id", "yy") * 4).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), probs.alias("p"), y.alias("y"))


_MCR = f"{_MC}, r AS (SELECT *, list_position(p, list_max(p)) - 1 AS pred, 1 + len(list_filter(p, lambda x: x > p[y + 1])) + len(list_filter(p[:y], lambda x: x = p[y + 1])) AS rk FROM mc WHERE y >= 0)"


@query("confusion_matrix", "E2", f"WITH {_MCR} SELECT y AS actual, pred::INTEGER AS predicted, count(*) AS n FROM r GROUP BY 1, 2")
def _(spark, sf):
    return e.confusion_matrix(multiclass(spark, sf), "y", e.argmax("p"))


@query(
    "multiclass_metrics",
    "E2",
    f"""WITH {_MCR}, c AS (SELECT k, count(*) FILTER (y = k) AS sup, count(*) FILTER (pred = k) AS pr, count(*) FILTER (y = k AND pred = k) AS hit FROM r CROSS JOIN (SELECT unnest(range(4)) AS k) GROUP BY 1), f AS (SELECT *, 2 * hit / (sup + pr) AS f1 FROM c)
        SELECT (SELECT round(avg((y = pred)::INTEGER), 6) FROM r) AS accuracy, (SELECT round(avg((rk <= 1)::INTEGER), 6) FROM r) AS top1_accuracy, (SELECT round(avg((rk <= 3)::INTEGER), 6) FROM r) AS top3_accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * sup) / sum(sup), 6) AS f1_weighted FROM f""",
)
def _(spark, sf):
    return rounded(e.multiclass_metrics(multiclass(spark, sf), "y", "p"), "accuracy", "top1_accuracy", "top3_accuracy", "f1_macro", "f1_weighted")


@query(
    "topk_class_metrics",
    "E3",
    f"WITH {_MCR} " + " UNION ALL ".join(f"SELECT {k} AS k, round(avg((rk <= {k})::INTEGER), 6) AS hit, round(avg((rk <= {k})::INTEGER) / {k}, 6) AS precision, round(avg(CASE WHEN rk <= {k} THEN 1 / log2(rk + 1) ELSE 0 END), 6) AS ndcg FROM r" for k in (1, 2, 3)),
)
def _(spark, sf):
    return rounded(e.topk_metrics(multiclass(spark, sf).where("y >= 0"), "y", "p", [1, 2, 3]), "hit", "precision", "ndcg")


@query(
    "regression_metrics",
    "E4",
    """SELECT l_returnflag, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae, round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)), 4) AS rmse, round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2,
       round(avg(abs(l_extendedprice - l_quantity * 1500) / (abs(l_extendedprice) + 1e-8)), 6) AS mape FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return rounded(rounded(e.regression_metrics(df, "l_extendedprice", "p", ["l_returnflag"]), "mae", "rmse", digits=4), "r2", "mape")


@query(
    "ranking_metrics",
    "E5",
    f"""WITH {PRED}, l AS (SELECT user_id, id, s2, CASE WHEN y = 1 THEN (id % 3)::INTEGER ELSE 0 END AS rel FROM pred), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s2 DESC, id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY rel DESC, id) AS i FROM l),
        c AS (SELECT *, sum((rel > 0)::INTEGER) OVER (PARTITION BY user_id ORDER BY r) AS seen FROM o),
        g AS (SELECT user_id, sum(rel / log2(r + 1)) FILTER (r <= 10) AS dcg, sum(rel / log2(i + 1)) FILTER (i <= 10) AS idcg, coalesce(sum(seen / r) FILTER (r <= 10 AND rel > 0) / count(*) FILTER (r <= 10 AND rel > 0), 0) AS ap, coalesce(1 / min(r) FILTER (rel > 0), 0) AS rr FROM c GROUP BY 1)
        SELECT round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, count(*) AS lists FROM g""",
)
def _(spark, sf):
    p = predictions(spark, sf).withColumn("rel", F.when(F.col("y") == 1, (F.col("id") % 3).cast("int")).otherwise(0))
    return rounded(e.ranking_metrics(p, "user_id", "id", "rel", "s2", 10), "ndcg", "map", "mrr")


_BANDIT = f"""b AS (SELECT event_id, user_id % 3 AS seg, value / 100 AS reward, 0.02 + 0.9 * {unit("event_id || ':log'")} AS p_log, {unit("event_id || ':new'")} AS p_new, value / 120 AS q, value / 90 AS qt, (event_id % 10 + 1)::INTEGER AS pos, ({unit("event_id || ':c'")} < 0.5 / (event_id % 10 + 1))::INTEGER AS click FROM events)"""


def bandit(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 3).alias("seg"), (F.col("value") / 100).alias("reward"), (0.02 + 0.9 * draw("event_id", "log")).alias("p_log"), draw("event_id", "new").alias("p_new"),
        (F.col("value") / 120).alias("q"), (F.col("value") / 90).alias("qt"), (F.col("event_id") % 10 + 1).cast("int").alias("pos"), (draw("event_id", "c") < 0.5 / (F.col("event_id") % 10 + 1)).cast("int").alias("click"),
    )


@query(
    "off_policy_estimates",
    "E6",
    f"""WITH {_BANDIT}, w AS (SELECT *, least(p_new / greatest(p_log, 1e-10), 10) AS w FROM b)
        SELECT seg, round(avg(w * reward), 6) AS ips, round(sum(w * reward) / sum(w), 6) AS snips, round(sum(w) ** 2 / sum(w * w), 4) AS ess, count(*) AS n, round(max(w), 6) AS max_weight, round(avg(qt + w * (reward - q)), 6) AS dr, round(avg(q + w * (reward - q)), 6) AS dr_logged FROM w GROUP BY 1""",
)
def _(spark, sf):
    b = bandit(spark, sf)
    full = e.ope(b, "reward", "p_log", "p_new", 10, "q", "qt", ["seg"])
    logged = e.ope(b, "reward", "p_log", "p_new", 10, "q", keys=["seg"]).select("seg", F.col("dr").alias("dr_logged"))
    return rounded(rounded(full.join(logged, "seg"), "ips", "snips", "dr", "dr_logged", "max_weight"), "ess", digits=4)


@query("bootstrap_interval", "E7")
def _(spark, sf):
    w = e.importance_weight("p_new", "p_log", 10)
    return e.bootstrap_ci(bandit(spark, sf), "event_id", w * F.col("reward"), w)


@query(
    "clip_sensitivity",
    "E8",
    f"""WITH {_BANDIT}, c AS (SELECT unnest([2, 5, 10, 20]) AS clip), w AS (SELECT clip, reward, least(p_new / greatest(p_log, 1e-10), clip) AS w FROM b CROSS JOIN c), g AS (SELECT clip::DOUBLE AS clip, sum(w * reward) / sum(w) AS s, sum(w) ** 2 / sum(w * w) / count(*) AS er, max(w) AS mw FROM w GROUP BY 1)
        SELECT clip, round(s, 6) AS snips, round(er, 6) AS ess_ratio, round(mw, 6) AS max_weight, (s > 0.1)::INTEGER AS go, (clip = coalesce((SELECT arg_max(clip, er) FROM g WHERE s > 0.1), 20))::INTEGER AS recommended FROM g""",
)
def _(spark, sf):
    return rounded(e.clip_sensitivity(bandit(spark, sf), "reward", "p_log", "p_new", [2, 5, 10, 20], 0.1), "snips", "ess_ratio", "max_weight")


@query(
    "go_no_go",
    "E9",
    f"""WITH {_BANDIT}, w AS (SELECT seg, reward, least(p_new / greatest(p_log, 1e-10), 10) AS w FROM b), g AS (SELECT seg, sum(w * reward) / sum(w) AS v, sum(w) ** 2 / sum(w * w) AS ess, count(*) AS n, stddev_samp(reward) / sqrt(count(*)) AS se FROM w GROUP BY 1)
        SELECT seg, round(v, 6) AS value, round((v - 0.12) / 0.12, 6) AS lift, round(ess / n, 6) AS ess_ratio, (v - 1.96 * se > 0.12)::INTEGER AS ci_ok, ((v - 0.12) / 0.12 > 0.02)::INTEGER AS lift_ok, (ess / n > 0.1)::INTEGER AS ess_ok, CASE WHEN v - 1.96 * se > 0.12 THEN 'Go' ELSE 'No-Go' END AS decision FROM g""",
)
def _(spark, sf):
    b = bandit(spark, sf)
    est = e.ope(b, "reward", "p_log", "p_new", 10, keys=["seg"]).join(b.groupBy("seg").agg((F.stddev_samp("reward") / F.sqrt(F.count("*"))).alias("se")), "seg")
    est = est.select("seg", F.col("snips").alias("value"), (F.col("snips") - 1.96 * F.col("se")).alias("ci_lower"), "ess", "n")
    return rounded(e.go_no_go(est, 0.12).drop("ci_lower", "ess", "n"), "value", "lift", "ess_ratio")


@query(
    "exposure_adjusted_rewards",
    "E10",
    f"WITH {_BANDIT} SELECT event_id, round(pow(0.7, pos - 1), 6) AS exam_prob, round(reward / pow(0.7, pos - 1), 6) AS reward_adjusted, round(pow(pos, -0.9), 6) AS reciprocal FROM b",
)
def _(spark, sf):
    out = e.adjust_rewards(bandit(spark, sf), "reward", "pos").withColumn("reciprocal", e.examination("pos", "reciprocal", 0.9))
    return rounded(out, "exam_prob", "reward_adjusted", "reciprocal").select("event_id", "exam_prob", "reward_adjusted", "reciprocal")


@query("position_bias", "E10", f"WITH {_BANDIT} SELECT pos, count(*) AS n, round(avg(click), 6) AS rate, round(avg(click) / (SELECT avg(click) FROM b WHERE pos = 1), 6) AS exam_prob FROM b GROUP BY 1")
def _(spark, sf):
    return rounded(e.estimate_position_bias(bandit(spark, sf), "click", "pos"), "rate", "exam_prob")


_UPLIFT = f"""u AS (SELECT o_orderkey AS id, floor({unit("o_orderkey || ':u'")} * 500) / 500 AS u, (o_orderkey % 2)::INTEGER AS t, CASE WHEN {unit("o_orderkey || ':o'")} < 0.2 + 0.4 * {unit("o_orderkey || ':u'")} * (o_orderkey % 2) THEN 1 ELSE 0 END AS y FROM orders)"""


def uplift(spark, sf):
    o = table(spark, sf, "orders")
    t = o.o_orderkey % 2
    return o.select(
        F.col("o_orderkey").alias("id"), (F.floor(draw("o_orderkey", "u") * 500) / 500).alias("u"), t.cast("int").alias("t"), (draw("o_orderkey", "o") < 0.2 + 0.4 * draw("o_orderkey", "u") * t).cast("int").alias("y"),
        draw("o_orderkey", "u").alias("x0"), (F.col("o_totalprice") / 100000).alias("x1"), F.month("o_orderdate").cast("double").alias("x2"),
    )


@query(
    "uplift_qini",
    "E13",
    f"""WITH {_UPLIFT}, c AS (SELECT *, row_number() OVER w AS pos, sum(t) OVER w AS nt, sum(t * y) OVER w AS yt, sum(1 - t) OVER w AS nc, sum((1 - t) * y) OVER w AS yc, count(*) OVER () AS n FROM u WINDOW w AS (ORDER BY u DESC, id ROWS UNBOUNDED PRECEDING)),
        p AS (SELECT sum(t * y) - sum((1 - t) * y) * sum(t) / sum(1 - t) AS p FROM u)
        SELECT round(avg(CASE WHEN nt = 0 OR nc = 0 THEN 0 ELSE yt - yc * nt / nc END) / any_value(p), 6) AS qini, """
    + ", ".join(f"round(avg(y) FILTER (t = 1 AND pos <= round({k} * n)) - avg(y) FILTER (t = 0 AND pos <= round({k} * n)), 6) AS uplift_at_{int(k * 100)}" for k in (0.1, 0.2, 0.3))
    + " FROM c CROSS JOIN p",
)
def _(spark, sf):
    return rounded(e.uplift_metrics(uplift(spark, sf), "u", "t", "y", "id"), "qini", "uplift_at_10", "uplift_at_20", "uplift_at_30")


_X = ["x0", "x1", "x2"]


@query("propensity_scores", "E11")
def _(spark, sf):
    u = uplift(spark, sf).withColumn("t", (F.col("u") + draw("id", "tt") > 1.0).cast("int"))
    return ln.propensity_score(u, ln.propensity_fit(u, _X, "t"), _X).select("id", "t", "propensity")


@query("uplift_t_and_x_learner", "E12")
def _(spark, sf):
    u = uplift(spark, sf)
    a = ln.t_learner(u, _X, "t", "y").select("id", F.col("uplift").alias("t_uplift"))
    return a.join(ln.x_learner(u, _X, "t", "y").select("id", F.col("uplift").alias("x_uplift")), "id")


@query(
    "variant_assignment",
    "E14",
    """WITH h AS (SELECT c_custkey, ('0x' || substr(sha256('s1:exp:' || c_custkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS h FROM customer) SELECT c_custkey, round(h, 9) AS hash_value, CASE WHEN h < 0.5 THEN 'control' WHEN h < 0.8 THEN 'b' ELSE 'c' END AS variant FROM h""",
)
def _(spark, sf):
    out = e.assign_variant(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "s1", "exp", {"control": 5, "b": 3, "c": 2})
    return rounded(out, "hash_value", digits=9)


_AB = """a AS (SELECT o_orderpriority AS task, CASE WHEN o_orderkey % 2 = 0 THEN 'control' ELSE 'b' END AS variant, (o_totalprice > 250000 - (o_orderkey % 2) * 12000)::INTEGER AS conv FROM orders),
  g AS (SELECT task, count(*) FILTER (variant = 'control') AS n0, count(*) FILTER (variant = 'b') AS n1, sum(conv) FILTER (variant = 'control') AS c0, sum(conv) FILTER (variant = 'b') AS c1 FROM a GROUP BY 1),
  z AS (SELECT *, c0 / n0 AS r0, c1 / n1 AS r1, (c1 / n1 - c0 / n0) / sqrt((c0 + c1) / (n0 + n1) * (1 - (c0 + c1) / (n0 + n1)) * (1 / n0 + 1 / n1)) AS z FROM g)"""


@query(
    "ab_significance",
    "E15",
    f"""WITH {_AB}, p AS (SELECT *, 2 * (1 - {phi('abs(z)')}) AS p FROM z), w AS (SELECT *, CASE WHEN p < 0.05 AND r1 > r0 THEN 'challenger' WHEN p < 0.05 THEN 'control' ELSE 'none' END AS winner FROM p)
        SELECT task, n0 AS control_n, n1 AS challenger_n, round(r0, 4) AS control_rate, round(r1, 4) AS challenger_rate, round((r1 - r0) / r0, 4) AS lift, round(p, 6) AS p_value, winner, CASE WHEN n0 < 100 OR n1 < 100 THEN 'wait' WHEN winner = 'challenger' THEN 'promote' WHEN winner = 'control' THEN 'keep' ELSE 'wait' END AS action FROM w""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    odd = F.col("o_orderkey") % 2
    a = o.select(F.col("o_orderpriority").alias("task"), F.when(odd == 0, "control").otherwise("b").alias("variant"), (F.col("o_totalprice") > 250000 - odd * 12000).cast("int").alias("conv"))
    return e.ab_significance(a, "variant", "conv", "control", "b", ["task"], 100)


@query(
    "paired_t_test",
    "E16",
    f"WITH {PRED}, d AS (SELECT task, s2 - s1 + 0.01 AS d FROM pred), g AS (SELECT task, count(*) AS n, avg(d) AS m, avg(d) / stddev_samp(d) * sqrt(count(*)) AS t FROM d GROUP BY 1) SELECT task, n, round(m, 6) AS mean_diff, round(t, 6) AS t, round(2 * (1 - {phi('least(z, 8)')}), 6) AS p_value FROM (SELECT *, (((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + 48 * a * a) + y + 3) / (48 * a * a) + 1) * sqrt(y) AS z FROM (SELECT *, n - 1.5 AS a, (n - 1.5) * ln(1 + t * t / (n - 1)) AS y FROM g))",
)
def _(spark, sf):
    p = predictions(spark, sf).withColumn("b", F.col("s2") + 0.01)
    return rounded(e.paired_t(p, "s1", "b", ["task"]), "mean_diff", "t", "p_value")


_MET = "m AS (SELECT event_type AS metric, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1)"


@query(
    "metric_competition",
    "E16",
    f"""WITH {_MET}, r AS (SELECT metric, a, b, CASE WHEN metric = 'error' THEN a - b ELSE b - a END / greatest(abs(a), 1e-10) AS rel FROM m), o AS (SELECT *, CASE WHEN metric = 'purchase' THEN rel >= 0.005 ELSE rel >= -0.02 END::INTEGER AS ok FROM r)
        SELECT metric, round(a, 6) AS champion, round(b, 6) AS challenger, round(rel, 6) AS relative, ok, (SELECT min(ok) FROM o) AS approved FROM o""",
)
def _(spark, sf):
    ev = table(spark, sf, "events")
    m = lambda k: ev.where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return rounded(e.compare_metrics(m(0), m(1), "purchase", ["error"]), "champion", "challenger")


@query(
    "run_comparison",
    "E17",
    """WITH f AS (SELECT user_id AS run, arg_max(value, (ts, event_id)) AS final FROM events WHERE event_type = 'view' GROUP BY 1) SELECT run, final, (final = (SELECT max(final) FROM f))::INTEGER AS best, round(final - (SELECT max(final) FROM f), 6) AS gap FROM f""",
)
def _(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "value", F.struct("ts", "event_id").alias("step"))
    return rounded(e.compare_runs(log, "view"), "gap")


@query(
    "run_parameter_diff",
    "E17",
    """WITH a AS (SELECT p_name AS param, max(p_size) AS a FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT p_name AS param, max(p_size) AS b FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
       SELECT param, coalesce(a, -1) AS a, coalesce(b, -1) AS b FROM a FULL JOIN b USING (param) WHERE a IS DISTINCT FROM b""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    one = lambda d: d.groupBy(F.col("p_name").alias("param")).agg(F.max("p_size").alias("value"))
    out = e.param_diff(one(p.where("p_partkey % 2 = 0")), one(p.where("p_partkey % 2 = 1")))
    return out.select("param", F.coalesce("a", F.lit(-1)).alias("a"), F.coalesce("b", F.lit(-1)).alias("b"))


_JSD = "(p * ln(p / m) + (1 - p) * ln((1 - p) / (1 - m)) + q * ln(q / m) + (1 - q) * ln((1 - q) / (1 - m))) / 2"


@query(
    "fidelity_binary",
    "E18",
    f"""WITH {PRED}, rk AS (SELECT y, s1, s2, {_RANK.format('s1').replace('PARTITION BY task ORDER', 'ORDER').replace('task, ', '')} AS r1, {_RANK.format('s2').replace('PARTITION BY task ORDER', 'ORDER').replace('task, ', '')} AS r2 FROM pred),
        j AS (SELECT p, q, (p + q) / 2 AS m FROM (SELECT least(greatest(s1, 1e-10), 1 - 1e-10) AS p, least(greatest(s2, 1e-10), 1 - 1e-10) AS q FROM pred)),
        b AS (SELECT len(list_filter([1 / 10, 2 / 10, 3 / 10, 4 / 10, 5 / 10, 6 / 10, 7 / 10, 8 / 10, 9 / 10], lambda x: x <= s2)) AS b, count(*) AS n, abs(avg(y) - avg(s2)) AS g FROM pred WHERE s2 < 1 GROUP BY 1),
        x AS (SELECT round(abs((sum(r1) FILTER (y = 1) - sum(r2) FILTER (y = 1)) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))), 6) AS auc_gap, round(avg(((s1 >= 0.5) = (s2 >= 0.5))::INTEGER), 6) AS agreement, (SELECT round(avg({_JSD}), 6) FROM j) AS jsd, round(corr(r1, r2), 6) AS ranking_corr,
          (SELECT round(sum(n * g) / (SELECT count(*) FROM pred), 6) FROM b) AS calibration_gap FROM rk)
        SELECT *, concat_ws(',', CASE WHEN auc_gap > 0.05 THEN 'auc_gap' END, CASE WHEN calibration_gap > 0.05 THEN 'calibration_gap' END) AS failures, concat_ws(',', CASE WHEN agreement < 0.85 THEN 'agreement' END, CASE WHEN jsd > 0.1 THEN 'jsd' END, CASE WHEN ranking_corr < 0.9 THEN 'ranking_corr' END) AS informational,
          (auc_gap <= 0.05 AND calibration_gap <= 0.05)::INTEGER AS passed FROM x""",
)
def _(spark, sf):
    return rounded(e.fidelity_binary(predictions(spark, sf), "s1", "s2", "y"), "auc_gap", "agreement", "jsd", "ranking_corr", "calibration_gap")


def _mcjsd():
    t = "list_sum(list_transform({0}, lambda x: greatest(x, 1e-10)))"
    return f"""list_sum(list_transform(range(1, 5), lambda i: (greatest(p[i], 1e-10) / {t.format('p')} * ln(greatest(p[i], 1e-10) / {t.format('p')} / ((greatest(p[i], 1e-10) / {t.format('p')} + greatest(s[i], 1e-10) / {t.format('s')}) / 2))
      + greatest(s[i], 1e-10) / {t.format('s')} * ln(greatest(s[i], 1e-10) / {t.format('s')} / ((greatest(p[i], 1e-10) / {t.format('p')} + greatest(s[i], 1e-10) / {t.format('s')}) / 2))) / 2))"""


def _mf1(col):
    return f"(SELECT avg(f1) FROM (SELECT k, 2 * count(*) FILTER (y = k AND {col} = k) / (count(*) FILTER (y = k) + count(*) FILTER ({col} = k)) AS f1 FROM z CROSS JOIN (SELECT unnest(range(4)) AS k) GROUP BY 1))"


@query(
    "fidelity_multiclass",
    "E18",
    f"""WITH {_MC}, z AS (SELECT y, p, s, list_position(p, list_max(p)) - 1 AS tp, list_position(s, list_max(s)) - 1 AS sp FROM (SELECT y, p, list_transform(p, lambda x, i: 0.6 * x + 0.4 * p[5 - i]) AS s FROM mc WHERE y >= 0)),
        x AS (SELECT round(avg((tp = sp)::INTEGER), 6) AS agreement, round(avg({_mcjsd()}), 6) AS jsd, round({_mf1('tp')}, 6) AS teacher_f1, round({_mf1('sp')}, 6) AS student_f1, round(abs({_mf1('tp')} - {_mf1('sp')}), 6) AS f1_macro_gap FROM z)
        SELECT *, CASE WHEN f1_macro_gap > 0.1 THEN 'f1_macro_gap' ELSE '' END AS failures, concat_ws(',', CASE WHEN agreement < 0.7 THEN 'agreement' END, CASE WHEN jsd > 0.1 THEN 'jsd' END) AS informational, (f1_macro_gap <= 0.1)::INTEGER AS passed FROM x""",
)
def _(spark, sf):
    m = multiclass(spark, sf).where("y >= 0")
    m = m.withColumn("s", F.zip_with("p", F.reverse("p"), lambda a, b: 0.6 * a + 0.4 * b))
    return rounded(e.fidelity_multiclass(m, "p", "s", "y"), "agreement", "jsd", "teacher_f1", "student_f1", "f1_macro_gap")


@query(
    "fidelity_regression",
    "E18",
    f"""WITH {PRED}, q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS a, quantile_cont(value * 0.9 + s1, [0.25, 0.5, 0.75]) AS b FROM pred), r AS (SELECT value AS t, value * 0.9 + s1 AS s, value * 0.95 + s2 AS y FROM pred),
        k AS (SELECT *, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS rt, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rs FROM r),
        x AS (SELECT round(avg((len(list_filter(a, lambda z: z <= t)) = len(list_filter(b, lambda z: z <= s)))::INTEGER), 6) AS quartile_agreement, round(abs(avg(abs(y - t)) - avg(abs(y - s))), 6) AS mae_gap, round(abs(sqrt(avg((y - t) ** 2)) - sqrt(avg((y - s) ** 2))), 6) AS rmse_gap, round(corr(rt, rs), 6) AS ranking_corr FROM k CROSS JOIN q)
        SELECT *, concat_ws(',', CASE WHEN mae_gap > 0.05 THEN 'mae_gap' END, CASE WHEN rmse_gap > 0.1 THEN 'rmse_gap' END) AS failures, concat_ws(',', CASE WHEN ranking_corr < 0.9 THEN 'ranking_corr' END, CASE WHEN quartile_agreement < 0.7 THEN 'quartile_agreement' END) AS informational, (mae_gap <= 0.05 AND rmse_gap <= 0.1)::INTEGER AS passed FROM x""",
)
def _(spark, sf):
    p = predictions(spark, sf).select(F.col("value").alias("t"), (F.col("value") * 0.9 + F.col("s1")).alias("s"), (F.col("value") * 0.95 + F.col("s2")).alias("y"))
    return rounded(e.fidelity_regression(p, "t", "s", "y"), "quartile_agreement", "mae_gap", "rmse_gap", "ranking_corr")


_GATE = "g AS (SELECT user_id AS task, CASE user_id % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'multiclass' ELSE 'regression' END AS task_type, round(avg(value) / 40, 6) AS value, (2 + user_id % 5)::INTEGER AS n_classes FROM events GROUP BY user_id)"


@query(
    "distil_gate",
    "E19",
    f"""WITH {_GATE} SELECT task, task_type, value, n_classes, CASE WHEN (task_type = 'binary' AND value > 0.6) OR (task_type = 'multiclass' AND value > 2 / n_classes) OR (task_type = 'regression' AND value > 0.05) THEN 'distil'
        WHEN (task_type = 'binary' AND value <= 0.52) OR (task_type = 'multiclass' AND value <= 1 / n_classes) OR (task_type = 'regression' AND value <= 0.01) THEN 'skip' ELSE 'hard_label' END AS route FROM g""",
)
def _(spark, sf):
    k = F.col("user_id") % 3
    g = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg("value") / 40, 6).alias("value"))
    g = g.select(F.col("user_id").alias("task"), F.when(k == 0, "binary").when(k == 1, "multiclass").otherwise("regression").alias("task_type"), "value", (F.col("user_id") % 5 + 2).cast("int").alias("n_classes"))
    return e.distil_gate(g)


@query(
    "student_targets",
    "E20",
    f"WITH {PRED} SELECT id, 'binary' AS kind, round(0.3 * y + 0.7 * s1, 6) AS target, 1::DOUBLE AS sample_weight FROM pred UNION ALL SELECT id, 'multiclass', y, 0.5 + 0.5 * (floor(s1 * 2) = y)::INTEGER FROM pred",
)
def _(spark, sf):
    p = predictions(spark, sf)
    a = e.student_target(p, "binary", "y", "s1", 0.3).select("id", F.lit("binary").alias("kind"), F.round("target", 6).alias("target"), "sample_weight")
    b = e.student_target(p.withColumn("c", F.floor(F.col("s1") * 2)), "multiclass", "y", "c", 0.3).select("id", F.lit("multiclass").alias("kind"), "target", "sample_weight")
    return a.unionByName(b)


@query(
    "linear_calibration",
    "E21",
    f"""WITH {PRED}, f AS (SELECT regr_slope(y, s1) AS a, regr_intercept(y, s1) AS b FROM pred WHERE {unit("id || ':cal'")} < 0.2) SELECT id, round(a * s1 + b, 6) AS calibrated FROM pred CROSS JOIN f""",
)
def _(spark, sf):
    out = e.linear_calibration(predictions(spark, sf), "s1", "y", draw("id", "cal") < 0.2)
    return out.select("id", F.round("calibrated", 6).alias("calibrated"))


@query("platt_calibration", "E21")
def _(spark, sf):
    return ln.platt_calibration(predictions(spark, sf), "s1", "y", draw("id", "cal") < 0.2).select("id", "s1", "calibrated")


@query(
    "platt_curve",
    "E21",
    f"""WITH RECURSIVE {PRED}, fit AS MATERIALIZED (SELECT s1 AS s, y::DOUBLE AS y FROM pred WHERE {unit("id || ':cal'")} < 0.2),
       newton(i, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
         UNION ALL SELECT i + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
           SELECT i, any_value(a) AS a, any_value(b) AS b, sum((y - p) * s) AS g1, sum(y - p) AS g2, sum(p * (1 - p) * s * s) AS h11, sum(p * (1 - p) * s) AS h12, sum(p * (1 - p)) AS h22
           FROM (SELECT i, a, b, s, y, 1 / (1 + exp(-(a * s + b))) AS p FROM newton CROSS JOIN fit) GROUP BY i) WHERE i < 12)
       SELECT (SELECT count(*) FROM pred) AS n, round(avg(1 / (1 + exp(-(a * s1 + b)))), 3) AS mean_calibrated, round(max(1 / (1 + exp(-(a * s1 + b)))) - min(1 / (1 + exp(-(a * s1 + b)))), 3) AS span FROM pred CROSS JOIN (SELECT a, b FROM newton WHERE i = 12)""",
)
def _(spark, sf):
    """Level and span of the fitted curve over all rows; the SQL finds it by Newton's method."""
    out = ln.platt_calibration(predictions(spark, sf), "s1", "y", draw("id", "cal") < 0.2)
    c = F.col("calibrated")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 3).alias("mean_calibrated"), F.round(F.max(c) - F.min(c), 3).alias("span"))


@query(
    "feature_selection",
    "E22",
    """WITH i AS (SELECT l_partkey AS feature, sum(l_quantity * l_quantity) AS imp FROM lineitem GROUP BY 1), r AS (SELECT feature, imp, row_number() OVER (ORDER BY imp DESC, feature) AS rank, sum(imp) OVER (ORDER BY imp DESC, feature ROWS UNBOUNDED PRECEDING) AS c, sum(imp) OVER () AS t FROM i)
       SELECT feature, rank, round(c / t, 9) AS cumulative, (((c - imp) / t < 0.6 OR rank <= 5) AND rank <= 900 OR feature IN (7, 8))::INTEGER AS selected FROM r""",
)
def _(spark, sf):
    imp = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("imp"))
    return rounded(e.select_features(imp, "feature", "imp", 0.6, 5, 900, [7, 8]).drop("imp"), "cumulative", digits=9)


@query("student_scores", "E23")
def _(spark, sf):
    p = predictions(spark, sf).withColumns({"x0": F.col("s1"), "x1": F.col("value"), "x2": F.hour("ts").cast("double")})
    p = e.student_target(p, "binary", "y", "s1", 0.3)
    model = ln.fit_student(p.where(draw("id", "tr") < 0.7), _X, "target", True, trees=10, depth=3)
    return ln.score_student(p, model, _X).select("id", "y", "student")


@query(
    "gate_statistics",
    "E24",
    f"""WITH {_MC}, w AS (SELECT 't' || (id % 3) AS task, list_transform(p, lambda x: (x + 0.00137) / list_sum(list_transform(p, lambda z: z + 0.00137))) AS w FROM mc)
        SELECT task, round(avg(-list_sum(list_transform(w, lambda x: x * ln(greatest(x, 1e-8))))), 6) AS entropy, round(avg(list_max(w)), 6) AS max_weight, round(avg(len(list_filter(w, lambda x: x > 0.05))), 6) AS active_experts, 4 AS n_experts, round(avg(-list_sum(list_transform(w, lambda x: x * ln(greatest(x, 1e-8))))) / ln(4), 6) AS entropy_ratio FROM w GROUP BY 1""",
)
def _(spark, sf):
    m = multiclass(spark, sf).withColumn("t", F.aggregate("p", F.lit(0.0), lambda s, x: s + (x + 0.00137)))
    m = m.select(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("task"), F.transform("p", lambda x: (x + 0.00137) / F.col("t")).alias("w"))
    return rounded(e.gate_stats(m, "task", "w"), "entropy", "max_weight", "active_experts", "entropy_ratio")


@query("canonical_correlation", "E25")
def _(spark, sf):
    v = table(spark, sf, "embeddings").select(F.slice("embedding", 1, 16).alias("a"), F.zip_with(F.slice("embedding", 9, 16), F.slice("embedding", 33, 16), lambda x, y: x + y).alias("b"))
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(ln.cca(v, "a", "b", 16, 16, 5))], "component int, correlation double")


@query(
    "canonical_correlation_plane",
    "E25",
    """WITH v AS (SELECT embedding[1]::DOUBLE AS a1, embedding[2]::DOUBLE AS a2, embedding[1]::DOUBLE + embedding[3] AS b1, embedding[4]::DOUBLE - embedding[2] AS b2 FROM embeddings),
       c AS (SELECT var_samp(a1) + 1e-4 AS p, covar_samp(a1, a2) AS q, var_samp(a2) + 1e-4 AS r, var_samp(b1) + 1e-4 AS s, covar_samp(b1, b2) AS t, var_samp(b2) + 1e-4 AS u, covar_samp(a1, b1) AS w, covar_samp(a1, b2) AS x, covar_samp(a2, b1) AS y, covar_samp(a2, b2) AS z FROM v),
       l AS (SELECT (r * w - q * y) / (p * r - q * q) AS l11, (r * x - q * z) / (p * r - q * q) AS l12, (p * y - q * w) / (p * r - q * q) AS l21, (p * z - q * x) / (p * r - q * q) AS l22,
               (u * w - t * x) / (s * u - t * t) AS m11, (u * y - t * z) / (s * u - t * t) AS m12, (s * x - t * w) / (s * u - t * t) AS m21, (s * z - t * y) / (s * u - t * t) AS m22 FROM c),
       e AS (SELECT l11 * m11 + l12 * m21 + l21 * m12 + l22 * m22 AS tr, (l11 * l22 - l12 * l21) * (m11 * m22 - m12 * m21) AS det FROM l)
       SELECT 1 AS component, round(sqrt(tr / 2 + sqrt(tr * tr / 4 - det)), 6) AS correlation FROM e UNION ALL SELECT 2, round(sqrt(tr / 2 - sqrt(tr * tr / 4 - det)), 6) FROM e""",
)
def _(spark, sf):
    """Two dimensions on either side; the SQL has the closed form."""
    x = lambda i: F.get("embedding", F.lit(i - 1)).cast("double")
    v = table(spark, sf, "embeddings").select(F.array(x(1), x(2)).alias("a"), F.array(x(1) + x(3), x(4) - x(2)).alias("b"))
    return spark.createDataFrame([(i + 1, round(c, 6)) for i, c in enumerate(ln.cca(v, "a", "b", 2, 2, 2))], "component int, correlation double")


@query(
    "explanation_faithfulness",
    "E26",
    """WITH x AS (SELECT vec_id, abs(embedding[1] - embedding[2] * 0.5)::DOUBLE AS c, (abs(embedding[1]) + abs(embedding[3]))::DOUBLE AS e FROM embeddings),
       d AS (SELECT vec_id, e1.embedding[1:32] AS a, e1.embedding[33:64] AS b FROM embeddings e1), s AS (SELECT greatest(list_dot_product(a::DOUBLE[], b::DOUBLE[]) / sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[]) * list_dot_product(b::DOUBLE[], b::DOUBLE[])), 0) AS c FROM d)
       SELECT round(greatest((corr(c, e) + 1) / 2, 0), 4) AS faithfulness, (SELECT round(avg(c), 4) FROM s) AS stability FROM x""",
)
def _(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    f = v.select(
        F.get("embedding", F.lit(0)).alias("o"), (F.get("embedding", F.lit(1)) * 0.5).alias("p"), F.slice("embedding", 1, 4).alias("a"), F.array(F.lit(1), F.lit(0), F.lit(1), F.lit(0)).alias("m")
    )
    s = e.stability(v.select(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b")), "a", "b")
    return e.faithfulness(f, "o", "p", "a", "m").withColumn("stability", s.scalar())


@query(
    "explanation_text_quality",
    "E26",
    """WITH f AS (SELECT doc_id, text, ['the', source, 'spend_total', lang, 'that'] AS feats FROM documents)
       SELECT doc_id, round((SELECT avg(CASE WHEN contains(lower(text), lower(x)) OR (starts_with(x, 'spend_') AND (contains(text, 'and') OR contains(text, 'der'))) THEN 1 ELSE 0 END) FROM (SELECT unnest(feats) AS x)), 6) AS fidelity FROM f""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("feats", F.array(F.lit("the"), F.col("source"), F.lit("spend_total"), F.col("lang"), F.lit("that")))
    return rounded(e.explanation_fidelity(d, "text", "feats", 5, {"spend_": ["and", "der"]}), "fidelity").select("doc_id", "fidelity")


@query(
    "explanation_completeness",
    "E26",
    """WITH c AS (SELECT 'reason' AS item, avg((contains(text, 'the') OR contains(text, 'le '))::INTEGER) AS c FROM documents UNION ALL SELECT 'contact', avg(contains(text, '@')::INTEGER) FROM documents) SELECT item, round(c, 6) AS coverage, (c < 0.5)::INTEGER AS missing FROM c""",
)
def _(spark, sf):
    return rounded(e.completeness(table(spark, sf, "documents"), "text", {"reason": ["the", "le "], "contact": ["@"]}), "coverage")


@query(
    "explanation_consistency",
    "E26",
    """WITH w AS (SELECT doc_id, lang, source, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents),
       p AS (SELECT len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS s FROM w a JOIN w b ON a.lang = b.lang AND a.source = b.source AND b.r BETWEEN a.r - 4 AND a.r - 1)
       SELECT round(avg(i / (s - i)), 6) AS consistency, count(*) AS pairs FROM p""",
)
def _(spark, sf):
    return rounded(e.consistency(table(spark, sf, "documents"), ["lang", "source"], "doc_id", "text", 4), "consistency")
