"""Model metrics, off-policy estimates, uplift and experiment decisions.

Metrics are sums over rows, or sums over value tables where ranks are involved; none sorts the whole
log in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.stats import dot, norm_cdf, safe_div, t_two_sided
from tallyframe.operators.drift import binary_jsd
from tallyframe.operators.monitoring import two_proportion_p
from tallyframe.operators.ranks import auc, average_precision, spearman
from tallyframe.plans.quantiles import exact_quantiles
from tallyframe.plans.session import GROUP_ROWS
from tallyframe.plans.skew import lookback, running


def _join_all(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Combine one-row-per-key results; without keys every part has exactly one row."""
    if keys:
        return reduce(lambda a, b: a.join(b, list(keys)), parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.select("*", *[p.select(c).scalar().alias(c) for c in p.columns])
    return out


def binary_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """auc_roc, auc_pr, f1, precision, recall, log_loss per key."""
    keys = list(keys)
    hard = F.col(p) >= threshold
    pos = F.col(y) == 1
    q = F.greatest(F.least(F.col(p).cast("double"), F.lit(1 - 1e-15)), F.lit(1e-15))
    c = df.groupBy(*keys).agg(
        F.sum((hard & pos).cast("double")).alias("_tp"),
        F.sum((hard & ~pos).cast("double")).alias("_fp"),
        F.sum((~hard & pos).cast("double")).alias("_fn"),
        (-F.avg(F.when(pos, F.ln(q)).otherwise(F.ln(1 - q)))).alias("log_loss"),
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    c = c.select(*keys, safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"), safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"), "log_loss")
    return _join_all([auc(df, keys, y, p, "auc_roc"), average_precision(df, keys, y, p, "auc_pr"), c], keys)


def argmax(probs: str | Column) -> Column:
    """0-based position of the first largest element."""
    c = F.col(probs) if isinstance(probs, str) else probs
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def confusion_matrix(df: DataFrame, y: str, pred: str | Column) -> DataFrame:
    p = F.col(pred) if isinstance(pred, str) else pred
    return df.where(F.col(y) >= 0).groupBy(F.col(y).cast("int").alias("actual"), p.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def f1_by_class(confusion: DataFrame) -> DataFrame:
    """(class, support, f1) over all classes that occur as label or prediction."""
    cells = confusion.select(F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")),
    )).alias("x")).select("x.*")
    g = cells.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("_p"), F.sum("hit").alias("_h"))
    return g.select("class", "support", safe_div(2.0 * F.col("_h"), F.col("support") + F.col("_p")).alias("f1"))


def multiclass_metrics(df: DataFrame, y: str, probs: str, ks: Sequence[int] = (1, 3)) -> DataFrame:
    """One row: accuracy, f1_macro, f1_weighted and top-k accuracy; labels below 0 are left out."""
    ok = df.where(F.col(y) >= 0)
    c = f1_by_class(confusion_matrix(ok, y, argmax(probs)))
    f1 = c.agg(F.avg("f1").alias("f1_macro"), safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))
    rank = true_class_rank(y, probs)
    base = ok.agg(F.avg((argmax(probs) == F.col(y)).cast("double")).alias("accuracy"), *[F.avg((rank <= k).cast("double")).alias(f"top{k}_accuracy") for k in ks])
    return _join_all([base, f1], [])


def true_class_rank(y: str, probs: str) -> Column:
    """1-based rank of the labelled class; equal scores rank by class number."""
    own = F.get(F.col(probs), F.col(y))
    above = F.size(F.filter(F.col(probs), lambda x: x > own))
    tied = F.size(F.filter(F.transform(F.col(probs), lambda x, i: (x == own) & (i < F.col(y))), lambda b: b))
    return 1 + above + tied


def topk_metrics(df: DataFrame, y: str, probs: str, ks: Sequence[int]) -> DataFrame:
    """(k, hit, precision, ndcg) for one relevant class per row; accuracy and recall equal hit."""
    r = true_class_rank(y, probs)
    base = df.select(r.alias("r"))
    wide = base.agg(*[F.struct(F.avg((F.col("r") <= k).cast("double")).alias("hit"), F.avg(F.when(F.col("r") <= k, 1.0 / F.log2(F.col("r") + 1.0)).otherwise(0.0)).alias("ndcg")).alias(f"k{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}.hit").alias("hit"), (F.col(f"k{k}.hit") / k).alias("precision"), F.col(f"k{k}.ndcg").alias("ndcg")) for k in ks])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def regression_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    e = F.col(y) - F.col(p)
    g = df.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_ss"),
        (F.var_pop(y) * F.count(y)).alias("_tot"),
        F.avg(F.abs(e) / (F.abs(y) + 1e-8)).alias("mape"),
    )
    return g.select(*keys, "mae", "rmse", (1 - safe_div(F.col("_ss"), F.col("_tot"))).alias("r2"), "mape")


def ranking_metrics(df: DataFrame, list_id: str, item: str, rel: str, score: str, k: int) -> DataFrame:
    """One row: mean NDCG@k, MAP@k and MRR over lists; equal scores rank by item.

    Only the best k rows by score and by relevance of each list are ordered; the first relevant
    position is a count of better scores, so a very long list is never sorted whole.
    """
    by_score = F.row_number().over(Window.partitionBy(list_id).orderBy(F.desc(score), item))
    by_rel = F.row_number().over(Window.partitionBy(list_id).orderBy(F.desc(rel), item))
    top = df.select(list_id, rel, by_score.alias("r")).where(F.col("r") <= k)
    best = df.select(list_id, rel, by_rel.alias("r")).where(F.col("r") <= k)
    gain = F.col(rel) / F.log2(F.col("r") + 1.0)
    hit = (F.col(rel) > 0).cast("double")
    top = top.withColumn("_seen", F.sum(hit).over(Window.partitionBy(list_id).orderBy("r")))
    a = top.groupBy(list_id).agg(F.sum(gain).alias("dcg"), safe_div(F.sum(hit * F.col("_seen") / F.col("r")), F.sum(hit)).alias("ap"))
    b = best.groupBy(list_id).agg(F.sum(gain).alias("idcg"))
    first = df.where(F.col(rel) > 0).groupBy(list_id).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))).alias("_f"))
    better = df.join(first, list_id).where(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i")) <= F.col("_f")).groupBy(list_id).agg((1.0 / F.count(F.lit(1))).alias("rr"))
    out = a.join(b, list_id).join(better, list_id, "left")
    return out.agg(F.avg(safe_div(F.col("dcg"), F.col("idcg"))).alias("ndcg"), F.avg("ap").alias("map"), F.avg(F.coalesce("rr", F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("lists"))


def importance_weight(p_new: str, p_log: str, clip: float, floor: float = 1e-10) -> Column:
    return F.greatest(F.least(F.col(p_new) / F.greatest(F.col(p_log), F.lit(floor)), F.lit(float(clip))), F.lit(0.0))


def ope(df: DataFrame, reward: str, p_log: str, p_new: str, clip: float, q_logged: str | None = None, q_target: str | None = None, keys: Sequence[str] = (), floor: float = 1e-10) -> DataFrame:
    """ips, snips, ess, n, max weight, and the doubly robust value where reward predictions are given.

    With only the logged prediction the correction is added to that prediction itself.
    """
    w, r = importance_weight(p_new, p_log, clip, floor), F.col(reward)
    aggs = [
        F.avg(w * r).alias("ips"),
        F.when(F.sum(w) < 1e-10, 0.0).otherwise(F.sum(w * r) / F.sum(w)).alias("snips"),
        F.when(F.sum(w * w) < 1e-10, 0.0).otherwise(F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"),
        F.count(F.lit(1)).alias("n"),
        F.max(w).alias("max_weight"),
    ]
    if q_logged:
        aggs.append(F.avg(F.col(q_target or q_logged) + w * (r - F.col(q_logged))).alias("dr"))
    return df.groupBy(*keys).agg(*aggs)


#: Cumulative probabilities of Poisson(1), enough for a 53-bit draw.
_POISSON = []
_p, _c = 2.718281828459045 ** -1, 0.0
for _k in range(18):
    _c += _p
    _POISSON.append(_c)
    _p /= _k + 1


def bootstrap_ci(df: DataFrame, key: str, num: Column, den: Column, b: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of sum(num) / sum(den) under a Poisson(1) bootstrap.

    Each row draws its weight in each replicate from a hash of (key, replicate, seed). The b copies
    exist only inside the task: they are summed per replicate before anything is shuffled.
    """
    rows = df.select(F.col(key).alias("_k"), num.alias("_n"), den.alias("_d"), F.explode(F.sequence(F.lit(1), F.lit(b))).alias("_b"))
    u = F.shiftrightunsigned(F.xxhash64("_k", "_b", F.lit(seed)), 11) / F.lit(float(1 << 53))
    w = reduce(lambda x, y: x + y, [(u > c).cast("int") for c in _POISSON])
    reps = rows.withColumn("_w", w).where("_w > 0").groupBy("_b").agg(F.sum(F.col("_w") * F.col("_n")).alias("n"), F.sum(F.col("_w") * F.col("_d")).alias("d"))
    est = reps.select(safe_div(F.col("n"), F.col("d")).alias("v"))
    q = F.percentile("v", F.array(F.lit(alpha / 2), F.lit(0.5), F.lit(1 - alpha / 2)))
    return est.agg(q.alias("q"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")).select(
        F.get("q", F.lit(0)).alias("ci_lower"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("ci_upper"), "mean", "std"
    )


def clip_sensitivity(df: DataFrame, reward: str, p_log: str, p_new: str, clips: Sequence[float] = (5, 10, 20, 50, 100), baseline: float = 0.0) -> DataFrame:
    """(clip, snips, ess_ratio, max_weight, go, recommended) from one scan; the best ESS ratio above the baseline is recommended."""
    r = F.col(reward)
    items = []
    for c in clips:
        w = importance_weight(p_new, p_log, c)
        items.append(F.struct(
            F.lit(float(c)).alias("clip"),
            F.when(F.sum(w) < 1e-10, 0.0).otherwise(F.sum(w * r) / F.sum(w)).alias("snips"),
            (F.when(F.sum(w * w) < 1e-10, 0.0).otherwise(F.sum(w) * F.sum(w) / F.sum(w * w)) / F.count(F.lit(1))).alias("ess_ratio"),
            F.max(w).alias("max_weight"),
        ).alias(f"c{len(items)}"))
    wide = df.agg(*items).select(F.array(*[f"c{i}" for i in range(len(items))]).alias("a"))
    ok = F.filter("a", lambda x: x["snips"] > baseline)
    best = F.array_max(F.transform(ok, lambda x: F.named_struct(F.lit("e"), x["ess_ratio"], F.lit("c"), -x["clip"])))
    rec = F.coalesce(-best["c"], F.lit(float(clips[-1])))
    out = wide.select(F.explode("a").alias("x"), rec.alias("_r")).select("x.*", "_r")
    return out.select("clip", "snips", "ess_ratio", "max_weight", (F.col("snips") > baseline).cast("int").alias("go"), (F.col("clip") == F.col("_r")).cast("int").alias("recommended"))


def go_no_go(est: DataFrame, current: float, min_lift: float = 0.02, min_ess_ratio: float = 0.10) -> DataFrame:
    """Decision from (value, ci_lower, ess, n): the interval must clear the current value, lift and ESS are advice."""
    lift = (F.col("value") - current) / abs(current) if abs(current) > 1e-10 else F.col("value") - current
    ess = safe_div(F.col("ess"), F.col("n"))
    need = F.col("ci_lower") > current
    return est.select(
        "*",
        lift.alias("lift"),
        ess.alias("ess_ratio"),
        need.cast("int").alias("ci_ok"),
        (lift > min_lift).cast("int").alias("lift_ok"),
        (ess > min_ess_ratio).cast("int").alias("ess_ok"),
        F.when(need, "Go").otherwise("No-Go").alias("decision"),
    )


def examination(position: str | Column, kind: str = "cascade", rate: float = 0.7) -> Column:
    """Probability that a 1-based position is looked at: rate^(k-1), or 1/k^rate for reciprocal; below 1 counts as 1."""
    k = F.col(position) if isinstance(position, str) else position
    k = F.greatest(k, F.lit(1))
    return F.pow(k.cast("double"), F.lit(-rate)) if kind == "reciprocal" else F.pow(F.lit(rate), (k - 1).cast("double"))


def adjust_rewards(df: DataFrame, reward: str, position: str, **model) -> DataFrame:
    e = F.greatest(examination(position, **model), F.lit(1e-10))
    return df.withColumns({"exam_prob": e, "reward_adjusted": F.col(reward) / e})


def estimate_position_bias(df: DataFrame, click: str, position: str) -> DataFrame:
    """(position, rate, exam_prob): click rate relative to the first position; unseen positions are 0."""
    g = df.where(F.col(position) >= 1).groupBy(position).agg(F.avg(F.col(click).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    first = g.where(F.col(position) == 1).select("rate").scalar()
    return g.withColumn("_f", first).select(position, "n", "rate", F.when(F.col("_f") > 0, F.col("rate") / F.when(F.col("_f") > 0, F.col("_f"))).otherwise(F.col("rate")).alias("exam_prob"))


def uplift_curve(df: DataFrame, uplift: str, treated: str, outcome: str, key: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows with their position by descending predicted uplift (ties by key) and running arm sums."""
    t = (F.col(treated) == 1).cast("double")
    y = F.col(outcome).cast("double")
    base = df.select(key, treated, outcome, uplift, (-F.col(uplift)).alias("_u"))
    return running(base, [], ["_u", key], {"pos": F.lit(1).cast("long"), "nt": t, "yt": t * y, "nc": 1 - t, "yc": (1 - t) * y}, group_rows=group_rows)


def uplift_metrics(df: DataFrame, uplift: str, treated: str, outcome: str, key: str, ks: Sequence[float] = (0.1, 0.2, 0.3), group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row: normalised Qini coefficient and observed uplift in the top shares."""
    curve = uplift_curve(df, uplift, treated, outcome, key, group_rows)
    totals = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col(treated) == 1).cast("double")).alias("nt"),
        F.sum((F.col(treated) == 0).cast("double")).alias("nc"),
        F.sum(F.when(F.col(treated) == 1, F.col(outcome)).otherwise(0.0)).alias("yt"),
        F.sum(F.when(F.col(treated) == 0, F.col(outcome)).otherwise(0.0)).alias("yc"),
    ).select(F.struct("*")).scalar()
    c = curve.withColumn("_t", totals)
    t = F.col("_t")
    gain = F.when((F.col("nt") == 0) | (F.col("nc") == 0), 0.0).otherwise(F.col("yt") - F.col("yc") * F.col("nt") / F.when(F.col("nc") > 0, F.col("nc")))
    perfect = F.when((t["nt"] > 0) & (t["nc"] > 0), t["yt"] - t["yc"] * t["nt"] / F.when(t["nc"] > 0, t["nc"]))
    aggs = [F.avg(gain).alias("_q"), F.first(perfect).alias("_p")]
    for k in ks:
        top = F.col("pos") <= F.greatest(F.bround(F.lit(k) * t["n"]), F.lit(1))
        a = F.avg(F.when(top & (F.col(treated) == 1), F.col(outcome).cast("double")))
        b = F.avg(F.when(top & (F.col(treated) == 0), F.col(outcome).cast("double")))
        aggs.append(F.coalesce(a - b, F.lit(0.0)).alias(f"uplift_at_{int(k * 100)}"))
    out = c.agg(*aggs)
    qini = F.when(F.abs("_p") < 1e-12, 0.0).otherwise(F.coalesce(F.col("_q") / F.when(F.abs("_p") >= 1e-12, F.col("_p")), F.lit(0.0)))
    return out.select(qini.alias("qini"), *[f"uplift_at_{int(k * 100)}" for k in ks])


def assign_variant(df: DataFrame, user: str, salt: str, experiment: str, weights: dict[str, float]) -> DataFrame:
    """Stable variant: first 32 bits of SHA-256("salt:experiment:user") against cumulative weights."""
    raw = F.concat(F.lit(f"{salt}:{experiment}:"), F.col(user).cast("string"))
    h = F.conv(F.substring(F.sha2(raw.cast("binary"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    total, acc, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        acc += w / total
        out = F.when(h < acc, name) if out is None else out.when(h < acc, name)
    return df.withColumns({"hash_value": h, "variant": out.otherwise(list(weights)[-1])})


def ab_significance(df: DataFrame, variant: str, converted: str, control: str, challenger: str, keys: Sequence[str] = (), min_per_arm: int = 10_000, alpha: float = 0.05) -> DataFrame:
    """Rates, lift, z, p-value, winner and the promotion action per key."""
    v, y = F.col(variant), F.col(converted).cast("double")
    g = df.where(v.isin(control, challenger)).groupBy(*keys).agg(
        F.sum((v == control).cast("double")).alias("control_n"), F.sum((v == challenger).cast("double")).alias("challenger_n"),
        F.coalesce(F.sum(F.when(v == control, y)), F.lit(0.0)).alias("_c"), F.coalesce(F.sum(F.when(v == challenger, y)), F.lit(0.0)).alias("_t"),
    )
    both = (F.col("control_n") > 0) & (F.col("challenger_n") > 0)
    n0, n1 = F.when(both, F.col("control_n")).otherwise(1.0), F.when(both, F.col("challenger_n")).otherwise(1.0)
    p = F.when(both, two_proportion_p(F.col("_t"), n1, F.col("_c"), n0)).otherwise(1.0)
    g = g.withColumns({"control_rate": safe_div(F.col("_c"), F.col("control_n")), "challenger_rate": safe_div(F.col("_t"), F.col("challenger_n")), "p_value": p})
    sig, up = F.col("p_value") < alpha, F.col("challenger_rate") > F.col("control_rate")
    g = g.withColumn("winner", F.when(sig & up, "challenger").when(sig, "control").otherwise("none"))
    few = (F.col("control_n") < min_per_arm) | (F.col("challenger_n") < min_per_arm)
    return g.select(
        *keys,
        F.col("control_n").cast("long").alias("control_n"), F.col("challenger_n").cast("long").alias("challenger_n"),
        F.round("control_rate", 4).alias("control_rate"), F.round("challenger_rate", 4).alias("challenger_rate"),
        F.round(safe_div(F.col("challenger_rate") - F.col("control_rate"), F.col("control_rate")), 4).alias("lift"),
        F.round("p_value", 6).alias("p_value"), "winner",
        F.when(few, "wait").when(F.col("winner") == "challenger", "promote").when(F.col("winner") == "control", "keep").otherwise("wait").alias("action"),
    )


def paired_t(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """t statistic of b - a per key with its two-sided p-value under Student's t law with n - 1 degrees of freedom."""
    d = F.col(b) - F.col(a)
    g = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_s"))
    flat = F.coalesce(F.col("_s"), F.lit(0.0)) < 1e-12
    t = F.when(flat, 0.0).otherwise(F.col("mean_diff") / F.when(~flat, F.col("_s")) * F.sqrt("n"))
    p = F.when((F.col("n") < 2) | (flat & (F.abs("mean_diff") < 1e-12)), 1.0).when(flat, 0.0).otherwise(t_two_sided(t, F.col("n") - 1))
    return g.select(*keys, "n", "mean_diff", t.alias("t"), p.alias("p_value"))


def compare_metrics(champion: DataFrame, challenger: DataFrame, primary: str, lower_is_better: Sequence[str] = (), min_gain: float = 0.005, max_loss: float = 0.02) -> DataFrame:
    """(metric, champion, challenger, relative, ok, approved): the primary must gain, the others must not lose."""
    j = champion.select("metric", F.col("value").alias("champion")).join(challenger.select("metric", F.col("value").alias("challenger")), "metric")
    low = F.col("metric").isin(*lower_is_better) if lower_is_better else F.lit(False)
    delta = F.when(low, F.col("champion") - F.col("challenger")).otherwise(F.col("challenger") - F.col("champion"))
    rel = delta / F.greatest(F.abs("champion"), F.lit(1e-10))
    out = j.withColumn("relative", F.round(rel, 6))
    out = out.withColumn("ok", F.when(F.col("metric") == primary, rel >= min_gain).otherwise(rel >= -max_loss).cast("int"))
    return out.withColumn("approved", out.agg(F.min("ok")).scalar())


def final_metrics(log: DataFrame, run: str, metric: str, value: str, step: str) -> DataFrame:
    """Last logged value of every metric of a run."""
    return log.groupBy(run, metric).agg(F.max_by(value, step).alias("final"))


def compare_runs(log: DataFrame, metric_name: str, run: str = "run", metric: str = "metric", value: str = "value", step: str = "step", higher: bool = True) -> DataFrame:
    """Runs by their final value of one metric: (run, final, best, gap to the best)."""
    f = final_metrics(log.where(F.col(metric) == metric_name), run, metric, value, step)
    best = f.agg((F.max if higher else F.min)("final")).scalar()
    out = f.withColumn("_b", best)
    return out.select(run, "final", (F.col("final") == F.col("_b")).cast("int").alias("best"), (F.col("final") - F.col("_b")).alias("gap"))


def param_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(param, a, b) of parameters that differ between two runs or exist in one only."""
    x = a.select("param", F.col("value").alias("a"))
    return x.join(b.select("param", F.col("value").alias("b")), "param", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


# Fidelity limits. The first two block a release, the others are recorded.
FIDELITY = {"auc_gap": 0.05, "calibration_gap": 0.05, "f1_macro_gap": 0.10, "mae_gap": 0.05, "rmse_gap": 0.10}
FIDELITY_INFO = {"jsd": 0.10, "min_ranking_corr": 0.90, "min_agreement": 0.85, "min_multiclass_agreement": 0.70, "min_quartile": 0.70}


def calibration_error(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins [lo, hi); a score of exactly 1 falls outside every bin."""
    edges = [i / bins for i in range(bins + 1)]
    b = F.when(F.col(p) < edges[0], None)
    for i in range(bins):
        b = b.when(F.col(p) < edges[i + 1], i)
    g = df.select(b.alias("b"), y, p).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("acc"), F.avg(p).alias("conf"))
    err = F.sum(F.when(F.col("b").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0))
    return g.agg((err / F.sum("n")).alias("ece"))


def _verdict(df: DataFrame, block: dict[str, Column], info: dict[str, Column]) -> DataFrame:
    return df.withColumns({
        "failures": F.concat_ws(",", *[F.when(c, n) for n, c in block.items()]),
        "informational": F.concat_ws(",", *[F.when(c, n) for n, c in info.items()]),
    }).withColumn("passed", (F.col("failures") == "").cast("int"))


def fidelity_binary(df: DataFrame, teacher: str, student: str, y: str) -> DataFrame:
    """One row: auc_gap, agreement, jsd, ranking_corr, calibration_gap, failures, passed."""
    t, s = F.col(teacher), F.col(student)
    base = df.agg(F.avg(((t >= 0.5) == (s >= 0.5)).cast("double")).alias("agreement"), F.avg(binary_jsd(t, s)).alias("jsd"))
    a, b = auc(df, [], y, teacher).scalar(), auc(df, [], y, student).scalar()
    out = base.select(
        F.abs(a - b).alias("auc_gap"), "agreement", "jsd",
        spearman(df, [], teacher, student).scalar().alias("ranking_corr"),
        calibration_error(df, y, student).scalar().alias("calibration_gap"),
    )
    return _verdict(
        out,
        {"auc_gap": F.col("auc_gap") > FIDELITY["auc_gap"], "calibration_gap": F.col("calibration_gap") > FIDELITY["calibration_gap"]},
        {"agreement": F.col("agreement") < FIDELITY_INFO["min_agreement"], "jsd": F.col("jsd") > FIDELITY_INFO["jsd"], "ranking_corr": F.col("ranking_corr") < FIDELITY_INFO["min_ranking_corr"]},
    )


def multiclass_jsd(p: str, q: str) -> Column:
    """Jensen-Shannon divergence of two probability arrays, floored at 1e-10 and renormalised."""
    def norm(c: str) -> Column:
        lifted = F.transform(c, lambda x: F.greatest(x.cast("double"), F.lit(1e-10)))
        total = F.aggregate(c, F.lit(0.0), lambda s, x: s + F.greatest(x.cast("double"), F.lit(1e-10)))
        return F.aggregate(F.array(total), F.array().cast("array<double>"), lambda _, t: F.transform(lifted, lambda x: x / t))

    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return (x * F.ln(x / m) + y * F.ln(y / m)) / 2

    return F.aggregate(F.zip_with(norm(p), norm(q), term), F.lit(0.0), lambda s, x: s + x)


def fidelity_multiclass(df: DataFrame, teacher: str, student: str, y: str) -> DataFrame:
    """One row: agreement, jsd, macro F1 of both and their gap, failures, passed."""
    base = df.agg(F.avg((argmax(teacher) == argmax(student)).cast("double")).alias("agreement"), F.avg(multiclass_jsd(teacher, student)).alias("jsd"))
    tf = f1_by_class(confusion_matrix(df, y, argmax(teacher))).agg(F.avg("f1")).scalar()
    sf = f1_by_class(confusion_matrix(df, y, argmax(student))).agg(F.avg("f1")).scalar()
    out = base.withColumns({"teacher_f1": tf, "student_f1": sf}).withColumn("f1_macro_gap", F.abs(F.col("teacher_f1") - F.col("student_f1")))
    return _verdict(
        out,
        {"f1_macro_gap": F.col("f1_macro_gap") > FIDELITY["f1_macro_gap"]},
        {"agreement": F.col("agreement") < FIDELITY_INFO["min_multiclass_agreement"], "jsd": F.col("jsd") > FIDELITY_INFO["jsd"]},
    )


def fidelity_regression(df: DataFrame, teacher: str, student: str, y: str) -> DataFrame:
    """One row: ranking_corr, quartile agreement, MAE and RMSE gaps, failures, passed."""
    cuts = exact_quantiles(df, [teacher, student], [0.25, 0.5, 0.75])

    def quartile(c: str) -> Column:
        return reduce(lambda a, b: a + b, [(F.col(c) >= q).cast("int") for q in cuts[c]])

    et, es = F.col(y) - F.col(teacher), F.col(y) - F.col(student)
    out = df.agg(
        F.avg((quartile(teacher) == quartile(student)).cast("double")).alias("quartile_agreement"),
        F.abs(F.avg(F.abs(et)) - F.avg(F.abs(es))).alias("mae_gap"),
        F.abs(F.sqrt(F.avg(et * et)) - F.sqrt(F.avg(es * es))).alias("rmse_gap"),
    ).withColumn("ranking_corr", spearman(df, [], teacher, student).scalar())
    return _verdict(
        out,
        {"mae_gap": F.col("mae_gap") > FIDELITY["mae_gap"], "rmse_gap": F.col("rmse_gap") > FIDELITY["rmse_gap"]},
        {"ranking_corr": F.col("ranking_corr") < FIDELITY_INFO["min_ranking_corr"], "quartile_agreement": F.col("quartile_agreement") < FIDELITY_INFO["min_quartile"]},
    )


def distil_gate(metrics: DataFrame) -> DataFrame:
    """Per task (type, value, n_classes): distil, hard_label or skip from the teacher's quality."""
    t, v, n = F.col("task_type"), F.col("value"), F.col("n_classes")
    good = F.when(t == "binary", v > 0.60).when(t == "multiclass", v > 2.0 / n).otherwise(v > 0.05)
    floor = F.when(t == "binary", v <= 0.52).when(t == "multiclass", v <= 1.0 / n).otherwise(v <= 0.01)
    return metrics.withColumn("route", F.when(good, "distil").when(F.coalesce(floor, F.lit(True)), "skip").otherwise("hard_label"))


def student_target(df: DataFrame, task_type: str, hard: str, soft: str, alpha: float) -> DataFrame:
    """Training target and sample weight from hard and teacher labels."""
    if task_type == "multiclass":
        is_list = dict(df.dtypes)[soft].startswith("array")
        w = F.array_max(soft) if is_list else 0.5 + 0.5 * (F.col(soft).cast("int") == F.col(hard).cast("int")).cast("double")
        return df.withColumns({"target": F.col(hard).cast("double"), "sample_weight": w.cast("double")})
    return df.withColumns({"target": alpha * F.col(hard).cast("double") + (1 - alpha) * F.col(soft).cast("double"), "sample_weight": F.lit(1.0)})


def linear_calibration(df: DataFrame, score: str, y: str, fit_on: Column) -> DataFrame:
    """Scores corrected by the least-squares line fitted on the rows of `fit_on`."""
    f = df.where(fit_on).agg(F.regr_slope(y, score).alias("a"), F.regr_intercept(y, score).alias("b")).select(F.struct("*")).scalar()
    return df.withColumn("_f", f).withColumn("calibrated", F.coalesce(F.col("_f.a") * F.col(score) + F.col("_f.b"), F.col(score))).drop("_f")


def select_features(imp: DataFrame, feature: str, importance: str, mass: float = 0.95, lo: int = 1, hi: int = 200, mandatory: Sequence[str] = ()) -> DataFrame:
    """Features sorted by importance up to the cumulative mass, clamped in number, mandatory ones added."""
    base = imp.select(feature, importance, (-F.col(importance)).alias("_i"))
    run = running(base, [], ["_i", feature], {"rank": F.lit(1).cast("long"), "_cum": F.col(importance).cast("double")})
    total = imp.agg(F.sum(importance)).scalar()
    run = run.withColumn("_t", total).withColumn("cumulative", safe_div(F.col("_cum"), F.col("_t")))
    # kept while the mass before the feature is still short
    before = F.col("cumulative") - safe_div(F.col(importance), F.col("_t"))
    keep = F.when(F.col("_t") < 1e-10, F.col("rank") <= lo).otherwise(((before < mass) | (F.col("rank") <= lo)) & (F.col("rank") <= hi))
    must = F.col(feature).isin(*mandatory) if mandatory else F.lit(False)
    return run.select(feature, importance, "rank", "cumulative", (keep | must).cast("int").alias("selected"))


def gate_stats(df: DataFrame, task: str, weights: str, threshold: float = 0.05, eps: float = 1e-8) -> DataFrame:
    """Per task mean entropy, its share of the maximum, mean largest weight and mean number of active experts."""
    ent = -F.aggregate(weights, F.lit(0.0), lambda s, w: s + w * F.ln(F.greatest(w, F.lit(eps))))
    g = df.groupBy(task).agg(
        F.avg(ent).alias("entropy"),
        F.avg(F.array_max(weights)).alias("max_weight"),
        F.avg(F.size(F.filter(weights, lambda w: w > threshold)).cast("double")).alias("active_experts"),
        F.max(F.size(weights)).alias("n_experts"),
    )
    return g.withColumn("entropy_ratio", F.col("entropy") / F.greatest(F.ln(F.col("n_experts").cast("double")), F.lit(1e-8)))


def faithfulness(df: DataFrame, original: str, perturbed: str, attributions: str, mask: str) -> DataFrame:
    """(corr + 1) / 2 between prediction change and the summed size of the masked attributions; 0.5 if constant."""
    change = F.abs(F.col(original) - F.col(perturbed))
    expected = F.aggregate(F.zip_with(attributions, mask, lambda a, m: F.abs(a) * m.cast("double")), F.lit(0.0), lambda s, x: s + x)
    g = df.select(change.alias("c"), expected.alias("e")).agg(F.corr("c", "e").alias("r"), F.stddev_pop("c").alias("sc"), F.stddev_pop("e").alias("se"), F.max("c").alias("mc"), F.max("e").alias("me"))
    flat = (F.col("sc") / (F.col("mc") + 1e-10) < 1e-10) | (F.col("se") / (F.col("me") + 1e-10) < 1e-10)
    return g.select(F.round(F.when(flat, 0.5).otherwise(F.greatest((F.col("r") + 1) / 2, F.lit(0.0))), 4).alias("faithfulness"))


def stability(df: DataFrame, run1: str, run2: str) -> DataFrame:
    """Mean positive cosine of two attribution vectors; two zero vectors agree fully."""
    n1, n2 = F.sqrt(dot(F.col(run1), F.col(run1))), F.sqrt(dot(F.col(run2), F.col(run2)))
    z1, z2 = n1 < 1e-10, n2 < 1e-10
    cos = F.when(z1 & z2, 1.0).when(z1 | z2, 0.0).otherwise(F.greatest(dot(F.col(run1), F.col(run2)) / F.when(~(z1 | z2), n1 * n2), F.lit(0.0)))
    return df.agg(F.round(F.avg(cos), 4).alias("stability"))


def explanation_fidelity(df: DataFrame, text: str, feats: str, first: int, keywords: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Share of the `first` named features that the text mentions by name or by a keyword of their prefix."""
    low = F.lower(text)
    top = F.slice(feats, 1, first)

    def named(f: Column) -> Column:
        hit = F.contains(low, F.lower(f))
        for prefix, words in (keywords or {}).items():
            hit = hit | (f.startswith(prefix) & reduce(lambda a, b: a | b, [F.contains(F.col(text), F.lit(w)) for w in words]))
        return hit

    n = F.size(top)
    return df.withColumn("fidelity", F.when(n > 0, F.size(F.filter(top, named)) / F.when(n > 0, n)).otherwise(0.0))


def completeness(df: DataFrame, text: str, items: dict[str, Sequence[str]]) -> DataFrame:
    """(item, coverage, missing) of mandatory items over all texts."""
    aggs = [F.avg(reduce(lambda a, b: a | b, [F.contains(F.col(text), F.lit(w)) for w in words]).cast("double")).alias(f"i{i}") for i, words in enumerate(items.values())]
    rows = F.array(*[F.struct(F.lit(n).alias("item"), F.col(f"i{i}").alias("coverage")) for i, n in enumerate(items)])
    out = df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")
    return out.withColumn("missing", (F.col("coverage") < 0.5).cast("int"))


def consistency(df: DataFrame, group: Sequence[str], order: str, text: str, ahead: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Mean Jaccard similarity of the word sets of texts at most `ahead` places apart in the same group."""
    words = df.select(*group, order, F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")).alias("_w"))

    def build(f: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order)
        return f.select("*", *[F.lag("_w", i).over(w).alias(f"_w{i}") for i in range(1, ahead + 1)])

    j = lookback(words, list(group), [order], ahead, build, group_rows)
    pairs = j.select("_w", F.explode(F.array(*[f"_w{i}" for i in range(1, ahead + 1)])).alias("_o")).where("_o IS NOT NULL")
    inter = F.size(F.array_intersect("_w", "_o"))
    union = F.size("_w") + F.size("_o") - inter
    sim = F.when(union > 0, inter / F.when(union > 0, union))
    return pairs.agg(F.coalesce(F.avg(sim), F.lit(1.0)).alias("consistency"), F.count(sim).alias("pairs"))
