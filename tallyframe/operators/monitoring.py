"""Model comparison on logged scores, retrain and risk decisions, incident and disclosure tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.stats import norm_cdf, safe_div
from tallyframe.plans.quantiles import exact_quantiles
from tallyframe.plans.session import GROUP_ROWS
from tallyframe.plans.skew import lookback, value_positions


def two_proportion_p(s1: Column, n1: Column, s0: Column, n0: Column) -> Column:
    """Two-sided p-value of a pooled z-test on mean scores; 1 where the pooled rate is not inside (0, 1)."""
    pool = (s1 + s0) / (n1 + n0)
    inside = (pool > 0) & (pool < 1)
    se = F.sqrt(F.when(inside, pool * (1 - pool)) * (1 / n1 + 1 / n0))
    z = (s1 / n1 - s0 / n0) / se
    return F.coalesce(F.when(inside & (se > 0), 2 * (1 - norm_cdf(F.abs(z)))), F.lit(1.0))


def champion_challenger(log: DataFrame, champion: str, challenger: str, task: str = "task", version: str = "version", score: str = "score", min_samples: int = 100, alpha: float = 0.05) -> DataFrame:
    """Per task: means, counts, lift, p-value and the action promote / keep / wait."""
    v, x = F.col(version), F.col(score)
    g = log.where(v.isin(champion, challenger)).groupBy(task).agg(
        F.sum((v == champion).cast("long")).alias("champion_n"),
        F.sum((v == challenger).cast("long")).alias("challenger_n"),
        F.coalesce(F.sum(F.when(v == champion, x)), F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum(F.when(v == challenger, x)), F.lit(0.0)).alias("_s1"),
    )
    m0, m1 = safe_div(F.col("_s0"), F.col("champion_n")), safe_div(F.col("_s1"), F.col("challenger_n"))
    g = g.withColumns({"champion_mean": m0, "challenger_mean": m1})
    enough = (F.col("champion_n") >= min_samples) & (F.col("challenger_n") >= min_samples)
    some = (F.col("champion_n") > 0) & (F.col("challenger_n") > 0)
    one = F.lit(1)
    p = two_proportion_p(F.col("_s1"), F.when(some, F.col("challenger_n")).otherwise(one), F.col("_s0"), F.when(some, F.col("champion_n")).otherwise(one))
    g = g.withColumn("p_value", F.when(enough, p).otherwise(1.0))
    lift = F.when(F.col("champion_mean") > 0, (F.col("challenger_mean") - F.col("champion_mean")) / F.when(F.col("champion_mean") > 0, F.col("champion_mean"))).otherwise(0.0)
    sig = F.col("p_value") < alpha
    action = F.when(sig & (F.col("challenger_mean") > F.col("champion_mean")), "promote").when(sig, "keep").otherwise("wait")
    return g.select(
        task, "champion_n", "challenger_n", "champion_mean", "challenger_mean",
        F.when(enough, lift).otherwise(0.0).alias("lift"), "p_value", sig.cast("int").alias("significant"), action.alias("action"),
    )


def version_stats(log: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """count, mean, std and the p50 / p95 / p99 order statistics (element int(n p), no interpolation) per key."""
    keys = list(keys)
    base = log.groupBy(*keys).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"))
    v = value_positions(log.where(F.col(score).isNotNull()), keys, score, {"c": F.lit(1).cast("long")}).join(base.select(*keys, "n"), keys)

    def at(p: int) -> Column:
        idx = F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
        return F.min(F.when(F.col("cum_c") > idx, F.col(score))).alias(f"p{p}")

    return base.join(v.groupBy(*keys).agg(at(50), at(95), at(99)), keys)


def retrain_decision(psi: DataFrame, log: DataFrame, trains: DataFrame, champion: str, challenger: str, now: str, psi_limit: float = 0.25, lift_limit: float = 0.02, min_samples: int = 100, stale_days: int = 30) -> DataFrame:
    """One row: critical drift, a clearly better challenger, a stale model, and whether to retrain.

    `log` has (version, score), `trains` one row per past training with `trained_at`; no training at
    all counts as stale.
    """
    d = psi.agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"), F.coalesce(F.sum((F.col("psi") >= psi_limit).cast("long")), F.lit(0)).alias("critical_features"))
    v = F.col("version")
    s = log.agg(
        F.sum((v == champion).cast("long")).alias("n0"), F.sum((v == challenger).cast("long")).alias("n1"),
        F.avg(F.when(v == champion, F.col("score"))).alias("m0"), F.avg(F.when(v == challenger, F.col("score"))).alias("m1"),
    ).select(F.struct("*")).scalar()
    last = trains.agg(F.max(F.col("trained_at").cast("timestamp"))).scalar()
    out = d.withColumns({"_s": s, "days_since_train": F.coalesce(F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(last)) / 86400), F.lit(-1))})
    enough = (F.col("_s.n0") >= min_samples) & (F.col("_s.n1") >= min_samples)
    lift = F.when(enough & (F.col("_s.m0") > 0), (F.col("_s.m1") - F.col("_s.m0")) / F.when(F.col("_s.m0") > 0, F.col("_s.m0"))).otherwise(0.0)
    out = out.select("max_psi", "critical_features", "days_since_train", lift.alias("lift"))
    reasons = [
        F.when(F.col("critical_features") > 0, "drift"),
        F.when(F.col("lift") > lift_limit, "challenger"),
        F.when((F.col("days_since_train") < 0) | (F.col("days_since_train") >= stale_days), "stale"),
    ]
    return out.withColumn("reasons", F.concat_ws(",", *reasons)).withColumn("retrain", (F.col("reasons") != "").cast("int"))


def guardrail_fit(df: DataFrame, vec: str, percentile: float = 95.0) -> dict:
    """Mean and population std per dimension and the score percentile that serves as the limit."""
    x = df.select(F.posexplode(vec).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    mu, sigma = [r["m"] for r in x], [r["s"] + 1e-6 for r in x]
    scored = df.select(_mahalanobis(F.col(vec), mu, sigma).alias("s"))
    return {"mu": mu, "sigma": sigma, "threshold": exact_quantiles(scored, ["s"], [percentile / 100])["s"][0]}


def _mahalanobis(v: Column, mu: list[float], sigma: list[float]) -> Column:
    m, s = F.array(*[F.lit(x) for x in mu]), F.array(*[F.lit(x) for x in sigma])
    ref = F.arrays_zip(v.alias("v"), m.alias("m"), s.alias("s"))
    return F.aggregate(ref, F.lit(0.0), lambda a, p: a + ((p["v"].cast("double") - p["m"]) / p["s"]) * ((p["v"].cast("double") - p["m"]) / p["s"]))


def guardrail_score(df: DataFrame, vec: str, fit: dict) -> DataFrame:
    """Distance from the reference and whether it is beyond the limit."""
    out = df.withColumn("score", _mahalanobis(F.col(vec), fit["mu"], fit["sigma"]))
    return out.withColumn("outlier", (F.col("score") > fit["threshold"]).cast("int"))


# Level limits, from the highest.
RISK_LEVELS = (("UNACCEPTABLE", 0.9), ("HIGH", 0.7), ("LIMITED", 0.4))


def risk_level(score: Column, levels: Sequence[tuple[str, float]] = RISK_LEVELS, lowest: str = "MINIMAL") -> Column:
    out = F.when(score >= levels[0][1], levels[0][0])
    for name, limit in levels[1:]:
        out = out.when(score >= limit, name)
    return out.otherwise(lowest)


def risk_score(df: DataFrame, weights: dict[str, float], levels: Sequence[tuple[str, float]] = RISK_LEVELS, lowest: str = "MINIMAL", name: str = "risk") -> DataFrame:
    """Weighted total of dimension scores in [0, 1], rounded to 4, and its level."""
    total = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()])
    out = df.withColumn(f"{name}_total", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 4))
    return out.withColumn(f"{name}_level", risk_level(F.col(f"{name}_total"), levels, lowest))


def grade_history(df: DataFrame, key: str, order: str, level: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Previous grade of the same model and whether it changed; one row per assessment."""
    def build(f: DataFrame, by: list[str]) -> DataFrame:
        return f.withColumn("prev_level", F.lag(level).over(Window.partitionBy(*by).orderBy(order)))

    out = lookback(df, [key], [order], 1, build, group_rows)
    return out.withColumn("level_change", F.coalesce((F.col("prev_level") != F.col(level)).cast("int"), F.lit(0)))


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def task_risk_dimensions(df: DataFrame) -> DataFrame:
    """Five dimension scores of a task from its metrics.

    Columns used: violation_count, di_value, spd_value, has_explanations, explanation_coverage,
    model_card_exists, auc, drift_detected, degradation, input_validation, encryption_enabled,
    access_control, human_review_rate, alert_configured, kill_switch. A dimension all of whose
    metrics are NULL scores 0.5.
    """
    def dim(cols: Sequence[str], score: Column) -> Column:
        return F.when(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNull(), 0.5).otherwise(_unit(score))

    def yes(c: str) -> Column:
        return F.coalesce(F.col(c).cast("boolean"), F.lit(False))

    def num(c: str, default: float) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(default))

    di, cov, auc_ = num("di_value", 1.0), num("explanation_coverage", 0.0), num("auc", 0.8)
    zero = F.lit(0.0)
    fair = F.least(num("violation_count", 0.0) * 0.15, F.lit(0.6)) + F.when((di < 0.8) | (di > 1.25), 0.3).otherwise(zero) + F.when(F.abs("spd_value") > 0.1, 0.1).otherwise(zero)
    trans = 0.5 - F.when(yes("has_explanations"), 0.2).otherwise(zero) - F.when(cov > 0.8, 0.15).when(cov > 0.5, 0.1).otherwise(zero) - F.when(yes("model_card_exists"), 0.1).otherwise(zero)
    acc = F.when(auc_ < 0.6, 0.5).when(auc_ < 0.7, 0.3).when(auc_ < 0.8, 0.15).otherwise(zero) + F.when(yes("drift_detected"), 0.25).otherwise(zero) + F.least(num("degradation", 0.0), F.lit(0.3))
    acl = F.col("access_control")
    sec = 0.6 - F.when(yes("input_validation"), 0.2).otherwise(zero) - F.when(yes("encryption_enabled"), 0.2).otherwise(zero) - F.when(acl == "strict", 0.15).when(acl == "moderate", 0.1).otherwise(zero)
    over = 0.6 - F.least(num("human_review_rate", 0.0) * 0.3, F.lit(0.3)) - F.when(yes("alert_configured"), 0.15).otherwise(zero) - F.when(yes("kill_switch"), 0.15).otherwise(zero)
    return df.withColumns(
        {
            "fairness_risk": dim(["violation_count", "di_value", "spd_value"], fair),
            "transparency_risk": dim(["has_explanations", "explanation_coverage", "model_card_exists"], trans),
            "accuracy_risk": dim(["auc", "drift_detected", "degradation"], acc),
            "security_risk": dim(["input_validation", "encryption_enabled", "access_control"], sec),
            "oversight_risk": dim(["human_review_rate", "alert_configured", "kill_switch"], over),
        }
    )


TASK_RISK_WEIGHTS = {d: 0.2 for d in ("fairness_risk", "transparency_risk", "accuracy_risk", "security_risk", "oversight_risk")}


def heuristic_dimension(col: str, kind: str, denominator: float = 1.0, fallback: float = 0.5) -> Column:
    """A dimension score from one metadata value: identity, one_minus or log10_ratio, clipped to [0, 1]."""
    v = F.col(col).cast("double")
    if kind == "one_minus":
        out = 1.0 - v
    elif kind == "log10_ratio":
        out = F.when(v.isNotNull(), F.log10(F.greatest(v, F.lit(1.0)) + 1.0) / F.log10(F.lit(max(denominator, 1.0) + 1.0)))
    else:
        out = v
    return F.when(v.isNull(), fallback).otherwise(_unit(out))


#: Metadata column, rule and denominator of the seven dimensions.
METADATA_DIMENSIONS = {
    "data_sensitivity": ("pii_ratio", "identity", 1.0),
    "automation_level": ("human_review_fraction", "one_minus", 1.0),
    "scope_of_impact": ("customer_count", "log10_ratio", 1_000_000),
    "model_complexity": ("param_count", "log10_ratio", 10_000_000),
    "external_dependency": ("provider_ratio", "identity", 1.0),
    "fairness_risk": ("disparate_impact_min", "one_minus", 1.0),
    "explainability_gap": ("reason_coverage", "one_minus", 1.0),
}


def metadata_dimensions(df: DataFrame) -> DataFrame:
    return df.withColumns({d: heuristic_dimension(c, k, n) if c in df.columns else F.lit(0.5) for d, (c, k, n) in METADATA_DIMENSIONS.items()})


def minimisation_score(inventory: DataFrame, key: str) -> DataFrame:
    """Mean over stored fields of 0.5 anonymised + 0.3 encrypted + retention credit."""
    item = (
        F.when(F.col("anonymized"), 0.5).otherwise(0.0)
        + F.when(F.col("encrypted"), 0.3).otherwise(0.0)
        + F.when(F.col("retention_days") <= 90, 0.2).when(F.col("retention_days") <= 365, 0.1).otherwise(0.0)
    )
    return inventory.groupBy(key).agg(F.round(F.avg(item), 4).alias("minimisation"))


def model_metadata(versions: DataFrame, key: str, sources: Sequence[DataFrame]) -> DataFrame:
    """Merge per-version sources; where two carry the same column the later one wins if it has a value."""
    out = versions.select(key).distinct()
    seen: list[str] = []
    for s in sources:
        cols = [c for c in s.columns if c != key]
        s = s.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols])
        out = out.join(s, key, "left")
        merged = {c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) if c in seen else F.col(f"_n_{c}") for c in cols}
        out = out.withColumns(merged).drop(*[f"_n_{c}" for c in cols])
        seen += [c for c in cols if c not in seen]
    return out


def lineage_metadata(fields: DataFrame, key: str) -> DataFrame:
    """Share of feature groups that are not pseudonymised."""
    return fields.groupBy(key).agg(F.avg((~F.coalesce(F.col("pseudonymized"), F.lit(False))).cast("double")).alias("pii_ratio"))


def fairness_metadata(archive: DataFrame, key: str) -> DataFrame:
    """Most skewed disparate impact of all entries per version, folded to [0, 1]."""
    v = F.col("disparate_impact")
    last = archive.where(v.isNotNull() & ~F.isnan(v))
    folded = F.when(v > 0, F.least(v, 1.0 / F.when(v > 0, v))).otherwise(0.0)
    return last.groupBy(key).agg(_unit(F.min(folded)).alias("disparate_impact_min"))


def review_metadata(queue: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    q = queue.groupBy(key).agg(F.count(F.lit(1)).alias("_q"))
    p = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("_p"))
    return p.join(q, key, "left").select(key, _unit(F.coalesce(F.col("_q"), F.lit(0)) / F.col("_p")).alias("human_review_fraction"))


def classify_incidents(df: DataFrame, kind: str = "event_type", di: str = "di_value", given: str = "severity") -> DataFrame:
    """Severity critical / major / minor from event type and metrics."""
    k, d = F.col(kind), F.coalesce(F.col(di), F.lit(1.0))
    sev = (
        F.when(k.isin("kill_switch_activation", "security_alert", "security_breach"), "critical")
        .when((k == "fairness_violation") & (d < 0.6), "critical")
        .when((k == "fairness_violation") & (d < 0.8), "major")
        .when(k == "fairness_violation", "minor")
        .when(k.isin("herding_critical", "model_rollback"), "major")
        .when(k.isin("drift_warning", "quality_drop", "herding_high"), "minor")
        .when(F.col(given).isin("critical", "major", "minor"), F.col(given))
        .otherwise("minor")
    )
    return df.withColumn("incident_severity", sev)


def incident_table(df: DataFrame, period: str, sev: str = "incident_severity") -> DataFrame:
    """Counts, open and resolved incidents and mean resolution hours per period and severity, with period totals."""
    done = F.col("status").isin("resolved", "closed")
    return df.rollup(period, sev).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(done.cast("long")).alias("resolved"),
        F.sum(F.col("status").isin("open", "investigating").cast("long")).alias("open"),
        F.avg(F.when(done, F.col("resolution_hours"))).alias("avg_resolution_hours"),
    ).where(F.col(period).isNotNull())


def disclosure_tables(period: str, metrics: DataFrame, fairness: DataFrame, incidents: DataFrame, events: DataFrame) -> DataFrame:
    """One long table (section, item, measure, value) of the periodic disclosure figures."""
    m = metrics.groupBy("task", "metric").agg(F.avg("value").alias("value")).select(F.lit("performance").alias("section"), F.col("task").alias("item"), F.col("metric").alias("measure"), "value")
    f = fairness.select(F.lit("fairness").alias("section"), F.col("attribute").alias("item"), F.explode(F.array(
        F.struct(F.lit("min_di").alias("measure"), F.col("min_di").alias("value")),
        F.struct(F.lit("is_fair").alias("measure"), F.col("is_fair").cast("double").alias("value")),
    )).alias("x")).select("section", "item", "x.measure", "x.value")
    i = incidents.groupBy("incident_severity").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("incidents").alias("section"), F.col("incident_severity").alias("item"), F.lit("count").alias("measure"), "value")
    done = F.col("status").isin("resolved", "closed")
    r = incidents.agg(F.avg(done.cast("double")).alias("rate"), F.avg(F.when(done, F.col("resolution_hours"))).alias("hours")).select(F.explode(F.array(
        F.struct(F.lit("resolution_rate").alias("measure"), F.col("rate").alias("value")), F.struct(F.lit("avg_resolution_hours").alias("measure"), F.col("hours").alias("value"))
    )).alias("x")).select(F.lit("incidents").alias("section"), F.lit("all").alias("item"), "x.measure", "x.value")
    e = events.groupBy("action").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("customers").alias("section"), F.col("action").alias("item"), F.lit("count").alias("measure"), "value")
    return reduce(DataFrame.unionByName, [m, f, i, r, e]).withColumn("period", F.lit(period))
