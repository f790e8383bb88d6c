"""Scoring, filtering, ranking and fallback decisions over customer x item frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.stats import md5_unit
from tallyframe.operators.joins import latest_per_key


def _zero() -> Column:
    return F.lit(0.0)


def _add(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def weighted_score(df: DataFrame, weights: dict[str, float], lo: float = 0.0, hi: float = 1.0, name: str = "score") -> DataFrame:
    """Weighted mean of the task predictions that are present, clipped; missing weights are shared out."""
    total = _add([F.coalesce(F.col(t), _zero()) * w for t, w in weights.items()])
    active = _add([F.when(F.col(t).isNotNull(), w).otherwise(0.0) for t, w in weights.items()])
    mean = F.when(active > 0, total / F.when(active > 0, active)).otherwise(total)
    return df.withColumn(name, F.least(F.greatest(mean, F.lit(lo)), F.lit(hi)))


@dataclass(frozen=True)
class CompositeConfig:
    """Coefficients of the four-stage score. `boosts` are (feature, threshold, task, factor)."""

    weights: dict[str, float]
    segment_boosts: dict[str, dict[str, float]] = field(default_factory=dict)
    boosts: Sequence[tuple[str, float, str, float]] = ()
    modifiers: dict[str, float] = field(default_factory=lambda: {"high": 1.2, "medium": 1.0, "low": 0.8})
    velocity: float = 0.15
    risk_limit: tuple[float, float] = (0.8, 0.3)
    risk_churn: tuple[float, float] = (0.3, 0.5)
    risk_messages: tuple[float, float] = (3, 0.2)
    fatigue: float = 0.85
    channel_factor: dict[str, float] = field(default_factory=lambda: {"app_push": 1.0, "email": 0.7, "sms": 0.9})
    engagement: float = 0.15


def _lookup(c: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for k, v in values.items():
        out = F.when(c == k, float(v)).otherwise(out)
    return out


def composite_score(df: DataFrame, cfg: CompositeConfig, name: str = "score") -> DataFrame:
    """task mean x modifier x velocity x (1 - risk) x fatigue x engagement, and its factors.

    Reads segment, flare, limit_util, churn_prob, n_messages_7d, channel, engagement_score and the
    task columns; NULL signals count as absent.
    """
    seg = F.coalesce(F.col("segment"), F.lit(""))

    def weight(task: str, base: float) -> Column:
        w = F.lit(base) * _lookup(seg, {s: min(max(m[task], 1.0), 1.5) for s, m in cfg.segment_boosts.items() if task in m}, 1.0)
        for feature, limit, target, factor in cfg.boosts:
            if target == task:
                w = w * F.when(F.coalesce(F.col(feature), _zero()) > limit, min(max(factor, 1.0), 1.5)).otherwise(1.0)
        return w

    ws = {t: F.when(F.col(t).isNotNull(), weight(t, b)).otherwise(0.0) for t, b in cfg.weights.items()}
    total = _add(list(ws.values()))
    task = F.when(total > 0, _add([w * F.coalesce(F.col(t), _zero()) for t, w in ws.items()]) / F.when(total > 0, total)).otherwise(0.0)

    def num(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), _zero())

    def risk(c: str, rule: tuple[float, float]) -> Column:
        return F.when(num(c) > rule[0], rule[1]).otherwise(0.0)

    pen = F.least(risk("limit_util", cfg.risk_limit) + risk("churn_prob", cfg.risk_churn) + risk("n_messages_7d", cfg.risk_messages), F.lit(1.0))
    fat = F.pow(F.lit(cfg.fatigue), num("n_messages_7d") * _lookup(F.coalesce(F.col("channel"), F.lit("default")), cfg.channel_factor, cfg.channel_factor.get("default", 1.0)))
    out = df.withColumns({
        "s_task": task,
        "w_modifier": _lookup(seg, cfg.modifiers, 1.0),
        "v_velocity": 1.0 + cfg.velocity * F.coalesce(F.col("flare").cast("double"), _zero()),
        "risk_penalty": pen,
        "fatigue_factor": fat,
        "engagement_boost": 1.0 + cfg.engagement * num("engagement_score"),
    })
    raw = F.col("s_task") * F.col("w_modifier") * F.col("v_velocity") * F.greatest(1.0 - F.col("risk_penalty"), _zero()) * F.col("fatigue_factor") * F.col("engagement_boost")
    return out.withColumn(name, F.coalesce(F.nanvl(raw, _zero()), _zero()))


def filter_fatigue(max_messages: int = 3, decay: dict[str, float] | None = None, default: float = 0.90, floor: float = 0.2) -> Column:
    """Rejection reason, or NULL where the candidate passes."""
    n = F.coalesce(F.col("n_messages_7d"), F.lit(0))
    left = F.pow(_lookup(F.coalesce(F.col("channel"), F.lit("default")), decay or {}, default), n.cast("double"))
    return F.when(n >= max_messages, "fatigue_count").when(left < floor, "fatigue_score")


def filter_eligibility(min_score: float = 0.10, max_churn: float = 0.70, score: str = "score") -> Column:
    return F.when(F.coalesce(F.col(score), _zero()) < min_score, "eligibility_score").when(F.coalesce(F.col("churn_prob"), _zero()) > max_churn, "eligibility_churn")


def filter_suitability(senior_age: int = 65, senior_max: int = 2, low_income: float = 30_000_000, low_income_max: int = 3, require: bool = True) -> Column:
    """Unrated items pass; an unassessed customer, a too risky item, seniors and low incomes above their cap do not."""
    risk, tol = F.col("item_risk_level"), F.col("customer_risk_tolerance")
    out = F.when(risk.isNull(), F.lit(None).cast("string"))
    out = out.when(tol.isNull(), F.lit("suitability_unassessed" if require else None).cast("string"))
    out = out.when(risk > tol, "suitability_risk")
    out = out.when((F.col("customer_age") >= senior_age) & (risk > senior_max), "suitability_senior")
    return out.when((F.col("customer_income") < low_income) & (risk > low_income_max), "suitability_income")


def filter_owned(item: str = "item_id", owned: str = "owned_products") -> Column:
    return F.when(F.array_contains(F.col(owned), F.col(item)), "owned_product")


FILTERS: dict[str, Callable[..., Column]] = {"fatigue": filter_fatigue, "eligibility": filter_eligibility, "suitability": filter_suitability, "owned": filter_owned}


def apply_filters(df: DataFrame, chain: Sequence[Column], name: str = "reject_reason") -> DataFrame:
    """Reason of the first failing filter of the chain, NULL where all pass. Nothing is dropped here."""
    return df.withColumn(name, F.coalesce(*chain))


def pass_rates(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """(reason, n, share) with 'passed' for the survivors."""
    total = df.agg(F.count(F.lit(1))).scalar()
    g = df.groupBy(F.coalesce(F.col(reason), F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / total)


def top_k(df: DataFrame, key: str, score: str, item: str, k: int, min_score: float | None = None) -> DataFrame:
    """The k best rows per key with their rank; Spark cuts to k per task before the shuffle."""
    rows = df if min_score is None else df.where(F.col(score) >= min_score)
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(item))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recommend(df: DataFrame, cfg: CompositeConfig, chain: Sequence[Column], key: str, item: str, k: int = 5, reasons: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """Score, filter and rank every candidate of every customer; `reasons` are extra explanation columns."""
    scored = apply_filters(composite_score(df, cfg), chain)
    best = top_k(scored.where(F.col("reject_reason").isNull()), key, "score", item, k)
    return best.select("*", *[c.alias(n) for n, c in reasons]).drop("reject_reason")


# The product path of the next-best-action rule and the rule thresholds.
PRODUCT_PATH = ("deposits", "savings", "investment", "insurance", "lending")


def _num(df: DataFrame, c: str, default: float | None) -> Column:
    """Column as double with a default where it is missing from the frame or NULL."""
    d = F.lit(default).cast("double")
    return F.coalesce(F.col(c).try_cast("double"), d) if c in df.columns else d


def _rule(prediction: Column, confidence: Column, name: str | Column) -> dict[str, Column]:
    return {"prediction": prediction.cast("double"), "confidence": confidence.cast("double"), "rule": F.lit(name) if isinstance(name, str) else name}


def _flag(c: Column) -> Column:
    return c.cast("int")


def _rule_churn(df: DataFrame) -> dict[str, Column]:
    n = _flag(_num(df, "recency_days", 0) > 30) + _flag(_num(df, "frequency_trend", 0) < 0) + _flag(_num(df, "monetary_change_pct", 0) < -0.20)
    return _rule(_flag(n >= 2), 0.40 + 0.15 * n, "churn_rfm_decay")


def _rule_category_shift(df: DataFrame) -> dict[str, Column]:
    x = F.abs(_num(df, "mcc_entropy_change", 0))
    return _rule(_flag(x >= 0.15), 0.50 + F.least(x * 2, F.lit(0.35)), "top_mcc_entropy")


def _rule_nba(df: DataFrame) -> dict[str, Column]:
    owned = [_flag(_num(df, c, 0) > 0) for c in df.columns if c.startswith("prod_")]
    n = F.greatest(_num(df, "num_products", 0), _add(owned).cast("double")) if owned else _num(df, "num_products", 0)
    # class = path position + 1; below two products the first step
    return _rule(F.when(n < 2, 1).otherwise(F.least(n, F.lit(len(PRODUCT_PATH) - 1.0)) + 1), F.lit(0.55), "nba_adjacency_matrix")


def _rule_segment(df: DataFrame) -> dict[str, Column]:
    b, f, p = _num(df, "balance", 0), _num(df, "monthly_freq", 0), _num(df, "num_products", 0)
    s = F.when(b >= 50000, 2).when(b >= 10000, 1).otherwise(0) + F.when(f >= 20, 2).when(f >= 5, 1).otherwise(0) + F.when(p >= 4, 2).when(p >= 2, 1).otherwise(0)
    return _rule(F.when(s >= 5, 0).when(s >= 3, 1).when(s >= 1, 2).otherwise(3), F.lit(0.50), "segment_3axis")


def _rule_deposits(df: DataFrame) -> dict[str, Column]:
    b, s = _num(df, "balance", 0), _num(df, "monthly_spend", 0)
    r = F.when(b > 0, F.greatest((b - s) / F.when(b > 0, b), _zero())).otherwise(0.0)
    return _rule(_flag(r >= 0.30), 0.40 + 0.30 * F.least(r, F.lit(1.0)), "deposits_surplus_ratio")


def _rule_investments(df: DataFrame) -> dict[str, Column]:
    ok = (_num(df, "risk_grade", 1) >= 3) & (_num(df, "asset_percentile", 0) >= 30)
    return _rule(_flag(ok), F.when(ok, 0.55).otherwise(0.70), "investments_risk_asset")


def _rule_accounts(df: DataFrame) -> dict[str, Column]:
    n = (
        _flag(_num(df, "tenure_months", 999) * 30 <= 90)
        + 2 * _flag((_num(df, "salary_deposit_flag", 0) > 0) & (_num(df, "is_primary_bank", 1) == 0))
        + _flag(_num(df, "interbank_transfer_pct", 0) >= 0.30)
    )
    return _rule(_flag(n >= 2), 0.40 + 0.15 * F.least(n, F.lit(3)), "accounts_pattern")


def _rule_lending(df: DataFrame) -> dict[str, Column]:
    ok = (_num(df, "credit_grade", 10) <= 4) & (_num(df, "dti", 1.0) < 0.40)
    return _rule(_flag(ok), F.when(ok, 0.60).otherwise(0.70), "lending_credit_dti")


def _rule_payments(df: DataFrame) -> dict[str, Column]:
    ok = (_num(df, "foreign_txn_pct", 0) >= 0.10) | ((_num(df, "card_spend_percentile", 0) >= 70) & (_num(df, "num_cards", 0) <= 1))
    return _rule(_flag(ok), F.when(ok, 0.65).otherwise(0.60), "payments_spend_foreign")


def _rule_stability(df: DataFrame) -> dict[str, Column]:
    d, b = _num(df, "days_since_last_txn", 0), _num(df, "balance_change_pct", 0)
    s = F.when(d >= 90, 0.30 + b * 0.1).when(d >= 60, 0.55 + b * 0.1).when(d >= 30, 0.75 + b * 0.05).otherwise(0.92 + b * 0.02)
    return _rule(F.round(F.least(F.greatest(s, _zero()), F.lit(1.0)), 4), F.lit(0.50), "stability_dormancy")


def _rule_cross_sell(df: DataFrame) -> dict[str, Column]:
    c = _num(df, "clv_percentile", 50)
    target = F.when(c >= 80, 4).when(c >= 40, 3).when(c >= 20, 2).otherwise(1)
    return _rule(F.greatest(target - _num(df, "num_products", 0), _zero()), F.lit(0.50), "cross_sell_clv_tier")


def _rule_next_category(df: DataFrame) -> dict[str, Column]:
    return _rule(_num(df, "top_mcc_code", 0), F.lit(0.45), "next_mcc_frequency")


def _rule_diversity(df: DataFrame) -> dict[str, Column]:
    recent = _num(df, "mcc_entropy_recent", 0)
    prior = F.coalesce(_num(df, "mcc_entropy_prior", None), recent)
    return _rule(F.round(recent - prior, 4), F.lit(0.40), "diversity_entropy_trend")


RULES: dict[str, Callable[[DataFrame], dict[str, Column]]] = {
    "churn_signal": _rule_churn,
    "top_mcc_shift": _rule_category_shift,
    "nba_primary": _rule_nba,
    "segment_prediction": _rule_segment,
    "will_acquire_deposits": _rule_deposits,
    "will_acquire_investments": _rule_investments,
    "will_acquire_accounts": _rule_accounts,
    "will_acquire_lending": _rule_lending,
    "will_acquire_payments": _rule_payments,
    "product_stability": _rule_stability,
    "cross_sell_count": _rule_cross_sell,
    "next_mcc": _rule_next_category,
    "mcc_diversity_trend": _rule_diversity,
}

#: Columns each rule reads, in order of weight.
RULE_INPUTS: dict[str, tuple[str, ...]] = {
    "churn_signal": ("recency_days", "frequency_trend", "monetary_change_pct"),
    "top_mcc_shift": ("mcc_entropy_change",),
    "nba_primary": ("num_products",),
    "segment_prediction": ("balance", "monthly_freq", "num_products"),
    "will_acquire_deposits": ("balance", "monthly_spend"),
    "will_acquire_investments": ("risk_grade", "asset_percentile"),
    "will_acquire_accounts": ("salary_deposit_flag", "interbank_transfer_pct", "tenure_months"),
    "will_acquire_lending": ("credit_grade", "dti"),
    "will_acquire_payments": ("foreign_txn_pct", "card_spend_percentile", "num_cards"),
    "product_stability": ("days_since_last_txn", "balance_change_pct"),
    "cross_sell_count": ("clv_percentile", "num_products"),
    "next_mcc": ("top_mcc_code",),
    "mcc_diversity_trend": ("mcc_entropy_recent", "mcc_entropy_prior"),
}


def rule_predict(df: DataFrame, key: str, tasks: Sequence[str], required_grade: dict[str, int] | None = None) -> DataFrame:
    """(key, task, prediction, confidence, rule, contributing) for every row and task.

    A task with a required grade is blocked (0 with confidence 1) for customers without a readable
    grade or with a lower one. All tasks are evaluated in one projection and unfolded.
    """
    grade = F.coalesce(*[F.col(c).try_cast("int") for c in ("risk_grade", "suitability_grade") if c in df.columns], F.lit(None).cast("int"))
    present = F.coalesce(*[F.col(c).cast("string") for c in ("risk_grade", "suitability_grade") if c in df.columns], F.lit(None).cast("string"))
    rows = []
    for t in tasks:
        r = RULES[t](df)
        need = (required_grade or {}).get(t, 0)
        if need > 0:
            unknown = present.isNull()
            blocked = unknown | (F.coalesce(grade, F.lit(0)) < need)
            r = {
                "prediction": F.when(blocked, 0.0).otherwise(r["prediction"]),
                "confidence": F.when(blocked, 1.0).otherwise(r["confidence"]),
                "rule": F.when(unknown, "suitability_unassessed").when(blocked, "suitability_block").otherwise(r["rule"]),
            }
        used = F.array(*[F.lit(c) for c in RULE_INPUTS[t] if c in df.columns]).cast("array<string>")
        rows.append(F.struct(F.lit(t).alias("task"), *[v.alias(n) for n, v in r.items()], used.alias("contributing")))
    return df.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")


# Teacher quality limits of the router.
TEACHER_MIN = {"binary": 0.60, "multiclass": 2.0, "regression": 0.05}


def route(tasks: DataFrame, checks: DataFrame, teacher: DataFrame, limits: dict[str, float], rules: Sequence[str], human: bool = True) -> DataFrame:
    """Layer per task: 1 distilled, 2 direct, 3 rule, 4 human.

    `tasks` has (task, task_type, has_model), `checks` one fidelity measurement per row
    (task, metric, value, higher_is_better) and `teacher` (task, quality). The first layer needs a good
    teacher and every limit met, the second any limit met or no measurement at all.
    """
    lim = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    bound = F.try_element_at(lim, F.col("metric"))
    ok = F.when(F.col("higher_is_better"), F.col("value") >= bound).otherwise(F.col("value") <= bound)
    c = checks.where(bound.isNotNull()).groupBy("task").agg(F.bool_and(ok).alias("_all"), F.bool_or(ok).alias("_any"))
    j = tasks.join(c, "task", "left").join(teacher, "task", "left")
    need = _lookup(F.col("task_type"), TEACHER_MIN, 0.0)
    good = F.coalesce(F.col("quality") >= need, F.lit(False))
    layer = (
        F.when(F.col("has_model") & good & F.coalesce(F.col("_all"), F.lit(False)), 1)
        .when(F.col("has_model") & F.coalesce(F.col("_any"), F.lit(True)), 2)
        .when(F.col("task").isin(*rules), 3)
        .otherwise(4 if human else 3)
    )
    return j.withColumn("layer", layer).select(*tasks.columns, "layer")


def popularity(events: DataFrame, item: str, k: int, where: Column | None = None) -> DataFrame:
    """The k most used items: (item, n, rank)."""
    rows = events if where is None else events.where(where)
    top = rows.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(item)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(item))))


# Default action distribution of a customer without history.
ACTION_PRIOR = (0.22, 0.18, 0.14, 0.12, 0.10, 0.08, 0.06, 0.04, 0.02, 0.02, 0.01, 0.01)
CHANNEL_CLASSES = {"app": 0, "mobile": 0, "web": 1, "branch": 2, "offline": 2}


def cold_start_class(user: str = "user_id", segment: str = "segment", age_days: str | None = None, threshold: int = 0) -> Column:
    """ANONYMOUS or COLDSTART."""
    s = F.upper(F.col(segment).cast("string"))
    out = F.when(F.col(user).isNull() | (F.col(user).cast("string") == ""), "ANONYMOUS").when(s.isin("0", "ANONYMOUS"), "ANONYMOUS").when(s.isin("1", "COLDSTART"), "COLDSTART")
    if age_days and threshold > 0:
        out = out.when(F.col(age_days) < threshold, "ANONYMOUS")
    return out.otherwise("COLDSTART")


def cold_start(df: DataFrame, channel: str, ts: str, means: dict[str, float], classes: dict[str, int], popular: Sequence = ()) -> DataFrame:
    """Default predictions per row: constants, uniform class vectors, channel, timing and action vectors, popular items."""
    slot = F.weekday(ts) * 4 + F.floor(F.hour(ts) / 6)
    def near(i: Column) -> Column:
        d = F.abs(i - slot)
        return F.exp(-0.5 * F.pow(F.least(d, 28 - d) / 3.0, F.lit(2.0)))

    slots = F.sequence(F.lit(0), F.lit(27))
    # the 28 weights are a rotation of one fixed vector, so their sum does not depend on the slot
    total = sum(2.718281828459045 ** (-0.5 * (min(i, 28 - i) / 3.0) ** 2) for i in range(28))
    ch = _lookup(F.lower(F.col(channel)), {k: float(v) for k, v in CHANNEL_CLASSES.items()}, -1.0)
    third = round(1 / 3, 6)
    norm = sum(ACTION_PRIOR)
    cols = {
        "pred_ctr": F.lit(0.05), "pred_churn": F.lit(0.08), "pred_retention": F.lit(0.60),
        **{f"pred_{t}": F.lit(float(m)) for t, m in means.items()},
        **{f"pred_{t}": F.array(*[F.lit(round(1 / n, 6))] * n) for t, n in classes.items()},
        "pred_channel": F.array(*[F.when(ch < 0, third).when(ch == i, 0.90).otherwise(0.05) for i in range(3)]),
        "pred_timing": F.transform(slots, lambda i: F.round(near(i) / total, 6)),
        "pred_nba": F.array(*[F.lit(round(p / norm, 6)) for p in ACTION_PRIOR]),
    }
    if popular:
        cols["candidates"] = F.array(*[F.lit(p) for p in popular])
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def contactable(requests: DataFrame, consent: DataFrame, dnc: DataFrame, customer: str = "customer_id", channel: str = "channel", at: str = "at", exempt: Sequence[str] = ()) -> DataFrame:
    """(contactable, reason): do-not-contact list, then the 21-08 Seoul night window, then a valid consent.

    `consent` holds events (customer, channel, recorded_at, consented, expires_at); the newest counts.
    """
    latest = latest_per_key(consent, [customer, channel], ["recorded_at"]).select(customer, channel, F.col("consented").alias("_ok"), F.col("expires_at").alias("_until"))
    blocked = dnc.select(customer).distinct().withColumn("_dnc", F.lit(True))
    j = requests.join(blocked, customer, "left").join(latest, [customer, channel], "left")
    hour = F.hour(F.from_utc_timestamp(F.col(at).cast("timestamp"), "Asia/Seoul"))
    night = ((hour >= 21) | (hour < 8)) & (~F.col(channel).isin(*exempt) if exempt else F.lit(True))
    live = F.coalesce(F.col("_ok"), F.lit(False)) & (F.col("_until").isNull() | (F.col("_until").cast("timestamp") >= F.col(at).cast("timestamp")))
    reason = F.when(F.col("_dnc"), "customer_on_dnc_list").when(night, "nighttime_restriction").when(~live, "no_active_consent")
    return j.select(*requests.columns, reason.isNull().cast("int").alias("contactable"), F.coalesce(reason, F.lit("")).alias("reason"))


def review_triage(df: DataFrame, key: str, tier: str, sample: float = 0.05, seed: int = 42) -> DataFrame:
    """Queue state: tiers 2 and 3 always, tier 1 by a hash draw."""
    draw = md5_unit(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    queued = (F.col(tier) >= 2) | ((F.col(tier) == 1) & (draw < sample))
    return df.withColumns({"queued": queued.cast("int"), "handling": F.when(F.col(tier) == 3, "human").when(F.col(tier) == 2, "review").when(queued, "post_hoc").otherwise("auto")})


def review_summary(df: DataFrame, tier: str) -> DataFrame:
    """Per tier the number of decisions, queued ones and the human share, with a total row."""
    return df.rollup(tier).agg(F.count(F.lit(1)).alias("total"), F.sum("queued").alias("queued"), F.avg(F.col("queued").cast("double")).alias("human_share"))


# Feature-name prefixes and the reason category they stand for.
PREFIX_CATEGORY = {
    "spend_": "spending_pattern", "amount_": "spending_pattern", "avg_txn_": "spending_pattern", "total_": "spending_pattern",
    "txn_count_": "frequency_pattern", "freq_": "frequency_pattern", "count_": "frequency_pattern", "mcc_": "frequency_pattern", "merchant_": "frequency_pattern",
    "age_": "life_stage", "life_stage_": "life_stage", "tenure_": "life_stage", "income_": "life_stage",
    "benefit_": "benefit_match", "reward_": "benefit_match", "cashback_": "benefit_match",
    "product_": "portfolio", "portfolio_": "portfolio", "card_": "portfolio",
    "churn_": "risk", "risk_": "risk", "fatigue_": "risk", "ctx_": "spending_pattern",
}
CATEGORIES = ("spending_pattern", "frequency_pattern", "life_stage", "benefit_match", "portfolio", "risk")


def feature_category(f: Column) -> Column:
    """Category by prefix, else a stable one from the name's MD5."""
    from tallyframe.operators.normalise import hash_code

    low = F.lower(f)
    out = None
    for p, c in PREFIX_CATEGORY.items():
        out = F.when(low.startswith(p), c) if out is None else out.when(low.startswith(p), c)
    return out.otherwise(F.get(F.array(*[F.lit(c) for c in CATEGORIES]), hash_code(f, len(CATEGORIES)).cast("int")))


def template_reasons(df: DataFrame, feats: str, templates: dict[str, str], auxiliary: str, empty: str, first: int) -> DataFrame:
    """Reason text from the `first` features: the first one's template, then the other categories."""
    cats = F.transform(F.slice(feats, 1, first), feature_category)
    texts = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])
    out = df.withColumn("_cats", cats).withColumn("category", F.get("_cats", F.lit(0)))
    aux = F.array_except(F.array_distinct("_cats"), F.array("category"))
    names = F.concat_ws(", ", aux)
    text = F.concat(F.try_element_at(texts, F.col("category")), F.when(F.size(aux) > 0, F.concat(F.lit(f" {auxiliary} "), names, F.lit("."))).otherwise(""))
    return out.withColumn("reason", F.coalesce(text, F.lit(empty))).drop("_cats")


def category_distribution(df: DataFrame, category: str = "category") -> DataFrame:
    """Count per primary category; categories that never occur count 0."""
    all_ = df.sparkSession.createDataFrame([(c,) for c in CATEGORIES], f"{category} string")
    return all_.join(df.groupBy(category).agg(F.count(F.lit(1)).alias("n")), category, "left").fillna(0, ["n"])
