"""Per-entity aggregates of event tables.

Every aggregate is a grouped sum, count or extremum that combines map-side, so a hot entity reaches
its reducer as one partial row per task. Windows run only on tables that are already aggregated to
(entity, category) or (entity, month).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.stats import safe_div
from tallyframe.plans.quantiles import exact_quantiles

FLOOR = 1e-8


def txn_summary(txn: DataFrame, user: str, amount: str, date: str, merchant: str, state: str, error: Column) -> DataFrame:
    """Count, sum, mean, sample std (0 if undefined), max, min, last date, distinct merchants and states, error share."""
    return txn.groupBy(user).agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.sum(amount).alias("txn_total"),
        F.avg(amount).alias("txn_mean"),
        F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("txn_std"),
        F.max(amount).alias("txn_max"),
        F.min(amount).alias("txn_min"),
        F.max(date).alias("last_date"),
        F.count_distinct(merchant).alias("n_merchants"),
        F.count_distinct(state).alias("n_states"),
        F.avg(error.cast("double")).alias("error_rate"),
    )


def rfm(users: DataFrame, summary: DataFrame, key: str, ref_date: str | Column, keep: Sequence[str] = ()) -> DataFrame:
    """Recency in days (9999 without transactions), frequency, monetary; demographics are carried along."""
    ref = F.lit(ref_date).cast("date") if isinstance(ref_date, str) else ref_date
    return users.select(key, *keep).join(summary, key, "left").select(
        key,
        *keep,
        F.coalesce(F.datediff(ref, "last_date"), F.lit(9999)).alias("recency"),
        F.coalesce("txn_count", F.lit(0)).alias("frequency"),
        F.coalesce("txn_total", F.lit(0.0)).alias("monetary"),
        F.coalesce("txn_mean", F.lit(0.0)).alias("avg_amount"),
    )


def top_values(df: DataFrame, col: str, n: int) -> list:
    """The n most frequent values; ties in ascending value order."""
    rows = df.where(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), F.asc(col)).limit(n).collect()
    return [r[0] for r in rows]


def category_shares(txn: DataFrame, user: str, cat: str, amount: str, n: int = 60, prefix: str = "share_") -> DataFrame:
    """Share of a user's spend in each of the n most frequent categories of the whole table."""
    cats = top_values(txn, cat, n)
    total = F.greatest(F.sum(amount), F.lit(FLOOR))
    return txn.groupBy(user).agg(*[(F.sum(F.when(F.col(cat) == c, F.col(amount)).otherwise(0.0)) / total).alias(f"{prefix}{i + 1}") for i, c in enumerate(cats)])


def monthly_pivot(txn: DataFrame, user: str, date: str, amount: str) -> DataFrame:
    """cnt_01..12 and amt_01..12 by calendar month."""
    m = F.month(date)
    return txn.groupBy(user).agg(
        *[F.sum((m == i).cast("long")).alias(f"cnt_{i:02d}") for i in range(1, 13)],
        *[F.sum(F.when(m == i, F.col(amount)).otherwise(0.0)).alias(f"amt_{i:02d}") for i in range(1, 13)],
    )


def month_index(date: str | Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def trailing_months(txn: DataFrame, user: str, date: str, amount: str, k: int = 12) -> DataFrame:
    """Amount and count in each of the last k calendar months, counted back from the table's newest month."""
    newest = txn.agg(F.max(date)).first()[0]
    last = newest.year * 12 + newest.month - 1
    ago = F.lit(last) - month_index(date)
    return txn.groupBy(user).agg(
        *[F.sum(F.when(ago == i, F.col(amount)).otherwise(0.0)).alias(f"amt_m{i}") for i in range(k)],
        *[F.sum((ago == i).cast("long")).alias(f"cnt_m{i}") for i in range(k)],
    )


def quarterly(txn: DataFrame, user: str, date: str, amount: str, latest_year_only: bool = False) -> DataFrame:
    q = F.quarter(date)
    rows = txn
    if latest_year_only:
        year = txn.agg(F.max(F.year(date))).first()[0]
        rows = txn.where(F.year(date) == year)
    return rows.groupBy(user).agg(*[F.sum(F.when(q == i, F.col(amount)).otherwise(0.0)).alias(f"amt_q{i}") for i in range(1, 5)])


def ratio_bundle(txn: DataFrame, user: str, shares: dict[str, Column], counts: dict[str, Column] | None = None) -> DataFrame:
    """Share of a user's rows that satisfy each predicate, and plain counts."""
    return txn.groupBy(user).agg(
        *[F.avg(F.when(p, 1.0).otherwise(0.0)).alias(n) for n, p in shares.items()],
        *[F.sum(F.when(p, 1).otherwise(0)).alias(n) for n, p in (counts or {}).items()],
    )


def time_predicates(ts: str, hour_bins: int = 6) -> dict[str, Column]:
    """Weekday, weekend and equal hour bins of a day."""
    width = 24 // hour_bins
    wd = F.weekday(ts)
    out = {"weekday": wd < 5, "weekend": wd >= 5}
    out.update({f"h{i * width:02d}_{(i + 1) * width:02d}": F.floor(F.hour(ts) / width) == i for i in range(hour_bins)})
    return out


def category_totals(txn: DataFrame, user: str, cat: str, amount: str) -> DataFrame:
    """(user, cat, amt, cnt): the table all concentration measures start from."""
    return txn.groupBy(user, cat).agg(F.sum(amount).alias("amt"), F.count(F.lit(1)).alias("cnt"))


def diversity(txn: DataFrame, user: str, cat: str, amount: str) -> DataFrame:
    """Distinct categories, entropy -sum(p ln max(p, 1e-15)), concentration and the share of the three largest.

    With p = a / T the sums over p are sums over a, so one grouped pass is enough and a user with very
    many categories stays a partial sum per task; only the three largest are ranked, and Spark cuts
    to three per task before the shuffle.
    """
    per = category_totals(txn, user, cat, amount)
    a, total = F.col("amt"), F.greatest(F.sum("amt"), F.lit(FLOOR))
    pos = a > 0
    up, down = F.sum(F.when(pos, a).otherwise(0.0)), F.sum(F.when(pos, 0.0).otherwise(a))
    log_sum = F.sum(F.when(pos, a * F.ln(F.when(pos, a))).otherwise(0.0))
    main = per.groupBy(user).agg(
        F.count(cat).alias("n_categories"),
        (-(log_sum - up * F.ln(total) + down * math.log(1e-15)) / total).alias("entropy"),
        (F.sum(a * a) / (total * total)).alias("hhi"),
        total.alias("_t"),
    )
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("amt"), cat))
    top = per.withColumn("_r", rank).where(F.col("_r") <= 3).groupBy(user).agg(F.sum("amt").alias("_top"))
    return main.join(top, user).select(user, "n_categories", "entropy", "hhi", (F.col("_top") / F.col("_t")).alias("top3_share"))


def hhi(txn: DataFrame, user: str, cat: str, amount: str) -> DataFrame:
    """Sum of squared spend shares."""
    total = F.greatest(F.sum("amt"), F.lit(FLOOR))
    return category_totals(txn, user, cat, amount).groupBy(user).agg((F.sum(F.col("amt") * F.col("amt")) / (total * total)).alias("hhi"))


def hierarchy_counts(txn: DataFrame, user: str, groups: dict[str, Column], channel: str, channels: Sequence[str], brand: str, n_cross: int = 7) -> DataFrame:
    """Code-group counts, channel counts and the n_cross most frequent brand x channel pairs as ratios."""
    pair = F.concat_ws("|", F.col(brand), F.col(channel))
    tops = top_values(txn.select(pair.alias("pair")), "pair", n_cross)
    total = F.count(F.lit(1))
    return txn.groupBy(user).agg(
        *[F.sum(F.when(p, 1).otherwise(0)).alias(f"grp_{n}") for n, p in groups.items()],
        *[F.sum((F.col(channel) == c).cast("long")).alias(f"ch_{c}") for c in channels],
        *[(F.sum(F.when(pair == t, 1).otherwise(0)) / total).alias(f"cross_{i + 1}") for i, t in enumerate(tops)],
    )


def anomaly_counts(txn: DataFrame, group: Sequence[str], amount: str, sigmas: float = 3.0) -> DataFrame:
    """Rows per group with abs(amount) above the table's mean + sigmas * std."""
    limit = txn.agg((F.avg(amount) + sigmas * F.stddev_samp(amount)).alias("t")).scalar()
    return txn.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum((F.abs(amount) > limit).cast("long")).alias("anomalies"))


def monthly_trend(txn: DataFrame, user: str, date: str, amount: str, spans: Sequence[int] = (3, 6, 12)) -> DataFrame:
    """Mean monthly amount and count over the last 3/6/12 active months, months seen, YYYYMM span and slope."""
    ym = F.year(date) * 100 + F.month(date)
    per = txn.groupBy(user, ym.alias("ym")).agg(F.count(F.lit(1)).alias("cnt"), F.sum(amount).alias("amt"))
    per = per.withColumn("_r", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("ym"))))
    return per.groupBy(user).agg(
        F.count(F.lit(1)).alias("n_months"),
        (F.max("ym") - F.min("ym")).alias("span_months"),
        *[F.avg(F.when(F.col("_r") <= k, F.col("amt"))).alias(f"amt_{k}m") for k in spans],
        *[F.avg(F.when(F.col("_r") <= k, F.col("cnt"))).alias(f"cnt_{k}m") for k in spans],
        F.coalesce(F.regr_slope("amt", "ym"), F.lit(0.0)).alias("trend_slope"),
    )


def dense_month_trend(txn: DataFrame, user: str, date: str, amount: str, spans: Sequence[int] = (3, 6, 12)) -> DataFrame:
    """Calendar-month totals 1..12 as a dense array: rolling means, OLS slope, active months, day span."""
    m = F.month(date)
    per = txn.groupBy(user).agg(
        F.array(*[F.sum(F.when(m == i, F.col(amount)).otherwise(0.0)) for i in range(1, 13)]).alias("amts"),
        F.datediff(F.max(date), F.min(date)).alias("span_days"),
    )
    def rolled(k: int) -> Column:
        def mean_at(_, i):
            part = F.slice("amts", F.greatest(i - k + 2, F.lit(1)), F.least(i + 1, F.lit(k)))
            return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.least(i + 1, F.lit(k))

        return F.transform("amts", mean_at).alias(f"roll_{k}")

    # slope over x = 1..12: sum((x - 6.5) y) / 143
    slope = F.aggregate(F.transform("amts", lambda y, i: (i - 5.5) * y), F.lit(0.0), lambda s, x: s + x) / 143.0
    active = F.size(F.filter("amts", lambda x: x > 0))
    return per.select(user, "span_days", *[rolled(k) for k in spans], slope.alias("slope"), active.alias("active_months"))


def mode_per_group(df: DataFrame, key: str, col: str, name: str | None = None) -> DataFrame:
    """Most frequent value per key, ties to the smallest; two combined aggregates, no value map per key."""
    per = df.where(F.col(col).isNotNull()).groupBy(key, col).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v")))
    return per.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.v").alias(name or f"{col}_mode"))


def modes_per_group(df: DataFrame, key: str, cols: dict[str, str]) -> DataFrame:
    """Most frequent value of several columns per key in one pass, `cols` maps a column to its result name.

    Every row contributes one (column, value) pair per column; the pairs are counted map-side, so
    the input is read once however many columns there are.
    """
    types = dict(df.dtypes)
    pairs = F.array(*[F.struct(F.lit(i).alias("d"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])
    per = df.select(key, F.explode(pairs).alias("p")).where("p.v IS NOT NULL").groupBy(key, "p.d", "p.v").agg(F.count(F.lit(1)).alias("n"))
    best = [F.min(F.when(F.col("d") == i, F.struct((-F.col("n")).alias("n"), F.col("v").cast(types[c]).alias("v"))))["v"].alias(out) for i, (c, out) in enumerate(cols.items())]
    return per.groupBy(key).agg(*best)


def top1(df: DataFrame, key: str, cat: str) -> DataFrame:
    """(key, cat, cnt) of the most frequent category."""
    per = df.groupBy(key, cat).agg(F.count(F.lit(1)).alias("cnt"))
    best = per.groupBy(key).agg(F.min(F.struct((-F.col("cnt")).alias("n"), F.col(cat).alias("c"))).alias("b"))
    return best.select(key, F.col("b.c").alias(cat), (-F.col("b.n")).alias("cnt"))


def median_gap(txn: DataFrame, user: str, date: str) -> DataFrame:
    """Median days between consecutive transactions (same-day pairs count as 0).

    Same-day rows are folded first: a day with n rows adds n - 1 zero gaps and one gap to the day
    before, so only (user, day) rows are ordered.
    """
    days = txn.groupBy(user, date).agg(F.count(F.lit(1)).alias("n"))

    # at most one row per calendar day and user is ordered here
    prev = F.lag(date).over(Window.partitionBy(user).orderBy(date))
    g = days.withColumn("gap", F.datediff(date, prev))
    weights = g.select(user, F.explode(F.array(F.struct(F.col("gap"), F.lit(1).cast("long").alias("w")), F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("w")))).alias("e"))
    weights = weights.where("e.gap IS NOT NULL AND e.w > 0").select(user, "e.gap", "e.w")
    return weights.groupBy(user, "gap").agg(F.sum("w").alias("w")).groupBy(user).agg(F.percentile(F.col("gap"), F.lit(0.5), F.col("w")).alias("median_gap"))


def counts_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col))


def segment_stats(df: DataFrame, seg: str, cols: Sequence[str], where: str | Column | None = None) -> DataFrame:
    """COUNT, SUM, AVG and STDDEV per segment, optionally of filtered rows."""
    rows = df.where(where) if where is not None else df
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.sum(c).alias(f"sum_{c}"), F.avg(c).alias(f"avg_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    return rows.groupBy(seg).agg(*aggs)


def label_distribution(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, value, n, share) of categorical labels in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in labels])
    n = df.count()
    out = df.select(F.explode(pairs).alias("p")).groupBy("p.label", "p.value").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.lit(max(n, 1)))


def sequence_profile(df: DataFrame, col: str, ks: Sequence[int], cold: int, heavy: int) -> DataFrame:
    """Length moments and quantiles, coverage by K, cold and heavy shares of a list column as (metric, value)."""
    lens = df.select(F.when(F.col(col).isNotNull(), F.size(col)).alias("len"))
    probs = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
    q = exact_quantiles(lens, ["len"], probs)["len"]
    n = F.count(F.lit(1))
    pct = lambda cond: F.sum(F.when(cond, 100.0).otherwise(0.0)) / n
    stats = {
        "n": n.cast("double"),
        "mean": F.avg("len"),
        "std": F.stddev_samp("len"),
        "min": F.min("len").cast("double"),
        "max": F.max("len").cast("double"),
        "null_count": F.sum(F.col("len").isNull().cast("double")),
        "pct_cold": pct(F.col("len") <= cold),
        "pct_heavy": pct(F.col("len") > heavy),
        "pct_empty": pct(F.col("len") == 0),
    }
    for k in ks:
        stats[f"full_{k}"] = pct(F.col("len") <= k)
        stats[f"events_{k}"] = safe_div(F.sum(F.least("len", F.lit(k))) * 100.0, F.sum("len"))
    wide = lens.agg(*[e.alias(m) for m, e in stats.items()])
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in stats]
    rows += [F.struct(F.lit(f"p{int(p * 100)}").alias("metric"), F.lit(v).cast("double").alias("value")) for p, v in zip(probs, q)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def element_coverage(df: DataFrame, col: str, ns: Sequence[int]) -> DataFrame:
    """Distinct elements, total elements and the share covered by the n most frequent ones."""
    counts = df.select(F.explode(col).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.agg(F.count(F.lit(1)).alias("unique_values"), F.sum("cnt").alias("total"))
    tops = counts.orderBy(F.desc("cnt"), F.asc("v")).limit(max(ns))
    ranked = tops.withColumn("r", F.row_number().over(Window.orderBy(F.desc("cnt"), F.asc("v"))))
    cover = ranked.agg(*[F.sum(F.when(F.col("r") <= n, F.col("cnt")).otherwise(0)).alias(f"top_{n}") for n in ns])
    t = total.select(F.struct("*")).scalar()
    return cover.select(
        t["unique_values"].alias("unique_values"), t["total"].alias("total_events"), *[(F.col(f"top_{n}") * 100.0 / t["total"]).alias(f"top_{n}_pct") for n in ns]
    )


def interval_distribution(df: DataFrame, col: str) -> DataFrame:
    """Moments and quantiles of all elements of a numeric list column."""
    u = df.select(F.explode(F.col(col).cast("array<double>")).alias("d"))
    q = exact_quantiles(u, ["d"], [0.1, 0.5, 0.9, 0.99])["d"]
    out = u.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), F.min("d").alias("min"), F.max("d").alias("max"))
    return out.select("*", *[F.lit(v).alias(p) for p, v in zip(("p10", "p50", "p90", "p99"), q)])


def persona_distributions(txn: DataFrame, persona: str, cat: str, amount: str, hour: str, date: str) -> DataFrame:
    """(persona, kind, slot, n, share, log_mean, log_std): categories with log-amount moments, hours, months."""
    kinds = F.array(
        F.struct(F.lit("category").alias("kind"), F.col(cat).cast("string").alias("slot")),
        F.struct(F.lit("hour").alias("kind"), F.col(hour).cast("string").alias("slot")),
        F.struct(F.lit("month").alias("kind"), F.month(date).cast("string").alias("slot")),
    )
    la = F.ln(F.greatest(F.abs(amount), F.lit(0.01)))
    per = txn.select(persona, F.explode(kinds).alias("k"), la.alias("la")).groupBy(persona, "k.kind", "k.slot").agg(
        F.count(F.lit(1)).alias("n"), F.avg("la").alias("log_mean"), F.coalesce(F.stddev_samp("la"), F.lit(0.0)).alias("log_std")
    )
    total = F.sum("n").over(Window.partitionBy(persona, "kind"))
    return per.withColumn("share", F.col("n") / total)


def verdict_rollup(df: DataFrame, period: str, task: str, layer: str, verdict: str) -> DataFrame:
    """pass / revise / reject counts and rates per period overall, per task and per layer."""
    v = F.coalesce(F.col(verdict), F.lit("pass"))
    base = df.select(F.col(period), F.coalesce(task, F.lit("unknown")).alias(task), F.coalesce(layer, F.lit("L1")).alias(layer), v.alias("_v"))
    sets = base.groupingSets([[F.col(period)], [F.col(period), F.col(task)], [F.col(period), F.col(layer)]], F.col(period), F.col(task), F.col(layer))
    out = sets.agg(F.count(F.lit(1)).alias("total"), *[F.sum((F.col("_v") == x).cast("long")).alias(x) for x in ("pass", "revise", "reject")])
    return out.withColumns({"pass_rate": F.col("pass") / F.col("total"), "reject_rate": F.col("reject") / F.col("total")})


def sla_status(now: str, warn_days: int, submitted: str = "submitted_at", deadline: str = "sla_deadline", status: str = "status", processed: str = "processed_at") -> Column:
    at = F.lit(now).cast("timestamp")
    done = (F.col(status) == "processed") & F.col(processed).isNotNull()
    pending = F.col(status) == "pending"
    return (
        F.when(done & (F.col(processed) <= F.col(deadline)), "on_time")
        .when(done, "late")
        .when(pending & (at > F.col(deadline)), "breached_pending")
        .when(pending & (at >= F.col(deadline) - F.make_dt_interval(days=F.lit(warn_days))), "approaching")
        .otherwise("other")
    )


def sla_report(requests: DataFrame, t0: str, t1: str, now: str, warn_days: int = 7, kind: str = "request_type") -> DataFrame:
    """Requests submitted in [t0, t1]: state counts per type, with a NULL-type total row."""
    rows = requests.where(F.col("submitted_at").between(F.lit(t0).cast("timestamp"), F.lit(t1).cast("timestamp")))
    rows = rows.withColumn("_s", sla_status(now, warn_days))
    states = ("on_time", "late", "breached_pending", "approaching")
    return rows.rollup(kind).agg(F.count(F.lit(1)).alias("total"), *[F.sum((F.col("_s") == s).cast("long")).alias(s) for s in states])


def summarise_metrics(metrics: DataFrame) -> DataFrame:
    """Average metric per task type; only the metrics that belong to a type are averaged."""
    belongs = (
        ((F.col("task_type") == "binary") & F.col("metric").isin("auc", "accuracy"))
        | ((F.col("task_type") == "multiclass") & F.col("metric").isin("f1_macro", "accuracy", "ndcg@3"))
        | ((F.col("task_type") == "regression") & F.col("metric").isin("mae"))
    )
    return metrics.where(belongs).groupBy("task_type", "metric").agg(F.avg("value").alias("avg_value"), F.count_distinct("task").alias("n_tasks"))
