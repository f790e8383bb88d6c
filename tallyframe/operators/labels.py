"""Label derivation: one column per named rule, all in one projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.lists import halves, last_element, list_mode
from tallyframe.functions.stats import array_moments
from tallyframe.operators import aggs
from tallyframe.operators.joins import interval_join, new_elements
from tallyframe.plans.quantiles import exact_quantiles
from tallyframe.plans.session import written

Rule = dict[str, Any]


def _direct(df: DataFrame, r: Rule) -> Column:
    return F.col(r["source"])


def _bucket(df: DataFrame, r: Rule) -> Column:
    v = F.col(r["source"]).cast("double")
    fill = r.get("sentinel_class", 0)
    out = F.when(v.isNull() | (v == r["sentinel"]) if "sentinel" in r else v.isNull(), fill)
    for i, b in enumerate(r["boundaries"]):
        out = out.when(v < b, i)
    return out.otherwise(len(r["boundaries"])).cast("int")


def _string_map(df: DataFrame, r: Rule) -> Column:
    top = max(r["map"].values())
    default = r.get("default", top)
    if dict(df.dtypes)[r["source"]] != "string":
        return F.coalesce(F.least(F.col(r["source"]), F.lit(top)), F.lit(default)).cast("int")
    codes = F.create_map(*[F.lit(x) for kv in r["map"].items() for x in kv])
    return F.coalesce(F.try_element_at(codes, F.col(r["source"])), F.lit(default)).cast("int")


def _list_first(df: DataFrame, r: Rule) -> Column:
    return F.coalesce(F.get(r["source"], F.lit(0)), F.lit(r.get("default", 0))).cast("int")


def _list_first_group(df: DataFrame, r: Rule) -> Column:
    first = F.get(r["source"], F.lit(0)).cast("int")
    out = F.when(first.isNull(), r.get("default", 0))
    for cls, members in r["group_map"].items():
        out = out.when(first.isin(*members), cls)
    return out.otherwise(r.get("default", 0)).cast("int")


def _list_length(df: DataFrame, r: Rule) -> Column:
    return F.when(F.col(r["source"]).isNull(), 0).otherwise(F.size(r["source"]))


def _list_intersect(df: DataFrame, r: Rule) -> Column:
    wanted = F.array(*[F.lit(i) for i in r["indices"]]).cast(df.schema[r["source"]].dataType)
    return F.coalesce(F.arrays_overlap(F.col(r["source"]), wanted), F.lit(False)).cast("int")


def _weighted_sum(df: DataFrame, r: Rule) -> Column:
    cols = [(c, w) for c, w in zip(r["source"], r["weights"]) if c in df.columns]
    tops = df.agg(*[F.max(F.col(c).cast("double")).alias(c) for c, _ in cols]).first().asDict() if r.get("normalize") else {}
    out = F.lit(0.0)
    for c, w in cols:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        if r.get("normalize"):
            x = x / tops[c] if (tops[c] or 0) > 0 else F.lit(0.0)
        out = out + w * x
    return out


def _sequence_last(df: DataFrame, r: Rule) -> Column:
    last = last_element(r["source"]).cast("int")
    default = r.get("default", -1)
    if not r.get("top_k"):
        return F.coalesce(last, F.lit(default))
    tops = aggs.top_values(df.select(last.alias("v")), "v", r["top_k"])
    if not tops:
        return F.lit(default)
    codes = F.create_map(*[F.lit(x) for i, v in enumerate(tops) for x in (v, i)])
    return F.when(last.isNull(), default).otherwise(F.coalesce(F.try_element_at(codes, last), F.lit(default)))


def _diversity_trend(df: DataFrame, r: Rule) -> Column:
    a, b = halves(r["source"])
    ratio = F.size(F.array_distinct(b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1)) - 1.0
    return F.when(F.col(r["source"]).isNull() | (F.size(r["source"]) < 4), 0.0).otherwise(ratio)


def _mode_shift(df: DataFrame, r: Rule) -> Column:
    a, b = halves(r["source"])
    return F.when(F.size(r["source"]) >= 4, (list_mode(a) != list_mode(b)).cast("int")).otherwise(0)


def _nba(df: DataFrame, r: Rule) -> Column:
    """Products held in the last month but not in the one before, as 0-based positions."""
    got = [F.when((F.size(s) >= 2) & (last_element(s) == 1) & (F.get(s, F.size(s) - 2) == 0), i) for i, s in enumerate(r["source"])]
    return F.filter(F.array(*got), lambda x: x.isNotNull())


def _churn_signal(df: DataFrame, r: Rule) -> Column:
    c = F.col(r["source"])
    n = F.size(c)
    before = F.aggregate(F.slice(c, 1, F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, x: s + x)
    return F.when((n >= 3) & (last_element(c) < before / F.greatest(n - 1, F.lit(1)) * r.get("factor", 0.7)), 1).otherwise(0)


def _stability(df: DataFrame, r: Rule) -> Column:
    def score(_, m):
        spread = F.sqrt(m["m2"] / F.greatest(m["n"], F.lit(1.0)))
        return F.when((m["n"] >= 2) & (m["mean"] > 0), 1.0 - F.least(spread / F.when(m["mean"] > 0, m["mean"]), F.lit(1.0))).otherwise(1.0)

    return F.aggregate(F.array(array_moments(F.col(r["source"]))), F.lit(1.0), score)


def winsor_log(df: DataFrame, col: str, q: float = 0.995) -> Column:
    """log1p of the value clipped at its q-quantile."""
    cut = exact_quantiles(df, [col], [q])[col][0]
    return F.when(F.col(col).isNotNull(), F.log1p(F.least(F.col(col), F.lit(cut))))


RULES: dict[str, Callable[[DataFrame, Rule], Column]] = {
    "direct": _direct,
    "bucket": _bucket,
    "string_map": _string_map,
    "list_first": _list_first,
    "list_first_group": _list_first_group,
    "list_length": _list_length,
    "list_intersect": _list_intersect,
    "weighted_sum": _weighted_sum,
    "sequence_last": _sequence_last,
    "sequence_diversity_trend": _diversity_trend,
    "sequence_mode_shift": _mode_shift,
    "nba_from_history": _nba,
    "churn_signal": _churn_signal,
    "product_stability": _stability,
    "winsor_log": lambda df, r: winsor_log(df, r["source"], r.get("q", 0.995)),
    # older names of the same rules
    "first_from_list": _list_first,
    "len_of_list": _list_length,
    "nba_group_check": _list_intersect,
}

#: What a rule gives when its source column does not exist.
MISSING = {"bucket": 0, "string_map": 0, "list_first": 0, "list_first_group": 0, "list_length": 0, "list_intersect": 0, "weighted_sum": 0.0,
           "sequence_last": -1, "sequence_diversity_trend": 0.0, "sequence_mode_shift": 0, "churn_signal": 0, "product_stability": 1.0}


def derive_labels(df: DataFrame, spec: dict[str, Rule]) -> DataFrame:
    """Add one column per rule. A rule whose source is missing yields its type's default."""
    cols = []
    for name, rule in spec.items():
        src = rule.get("source")
        names = [src] if isinstance(src, str) else list(src or [])
        if any(c not in df.columns for c in names) and rule["type"] != "weighted_sum":
            cols.append(F.lit(rule.get("default", MISSING.get(rule["type"]))).alias(name))
        else:
            cols.append(RULES[rule["type"]](df, rule).alias(name))
    return df.select("*", *cols)


def card_labels(users: DataFrame, txn: DataFrame, ref_date: str, channels: Sequence[str], brands: Sequence[str], major: dict[int, Sequence[int]], user: str = "user_id") -> DataFrame:
    """The bundle of card labels per user from (amount, day, slot, channel, mcc, merchant, brand, fraud).

    `users` carries age and credit_limit. All parts are per-user aggregates joined by key.
    """
    ref = F.lit(ref_date).cast("date")
    m = F.month("day")
    core = txn.groupBy(user).agg(
        F.avg(F.col("fraud").cast("double")).alias("fraud_rate"),
        F.max("day").alias("last_date"),
        F.sum("amount").alias("total"),
        *[F.sum((m == i).cast("long")).alias(f"_c{i}") for i in range(1, 13)],
    )
    median = exact_quantiles(core, ["fraud_rate"], [0.5])["fraud_rate"][0]
    parts = [
        core,
        aggs.modes_per_group(txn, user, {"channel": "top_channel", "slot": "top_slot", "mcc": "mcc", "brand": "top_brand"}),
        aggs.median_gap(txn, user, "day"),
        aggs.hhi(txn, user, "merchant", "amount"),
    ]
    out = users
    for p in parts:
        out = out.join(p, user, "left")

    def code(col: str, values: Sequence[str]) -> Column:
        at = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col))
        return F.when(at > 0, at - 1).otherwise(0).cast("int")

    active = F.coalesce((F.col("last_date") >= F.date_sub(ref, 90)).cast("int"), F.lit(0))
    slope = sum((F.col(f"_c{i}") * (i - 6.5) for i in range(2, 13)), F.col("_c1") * -5.5) / 143.0
    nba = None
    for idx, codes in major.items():
        nba = F.when(F.col("mcc").isin(*codes), idx) if nba is None else nba.when(F.col("mcc").isin(*codes), idx)
    gap = F.coalesce(F.col("median_gap"), F.lit(999.0))
    total = F.coalesce(F.col("total"), F.lit(0.0))
    out = out.select(
        user,
        (F.coalesce(F.col("fraud_rate"), F.lit(0.0)) > F.lit(median)).cast("int").alias("label_is_fraud"),
        active.alias("label_will_transact"),
        (1 - active).alias("label_churn"),
        active.alias("label_retention"),
        F.least(F.greatest(F.floor((F.coalesce(F.col("age"), F.lit(30)) - 20) / 10), F.lit(0)), F.lit(4)).cast("int").alias("label_life_stage"),
        total.alias("label_ltv"),
        (total / F.greatest(F.coalesce(F.col("credit_limit"), F.lit(1.0)), F.lit(1.0))).alias("label_balance_util"),
        F.coalesce(slope, F.lit(0.0)).alias("label_engagement"),
        code("top_channel", channels).alias("label_channel"),
        F.least(F.coalesce(F.col("top_slot"), F.lit(0)), F.lit(7)).cast("int").alias("label_timing"),
        (nba.otherwise(7) % 15).cast("int").alias("label_nba"),
        (F.coalesce(F.col("mcc"), F.lit(0)) % 15).cast("int").alias("label_spending_category"),
        F.when(gap <= 10, 0).when(gap <= 20, 1).when(gap <= 35, 2).otherwise(3).alias("label_consumption_cycle"),
        (total / 12).alias("label_spending_amount"),
        F.coalesce(F.col("hhi"), F.lit(0.0)).alias("label_merchant_affinity"),
        code("top_brand", brands).alias("label_brand"),
    )
    out = written(out)  # one row per user; the cut points and the final projection read it back
    cuts = exact_quantiles(out, ["label_ltv", "label_spending_amount"], [0.995])
    return out.withColumns({c: F.when(F.col(c).isNotNull(), F.log1p(F.least(F.col(c), F.lit(q[0])))) for c, q in cuts.items()})


def future_labels(txn: DataFrame, windows: DataFrame, user: str = "user_id", horizon: int = 30) -> DataFrame:
    """Labels of the `horizon` days after each (win_id, win_start, win_end): spend, count, top category, new category.

    Only (user, window) pairs with at least one transaction after the window appear.
    """
    w = windows.withColumns({"lab_start": F.date_add("win_end", 1), "lab_end": F.date_add("win_end", horizon)})
    past = interval_join(txn, w, "day", "win_start", "win_end").groupBy(user, "win_id").agg(F.collect_set("mcc").alias("_past"))
    after = interval_join(txn, w, "day", "lab_start", "lab_end")
    per = after.groupBy(user, "win_id", "mcc").agg(F.sum("amount").alias("s"), F.count(F.lit(1)).alias("n"))
    lab = per.groupBy(user, "win_id").agg(
        F.sum("s").alias("label_spend"),
        F.sum("n").alias("label_txn_count"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("mcc").alias("v")))["v"].alias("label_top"),
        F.collect_set("mcc").alias("_new"),
    )
    out = lab.join(past, [user, "win_id"], "left")
    return out.select(user, "win_id", "label_spend", "label_txn_count", "label_top", new_elements(F.col("_past"), F.col("_new")).alias("has_new"))
