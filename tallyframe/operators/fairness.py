"""Group fairness, stage attribution and recommendation concentration.

All measures are ratios of sums, so each is one combined aggregate over the recommendations; the
remaining work is on tables with one row per group, pair or item.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.stats import safe_div
from tallyframe.operators.ranks import gini

# Violation limits.
DI_LOW, DI_HIGH, DIFF_MAX = 0.8, 1.25, 0.1
HERDING_LIMITS = {"max_hhi": 0.25, "min_entropy_ratio": 0.5, "max_top3": 0.6, "max_gini": 0.7}


def _flag(c: str) -> Column:
    return F.col(c).cast("boolean").cast("double")


def fairness(recs: DataFrame, attr: str, pairs: Sequence[tuple[str, str]], recommended: str = "recommended", actual: str | None = None) -> DataFrame:
    """(attribute, privileged, unprivileged, di, spd, eod) per pair, rounded to 6.

    An empty group gives parity (DI 1); a privileged group without any positive gives DI 0.
    """
    tpr = F.avg(F.when(_flag(actual) == 1, _flag(recommended))) if actual else F.lit(None).cast("double")
    g = recs.groupBy(F.col(attr).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(_flag(recommended), F.lit(0.0))).alias("rate"), tpr.alias("tpr"))
    p = recs.sparkSession.createDataFrame([(a, b) for a, b in pairs], "privileged string, unprivileged string")
    a, b = g.alias("a"), g.alias("b")
    j = p.join(a, F.col("privileged") == F.col("a.g"), "left").join(b, F.col("unprivileged") == F.col("b.g"), "left")
    empty = F.coalesce(F.col("a.n"), F.lit(0)) * F.coalesce(F.col("b.n"), F.lit(0)) == 0
    rate = lambda s: F.coalesce(F.col(f"{s}.rate"), F.lit(0.0))
    tp = lambda s: F.coalesce(F.col(f"{s}.tpr"), F.lit(0.0))
    return j.select(
        F.lit(attr).alias("attribute"),
        "privileged",
        "unprivileged",
        F.when(empty, 1.0).otherwise(F.round(safe_div(rate("b"), rate("a")), 6)).alias("di"),
        F.round(rate("b") - rate("a"), 6).alias("spd"),
        F.round(tp("b") - tp("a"), 6).alias("eod"),
    )


def fairness_report(measures: DataFrame) -> DataFrame:
    """Per attribute the worst values over pairs and the violated limits."""
    out = measures.groupBy("attribute").agg(
        F.min("di").alias("min_di"),
        F.max("di").alias("max_di"),
        F.max(F.struct(F.abs("spd").alias("a"), F.col("spd").alias("v")))["v"].alias("worst_spd"),
        F.max(F.struct(F.abs("eod").alias("a"), F.col("eod").alias("v")))["v"].alias("worst_eod"),
        F.count(F.lit(1)).alias("pairs"),
    )
    found = [
        F.when(F.col("min_di") < DI_LOW, "di_low"),
        F.when(F.col("max_di") > DI_HIGH, "di_high"),
        F.when(F.abs("worst_spd") > DIFF_MAX, "spd"),
        F.when(F.abs("worst_eod") > DIFF_MAX, "eod"),
    ]
    return out.withColumn("violations", F.concat_ws(",", *found)).withColumn("is_fair", (F.col("violations") == "").cast("int"))


def intersectional(recs: DataFrame, a: str, b: str, protected_a: Sequence[str], protected_b: Sequence[str], recommended: str = "recommended", min_size: int = 30, limit: float = DI_LOW) -> DataFrame:
    """Subgroup rate over overall rate for every protected (a, b) combination, beside both single-attribute ratios.

    `hidden` marks subgroups that fail although both attributes pass on their own. One cube gives
    the subgroup, single and overall rates together.
    """
    base = recs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    base = base.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.coalesce(_flag(recommended), F.lit(0.0)).alias("r"))
    c = base.cube("a", "b").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.avg("r").alias("rate"))
    both = c.where("gid = 0").where(F.col("a").isin(*protected_a) & F.col("b").isin(*protected_b) & (F.col("n") >= min_size))
    one_a = c.where("gid = 1").select("a", F.col("rate").alias("rate_a"))
    one_b = c.where("gid = 2").select("b", F.col("rate").alias("rate_b"))
    overall = c.where("gid = 3").select("rate").scalar()
    out = both.join(one_a, "a").join(one_b, "b").withColumn("_o", overall).where("_o > 0")
    out = out.select(
        "a", "b", "n",
        F.round(F.col("rate") / F.col("_o"), 4).alias("di"),
        F.round(F.col("rate_a") / F.col("_o"), 4).alias("di_a"),
        F.round(F.col("rate_b") / F.col("_o"), 4).alias("di_b"),
        (F.col("rate") / F.col("_o") < limit).cast("int").alias("violation"),
    )
    return out.withColumn("hidden", F.when((F.col("violation") == 1) & (F.col("di_a") >= limit) & (F.col("di_b") >= limit), 1).otherwise(0))


def bias_by_stage(customers: DataFrame, stages: Sequence[tuple[str, DataFrame]], key: str, attr: str, group: str, recommended: str = "recommended", min_size: int = 30) -> DataFrame:
    """Disparate impact of one group after each stage and the change to the stage before."""
    rows = reduce(DataFrame.unionByName, [
        d.select(key, F.coalesce(_flag(recommended), F.lit(0.0)).alias("r"), F.lit(i).alias("stage_no"), F.lit(n).alias("stage")) for i, (n, d) in enumerate(stages)
    ])
    j = rows.join(customers.select(key, F.col(attr).alias("_a")).where(F.col("_a").isNotNull()), key)
    mine = F.col("_a") == group
    g = j.groupBy("stage_no", "stage").agg(F.sum(F.when(mine, 1).otherwise(0)).alias("subgroup_size"), F.avg(F.when(mine, F.col("r"))).alias("sub"), F.avg("r").alias("all"))
    small = F.col("subgroup_size") < min_size
    g = g.select(
        "stage_no", "stage", "subgroup_size",
        F.when(small, 1.0).otherwise(F.round(safe_div(F.col("sub"), F.col("all")), 4)).alias("di"),
        F.when(small, 0.0).otherwise(F.round("sub", 4)).alias("subgroup_rate"),
        F.when(small, 0.0).otherwise(F.round("all", 4)).alias("overall_rate"),
    )
    # as many rows as stages
    delta = F.col("di") - F.lag("di").over(Window.orderBy("stage_no"))
    out = g.withColumn("delta", F.round(F.coalesce(delta, F.lit(0.0)), 4))
    worst = out.agg(F.min(F.struct("delta", "stage_no"))["stage_no"].alias("w"), F.min("delta").alias("d")).select(F.struct("*")).scalar()
    return out.withColumn("is_worst", ((F.col("stage_no") == worst["w"]) & (worst["d"] < 0)).cast("int"))


def herding(recs: DataFrame, item: str, limits: dict[str, float] | None = None) -> DataFrame:
    """Concentration of recommendations over items: one row of measures, violation count, severity."""
    t = {**HERDING_LIMITS, **(limits or {})}
    counts = recs.groupBy(F.coalesce(F.col(item).cast("string"), F.lit("unknown")).alias("item")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    p = F.col("n") / F.col("_t")
    top = counts.orderBy(F.desc("n"), "item").limit(3).agg(F.sum("n")).scalar()
    base = counts.withColumn("_t", total).agg(
        (-F.sum(p * F.log2(p))).alias("_e"), F.sum(p * p).alias("_h"), F.count(F.lit(1)).alias("unique_items"), F.max("_t").alias("_t")
    )
    g = gini(counts, [], "n").scalar()
    norm = F.when(F.col("unique_items") > 1, F.col("_e") / F.log2(F.col("unique_items").cast("double"))).otherwise(F.col("_e"))
    out = base.select("*", norm.alias("_n"), (top / F.col("_t")).alias("_top"), g.alias("_g"))
    risk = 0.3 * F.col("_h") + 0.3 * (1 - F.col("_n")) + 0.2 * F.col("_top") + 0.2 * F.col("_g")
    out = out.select(
        F.col("_t").cast("long").alias("total"),
        "unique_items",
        F.round("_e", 4).alias("entropy"),
        F.round("_n", 4).alias("normalised_entropy"),
        F.round("_h", 4).alias("hhi"),
        F.round("_top", 4).alias("top3_share"),
        F.round("_g", 4).alias("gini"),
        F.round(F.least(risk, F.lit(1.0)), 4).alias("risk"),
    )
    v = [F.col("hhi") > t["max_hhi"], F.col("normalised_entropy") < t["min_entropy_ratio"], F.col("top3_share") > t["max_top3"], F.col("gini") > t["max_gini"]]
    n = reduce(lambda a, b: a + b, [x.cast("int") for x in v])
    sev = F.when(n == 0, "none").when(n == 1, "low").when(n == 2, "medium").when(n == 3, "high").otherwise("critical")
    return out.select("*", n.alias("violations"), sev.alias("severity"), (n >= 2).cast("int").alias("is_herding"))


def task_herding(contrib: DataFrame, task: str, ratio: str, limit: float = 0.5) -> DataFrame:
    """Average contribution per task and whether one dominates."""
    return contrib.groupBy(task).agg(F.avg(ratio).alias("avg_ratio")).withColumn("dominant", (F.col("avg_ratio") > limit).cast("int"))
