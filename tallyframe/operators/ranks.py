"""Rank statistics computed from value tables, so ties and order never need a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.stats import safe_div
from tallyframe.plans.session import GROUP_ROWS
from tallyframe.plans.skew import value_positions


def auc(df: DataFrame, keys: Sequence[str], y: str, p: str, name: str = "auc", group_rows: int = GROUP_ROWS) -> DataFrame:
    """ROC AUC per key: positives times negatives ranked below (ties count half); NULL with one class."""
    pos, neg = (F.col(y) == 1).cast("double"), (F.col(y) == 0).cast("double")
    v = value_positions(df, keys, p, {"_pos": pos, "_neg": neg}, group_rows)
    below = F.col("cum__neg") - F.col("_neg") / 2
    agg = v.groupBy(*keys).agg(F.sum(F.col("_pos") * below).alias("_u"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    return agg.select(*keys, safe_div(F.col("_u"), F.col("_p") * F.col("_n"), None).alias(name))


def average_precision(df: DataFrame, keys: Sequence[str], y: str, p: str, name: str = "average_precision", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Sum of precision times recall step, thresholds from high to low."""
    flipped = df.withColumn("_neg_score", -F.col(p))
    v = value_positions(flipped, keys, "_neg_score", {"_pos": (F.col(y) == 1).cast("double"), "_all": F.lit(1.0)}, group_rows)
    agg = v.groupBy(*keys).agg(F.sum(F.col("_pos") * F.col("cum__pos") / F.col("cum__all")).alias("_s"), F.sum("_pos").alias("_p"))
    return agg.select(*keys, safe_div(F.col("_s"), F.col("_p"), 0.0).alias(name))


def value_ranks(df: DataFrame, keys: Sequence[str], col: str, name: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(keys, value, average rank) with one row per distinct value."""
    v = value_positions(df.where(F.col(col).isNotNull()), keys, col, {"_k": F.lit(1.0)}, group_rows)
    return v.select(*keys, col, (F.col("cum__k") - (F.col("_k") - 1) / 2).alias(name))


def weighted_corr(w: Column, a: Column, b: Column) -> Column:
    n, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    cov = F.sum(w * a * b) - sa * sb / n
    va, vb = F.sum(w * a * a) - sa * sa / n, F.sum(w * b * b) - sb * sb / n
    return F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb)).otherwise(0.0)


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "spearman", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Correlation of average ranks; rows are folded to distinct (a, b) pairs before ranks are joined."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = both.groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    ra = value_ranks(both, keys, a, "_ra", group_rows)
    rb = value_ranks(both, keys, b, "_rb", group_rows)
    j = pairs.join(ra, [*keys, a]).join(rb, [*keys, b])
    # centred ranks keep the sums of squares small
    mid = j.groupBy(*keys).agg((F.sum(F.col("_w")) / 2).alias("_mid"))
    j = j.join(mid, list(keys)) if keys else j.withColumn("_mid", mid.select("_mid").scalar())
    return j.groupBy(*keys).agg(weighted_corr(F.col("_w"), F.col("_ra") - F.col("_mid"), F.col("_rb") - F.col("_mid")).alias(name))


def gini(counts: DataFrame, keys: Sequence[str], value: str, name: str = "gini", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Gini coefficient of one non-negative value per row, per key."""
    v = value_positions(counts, keys, value, {"_k": F.lit(1.0)}, group_rows)
    # k equal values at ranks c-k+1..c contribute k * value * (2c - k)
    part = F.sum(F.col("_k") * F.col(value) * (2 * F.col("cum__k") - F.col("_k")))
    agg = v.groupBy(*keys).agg(part.alias("_s"), F.sum("_k").alias("_m"), F.sum(F.col("_k") * F.col(value)).alias("_t"))
    return agg.select(*keys, F.when(F.col("_t") > 0, F.col("_s") / (F.col("_m") * F.col("_t")) - 1.0).otherwise(0.0).alias(name))


def rank_in(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """row_number inside naturally small groups (a ranked list, a result page)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
