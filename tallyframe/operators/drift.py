"""Distribution and prediction drift. The three population stability indexes stay separate on purpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.ranks import auc, spearman
from tallyframe.plans.quantiles import exact_quantiles

# Drift limits of the monitor and of prediction comparison.
WARN_PSI, CRITICAL_PSI = 0.1, 0.25
MAX_PSI, MAX_JSD, MAX_SHIFT, MIN_RHO, MAX_AUC_SHIFT = 0.20, 0.10, 0.10, 0.95, 0.05


def bin_counts(ref: DataFrame, cur: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(feature, bin, r, c): counts per bin [e_i, e_i+1) with the last one closed, both frames in one aggregate."""
    def side(df: DataFrame, which: str) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("feature"), _bin(F.col(c).cast("double"), e).alias("bin")) for c, e in edges.items()]
        return df.select(F.explode(F.array(*cells)).alias("x")).select("x.feature", "x.bin", F.lit(which).alias("side")).where("bin IS NOT NULL")

    both = side(ref, "r").unionByName(side(cur, "c"))
    return both.groupBy("feature", "bin").agg(F.sum((F.col("side") == "r").cast("long")).alias("r"), F.sum((F.col("side") == "c").cast("long")).alias("c"))


def _bin(v: Column, edges: list[float]) -> Column:
    n = len(edges) - 1
    out = F.when(v.isNull() | F.isnan(v) | (v < edges[0]) | (v > edges[-1]), F.lit(None).cast("int"))
    for i in range(1, n):
        out = out.when(v < edges[i], i - 1)
    return out.otherwise(n - 1)


def _psi(bins: DataFrame, share) -> DataFrame:
    """Sum over bins of (c - r) ln(c / r); `share(count, total)` applies each variant's zero rule."""
    total = bins.groupBy("feature").agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"))
    j = bins.join(total, "feature")
    r, c = share(F.col("r"), F.col("rn")), share(F.col("c"), F.col("cn"))
    return j.groupBy("feature").agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))


def psi_quantile(ref: DataFrame, cur: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """Bins are quantiles of the reference with open ends, duplicates merged; 1e-6 is added to each share."""
    grid = exact_quantiles(ref, cols, [i / n for i in range(n + 1)])
    edges = {c: [float("-inf"), *sorted(set(q[1:-1])), float("inf")] for c, q in grid.items()}
    return _psi(bin_counts(ref, cur, edges), lambda k, t: k / t + 1e-6)


def psi_width(ref: DataFrame, cur: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """Equal-width bins over the joint range; shares are floored at 1e-4. Empty columns give no row."""
    ends = [F.min(F.col(c).cast("double")).alias(f"a_{c}") for c in cols] + [F.max(F.col(c).cast("double")).alias(f"b_{c}") for c in cols]
    x, y = ref.agg(*ends).first(), cur.agg(*ends).first()
    edges = {}
    for c in cols:
        if x[f"a_{c}"] is None or y[f"a_{c}"] is None:
            continue
        lo, hi = min(x[f"a_{c}"], y[f"a_{c}"]), max(x[f"b_{c}"], y[f"b_{c}"])
        edges[c] = [lo + (hi - lo) * i / n for i in range(n)] + [hi]
    return _psi(bin_counts(ref, cur, edges), lambda k, t: F.greatest(k / t, F.lit(1e-4)))


def psi_unit(prev: DataFrame, cur: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """Ten bins on [0, 1] for probabilities (clipped); shares below 1e-7 become 1e-7."""
    def clip(df: DataFrame) -> DataFrame:
        return df.select(*[F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0))).alias(c) for c in cols])

    edges = {c: [i / n for i in range(n + 1)] for c in cols}
    out = _psi(bin_counts(clip(prev), clip(cur), edges), lambda k, t: F.greatest(k / F.greatest(t, F.lit(1)), F.lit(1e-7)))
    return out.withColumn("psi", F.greatest("psi", F.lit(0.0)))


def drift_report(psi: DataFrame) -> DataFrame:
    """(feature, psi, severity): warning from 0.1, critical from 0.25."""
    sev = F.when(F.col("psi") >= CRITICAL_PSI, "critical").when(F.col("psi") >= WARN_PSI, "warning").otherwise("normal")
    return psi.withColumn("severity", sev)


def drift_summary(report: DataFrame) -> DataFrame:
    s = F.col("severity")
    return report.agg(
        F.count(F.lit(1)).alias("total_features"),
        F.sum((s == "warning").cast("long")).alias("warning_count"),
        F.sum((s == "critical").cast("long")).alias("critical_count"),
        F.max("psi").alias("max_psi"),
        F.avg("psi").alias("avg_psi"),
        F.max((s != "normal").cast("int")).alias("drift_detected"),
    )


def binary_jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of (p, 1-p) and (q, 1-q) in nats."""
    eps = 1e-10
    p, q = (F.greatest(F.least(x.cast("double"), F.lit(1 - eps)), F.lit(eps)) for x in (p, q))
    m = (p + q) / 2

    def kl(a: Column) -> Column:
        return a * F.ln(a / m) + (1 - a) * F.ln((1 - a) / (1 - m))

    return (kl(p) + kl(q)) / 2


def prediction_drift(prev: DataFrame, cur: DataFrame, key: str, score: str, label: str | None = None) -> DataFrame:
    """One row comparing two versions' scores by key: psi, jsd, mean shift, rank correlation, AUC shift, alerts."""
    cols = [key, score] + ([label] if label else [])
    j = prev.select(key, F.col(score).alias("_a")).join(cur.select(*cols).withColumnRenamed(score, "_b"), key)
    base = j.agg(F.avg(binary_jsd(F.col("_a"), F.col("_b"))).alias("jsd"), F.abs(F.avg("_b") - F.avg("_a")).alias("mean_shift"))
    psi = psi_unit(prev.select(F.col(score).alias("s")), cur.select(F.col(score).alias("s")), ["s"]).select("psi")
    rho = spearman(j, [], "_a", "_b", "rank_correlation")
    out = base.select("*", psi.scalar().alias("psi"), rho.scalar().alias("rank_correlation"))
    if label:
        ok = j.where(F.col(label).isin(0, 1))
        a, b = auc(ok, [], label, "_a").scalar(), auc(ok, [], label, "_b").scalar()
        out = out.withColumn("auc_shift", F.coalesce(F.abs(b - a), F.lit(0.0)))
    alerts = [
        F.when(F.col("psi") > MAX_PSI, "psi"),
        F.when(F.col("jsd") > MAX_JSD, "jsd"),
        F.when(F.col("mean_shift") > MAX_SHIFT, "mean_shift"),
        F.when(F.col("rank_correlation") < MIN_RHO, "rank_correlation"),
    ] + ([F.when(F.col("auc_shift") > MAX_AUC_SHIFT, "auc_shift")] if label else [])
    return out.withColumn("alerts", F.concat_ws(",", *alerts))
