"""Propensity, uplift, student and cluster models on Spark ML, and canonical correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, cols: Sequence[str], out: str = "_x") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def propensity_fit(df: DataFrame, features: Sequence[str], treated: str, reg: float = 0.01):
    return LogisticRegression(featuresCol="_x", labelCol=treated, regParam=reg, maxIter=50).fit(assemble(df.withColumn(treated, F.col(treated).cast("double")), features))


def propensity_score(df: DataFrame, model, features: Sequence[str], clip: tuple[float, float] = (0.01, 0.99), name: str = "propensity") -> DataFrame:
    """P(treated) clipped away from 0 and 1."""
    keep = df.columns
    out = model.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_c").transform(assemble(df, features))
    p = F.get(vector_to_array("_p"), F.lit(1))
    return out.select(*keep, F.greatest(F.least(p, F.lit(clip[1])), F.lit(clip[0])).alias(name))


def _line(df: DataFrame, features: Sequence[str], y: str):
    return LinearRegression(featuresCol="_x", labelCol=y, regParam=0.01).fit(assemble(df, features))


def _apply(model, df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    keep = df.columns
    return model.setPredictionCol("_y").transform(assemble(df, features)).select(*keep, F.col("_y").alias(name))


def t_learner(df: DataFrame, features: Sequence[str], treated: str, outcome: str) -> DataFrame:
    """`uplift` = treated-arm prediction minus control-arm prediction."""
    m1 = _line(df.where(F.col(treated) == 1), features, outcome)
    m0 = _line(df.where(F.col(treated) == 0), features, outcome)
    out = _apply(m0, _apply(m1, df, features, "_mu1"), features, "_mu0")
    return out.withColumn("uplift", F.col("_mu1") - F.col("_mu0")).drop("_mu1", "_mu0")


def x_learner(df: DataFrame, features: Sequence[str], treated: str, outcome: str) -> DataFrame:
    """`uplift` = g tau0 + (1 - g) tau1 with effects imputed per arm and g the propensity."""
    m1 = _line(df.where(F.col(treated) == 1), features, outcome)
    m0 = _line(df.where(F.col(treated) == 0), features, outcome)
    both = _apply(m0, _apply(m1, df, features, "_mu1"), features, "_mu0")
    d1 = both.where(F.col(treated) == 1).withColumn("_d", F.col(outcome) - F.col("_mu0"))
    d0 = both.where(F.col(treated) == 0).withColumn("_d", F.col("_mu1") - F.col(outcome))
    t1, t0 = _line(d1, features, "_d"), _line(d0, features, "_d")
    g = propensity_score(df, propensity_fit(df, features, treated), features, name="_g")
    out = _apply(t0, _apply(t1, g, features, "_t1"), features, "_t0")
    return out.withColumn("uplift", F.col("_g") * F.col("_t0") + (1 - F.col("_g")) * F.col("_t1")).drop("_t1", "_t0", "_g")


def fit_student(df: DataFrame, features: Sequence[str], target: str, binary: bool, weight: str | None = None, trees: int = 20, depth: int = 4, seed: int = 42):
    """Boosted trees on the features; the binary learner takes the rounded target."""
    extra = {"weightCol": weight} if weight else {}
    data = assemble(df, features)
    if binary:
        data = data.withColumn("_t", (F.col(target) >= 0.5).cast("double"))
        return GBTClassifier(featuresCol="_x", labelCol="_t", maxIter=trees, maxDepth=depth, seed=seed, **extra).fit(data)
    return GBTRegressor(featuresCol="_x", labelCol=target, maxIter=trees, maxDepth=depth, seed=seed, **extra).fit(data)


def score_student(df: DataFrame, model, features: Sequence[str], name: str = "student") -> DataFrame:
    keep = df.columns
    data = assemble(df, features)
    if hasattr(model, "setProbabilityCol"):
        out = model.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_c").transform(data)
        return out.select(*keep, F.get(vector_to_array("_p"), F.lit(1)).alias(name))
    return model.setPredictionCol("_y").transform(data).select(*keep, F.col("_y").alias(name))


def platt_calibration(df: DataFrame, score: str, y: str, fit_on: Column) -> DataFrame:
    """Logistic curve on the score, fitted on the rows of `fit_on`."""
    data = df.withColumn("_yy", F.col(y).cast("double"))
    m = LogisticRegression(featuresCol="_x", labelCol="_yy", maxIter=100).fit(assemble(data.where(fit_on), [score]))
    a, b = float(m.coefficients[0]), float(m.intercept)
    return df.withColumn("calibrated", 1.0 / (1.0 + F.exp(-(F.col(score) * a + b))))


def gmm_fit(df: DataFrame, features: Sequence[str], k: int, min_rows: int = 100, seed: int = 42):
    """Scaler and mixture, or None when there are too few rows to fit."""
    data = assemble(df, features, "_raw")
    if data.count() < max(min_rows, k):
        return None
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(data)
    return scaler, GaussianMixture(featuresCol="_x", k=k, seed=seed, maxIter=50, probabilityCol="_p", predictionCol="_c").fit(scaler.transform(data))


def gmm_transform(df: DataFrame, features: Sequence[str], fit, k: int) -> DataFrame:
    """cluster id, probabilities and their entropy; uniform without a fitted model."""
    keep = df.columns
    if fit is None:
        probs = F.array(*[F.lit(1.0 / k)] * k)
        return df.select(*keep, F.lit(0).alias("cluster"), probs.alias("probs"), F.lit(float(np.log(k))).alias("entropy"))
    scaler, model = fit
    out = model.transform(scaler.transform(assemble(df, features, "_raw"))).withColumn("probs", vector_to_array("_p"))
    ent = -F.aggregate("probs", F.lit(0.0), lambda s, x: s + x * F.ln(F.greatest(x, F.lit(1e-12))))
    return out.select(*keep, F.col("_c").alias("cluster"), "probs", ent.alias("entropy"))


def _gram(df: DataFrame, vec: Column, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum and cross-product matrix of vectors. Tasks add up whole batches; Spark adds the cells."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros((dim + 1, dim + 1))
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), dtype="float64").reshape(-1, dim)
            x = np.hstack([np.ones((len(x), 1)), x])
            total += x.T @ x
            n += len(x)
        if n:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    cells = df.select(vec.alias("v")).mapInPandas(part, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    g = np.zeros((dim + 1, dim + 1))
    for r in cells.collect():  # (dim + 1)^2 sums, independent of the number of rows
        g[r["i"], r["j"]] = r["v"]
    return g[0, 1:], g[1:, 1:], int(round(g[0, 0]))


def cca(df: DataFrame, a: str, b: str, dim_a: int, dim_b: int, n: int = 5, reg: float = 1e-4) -> list[float]:
    """The n largest canonical correlations of two vector columns."""
    s, g, rows = _gram(df, F.concat(F.col(a).cast("array<double>"), F.col(b).cast("array<double>")), dim_a + dim_b)
    c = (g - np.outer(s, s) / rows) / max(rows - 1, 1)
    caa, cbb, cab = c[:dim_a, :dim_a] + reg * np.eye(dim_a), c[dim_a:, dim_a:] + reg * np.eye(dim_b), c[:dim_a, dim_a:]

    def inv_sqrt(m: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(m)
        return v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-12))) @ v.T

    sv = np.linalg.svd(inv_sqrt(caa) @ cab @ inv_sqrt(cbb), compute_uv=False)
    return [float(min(max(x, 0.0), 1.0)) for x in sv[:n]]
