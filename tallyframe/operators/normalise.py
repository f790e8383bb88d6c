"""Fitted scalers and encoders: `fit_*` returns a small dict or lookup table, `apply` is a projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.profile import BATCH, is_numeric, per_column
from tallyframe.functions.stats import norm_ppf
from tallyframe.plans.quantiles import exact_quantiles
from tallyframe.plans.skew import position

# Thresholds of the power-law test and the scale floor.
SKEW_MIN, KURT_MIN, R2_MIN, STD_FLOOR = 2.0, 6.0, 0.9, 1e-10


@dataclass(frozen=True)
class NormaliserConfig:
    id_suffixes: Sequence[str] = ("_id", "_key", "key")
    id_prefixes: Sequence[str] = ()
    prob_prefixes: Sequence[str] = ("prob_",)
    min_nunique: int = 20
    min_samples: int = 50
    log_copies: bool = True


@dataclass(frozen=True)
class Normaliser:
    order: list[str]
    classes: dict[str, str]
    mean: dict[str, float]
    std: dict[str, float]
    logs: list[str] = field(default_factory=list)


def _class_of(c: str, numeric: bool, binary: bool, cfg: NormaliserConfig) -> str:
    if binary:
        return "binary"
    if c.endswith(tuple(cfg.id_suffixes)) or (cfg.id_prefixes and c.startswith(tuple(cfg.id_prefixes))):
        return "categorical"
    if c.startswith(tuple(cfg.prob_prefixes)) or "_prob_" in c:
        return "probability"
    return "continuous" if numeric else "other"


def _is_binary(c: str) -> Column:
    return F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True))


def classify_columns(df: DataFrame, cols: Sequence[str], cfg: NormaliserConfig = NormaliserConfig()) -> dict[str, str]:
    """binary / categorical / probability / continuous / other per column, from one aggregate."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in cols if is_numeric(types[c])]
    flags: dict[str, bool] = {}
    for at in range(0, len(numeric), BATCH):
        flags.update(df.agg(*[_is_binary(c).alias(c) for c in numeric[at : at + BATCH]]).first().asDict())
    return {c: _class_of(c, c in numeric, flags.get(c, False), cfg) for c in cols}


def _shape(c: str) -> dict[str, Column]:
    return {"n": F.count(c).cast("double"), "g1": F.skewness(c), "g2": F.kurtosis(c), "min": F.min(F.col(c).cast("double"))}


def _corrected(df: DataFrame) -> dict[str, Column]:
    """Bias-corrected skewness and excess kurtosis from the population forms."""
    n = F.col("n")
    return {
        "skew": F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1")),
        "kurt": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)),
    }


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n, skew, kurt, min): bias-corrected skewness and excess kurtosis."""
    raw = per_column(df, list(cols), _shape)
    return raw.withColumns(_corrected(raw)).select("column", "n", "skew", "kurt", "min")


def loglog_r2(df: DataFrame, col: str, min_samples: int = 50) -> float:
    """Squared correlation of ln(value) and ln(rank) over the larger half of the positive values."""
    pos = df.where(F.col(col) > 0).select(F.col(col).cast("double").alias("v"))
    n = pos.count()
    if n < min_samples:
        return 0.0
    keep = max(min_samples, n // 2)
    ranked = position(pos.withColumn("neg", -F.col("v")), [], ["neg"], "rank").where(F.col("rank") <= keep)
    lv, lr = F.ln("v"), F.ln(F.col("rank").cast("double"))
    row = ranked.agg(F.stddev_pop(lv).alias("s"), F.corr(lv, lr).alias("r")).first()
    return 0.0 if not row["s"] or row["s"] < 1e-10 else row["r"] ** 2


def _heavy(shape: DataFrame) -> list[str]:
    return [r["column"] for r in shape.where(f"abs(skew) > {SKEW_MIN} AND kurt > {KURT_MIN} AND min >= 0").collect()]


def _confirmed(df: DataFrame, candidates: Sequence[str], cfg: NormaliserConfig) -> list[str]:
    """Candidates with enough distinct values whose rank plot is close to a line."""
    out = []
    for c in candidates:
        if df.select(c).where(F.col(c).isNotNull()).distinct().count() > cfg.min_nunique and loglog_r2(df, c, cfg.min_samples) >= R2_MIN:
            out.append(c)
    return out


def detect_power_law(df: DataFrame, cols: Sequence[str], cfg: NormaliserConfig = NormaliserConfig()) -> list[str]:
    """Columns with a heavy right tail. Cheap moment tests first; only survivors are ranked."""
    found = _confirmed(df, _heavy(moments(df, cols)), cfg)
    return [c for c in cols if c in found]


def normalize_fit(df: DataFrame, cols: Sequence[str], train: str | Column | None = None, cfg: NormaliserConfig = NormaliserConfig()) -> Normaliser:
    """Learn from training rows only. NULL counts as 0 in the mean and the deviation.

    Column class, mean, deviation and the moments of the tail test come from the same scan; only
    columns with a heavy tail are looked at again.
    """
    rows = df.where(train) if train is not None else df
    types = {f.name: f.dataType for f in rows.schema.fields}
    numeric = [c for c in cols if is_numeric(types[c])]

    def stats(c: str) -> dict[str, Column]:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return {"binary": _is_binary(c), "mean": F.avg(x), "std": F.stddev_samp(x), **_shape(c)}

    mean: dict[str, float] = {}
    std: dict[str, float] = {}
    binary: dict[str, bool] = {}
    heavy: list[str] = []
    if numeric:
        raw = per_column(rows, numeric, stats)
        for r in raw.withColumns(_corrected(raw)).collect():  # one row per column
            c = r["column"]
            binary[c] = r["binary"]
            mean[c] = r["mean"] or 0.0
            std[c] = r["std"] if r["std"] is not None and r["std"] > STD_FLOOR else 1.0
            if r["skew"] is not None and r["kurt"] is not None and abs(r["skew"]) > SKEW_MIN and r["kurt"] > KURT_MIN and r["min"] >= 0:
                heavy.append(c)
    classes = {c: _class_of(c, c in numeric, binary.get(c, False), cfg) for c in cols}
    cont = [c for c in cols if classes[c] == "continuous"]
    logs = _confirmed(rows, [c for c in cont if c in heavy], cfg) if cfg.log_copies else []
    return Normaliser(list(cols), classes, {c: mean[c] for c in cont}, {c: std[c] for c in cont}, logs)


def normalize_transform(df: DataFrame, fit: Normaliser, keep: Sequence[str] = ()) -> DataFrame:
    """Scaled continuous columns and untouched others in input order, `_log` copies last."""
    out = [F.col(k) for k in keep]
    for c in fit.order:
        x = F.col(c).cast("double")
        if c in fit.mean:
            x = (F.coalesce(x, F.lit(0.0)) - fit.mean[c]) / fit.std[c]
        out.append(x.alias(c))
    out += [F.ln(F.greatest(F.col(c).cast("double"), F.lit(0.0)) + 1).alias(f"{c}_log") for c in fit.logs]
    return df.select(*out)


def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] if (row[f"s_{c}"] or 0) > STD_FLOOR else 1.0) for c in cols}


def standard_scale(df: DataFrame, fit: dict[str, tuple[float, float]], clip: float | None = None) -> DataFrame:
    """z-scores (population deviation), optionally clipped to +-clip."""
    def z(c: str, m: float, s: float) -> Column:
        x = (F.col(c) - m) / s
        return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))) if clip else x

    return df.withColumns({c: z(c, *ms) for c, ms in fit.items()})


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.min(c).alias(f"a_{c}") for c in cols], *[F.max(c).alias(f"b_{c}") for c in cols]).first()
    return {c: (row[f"a_{c}"], row[f"b_{c}"]) for c in cols}


def minmax_scale(df: DataFrame, fit: dict[str, tuple[float, float]], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    return df.withColumns({c: (F.col(c) - a) / ((b - a) or 1.0) * (hi - lo) + lo for c, (a, b) in fit.items()})


def log_transform(df: DataFrame, cols: Sequence[str], keep_raw: bool = False) -> DataFrame:
    return df.withColumns({f"{c}_log" if keep_raw else c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in cols})


def fit_quantiles(df: DataFrame, cols: Sequence[str], n: int = 100) -> dict[str, list[float]]:
    return exact_quantiles(df, cols, [i / (n - 1) for i in range(n)])


def quantile_transform(df: DataFrame, grids: dict[str, list[float]], normal: bool = False) -> DataFrame:
    """Map values to their place on the fitted quantile grid, then optionally through the normal quantile.

    The interpolation is a vectorised binary search over the (short) grid, one Arrow batch at a time.
    """
    def place(c: str, grid: list[float]) -> Column:
        marks = [i / (len(grid) - 1) for i in range(len(grid))]

        @F.pandas_udf("double")
        def interpolate(x: pd.Series) -> pd.Series:
            v, q, r = x.to_numpy("float64"), np.asarray(grid), np.asarray(marks)
            # the mean of both directions puts a plateau of equal grid points at its middle
            return pd.Series((np.interp(v, q, r) - np.interp(-v, -q[::-1], -r[::-1])) / 2)

        return interpolate(F.col(c).cast("double"))

    out = df.withColumns({c: place(c, g) for c, g in grids.items()})
    if not normal:
        return out
    eps = 1e-7
    return out.withColumns({c: F.when(F.col(c).isNotNull(), norm_ppf(F.greatest(F.least(F.col(c), F.lit(1 - eps)), F.lit(eps)))) for c in grids})


def fit_null_fill(df: DataFrame, how: dict[str, str | float]) -> dict[str, float]:
    """mean / median / mode / a constant per column, learned on the given rows."""
    out: dict[str, float] = {}
    medians = [c for c, h in how.items() if h == "median"]
    out.update({c: q[0] for c, q in exact_quantiles(df, medians, [0.5]).items()})
    for c, h in how.items():
        if h == "mean":
            out[c] = df.agg(F.avg(c)).first()[0]
        elif h == "mode":
            out[c] = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), F.asc(c)).first()[0]
        elif h != "median":
            out[c] = h
    return out


def null_fill(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def _as_key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def code_maps(df: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """Per column a table (val, code): 0-based position in sorted distinct values, NULL as 'nan'."""
    out = {}
    for c in cols:
        vals = df.select(_as_key(c).alias("val")).groupBy("val").agg(F.count(F.lit(1)).alias("n"))
        out[c] = position(vals.select("val"), [], ["val"], "code").select("val", (F.col("code") - 1).cast("int").alias("code"))
    return out


def encode_with(df: DataFrame, maps: dict[str, DataFrame], unseen: int = -1) -> DataFrame:
    """Replace values by codes. Adaptive execution broadcasts a map when it is small enough."""
    out = df
    for c, m in maps.items():
        m = m.select(F.col("val").alias("_val"), F.col("code").alias("_code"))
        out = out.join(m, _as_key(c) == F.col("_val"), "left")
        out = out.withColumn(c, F.coalesce(F.col("_code"), F.lit(unseen))).drop("_val", "_code")
    return out


def label_encode(df: DataFrame, cols: Sequence[str], train: str | Column | None = None) -> DataFrame:
    return encode_with(df, code_maps(df.where(train) if train is not None else df, cols))


def hash_code(c: Column, n: int) -> Column:
    """MD5 as a 128-bit integer modulo n, NULL as 0; folded in four 32-bit steps."""
    hex_ = F.md5(c.cast("string").cast("binary"))
    h = F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(hex_, 1 + 8 * i, 8), 16, 10).cast("long")
        h = (h * (4294967296 % n) + part) % n
    return F.coalesce(h, F.lit(0).cast("long"))


def hash_encode(df: DataFrame, cols: Sequence[str], n: int = 1024) -> DataFrame:
    return df.withColumns({c: hash_code(F.col(c), n) for c in cols})


def code_level(col: str, codes: dict[int, Sequence[int]], ranges: Sequence[tuple[int, int, int]] = (), default: int = 0) -> Column:
    """Index of a code: explicit lists first, then closed ranges, then the default."""
    c = F.col(col)
    out = None
    for idx, members in codes.items():
        cond = c.isin(*members)
        out = F.when(cond, idx) if out is None else out.when(cond, idx)
    for lo, hi, idx in ranges:
        cond = c.between(lo, hi)
        out = F.when(cond, idx) if out is None else out.when(cond, idx)
    return F.lit(default) if out is None else out.otherwise(default)


def quartile_segment(col: str, cuts: Sequence[float], low_when: Column | None = None) -> Column:
    """1..4 by three cut points; `low_when` forces class 1."""
    c = F.col(col)
    out = F.when(low_when, 1) if low_when is not None else None
    for i, q in enumerate(cuts):
        out = F.when(c < q, i + 1) if out is None else out.when(c < q, i + 1)
    return out.otherwise(len(cuts) + 1)


# Age class upper bounds.
AGE_CUTS = (25, 35, 45, 55, 65)


def segment(df: DataFrame, age: str, income: str, activity: str) -> DataFrame:
    """Age class by fixed cuts; income and activity class by quartiles (income of positive values only)."""
    inc = exact_quantiles(df.where(F.col(income) > 0), [income], [0.25, 0.5, 0.75])[income]
    act = exact_quantiles(df, [activity], [0.25, 0.5, 0.75])[activity]
    return df.withColumns(
        {
            "seg_age": quartile_segment(age, AGE_CUTS),
            "seg_income": quartile_segment(income, inc, F.col(income).isNull() | (F.col(income) <= 0)),
            "seg_activity": quartile_segment(activity, act),
        }
    )
