"""Column selection, cleaning and row filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.profile import distinct_counts, is_numeric, numeric_columns, per_column
from tallyframe.operators.normalise import code_maps, encode_with
from tallyframe.plans.quantiles import exact_quantiles


@dataclass(frozen=True)
class ColumnFilter:
    exclude_binary: bool = False
    min_nunique: int = 0
    include_prefix: Sequence[str] = ()
    exclude_prefix: Sequence[str] = ()
    exclude: Sequence[str] = ()


def binary_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, is_binary): all non-null values are 0 or 1. One scan."""
    return per_column(df, list(cols), lambda c: {"is_binary": F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True))})


def resolve_columns(df: DataFrame, rule: ColumnFilter) -> list[str]:
    """Numeric columns that pass the filter, in table order. Names are checked before any scan."""
    cols = [
        c
        for c in numeric_columns(df, rule.exclude)
        if (not rule.include_prefix or c.startswith(tuple(rule.include_prefix))) and not (rule.exclude_prefix and c.startswith(tuple(rule.exclude_prefix)))
    ]
    if cols and rule.exclude_binary:
        binary = {r["column"] for r in binary_flags(df, cols).where("is_binary").collect()}
        cols = [c for c in cols if c not in binary]
    if cols and rule.min_nunique > 0:
        few = {r["column"] for r in distinct_counts(df, cols).where(F.col("distinct") < rule.min_nunique).collect()}
        cols = [c for c in cols if c not in few]
    return cols


def classify_axes(df: DataFrame, axes: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(column, axis): configured axes first, then list columns are snapshots, 0/1 columns items, the rest state."""
    fixed = {c: a for a, cs in (axes or {}).items() for c in cs}
    spark = df.sparkSession
    known = [(c, a) for c, a in fixed.items()]
    numeric = []
    for f in df.schema.fields:
        if f.name in fixed:
            continue
        if isinstance(f.dataType, T.ArrayType):
            known.append((f.name, "snapshot"))
        elif is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType):
            numeric.append(f.name)
        else:
            known.append((f.name, "state"))
    out = spark.createDataFrame(known, "column string, axis string") if known else None
    if numeric:
        flags = binary_flags(df.select(*[F.col(c).cast("double").alias(c) for c in numeric]), numeric)
        flags = flags.select("column", F.when(F.col("is_binary"), "item").otherwise("state").alias("axis"))
        out = flags if out is None else out.unionByName(flags)
    return out


def preprocess(
    df: DataFrame,
    sentinels: dict[str, float] | None = None,
    impute: dict[str, str] | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Strings to sorted codes, sentinel to NULL, numeric NULL to mean / median / mode / zero.

    The fill statistics are those of the column as read. Lists, dates and `exclude` pass through.
    """
    sentinels, impute = sentinels or {}, impute or {}
    medians = [c for c, how in impute.items() if how == "median"]
    fills: dict[str, float] = {c: q[0] for c, q in exact_quantiles(df, medians, [0.5]).items()}
    means = [c for c, how in impute.items() if how == "mean"]
    if means:
        fills.update(df.agg(*[F.avg(c).alias(c) for c in means]).first().asDict())
    for c in (c for c, how in impute.items() if how == "mode"):
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), F.asc(c)).first()
        fills[c] = top[0] if top else None
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if is_numeric(f.dataType) and f.name not in exclude:
            c = F.when(c != sentinels[f.name], c) if f.name in sentinels else c
            how = impute.get(f.name, "zero")
            fill = fills.get(f.name) if how in ("mean", "median", "mode") else (0 if how == "zero" else None)
            c = F.coalesce(c, F.lit(fill)) if fill is not None else c
        cols.append(c.alias(f.name))
    return encode_with(df.select(*cols), code_maps(df, text))


def clip_and_flag(df: DataFrame, col: str, sentinel: float, lo: float, hi: float, flag: str) -> DataFrame:
    """Sentinel or NULL becomes `lo` with flag 1; everything else is clipped to [lo, hi] with flag 0."""
    c = F.col(col)
    unknown = c.isNull() | (c == sentinel)
    return df.withColumn(flag, unknown.cast("int")).withColumn(
        col, F.when(unknown, F.lit(lo)).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))
    )


def truncate_and_recompute(df: DataFrame, seq_cols: Sequence[str], n: int = 1, pairs: dict[str, str] | None = None) -> DataFrame:
    """Drop the last n list elements (lists of length <= n stay) and set each paired snapshot to the new last one."""
    cut = {s: F.when(F.size(s) > n, F.slice(s, 1, F.greatest(F.size(s) - n, F.lit(0)))).otherwise(F.col(s)) for s in seq_cols}
    out = df.withColumns(cut)
    last = {p: F.when(F.size(s) > 0, F.get(s, F.size(s) - 1)).otherwise(F.col(p)) for p, s in (pairs or {}).items()}
    return out.withColumns(last) if last else out


def item_universe(campaigns: DataFrame, products: DataFrame, as_of: str | Column, active: Sequence[str] = ("active",)) -> DataFrame:
    """Running campaigns at `as_of` and active products, in one shape."""
    t = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    c = campaigns.where(
        F.col("status").isin(*active)
        & (F.col("start_date").isNull() | (F.col("start_date") <= t))
        & (F.col("end_date").isNull() | (F.col("end_date") >= t))
    )
    left = c.select(F.lit("campaign").alias("kind"), F.col("campaign_id").alias("item_id"), "name", F.col("target_segments").alias("detail"))
    right = products.where("active").select(F.lit("product").alias("kind"), F.col("product_id").alias("item_id"), "name", F.col("category").alias("detail"))
    return left.unionByName(right)


def recent_events(df: DataFrame, since: str, ts: str = "timestamp", types: Sequence[str] = (), user: tuple[str, object] | None = None, type_col: str = "event_type") -> DataFrame:
    """Events at or after `since`, optionally of some types or one user, newest first."""
    out = df.where(F.col(ts).cast("timestamp") >= F.lit(since).cast("timestamp"))
    if types:
        out = out.where(F.col(type_col).isin(*types))
    if user:
        out = out.where(F.col(user[0]) == user[1])
    return out.orderBy(F.col(ts).desc())


def customer_audit(df: DataFrame, customer: object, d0: str, d1: str, key: str = "customer_id") -> DataFrame:
    """One customer's audit rows in a date range; `dt` prunes partitions."""
    return df.where(F.col("dt").between(d0, d1) & (F.col(key) == customer))
