"""One-pass column statistics as a long table: one row per column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Aggregate expressions per job; larger sets are split so that generated code stays compiled.
BATCH = 150


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def per_column(df: DataFrame, cols: Sequence[str], stats: Callable[[str], dict[str, Column]]) -> DataFrame:
    """Aggregate `stats(column)` for every column in one scan, then unfold to (column, *stats).

    Columns are handled in batches; each batch is one scan that reads only its own columns.
    """
    names = list(stats(cols[0]))
    size = max(1, BATCH // len(names))
    out = None
    for at in range(0, len(cols), size):
        part = cols[at : at + size]
        wide = df.agg(*[F.struct(*[e.alias(n) for n, e in stats(c).items()]).alias(f"s{i}") for i, c in enumerate(part)])
        rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"s{i}.{n}").alias(n) for n in names]) for i, c in enumerate(part)])
        long = wide.select(F.explode(rows).alias("r")).select("r.*")
        out = long if out is None else out.unionByName(long)
    return out


def column_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, nulls, null_pct, mean, sample std, min, max per column; text columns get 0 mean/std."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}

    def stats(c: str) -> dict[str, Column]:
        num = F.col(c).cast("double") if is_numeric(types[c]) else F.lit(None).cast("double")
        return {
            "rows": F.count(F.lit(1)),
            "nulls": F.sum(F.col(c).isNull().cast("long")),
            "mean": F.avg(num),
            "std": F.stddev_samp(num),
            "min": F.min(num),
            "max": F.max(num),
        }

    return per_column(df, cols, stats).withColumn(
        "null_pct", F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows") * 100).otherwise(0.0)
    )


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, distinct) with NULL not counted; pre-aggregated per (column, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
    return (
        df.select(F.explode(pairs).alias("p"))
        .groupBy("p.column", "p.v")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(F.count("v").alias("distinct"))
    )
