"""Session settings, folds and the query register of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a Python worker holds few long texts at once."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: fn(prepare(spark), sf)
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a NULL key counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns; an input column of the same name gives way to the new one."""
    names = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names], *[c.alias(n) for n, c in columns.items()])
