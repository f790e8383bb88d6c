"""Reading, cleaning, registering and writing tables."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.profile import is_numeric


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, where: str | Column | None = None, limit: int | None = None) -> DataFrame:
    """Parquet file, folder or glob with pushed-down filter and pruned columns."""
    df = spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    return df if limit is None else df.limit(limit)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """CSV with the given schema; inference (an extra pass) only when none is given."""
    reader = spark.read.option("header", header)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


@dataclass(frozen=True)
class Cast:
    """How one raw text column becomes typed: kind is money, percent, date, flag, category or a Spark type."""

    kind: str
    format: str | None = None


def to_typed(df: DataFrame, casts: dict[str, Cast | str], drop: Sequence[str] = ()) -> DataFrame:
    """Clean raw text into typed columns; anything unreadable becomes NULL instead of failing."""
    out = []
    for name in df.columns:
        if name in drop:
            continue
        rule = casts.get(name)
        rule = Cast(rule) if isinstance(rule, str) else rule
        raw = F.trim(F.col(name).cast("string"))
        if rule is None:
            out.append(F.col(name).alias(name.strip()))
            continue
        if rule.kind == "money":
            val = F.regexp_replace(raw, "[$,]", "").try_cast("double")
        elif rule.kind == "percent":
            val = F.regexp_replace(raw, "%", "").try_cast("double") / 100
        elif rule.kind == "date":
            val = F.try_to_timestamp(raw, F.lit(rule.format)).cast("date") if rule.format else raw.try_cast("date")
        elif rule.kind == "flag":
            low = F.lower(raw)
            val = F.when(low.isin("yes", "y", "true", "1"), 1).when(low.isin("no", "n", "false", "0"), 0)
        elif rule.kind == "category":
            val = F.when(raw != "", raw)
        else:
            val = raw.try_cast(rule.kind)
        out.append(val.alias(name.strip()))
    return df.select(*out)


def null_sentinels(df: DataFrame, threshold: float = -99999, exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric values below the threshold become NULL."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        cols.append(F.when(c >= threshold, c).alias(f.name) if is_numeric(f.dataType) and f.name not in exclude else c)
    return df.select(*cols)


def register_views(spark: SparkSession, paths: dict[str, str]) -> None:
    """Name parquet paths as SQL views; missing paths are skipped so optional archives may be absent."""
    for name, path in paths.items():
        df = read_or_none(spark, path)
        if df is not None:
            df.createOrReplaceTempView(name)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", partition_by: Sequence[str] = (), mode: str = "overwrite", row_group_bytes: int | None = None) -> None:
    writer = df.write.mode(mode).option("compression", compression)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_partitioned(df: DataFrame, path: str, dt_col: str) -> None:
    """Append under `dt=` folders. Rows are rebalanced by day: small days share a task, heavy days are split by size."""
    day = df.withColumn("dt", F.date_format(dt_col, "yyyy-MM-dd"))
    day.hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The archive, or an empty table of the given schema when nothing was written yet."""
    df = read_or_none(spark, path)
    return df if df is not None else spark.createDataFrame([], schema)


def checkpoint(df: DataFrame, folder: str, stage: str, parameters: str = "") -> DataFrame:
    """Write a stage result once and continue from the file; a finished one of the same work is reused.

    The folder's name carries a fingerprint of the plan (inputs and expressions) and of `parameters`,
    for instance the version of the inputs, so a result of other work is never taken. A
    result counts as finished when Spark's end mark is there; a stage that broke off is written anew.
    """
    spark = df.sparkSession
    print_ = zlib.crc32(f"{df.semanticHash()}|{df.schema.simpleString()}|{parameters}".encode())
    path = f"{folder.rstrip('/')}/{stage}-{print_:08x}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach_embeddings(df: DataFrame, emb: DataFrame, key: str, dim: int, vector: str = "embedding") -> DataFrame:
    """Left join vectors by key; entities without one get the zero vector."""
    zero = F.array_repeat(F.lit(0.0), dim)
    e = emb.select(F.col(key), F.transform(vector, lambda x: x.cast("double")).alias(vector))
    return df.join(e, key, "left").withColumn(vector, F.coalesce(vector, zero))


@dataclass(frozen=True)
class SourceSpec:
    """What a source must look like and what to do with it on ingest."""

    name: str
    types: dict[str, str]
    required: Sequence[str] = ()
    nullable: Sequence[str] = ()
    casts: dict[str, Cast | str] = field(default_factory=dict)
    pii: dict[str, str] = field(default_factory=dict)
    drop: Sequence[str] = ()
    rows: tuple[int, int] | None = None
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    allowed: dict[str, Sequence[str]] = field(default_factory=dict)
    enabled: bool = True
