"""Dataset version profiles and their differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.profile import column_stats, is_numeric


def schema_hash(df: DataFrame) -> str:
    """SHA-256 of the sorted (name, type) pairs: column order does not matter, renames and retypes do."""
    import hashlib

    items = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return hashlib.sha256(repr(items).encode()).hexdigest()


def profile_version(df: DataFrame, version: str) -> DataFrame:
    """Manifest rows: version, row and column count, schema hash, then mean/std/null_pct per column."""
    return _manifest(column_stats(df), df, version)


def _manifest(s: DataFrame, df: DataFrame, version: str) -> DataFrame:
    return s.select(
        F.lit(version).alias("version"),
        F.col("rows").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(schema_hash(df)).alias("schema_hash"),
        "column",
        F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"),
        F.round(F.coalesce("std", F.lit(0.0)), 6).alias("std"),
        F.round("null_pct", 4).alias("null_pct"),
    )


#: A partition's state: rows and NULLs, then count, mean, squared deviations and bounds of the numbers.
STATE = ("rows", "nulls", "n", "mean", "m2", "min", "max")


def partition_files(df: DataFrame, part: str) -> DataFrame:
    """(part, files): a fingerprint of the files that each partition of a stored dataset consists of.

    Reads file listings and footers, no column.
    """
    f = df.select(F.col(part).cast("string").alias(part), "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    one = F.concat_ws("|", "file_path", "file_size", F.unix_micros("file_modification_time"))
    return f.groupBy(part).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(one)), "\n"), 256).alias("files"))


def partition_states(df: DataFrame, part: str, cols: Sequence[str]) -> DataFrame:
    """(part, column, *STATE): states of each partition that `merge_states` joins to those of any union of partitions."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def state(c: str):
        v = F.col(c).cast("double") if is_numeric(types[c]) else F.lit(None).cast("double")
        n = F.count(v)
        fields = {"rows": F.count(F.lit(1)), "nulls": F.sum(F.col(c).isNull().cast("long")), "n": n, "mean": F.avg(v), "m2": F.var_pop(v) * n, "min": F.min(v), "max": F.max(v)}
        return F.struct(F.lit(c).alias("column"), *[e.alias(k) for k, e in fields.items()])

    wide = df.groupBy(F.col(part).cast("string").alias(part)).agg(*[state(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    return wide.select(part, F.explode(F.array(*[f"_s{i}" for i in range(len(cols))])).alias("_s")).select(part, "_s.*")


def refresh_states(df: DataFrame, part: str, cols: Sequence[str], stored: DataFrame | None = None) -> DataFrame:
    """(part, files, column, *STATE) of a partitioned dataset as it is now, from the stored states and the data that is new.

    Partitions whose files are those of the stored states are not read again; new and rewritten ones are, dropped ones go.
    The partition values to read come to the driver, which lists the dataset's folders anyway, and prune the scan. The
    caller writes the result for the next version (a cached one would be computed anew when the data's path is written). The NULL partition counts as one.
    """
    now = partition_files(df, part)
    if stored is None:
        old, fresh = None, now
    else:
        same = F.col("a.files").eqNullSafe(F.col("b.files")) & F.col(f"a.{part}").eqNullSafe(F.col(f"b.{part}"))
        old = stored.alias("a").join(now.alias("b"), same, "left_semi")
        fresh = now.alias("a").join(stored.select(part, "files").distinct().alias("b"), same, "left_anti")
    names = [r[0] for r in fresh.select(part).collect()]
    p = F.col(part)
    values = [F.lit(x).cast(df.schema[part].dataType) for x in names if x is not None]
    ask = (p.isin(*values) if values else F.lit(False)) | (p.isNull() if None in names else F.lit(False))
    new = partition_states(df.where(ask), part, cols).alias("a").join(now.alias("b"), F.col(f"a.{part}").eqNullSafe(F.col(f"b.{part}")))
    new = new.select(F.col(f"a.{part}").alias(part), "b.files", "a.column", *[f"a.{c}" for c in STATE])
    return new if old is None else old.select(part, "files", "column", *STATE).unionByName(new)


def merge_states(states: DataFrame) -> DataFrame:
    """(column, rows, nulls, n, mean, std, min, max) of all partitions together; std is the sample deviation.

    Squared deviations are moved to the common mean before they are added, so no digits cancel.
    """
    means = states.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("_mean"))
    off = F.col("mean") - F.col("_mean")
    out = states.join(means, "column").groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("n").alias("n"), F.first("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * off * off).alias("_m2"), F.min("min").alias("min"), F.max("max").alias("max"),
    )
    return out.withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("_m2") / (F.col("n") - 1)))).drop("_m2")


def profile_states(states: DataFrame, df: DataFrame, version: str) -> DataFrame:
    """The manifest rows of `profile_version` for the columns that have states, without reading the data."""
    return _manifest(merge_states(states).withColumn("null_pct", F.col("nulls") / F.col("rows") * 100), df, version)


def latest_version(manifests: DataFrame) -> DataFrame:
    """Rows of the newest version string of a manifest archive."""
    top = manifests.agg(F.max("version").alias("v"))
    return manifests.where(F.col("version") == top.scalar())


def diff_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per column: added / removed / shared, deltas (b - a) of the statistics, table-level deltas."""
    x, y = a.alias("x"), b.alias("y")
    j = x.join(y, F.col("x.column") == F.col("y.column"), "full_outer")
    shared = F.col("x.column").isNotNull() & F.col("y.column").isNotNull()

    def delta(c: str):
        return F.when(shared, F.round(F.col(f"y.{c}") - F.col(f"x.{c}"), 6)).alias(f"{c}_delta")

    def one(d: DataFrame, c: str):
        return d.agg(F.max(c)).scalar()

    return j.select(
        F.coalesce("x.column", "y.column").alias("column"),
        F.when(shared, "shared").when(F.col("x.column").isNull(), "added").otherwise("removed").alias("status"),
        delta("mean"),
        delta("std"),
        delta("null_pct"),
        (one(b, "row_count") - one(a, "row_count")).alias("row_count_delta"),
        (one(b, "column_count") - one(a, "column_count")).alias("column_count_delta"),
        (one(b, "schema_hash") != one(a, "schema_hash")).cast("int").alias("schema_changed"),
    )
