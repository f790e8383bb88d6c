"""Contracts, value checks and the quality verdict. Every check is a report table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.profile import is_numeric, per_column
from tallyframe.sources.tables import SourceSpec

REPORT = "check string, column string, status string, value double, threshold double"
_FAMILY = {"tinyint": "number", "smallint": "number", "int": "number", "bigint": "number", "float": "number", "double": "number"}


def _family(t: str) -> str:
    return "number" if t.startswith("decimal") else _FAMILY.get(t, t)


def _rows(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rows), REPORT)


def check_contract(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Missing, new and retyped columns and the row count; numeric types are interchangeable."""
    have = dict(df.dtypes)
    out = [("contract_missing", c, "FAIL", None, None) for c in spec.types if c not in have]
    out += [("contract_new", c, "WARN", None, None) for c in have if c not in spec.types]
    out += [("contract_type", c, "FAIL", None, None) for c, t in spec.types.items() if c in have and _family(have[c]) != _family(t)]
    report = _rows(df, out)
    if spec.rows:
        lo, hi = spec.rows
        n = df.agg(F.count(F.lit(1)).cast("double").alias("n"))
        bad = (F.col("n") < lo) | (F.col("n") > hi)
        report = report.unionByName(
            n.where(bad).select(F.lit("contract_rows").alias("check"), F.lit(None).cast("string").alias("column"), F.lit("WARN").alias("status"), F.col("n").alias("value"), F.lit(float(hi)).alias("threshold"))
        )
    return report


def check_schema(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Presence of required columns, extra columns, and numeric columns that are not numeric."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = [("schema_columns", c, "FAIL", None, None) for c in spec.types if c not in have and c not in spec.nullable]
    out += [("schema_extra_columns", c, "WARN", None, None) for c in have if c not in spec.types]
    out += [("schema_type", c, "WARN", None, None) for c, t in spec.types.items() if c in have and _family(t) == "number" and not is_numeric(have[c])]
    return _rows(df, out)


def check_nulls(df: DataFrame, non_nullable: Sequence[str] = (), default: float = 0.5) -> DataFrame:
    """Null share per column against its threshold: above 0 fails for non-nullable, above `default` warns."""
    stats = per_column(df, df.columns, lambda c: {"value": F.avg(F.col(c).isNull().cast("double"))})
    strict = F.col("column").isin(*non_nullable) if non_nullable else F.lit(False)
    limit = F.when(strict, 0.0).otherwise(default)
    status = F.when(F.col("value") <= limit, "PASS").when(strict, "FAIL").otherwise("WARN")
    return stats.select(F.lit("null_ratio").alias("check"), "column", status.alias("status"), "value", limit.alias("threshold"))


def check_ranges(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]], allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Observed minima, maxima and the number of values outside the allowed set, in one scan."""
    items: list[tuple[str, str, Column, Column, Column]] = []
    for c, (lo, hi) in ranges.items():
        if lo is not None:
            m = F.min(F.col(c).cast("double"))
            items.append(("value_range_min", c, m, F.lit(float(lo)), m < lo))
        if hi is not None:
            m = F.max(F.col(c).cast("double"))
            items.append(("value_range_max", c, m, F.lit(float(hi)), m > hi))
    for c, vals in allowed.items():
        n = F.sum(F.when(F.col(c).isNotNull() & ~F.col(c).isin(*vals), 1.0).otherwise(0.0))
        items.append(("value_range_allowed", c, n, F.lit(0.0), n > 0))
    wide = df.agg(*[
        F.struct(F.lit(k).alias("check"), F.lit(c).alias("column"), F.when(bad, "FAIL").otherwise("PASS").alias("status"), v.alias("value"), t.alias("threshold")).alias(f"r{i}")
        for i, (k, c, v, t, bad) in enumerate(items)
    ])
    return wide.select(F.explode(F.array(*[f"r{i}" for i in range(len(items))])).alias("r")).select("r.*")


# Content patterns with the share of values that must match, and the name pattern.
PII_PATTERNS = {
    "email": (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", 0.3),
    "phone_kr": (r"01[016789]-?\d{3,4}-?\d{4}", 0.3),
    "phone_intl": (r"\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{4}", 0.2),
    "ssn_kr": (r"\d{6}-?[1-4]\d{6}", 0.1),
    "credit_card": (r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}", 0.1),
    "ipv4": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.3),
}
PII_NAMES = (
    r"(?i)(email|phone|ssn|social_security|passport|driver_license|credit_card|card_no|card_number|account_no|account_number|"
    r"resident_number|birth_date|dob|address|zip_code|postal|ip_addr|name|first_name|last_name|full_name|customer_name)"
)


def scan_pii(df: DataFrame, patterns: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """(column, pattern, match_ratio, detected) over all values of text columns; one scan for all pairs."""
    patterns = patterns or PII_PATTERNS
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    hits = per_column(df, text, lambda c: {p: F.avg(F.col(c).rlike(rx).cast("double")) for p, (rx, _) in patterns.items()})
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.coalesce(F.col(p), F.lit(0.0)).alias("match_ratio"), F.lit(m).alias("m")) for p, (_, m) in patterns.items()])
    out = hits.select("column", F.explode(rows).alias("r")).select("column", "r.pattern", "r.match_ratio", (F.col("r.match_ratio") >= F.col("r.m")).cast("int").alias("detected"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string").where(F.col("column").rlike(PII_NAMES))
    return out.unionByName(names.select("column", F.lit("column_name").alias("pattern"), F.lit(1.0).alias("match_ratio"), F.lit(1).alias("detected")))


def degenerate_columns(df: DataFrame) -> DataFrame:
    """(column, kind) of columns with at most one distinct value (NULL counts as a value)."""
    def stats(c: str) -> dict[str, Column]:
        v = F.col(c)
        zero = v.cast("double") == 0 if is_numeric(df.schema[c].dataType) else F.lit(False)
        return {"same": F.min(v).eqNullSafe(F.max(v)), "nulls": F.sum(v.isNull().cast("long")), "rows": F.count(F.lit(1)), "zero": F.bool_and(F.coalesce(zero, F.lit(False)))}

    out = per_column(df, df.columns, stats)
    one_value = F.col("same") & ((F.col("nulls") == 0) | (F.col("nulls") == F.col("rows")))
    return out.where((F.col("rows") > 0) & one_value).select("column", F.when(F.col("zero"), "all_zero").otherwise("constant").alias("kind"))


# Checks whose failure stops the load, and the drift limits of the gate.
CRITICAL_CHECKS = ("schema_columns", "null_ratio", "value_range")
GATE_PSI_WARN, GATE_PSI_FAIL = 0.1, 0.2


def gate(checks: DataFrame, psi: DataFrame | None = None, critical: Sequence[str] = CRITICAL_CHECKS, psi_col: str = "psi") -> DataFrame:
    """One row: PASS / WARN / FAIL and the counts behind it."""
    crit = reduce(lambda a, b: a | b, [(F.col("check") == c) | F.col("check").startswith(f"{c}_") for c in critical])
    fail, warn = F.col("status") == "FAIL", F.col("status") == "WARN"
    out = checks.agg(
        F.sum((fail & crit).cast("long")).alias("critical_fails"),
        F.sum((fail & ~crit).cast("long")).alias("other_fails"),
        F.sum(warn.cast("long")).alias("warnings"),
    ).na.fill(0)
    top = psi.agg(F.coalesce(F.max(psi_col), F.lit(0.0)).alias("m")).scalar() if psi is not None else F.lit(0.0)
    out = out.withColumn("max_psi", top)
    verdict = (
        F.when((F.col("critical_fails") > 0) | (F.col("max_psi") > GATE_PSI_FAIL), "FAIL")
        .when((F.col("other_fails") > 0) | (F.col("warnings") > 0) | (F.col("max_psi") > GATE_PSI_WARN), "WARN")
        .otherwise("PASS")
    )
    return out.withColumn("verdict", verdict)
