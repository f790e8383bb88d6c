"""Contract-checked ingest of source domains."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.privacy import encrypt, encryption_policy, resolve_domain
from tallyframe.operators.quality import check_contract, check_schema
from tallyframe.sources.tables import SourceSpec, read_parquet, to_typed, write_parquet

RESULT = "source string, row_count long, column_count int, passed int, pii_indexed int, pii_dropped int, warnings string, output string"


@dataclass(frozen=True)
class Domain:
    """One source: where it is read, what it must look like, how it is transformed and written."""

    spec: SourceSpec
    path: str
    output: str | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None
    pii: Sequence[str] = ()
    salts: dict[str, bytes] = field(default_factory=dict)
    checked: SourceSpec | None = None


def ingest(spark: SparkSession, d: Domain) -> tuple[DataFrame | None, DataFrame]:
    """(clean frame, one result row). A missing required column stops the domain; other findings are warnings.

    The row count is the only extra pass; contract and schema checks read the schema alone.
    """
    df = read_parquet(spark, d.path)
    notes = [f"{r['check']}:{r['column'] or 'rows'}" for r in check_contract(df, d.spec).collect()]
    missing = [c for c in d.spec.required if c not in df.columns]
    if missing:
        row = (d.spec.name, df.count(), len(df.columns), 0, 0, 0, ";".join(sorted([*notes, *[f"required:{c}" for c in missing]])), d.output or "")
        return None, spark.createDataFrame([row], RESULT)
    out = to_typed(df, d.spec.casts) if d.spec.casts else df
    out = d.transform(out) if d.transform else out
    report = check_schema(out, d.checked or d.spec).collect()
    notes += [f"{r['check']}:{r['column']}" for r in report]
    passed = all(r["status"] != "FAIL" for r in report)
    indexed = dropped = 0
    if d.pii:
        empty = spark.createDataFrame([], "hash binary, id long")
        before = set(out.columns)
        out, _, audit = encrypt(out, encryption_policy(d.pii), d.salts, {resolve_domain(c): empty for c in d.pii})
        indexed, dropped = len(audit["indexed"]), len(before - set(out.columns))
    out = out.drop(*d.spec.drop)
    if d.output:
        write_parquet(out, d.output)
        out = spark.read.parquet(d.output)
    row = out.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(d.spec.name).alias("source"), "row_count", F.lit(len(out.columns)).alias("column_count"), F.lit(int(passed)).alias("passed"), F.lit(indexed).alias("pii_indexed"), F.lit(dropped).alias("pii_dropped"),
        F.lit(";".join(sorted(notes))).alias("warnings"), F.lit(d.output or "").alias("output"),
    )
    return out, row


def ingest_all(spark: SparkSession, domains: Sequence[Domain]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run every enabled domain: frames by name and the manifest of result rows."""
    frames, manifest = {}, spark.createDataFrame([], RESULT)
    for d in domains:
        if not d.spec.enabled:
            continue
        df, row = ingest(spark, d)
        if df is not None:
            frames[d.spec.name] = df
        manifest = manifest.unionByName(row)
    return frames, manifest
