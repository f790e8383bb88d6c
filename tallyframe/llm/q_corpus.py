"""Queries of the operators that compare texts with each other or with the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.llm import interpolation, jaccard, suffixes
from tallyframe.llm.base import fold, query


@query("op1_deleted_interpolation")
def op1_deleted_interpolation(spark, sf):
    """Log10 probability of every document under the interpolated trigram model."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = interpolation.score(docs, fold("doc_id", 10), order=3)
    return out.select("doc_id", (F.col("part") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_parity_join")
def op6_parity_join(spark, sf):
    """The near-duplicate component of every document."""
    return jaccard.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf):
    """What repeated 400-byte strings leave of every document."""
    out = suffixes.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
