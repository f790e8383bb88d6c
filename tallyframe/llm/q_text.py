"""Queries of the operators that look at one text at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, language, lattice, pii, toxicity
from tallyframe.llm.base import fold, query


@query("op5_language_filter")
def op5_language_filter(spark, sf):
    """The language of every document, learned from four fifths of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = fold("doc_id", 5) == 0
    model = language.learn(docs.where(~held))
    return docs.select("doc_id", held.alias("held_out"), language.predict(model).alias("p")).select("doc_id", "held_out", "p.*")


@query("op8_pii_anchors")
def op8_pii_anchors(spark, sf):
    """Counts and positions of personal data in every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = docs.select("doc_id", pii.spans().alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("s", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("s")).alias("spans"), *[count(k) for k in pii.KINDS[len(pii.BASE) :]])

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op2_sampled_pieces")
def op2_sampled_pieces(spark, sf):
    """Three distinct segmentations of every document, with digests of the ids and of the decoded text."""
    return lattice.encode(spark.read.parquet(f"{sf}/documents.parquet"), lattice.load(PIECES), k=3, digest=True)


@query("op4_spaced_seeds")
def op4_spaced_seeds(spark, sf):
    """Every overlap of a document with a benchmark item, positions in words."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    return out.where(F.size("overlap") > 0).select("doc_id", F.explode("overlap").alias("o")).select("doc_id", "o.*")


@query("op7_toxicity_cnn")
def op7_toxicity_cnn(spark, sf):
    """Toxicity of every document, learned from labels of four fifths of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    out = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), toxicity.score(model).alias("score"))
    return out.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
