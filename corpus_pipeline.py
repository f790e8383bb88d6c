"""Corpus pipeline: five stages, each applying one operator to what its predecessor kept.

run() writes every stage's result to the shared folder and reads it back, so a lost executor costs
one stage at most. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, jaccard, language, lattice, pii
from tallyframe.llm.base import prepare
from tallyframe.llm.q_text import PIECES
from tallyframe.plans.session import written

#: Share of a text's trigrams that the best language must hold; below it a text is no language text.
MIN_SCORE = 0.1


def unused(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts in none of the languages; a missing `lang` is filled in.

    An input without any language to learn from rejects only the texts without letters.
    """
    prepare(spark)
    model = language.learn(docs)
    found = unused(docs, "_l")
    told = docs.withColumn(found, language.predict(model) if model.languages else language.letters())
    lang = F.coalesce(F.col("lang"), F.when(F.lit(bool(model.languages)), F.col(found)["lang_pred"]))
    kept = told.where((F.col(found)["lang_pred"] != "und") & (F.col(found)["score"] >= MIN_SCORE))
    return kept.select(*[lang.alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    prepare(spark)
    return jaccard.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of `benchmark` go."""
    prepare(spark)
    found = unused(docs, "_overlap")
    marked = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=found)
    return marked.where(F.size(found) == 0).drop(found)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind; `n_chars` follows the text."""
    prepare(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every document, as the operator's own query draws, and the text decoded from their ids."""
    prepare(spark)
    out = lattice.encode(docs, lattice.load(PIECES), k=3, decoded=True, block=1 << 19, shared=1 << 19)
    return out.select("doc_id", "sample", "n_pieces", "log_prob", "ids", "text")


STAGES = [
    ("language", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("pieces", pieces),
]

#: SQL cannot express the stages; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
