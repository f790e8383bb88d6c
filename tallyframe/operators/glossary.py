"""Glossary terms in texts: where each one occurs, and which share of a row's features they ground."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of terms one automaton is built from (some 60 bytes of memory each).
TERM_CHARS = 4 << 20
#: Characters of texts that meet one block of terms in one task, where the terms need several blocks.
TEXT_CHARS = 32 << 20


def _automaton(terms: Iterable[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term in terms:
        out.add_word(term, len(term))
    if len(out):
        out.make_automaton()
    return out


def _hits(automaton, keys: list, texts: list, schema: pa.Schema, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """All occurrences, overlapping ones too, in batches of bounded length."""
    found: list[list] = [[], [], [], []]

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)
        for c in found:
            c.clear()
        return batch

    for key, text in zip(keys, texts):
        if not text or not len(automaton):
            continue
        for last, size in automaton.iter(text):
            start = last + 1 - size
            for column, value in zip(found, (key, text[start : last + 1], start, last + 1)):
                column.append(value)
            if len(found[0]) >= rows:
                yield flush()
    if found[0]:
        yield flush()


def glossary_hits(df: DataFrame, key: str, text: str, glossary: DataFrame, term: str, term_chars: int = TERM_CHARS, text_chars: int = TEXT_CHARS) -> DataFrame:
    """(key, term, start, end) of every occurrence of a glossary term, in code points of the lower-cased text, end exclusive.

    Upper and lower case are the same; NULL and empty terms are left out, repeated ones count once; NULL texts have
    no hits; a repeated row gives its hits again. Terms of up to `term_chars` characters in all travel with the tasks and
    the texts stay where they are. A larger glossary is dealt into blocks of that size, and every text meets every
    block: texts are copied once per block, and terms once per `text_chars` of text.
    """
    terms = glossary.select(F.lower(term).alias("_term")).where("_term <> ''").distinct()
    texts = df.select(F.col(key).alias("_key"), F.lower(text).alias("_text")).where("_text <> ''")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    chars = terms.agg(F.coalesce(F.sum(F.length("_term")), F.lit(0))).head()[0]
    if chars <= term_chars:
        known = [r[0] for r in terms.collect()]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, arrow = _automaton(known), _arrow(schema)
            for b in batches:
                yield from _hits(automaton, b.column(0).to_pylist(), b.column(1).to_pylist(), arrow)

        return texts.mapInArrow(scan, schema)

    blocks = -(-chars // term_chars)
    salts = max(1, -(-texts.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).head()[0] // text_chars))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    left = texts.withColumn("_salt", F.pmod(F.xxhash64("_key", "_text"), F.lit(salts)).cast("int")).withColumn("_block", every(blocks))
    right = terms.withColumn("_block", F.pmod(F.xxhash64("_term"), F.lit(blocks)).cast("int")).withColumn("_salt", every(salts))

    def meet(mine: pa.Table, known: pa.Table) -> pa.Table:
        arrow = _arrow(schema)
        automaton = _automaton(known["_term"].to_pylist())
        return pa.Table.from_batches(_hits(automaton, mine["_key"].to_pylist(), mine["_text"].to_pylist(), arrow), arrow)

    return left.groupBy("_block", "_salt").cogroup(right.groupBy("_block", "_salt")).applyInArrow(meet, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def glossary_grounding(df: DataFrame, key: str, text: str, feats: str, glossary: DataFrame, term: str, feature: str, **bounds: int) -> DataFrame:
    """(key, n_features, n_grounded, grounding): share of a row's distinct features one of whose terms occurs in its text.

    `feats` is a list of feature names, the glossary holds any number of terms per feature; keys are unique. A row
    without features has a share of 0.
    """
    hits = glossary_hits(df, key, text, glossary, term, **bounds).select(F.col(key), "term").distinct()
    known = glossary.select(F.lower(term).alias("term"), F.col(feature).alias("_feature")).distinct()
    named = hits.join(known, "term").select(key, "_feature").distinct().withColumn("_hit", F.lit(1))
    wanted = df.select(key, F.explode_outer(F.array_distinct(feats)).alias("_feature"))
    out = wanted.join(named, [key, "_feature"], "left").groupBy(key).agg(F.count("_feature").alias("n_features"), F.count("_hit").alias("n_grounded"))
    share = F.when(F.col("n_features") > 0, F.col("n_grounded") / F.col("n_features")).otherwise(0.0)
    return out.withColumn("grounding", share)
