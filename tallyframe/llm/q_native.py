"""Queries of the operators written in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.llm import chat, quality, urls
from tallyframe.llm.base import query

_TURNS = """turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text))"""
_ESC = "replace(replace(replace({0}, '~', '~0'), '<', '~1'), '[', '~2')"


@query(
    "op9_chat_format",
    f"""WITH {_TURNS}, marked AS (SELECT *, role IS DISTINCT FROM lag(role) OVER w AS opens FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESC.format('text')}) + CASE WHEN opens THEN length('<s>[INST][/INST]</s>') + length({_ESC.format('role')}) ELSE length('[NEXT]') END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""",
)
def op9_chat_format(spark, sf):
    """Every conversation and conversation -1, formatted and read back from the output."""
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    control = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{control}'), (-1L, 1L, 'assistant', '{control}') AS own(conv_id, turn, role, text)")
    out = chat.format_turns(talks.select("conv_id", "turn", "role", "text").unionByName(own))
    back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op10_quality_divergence")
def op10_quality_divergence(spark, sf):
    """Base counts and the divergence verdict of every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    out = quality.divergence(docs, quality.references(docs))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Fixed rules of the query.
RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


@query("op12_url_trees")
def op12_url_trees(spark, sf):
    """The verdict on the address of every page."""
    return urls.filter_urls(spark.read.parquet(f"{sf}/pages.parquet"), RULES)
