"""Queries of the operators on tokenizations, addresses and dataset manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.llm import alignment, manifest
from tallyframe.llm.base import fold, query

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark, sf):
    """Groups and links of the two tokenizations of every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = alignment.align(docs, alignment.load(BYTE_LEVEL, PIECES), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


#: sha256 of one value: `-` or length in bytes, `:` and the value.
_TOLD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_TOLD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{0}")) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The public reflected CRC-32, bit by bit over the characters of the decimal id.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''),
  lambda c: CASE WHEN c = '' THEN []::BIGINT[] ELSE [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] END))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


@query(
    "op13_merkle_manifest",
    f"""WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, lang, {_LEAF.format('text')} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(_LOWER)} ELSE {_LEAF.format('text')} END AS shown FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
below(lang, level, r, h, n) AS (SELECT lang, 0, r, leaf, n FROM placed
  UNION ALL SELECT lang, level + 1, r // 8, sha256(string_agg(h, '' ORDER BY r)), (any_value(n) + 7) // 8 FROM below WHERE n > 1 GROUP BY lang, level, r // 8),
tree AS MATERIALIZED (SELECT * FROM below),
tops AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
crown(level, r, h, n) AS (SELECT 0, place, subroot, n FROM tops
  UNION ALL SELECT level + 1, r // 8, sha256(string_agg(h, '' ORDER BY r)), (any_value(n) + 7) // 8 FROM crown WHERE n > 1 GROUP BY level, r // 8),
peak AS MATERIALIZED (SELECT * FROM crown),
walk(doc_id, leaf, lang, subroot, place, level, r, shown, heard) AS (
  SELECT p.doc_id, p.leaf, p.lang, t.subroot, t.place, 0, p.r, p.shown, '' FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang
  UNION ALL SELECT w.doc_id, w.leaf, w.lang, w.subroot, w.place, w.level + 1, w.r // 8, sha256(k.before || w.shown || k.after), w.heard || k.before || k.after
  FROM walk w JOIN (SELECT lang, level, r,
      coalesce(string_agg(h, '') OVER (PARTITION BY lang, level, r // 8 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
      coalesce(string_agg(h, '') OVER (PARTITION BY lang, level, r // 8 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM tree WHERE n > 1) k ON w.lang IS NOT DISTINCT FROM k.lang AND w.level = k.level AND w.r = k.r),
arrived AS MATERIALIZED (SELECT * FROM walk w WHERE NOT EXISTS (FROM tree t WHERE t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.n > 1)),
rise(doc_id, leaf, subroot, level, r, shown, heard) AS (
  SELECT doc_id, leaf, subroot, 0, place, shown, heard FROM arrived
  UNION ALL SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.r // 8, sha256(k.before || w.shown || k.after), w.heard || k.before || k.after
  FROM rise w JOIN (SELECT level, r,
      coalesce(string_agg(h, '') OVER (PARTITION BY level, r // 8 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
      coalesce(string_agg(h, '') OVER (PARTITION BY level, r // 8 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM peak WHERE n > 1) k ON w.level = k.level AND w.r = k.r)
SELECT doc_id, leaf, subroot, p.h AS root, sha256(heard) AS proof_sha256, shown AS folded_root, shown = p.h AS verified
FROM rise JOIN peak p ON p.n = 1 AND rise.level = p.level""",
)
def op13_merkle_manifest(spark, sf):
    """Leaf, roots and proof of every document, and the root that a partly tampered copy leads to."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = lambda text: manifest.leaf([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text])
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(fold("doc_id", 3) == 0, told(F.translate("text", capitals, capitals.lower())))
    rows = docs.select("doc_id", "lang", told(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    out = manifest.proofs(rows, group="lang", order="doc_id", leaf="leaf")
    shown = manifest.fold(F.coalesce("item.tampered", "item.leaf"), F.col("path"))
    out = out.select("item.doc_id", "item.leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"), shown.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
