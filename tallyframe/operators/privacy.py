"""Hashing, indexing and masking of personal data, and checks on generated text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.stats import md5_unit
from tallyframe.plans.session import GROUP_ROWS
from tallyframe.plans.skew import lookback, position

# Column-name patterns and their data domain, in order of precedence.
COLUMN_DOMAINS = {
    "customer_id": "customer", "cust_no": "customer", "cust_id": "customer", "csno": "customer",
    "account_no": "account", "actno": "account", "acct_no": "account", "deps_actno": "account",
    "card_no": "card", "card_number": "card", "chk_cdno": "card",
    "merchant_id": "merchant", "frcs_no": "merchant",
    "insurance_policy": "insurance", "insr_plcy_no": "insurance",
    "phone": "contact", "telno": "contact", "hp_no": "contact", "email": "contact",
    "rrno": "personal_id", "brno": "personal_id",
    "name": "customer", "cust_nm": "customer",
}
NULL_DIGEST = "00" * 32


def resolve_domain(column: str) -> str:
    """Domain of a column name: exact match, then the first contained pattern, else "default"."""
    low = column.lower()
    if low in COLUMN_DOMAINS:
        return COLUMN_DOMAINS[low]
    return next((d for p, d in COLUMN_DOMAINS.items() if p in low), "default")


def hash_value(c: Column, salt: bytes) -> Column:
    """SHA-256 of salt + value as 32 bytes; NULL becomes 32 zero bytes."""
    salted = F.concat(F.unhex(F.lit(salt.hex())), c.cast("string").cast("binary"))
    return F.coalesce(F.unhex(F.sha2(salted, 256)), F.unhex(F.lit(NULL_DIGEST)))


def hash_pii(df: DataFrame, domains: dict[str, str], salts: dict[str, bytes]) -> DataFrame:
    """Replace each listed column by `{col}_hashed`."""
    keep = [F.col(c) for c in df.columns if c not in domains]
    return df.select(*keep, *[hash_value(F.col(c), salts[d]).alias(f"{c}_hashed") for c, d in domains.items() if c in df.columns])


def index_pii(df: DataFrame, col: str, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frame with `{base}_idx`, grown index) for a hashed column.

    Known hashes keep their id; new ones are numbered in hash order after the largest id, starting
    at 1. The NULL digest maps to -1. `index` has (hash, id).
    """
    null = F.unhex(F.lit(NULL_DIGEST))
    seen = df.select(F.col(col).alias("hash")).where(F.col("hash").isNotNull() & (F.col("hash") != null)).distinct()
    new = position(seen.join(index, "hash", "left_anti"), [], ["hash"], "_r")
    top = index.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    new = new.withColumn("_m", top).select("hash", (F.col("_m") + F.col("_r")).cast("long").alias("id"))
    grown = index.select("hash", F.col("id").cast("long").alias("id")).unionByName(new)
    base = col.removesuffix("_hashed")
    out = df.join(grown.withColumnsRenamed({"hash": "_h", "id": "_id"}), F.col(col) == F.col("_h"), "left")
    return out.withColumn(f"{base}_idx", F.coalesce("_id", F.lit(-1))).drop("_h", "_id", col), grown


def encryption_policy(pii: Sequence[str]) -> dict[str, str]:
    """Action per personal column: contact data and personal ids are dropped, the rest hashed and indexed."""
    return {c: "drop" if resolve_domain(c) in ("contact", "personal_id") else "hash_and_index" for c in pii}


def encrypt(df: DataFrame, policy: dict[str, str], salts: dict[str, bytes], indexes: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame], dict]:
    """Drop, hash and index the personal columns: (frame, grown index per domain, audit row)."""
    drop = [c for c, a in policy.items() if a == "drop" and c in df.columns]
    domains = {c: resolve_domain(c) for c, a in policy.items() if a != "drop" and c in df.columns}
    out = hash_pii(df.drop(*drop), domains, salts)
    grown = dict(indexes)
    for c, d in domains.items():
        out, grown[d] = index_pii(out, f"{c}_hashed", grown[d])
    return out, grown, {"dropped": drop, "hashed": list(domains), "indexed": list(domains)}


# Personal-data patterns in the order they are masked, units whose numbers become
# ranges, and the words of the ranges.
SCRUB_PATTERNS = {
    "korean_name": r"[가-힣]{2,4}(님|씨|고객)",
    "phone": r"01[016789]-?\d{3,4}-?\d{4}",
    "email": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "ssn": r"\d{6}-?[1-4]\d{6}",
    "card_number": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}",
    "account_number": r"\d{3}-?\d{2,6}-?\d{2,6}",
    "business_reg": r"\d{3}-?\d{2}-?\d{5}",
}
NUMBER_WITH_UNIT = r"(\d+(?:\.\d+)?)\s*(건|회|원|만원|%|점|개월|일)"
CUSTOMER_KEY = r"(?i)(customer_id|cust_id|CSNO|고객\s*ID)\s*[:=]?\s*\d+"
SEGMENT_KEY = r"(?i)(세그먼트|segment|cluster)\s*[:=]?\s*\d+"
LOW, MIDDLE, HIGH, VERY_HIGH = "낮은 수준", "중간 수준", "높은 수준", "매우 높은 수준"


def range_text(value: Column, unit: Column) -> Column:
    """A number with its unit as a level (percent, scores) or as the bucket it falls into."""
    size = F.when(value < 10, 5).when(value < 100, 10).when(value < 1000, 100).otherwise(1000)
    low = (F.floor(value / size) * size).cast("long")
    return (
        F.when((unit == "%") & (value < 20), LOW).when((unit == "%") & (value < 50), MIDDLE).when((unit == "%") & (value < 80), HIGH).when(unit == "%", VERY_HIGH)
        .when(((unit == "점") | ((value > 0) & (value < 1.5))) & (value < 0.3), LOW)
        .when(((unit == "점") | ((value > 0) & (value < 1.5))) & (value < 0.7), MIDDLE)
        .when((unit == "점") | ((value > 0) & (value < 1.5)), HIGH)
        .otherwise(F.concat(low.cast("string"), F.lit("~"), (low + size).cast("string"), unit, F.lit("대")))
    )


def scrub_text(df: DataFrame, col: str, name: str = "scrubbed") -> DataFrame:
    """Mask personal data, turn numbers with units into ranges, mask ids; `{name}_count` counts replacements.

    Patterns apply one after the other to the text left by the previous one.
    """
    out = df.withColumn(name, F.col(col)).withColumn("_n", F.lit(0))
    for label, rx in SCRUB_PATTERNS.items():
        # the address pattern walks every word; a text without "@" cannot match it
        maybe = F.contains(F.col(name), F.lit("@")) if "@" in rx else F.col(name).rlike(rx)
        out = out.select("*", F.coalesce(maybe, F.lit(False)).alias("_maybe"))
        n = F.when(F.col("_maybe"), F.regexp_count(name, F.lit(rx))).otherwise(0)
        text = F.when(F.col("_maybe"), F.regexp_replace(name, rx, f"[{label}]")).otherwise(F.col(name))
        out = out.select(*[c for c in out.columns if c not in (name, "_n", "_maybe")], (F.col("_n") + n).alias("_n"), text.alias(name))
    nums = F.regexp_extract_all(name, F.lit(NUMBER_WITH_UNIT), F.lit(1))
    units = F.regexp_extract_all(name, F.lit(NUMBER_WITH_UNIT), F.lit(2))
    out = out.select("*", F.split(name, NUMBER_WITH_UNIT, -1).alias("_gaps"), F.arrays_zip(nums.alias("v"), units.alias("u")).alias("_hits"))
    ranged = F.transform("_hits", lambda h: range_text(h["v"].cast("double"), h["u"]))
    joined = F.array_join(F.zip_with("_gaps", F.concat(ranged, F.array(F.lit(""))), lambda g, r: F.concat(g, r)), "")
    keep = [c for c in df.columns if c != name]
    out = out.select(*keep, (F.col("_n") + F.size("_hits")).alias("_n"), F.regexp_replace(joined, CUSTOMER_KEY, "$1: [익명]").alias(name))
    masked = F.contains(F.col(name), F.lit("[익명]")).cast("int")
    return out.select(*keep, (F.col("_n") + masked).alias(f"{name}_count"), F.regexp_replace(name, SEGMENT_KEY, "$1: [그룹]").alias(name))


# Patterns of customer-specific and of aggregated statements.
HIGH_PATTERNS = (
    r"고객\s*(ID|번호|식별)", r"customer[_\s]*(id|no|idx)", r"CSNO|CUST_NO|cust_id", r"월\s*평균\s*\d+\s*(건|회|원|만원)", r"거래\s*(건수|금액|횟수)\s*[:=]?\s*\d+",
    r"소득\s*(안정성|추세|등급)\s*[:=]?\s*[0-9.]+", r"한도\s*(소진율|사용률)\s*[:=]?\s*[0-9.]+", r"이탈\s*(위험|확률|점수)\s*[:=]?\s*[0-9.]+", r"churn[_\s]*(risk|prob|score)\s*[:=]?\s*[0-9.]+",
    r"세그먼트\s*[:=]?\s*\d+", r"cluster[_\s]*(id|prob)\s*[:=]?\s*\d+", r"rfm[_\s]*\d+\s*[:=]?\s*[0-9.]+", r"feature[_\s]*\d+\s*[:=]?\s*[0-9.]+",
)
MEDIUM_PATTERNS = (r"(높|중|낮)(음|은|은\s*수준)", r"(상위|하위)\s*\d+%", r"평균\s*(대비|이상|이하)", r"등급\s*[:=]?\s*[A-F가-힣]")
# Patterns of attempts to change a model's instructions.
INJECTION_PATTERNS = (
    r"(?i)ignore\s+(all\s+)?previous\s+instructions", r"(?i)disregard\s+(all\s+)?above", r"(?i)forget\s+(your|all|everything)\s+(rules|instructions|prompt)", r"(?i)\byou\s+are\s+now\s+(?:a|an)\s+\w+",
    r"(?i)pretend\s+(you\s+are|to\s+be)\s+", r"(?i)\bdeveloper\s+mode\b", r"(?i)\bjailbreak\b", r"(?i)\bDAN\s+(mode|prompt)\b", r"(?i)do\s+anything\s+now", r"(?i)respond\s+as\s+(?:if\s+you\s+)?(?:have\s+no|without)\s+restrictions",
    r"(?i)reveal\s+(your|the)\s+(system|initial)\s+prompt", r"(?i)show\s+me\s+(your|the)\s+(instructions|system\s+prompt)", r"(?i)output\s+(your|the)\s+(instructions|prompt|rules)", r"(?i)base64\s*:\s*[A-Za-z0-9+/=]{20,}",
    r"(?i)\bcall\s+(?:the|any)\s+(?:tool|function)\s+(?:named|called)\b", r"(?i)<\s*tool[_\s]*call\s*>",
)
# Patterns of answers that give away instructions or personal numbers.
LEAK_PATTERNS = (
    r"(?i)system\s+prompt\s*[:=]", r"(?i)my\s+(?:original\s+)?instructions?\s+(?:were|are)\s*[:=]", r"(?i)the\s+rules?\s+i\s+(?:was\s+)?given\s*[:=]", r"(?i)i\s+am\s+(?:actually|really)\s+(?:a|an)\s+\w+\s+(?:AI|model|assistant)",
    r"(?i)as\s+(?:a|an)\s+\w+\s+(?:without\s+restrictions|in\s+developer\s+mode)", r"\b\d{6}[-\s]?\d{7}\b", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
)
# Terms of art, and vague words.
JARGON = (r"IG\s*기여도", "PSI", "AUC", "logit", "sigmoid", "softmax", "attribution", "perturbation")
VAGUE = (r"어느\s*정도", "다소", "약간", "상당히", r"매우\s*다양")


def _any(c: Column, patterns: Sequence[str], flags: str = "") -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(flags + p) for p in patterns])


def classify_text(df: DataFrame, col: str, high: Sequence[str] = HIGH_PATTERNS, medium: Sequence[str] = MEDIUM_PATTERNS) -> DataFrame:
    """HIGH, MEDIUM or LOW sensitivity; the first class with a matching pattern."""
    return df.withColumn("sensitivity", F.when(_any(F.col(col), high, "(?i)"), "HIGH").when(_any(F.col(col), medium, "(?i)"), "MEDIUM").otherwise("LOW"))


def scan_text(df: DataFrame, col: str, patterns: Sequence[str], layer: str, severity: str = "high") -> DataFrame:
    """`findings`, one per pattern that matches, in pattern order and with the whole match, and whether the text must be blocked."""
    c = F.col(col)
    hits = F.array(*[F.when(c.rlike(p), F.struct(F.lit(layer).alias("layer"), F.lit(p).alias("rule"), F.regexp_substr(c, F.lit(p)).alias("preview"), F.lit(severity).alias("severity"))) for p in patterns])
    found = F.filter(hits, lambda x: x.isNotNull())
    out = df.withColumn("findings", F.coalesce(found, F.array().cast(found_type())))
    return out.withColumn("blocked", ((F.size("findings") > 0) & F.lit(severity in ("high", "critical"))).cast("int"))


def found_type() -> str:
    return "array<struct<layer:string,rule:string,preview:string,severity:string>>"


def readability(df: DataFrame, col: str, max_sentence: int = 80, max_jargon: float = 0.15, jargon: Sequence[str] = JARGON, vague: Sequence[str] = VAGUE) -> DataFrame:
    """0.4 sentence length + 0.35 jargon + 0.25 vagueness, each from 0 to 1; an empty text scores 0."""
    c = F.col(col)
    sentences = F.filter(F.split(c, r"[.!?。]\s*", -1), lambda s: F.trim(s) != "")
    out = df.select("*", sentences.alias("_s"), F.size(F.filter(F.split(c, r"\s+", -1), lambda w: w != "")).alias("_w"))
    n = F.size("_s")
    mean = F.aggregate("_s", F.lit(0.0), lambda a, s: a + F.length(s)) / F.when(n > 0, n)
    length = F.when(n > 0, F.greatest(1.0 - F.greatest(mean - 30, F.lit(0.0)) / max_sentence, F.lit(0.0))).otherwise(0.5)
    terms = reduce(lambda a, b: a + b, [F.regexp_count(c, F.lit(p)) for p in jargon])
    words = F.when(F.col("_w") > 0, F.greatest(1.0 - terms / F.when(F.col("_w") > 0, F.col("_w")) / max_jargon, F.lit(0.0))).otherwise(0.5)
    soft = F.greatest(1.0 - 0.2 * reduce(lambda a, b: a + b, [c.rlike(p).cast("int") for p in vague]), F.lit(0.0))
    score = F.when(c.isNull() | (c == ""), 0.0).otherwise(F.round(0.4 * length + 0.35 * words + 0.25 * soft, 4))
    return out.select(*df.columns, score.alias("readability"))


def grounding(df: DataFrame, text: str, feats: str, glossary: dict[str, str] | None = None) -> DataFrame:
    """Share of the listed features (name, text) that the text names, by name, glossary or a word of their text."""
    low = F.lower(text)
    gloss = F.create_map(*[F.lit(x) for kv in (glossary or {"": ""}).items() for x in kv])

    def named(f: Column) -> Column:
        words = F.filter(F.split(F.coalesce(f["text"], F.lit("")), r"\s+"), lambda w: F.length(w) > 2)
        terms = F.concat(F.array(f["name"]), F.filter(F.array(F.try_element_at(gloss, f["name"])), lambda t: t.isNotNull()), words)
        return F.exists(terms, lambda t: F.contains(low, F.lower(t)))

    hits = F.filter(feats, named)
    n = F.size(feats)
    score = F.when((n > 0) & (F.col(text) != ""), F.round(F.size(hits) / F.when(n > 0, n), 4)).otherwise(0.0)
    return df.withColumns({"mentioned": F.transform(hits, lambda f: f["name"]), "grounding": F.coalesce(score, F.lit(0.0))})


def quality_score(df: DataFrame, faithfulness: str, grounded: str, compliance: str, readable: str) -> DataFrame:
    """0.30 faithfulness + 0.25 grounding + 0.25 compliance + 0.20 readability."""
    return df.withColumn("quality", 0.30 * F.col(faithfulness) + 0.25 * F.col(grounded) + 0.25 * F.col(compliance) + 0.20 * F.col(readable))


def stratified_sample(df: DataFrame, key: Sequence[str], n: int, confidence: str, segment: str, protected: Sequence[str], strata: Sequence[str], flagged: str, layer: str, forced_layer: str = "L2b", seed: int = 42) -> DataFrame:
    """All flagged rows of the forced layer, plus n rows per stratum: borderline first, then protected groups, then a hash draw.

    The n per stratum come from a ranked window that Spark cuts per task before the shuffle.
    """
    forced = F.coalesce(F.col(flagged), F.lit(False)) & (F.coalesce(F.col(layer), F.lit("")) == forced_layer)
    draw = md5_unit(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    border = F.when((F.col(confidence) >= 0.6) & (F.col(confidence) < 0.8), 3.0).otherwise(0.0)
    score = border + F.when(F.col(segment).isin(*protected), 2.0).otherwise(0.0) + draw * 0.1
    rest = df.where(~forced).withColumn("_p", score)
    w = Window.partitionBy(*strata).orderBy(F.desc("_p"), *key)
    picked = rest.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_p", "_r")
    return df.where(forced).withColumn("forced", F.lit(1)).unionByName(picked.withColumn("forced", F.lit(0)))


def self_check(df: DataFrame, col: str, rules: dict[str, tuple[str, str]], injections: Sequence[str] = INJECTION_PATTERNS) -> DataFrame:
    """`violations`, `injections` and the verdict reject / revise / pass.

    `rules` maps a name to (pattern, severity); a critical hit or an injection rejects, another hit asks for a revision.
    """
    c = F.col(col)
    bad = F.filter(F.array(*[F.when(c.rlike("(?i)" + p), n) for n, (p, _) in rules.items()]), lambda x: x.isNotNull())
    critical = [p for p, s in rules.values() if s == "critical"]
    serious = [p for p, s in rules.values() if s in ("medium", "high")]
    none = F.lit(False)
    hurt = _any(c, critical, "(?i)") if critical else none
    warn = _any(c, serious, "(?i)") if serious else none
    inj = F.size(F.filter(F.array(*[F.when(c.rlike(p), p) for p in injections]), lambda x: x.isNotNull()))
    out = df.withColumns({"violations": bad, "injections": inj})
    return out.withColumn("verdict", F.when(hurt | (F.col("injections") > 0), "reject").when(warn, "revise").otherwise("pass"))


def safety_gate(df: DataFrame, col: str, min_len: int = 10, max_len: int = 500, sentences: int = 1, banned: Sequence[str] = (), banned_rx: Sequence[str] = (), pii_rx: Sequence[str] = ()) -> DataFrame:
    """`gate_issues` of the first failing layer (parse, then rules) and `gate_layer`, "all" where everything passes."""
    c = F.col(col)
    n = F.length(F.trim(c))
    parse = F.concat_ws(",", F.when(n < min_len, "too_short"), F.when(n > max_len, "too_long"), F.when(F.regexp_count(c, F.lit("[.!?。！？]")) < sentences, "insufficient_sentences") if sentences > 0 else F.lit(None))
    low = F.lower(c)
    hits = [F.when(F.contains(low, F.lit(b.lower())), "banned_phrase") for b in banned]
    hits += [F.when(c.rlike(p), "banned_regex") for p in banned_rx] + [F.when(c.rlike(p), "pii_leak") for p in pii_rx]
    rules = F.concat_ws(",", *hits) if hits else F.lit("")
    issues = F.when(c.isNull(), "text is null").when(parse != "", parse).otherwise(rules)
    layer = F.when(c.isNull() | (parse != ""), "parse").when(rules != "", "rules").otherwise("all")
    return df.withColumns({"gate_issues": issues, "gate_layer": layer})


def apply_marker(df: DataFrame, col: str, marker: str, key: str, position_: str = "append", separator: str = "\n\n") -> DataFrame:
    """Add the marker unless the text already carries it (or its key); NULL becomes an empty text."""
    c = F.coalesce(F.col(col), F.lit(""))
    has = F.contains(c, F.lit(marker)) | (F.contains(c, F.lit(key)) if key else F.lit(False))
    added = F.concat(c, F.lit(separator + marker)) if position_ == "append" else F.concat(F.lit(marker + separator), c)
    return df.withColumn(col, F.when(F.col(col).isNull(), "").when(has, c).when(c == "", marker).otherwise(added))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 as lower-case hex, from two SHA-256 over the padded key."""
    import hashlib

    k = hashlib.sha256(key).digest() if len(key) > 64 else key
    k = k.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    first = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner.hex())), message.cast("binary")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), first), 256)


def verify_chain(log: DataFrame, keys: Sequence[str], seq: str, entry: str, body: str, prev_hash: str, signature: str | None = None, key: bytes = b"", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(chain_ok, hmac_ok) per entry of an audit log, one chain per `keys` (none = one global chain).

    `entry` is the full text whose hash the next entry stores in `prev_hash`; `body` is the signed part.
    """
    def build(f: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(seq)
        return f.withColumn("_prev", F.lag(F.sha2(F.col(entry).cast("binary"), 256)).over(w))

    out = lookback(log, list(keys), [seq], 1, build, group_rows)
    chain = (F.coalesce(F.col("_prev"), F.lit("GENESIS")) == F.coalesce(F.col(prev_hash), F.lit(""))).cast("int")
    sig = F.coalesce(hmac_sha256(F.col(body), key) == F.col(signature), F.lit(False)).cast("int") if signature else F.lit(1)
    return out.withColumns({"chain_ok": chain, "hmac_ok": sig}).drop("_prev")


def chain_summary(checked: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Per chain: entries, whether it is intact, and the first broken position."""
    bad = (F.col("chain_ok") == 0) | (F.col("hmac_ok") == 0)
    return checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), (F.sum(bad.cast("int")) == 0).cast("int").alias("intact"), F.min(F.when(bad, F.col(seq))).alias("first_broken"))


