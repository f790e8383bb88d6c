"""Quality rules by distribution divergence, in Spark expressions only.

A text is compared with a reference of its language by two histograms: character classes (lower
case, upper case, space, digit, symbol, other) and the language's commonest short words (one bin
each, and one for all other words). Both comparisons use the Jensen-Shannon distance with base-2
logarithms, so 0 means equal and 1 disjoint. A histogram of n words differs from the one it was drawn
from by a squared distance of about bins / (8 ln 2 n); below `full_words` words the limit of the word
distance grows by what that exceeds its value at `full_words`, so texts of every length are judged.

Every language has its own reference, whatever its share of the corpus; the references are a table.

Defined results: a NULL or empty text has no words and zero counts and fails the base rules; a language
of too few words for a reference leaves the distances of its texts NULL; a NULL language is compared
with the reference of all texts; an empty table gives an empty result; ties among common words go to the smaller word; input columns
named like a result column give way to it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.plans.session import written

BLANK = r"[\x20\x09-\x0D]+"
CLASSES = ("lower", "upper", "space", "digit", "symbol", "other")
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def _total(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def counted(df: DataFrame, text: str, lang: str) -> DataFrame:
    """`row` (the other input columns), `lang`, `text`, `words`, `n_dup_lines`, `chars` and a count per character class.

    Classes are counted by removing one class after the other, so each step scans less text.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() != text.lower()]
    d = df.select(F.struct(*others).alias("row"), F.col(lang).alias("lang"), F.col(text).alias("text"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    lines = F.filter(F.split("body", "\n"), lambda x: F.regexp_replace(x, BLANK, "") != "")
    d = d.withColumn("lines", lines).withColumn("r1", F.regexp_replace("body", "[a-z]+", ""))
    d = d.withColumn("r2", F.regexp_replace("r1", BLANK, ""))
    d = d.withColumn("r3", F.regexp_replace("r2", "[A-Z]+", ""))
    d = d.withColumn("r4", F.regexp_replace("r3", "[0-9]+", ""))
    d = d.withColumn("r5", F.regexp_replace("r4", r"[#*$%&|<>]+", ""))
    steps = {"lower": ("body", "r1"), "space": ("r1", "r2"), "upper": ("r2", "r3"), "digit": ("r3", "r4"), "symbol": ("r4", "r5")}
    sizes = {n: (F.length(a) - F.length(b)).cast("long").alias(n) for n, (a, b) in steps.items()}
    sizes["other"] = F.length("r5").cast("long").alias("other")
    dups = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")
    return d.select("row", "lang", "text", F.filter(F.split("body", BLANK), lambda w: w != "").alias("words"), dups, F.length("body").cast("long").alias("chars"), *[sizes[c] for c in CLASSES])


def with_repeats(d: DataFrame) -> DataFrame:
    """Add `n_repeat_words`: words that lie in a 5-word window which the text holds twice or more.

    Windows are compared by their 64-bit hashes, built from those of 2 and 4 words. Most texts
    repeat no window, which one distinct count shows; the others sort (hash, position) pairs and add
    up what their repeated windows cover.
    """
    cut = lambda c, by, n: F.slice(c, by + 1, F.greatest(F.size("words") - n, F.lit(0)))
    pair = lambda a, b: F.xxhash64(a, b)
    d = d.withColumn("two", F.zip_with(cut("words", 0, 1), cut("words", 1, 1), pair))
    d = d.withColumn("five", F.zip_with(F.zip_with(cut("two", 0, 4), cut("two", 2, 4), pair), cut("words", 4, 4), pair))
    pairs = F.sort_array(F.transform("five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("pairs", F.when(F.size(F.array_distinct("five")) < F.size("five"), pairs).otherwise(none)).drop("two", "five")
    same = lambda a, b: F.coalesce(F.get(F.col("pairs"), a)["h"] == F.get(F.col("pairs"), b)["h"], F.lit(False))
    found = F.filter("pairs", lambda p, i: same(i, i - 1) | same(i, i + 1))
    d = d.withColumn("at", F.sort_array(F.transform(found, lambda p: p["i"])))
    ends = F.transform("at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get(F.col("at"), i + 1) - p, F.lit(5))).cast("long"))
    return d.withColumn("n_repeat_words", F.aggregate(ends, F.lit(0).cast("long"), lambda s, x: s + x)).drop("pairs", "at")


def references(df: DataFrame, text: str = "text", lang: str = "lang", bins: int = 20, max_chars: int = 5, ref_words: int = 1000) -> DataFrame:
    """A written table (lang, classes, words, shares, longest): a row per language, and one of all texts under NULL.

    All texts are counted. The `bins` commonest words of at most `max_chars` characters are the
    common words, `shares` ends with the share of all others, `longest` is the most bytes of a common
    word. Languages of fewer than `ref_words` words have no row: their own histogram would be coarse.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    each = df.select(F.col(lang).alias("lang"), F.explode(F.split(body, BLANK)).alias("w")).where(F.col("w") != "")
    # Longer words only count towards the total; they share the empty name.
    named = each.select("lang", F.when(F.length("w") <= max_chars, F.col("w")).otherwise(F.lit("")).alias("w"))
    counts = written(named.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("c")))
    chars = written(counted(df, text, lang).groupBy("lang").agg(*[F.sum(c).alias(c) for c in CLASSES]))
    none = F.lit(None).cast("string").alias("lang")
    sums = counts.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("c").alias("n")).where(F.col("n") >= ref_words)
    sums = sums.unionByName(counts.agg(F.sum("c").alias("n")).where("n > 0").select(none, "n"))
    classes = chars.where("lang IS NOT NULL").unionByName(chars.agg(*[F.sum(c).alias(c) for c in CLASSES]).select(none, *CLASSES))
    pooled = counts.groupBy("w").agg(F.sum("c").alias("c")).select(none, "w", "c")
    groups = counts.where("lang IS NOT NULL").unionByName(pooled).where("w <> ''")
    ranked = groups.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "w")))
    best = ranked.where(F.col("r") <= bins).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "c"))).alias("best"))

    def beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnRenamed("lang", "other_lang")
        return left.join(right, F.col("lang").eqNullSafe(F.col("other_lang")), how).drop("other_lang")

    out = beside(beside(sums, classes, "inner"), best, "left")
    every = reduce(lambda a, b: a + b, [F.col(c) for c in CLASSES])
    shares = F.transform(F.coalesce("best", F.array()), lambda b: b["c"] / F.col("n"))
    out = out.select("lang", F.array(*[F.col(c) / every for c in CLASSES]).alias("classes"), F.coalesce(F.col("best.w"), F.array().cast("array<string>")).alias("words"), shares.alias("s"))
    rest = F.greatest(F.lit(0.0), 1 - _total("s"))
    longest = F.coalesce(F.array_max(F.transform("words", lambda w: F.octet_length(w))), F.lit(0))
    return written(out.select("lang", "classes", "words", F.concat("s", F.array(rest)).alias("shares"), longest.alias("longest")))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    return F.sqrt(F.greatest(_total(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))) / 2, F.lit(0.0)))


def divergence(
    df: DataFrame,
    refs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_classes: float = 0.3,
    max_words: float = 0.45,
    min_chars: int = 200,
    full_words: int = 30,
    bins: int = 20,
) -> DataFrame:
    """Append the base counts, `class_distance`, `word_distance`, `base_failed` and `kept`.

    `base_failed`: fewer than 10 words, or more than a fifth of the words lie in repeated 5-word
    windows. A text is kept if it passes and neither distance exceeds its limit, which for words is
    `max_words` from `full_words` words on and grows below. Texts under `min_chars` characters have no
    class distance (NULL). `bins` is that of the references, which are joined by language.
    """
    own = refs.select(F.col("lang").alias("_lang"), F.struct("classes", "words", "shares", "longest").alias("_ref"))
    d = with_repeats(counted(df.join(own, df[lang].eqNullSafe(F.col("_lang")), "left").drop("_lang"), text, lang))
    ref = F.col("row._ref")
    d = d.withColumns({"n_words": F.size("words").cast("long"), "rc": ref["classes"], "rw": ref["words"], "rs": ref["shares"], "longest": ref["longest"]})
    d = d.withColumn("short", F.filter("words", lambda w: F.octet_length(w) <= F.col("longest")))
    # One expression per bin: `short` is then used several times, so Spark computes it once.
    occurs = lambda i: F.size(F.filter("short", lambda w: w == F.get(F.col("rw"), F.lit(i)))).cast("double")
    found = [occurs(i) for i in range(bins)]
    d = d.withColumn("hits", F.slice(F.array(*found).cast("array<double>"), F.lit(1), F.size("rw")))
    word_shares = F.transform(F.concat("hits", F.array(F.col("n_words") - _total("hits"))), lambda x: x / F.col("n_words"))
    class_shares = F.array(*[F.col(c) / F.col("chars") for c in CLASSES])
    known = F.col("rc").isNotNull()
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = d.withColumns({
        "class_distance": F.when(known & (F.col("chars") >= min_chars) & (F.col("chars") > 0), js_distance(class_shares, F.col("rc"))),
        "word_distance": F.when(known & (F.col("n_words") > 0), js_distance(word_shares, F.col("rs"))),
    })
    coarse = F.size("rw") / (8 * math.log(2)) * F.greatest(1 / F.col("n_words") - 1 / full_words, F.lit(0.0))
    near = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= max_classes) & F.coalesce(F.col("word_distance") <= F.sqrt(max_words**2 + coarse), F.lit(True))
    return d.select(
        *[F.col("text").alias(c) if c.lower() == text.lower() else F.col(f"row.`{c}`") for c in df.columns if c.lower() not in RESULT],
        "n_words",
        (F.col("chars") - F.col("space")).alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "class_distance",
        "word_distance",
        failed.alias("base_failed"),
        (~failed & near).alias("kept"),
    )
