"""URL filter: host and path rules, and boosted trees on lexical features for what no rule decides.

Spark expressions and Spark ML's boosted trees only. Features of a URL: lengths of the whole, host,
path and query; depth of path and host; share of digits; entropy of its characters; parameters;
hyphens, other signs and capitals; scheme; and statistics of its suffix (the last two labels of the host)
over all URLs: how many there are, how long they are, their share of digits, and how many labelled
ones are blocked (with one of each verdict added, and without the URL's own label while training).

Trees are fitted on at most `rows` labelled URLs, those with the smallest hash of the URL (repeats
by their key), which are the same whatever the partitioning. Everything else covers all URLs.

Defined results: a NULL URL, and one without `://`, has an empty host and path and is judged by the
other features; ties between rules of one length go to the rule that sorts last; repeated rows are
judged alike and stay; with labels of one verdict only that verdict, without any `allow` is given;
an empty table gives an empty result; very long URLs are read whole; input columns other than
those asked for are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.session import written

#: Labelled URLs that the trees are fitted on, at most; trees, their depth and the bins of a feature.
ROWS, TREES, DEPTH, BINS = 20_000, 20, 4, 32


class Rule(NamedTuple):
    """A verdict for a host with its subdomains and for paths that start with `path`."""

    verdict: str
    host: str
    path: str


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; '' without `://`."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0), capitals, capitals.lower())


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (host and path) that fits, as struct of its length, `rule` and `verdict`; NULL where none does.

    Rules are a short list of the caller's; each becomes one comparison of the plan.
    """
    fits = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(len(r.host + r.path)).alias("length"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length: int, rule: string, verdict: string>")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a text; 0 for an empty one. Work: n log n."""
    chars = F.array_sort(F.split(text, ""))
    n = F.length(text)
    bits = lambda run: run * F.log2(run)
    start = F.struct(F.lit("").alias("last"), F.lit(1.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda s, c: F.when(
        s["last"] == c, F.struct(s["last"].alias("last"), (s["run"] + 1.0).alias("run"), s["sum"].alias("sum"))
    ).otherwise(F.struct(c.alias("last"), F.lit(1.0).alias("run"), (s["sum"] + bits(s["run"])).alias("sum")))
    total = F.aggregate(chars, start, step, lambda s: s["sum"] + bits(s["run"]))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - total / n)).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


LEXICAL = (
    "size", "host_size", "path_size", "query_size", "depth", "labels", "digits", "host_digits", "entropy", "host_entropy",
    "parameters", "hyphens", "signs", "capitals", "fragment", "secure",
)
SUFFIX = ("suffix_urls", "suffix_size", "suffix_digits", "suffix_blocked")


def features(url: Column, h: Column, p: Column) -> dict[str, Column]:
    """The `LEXICAL` features of a URL, its host and its path, all of them doubles."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    size = F.length(text).cast("double")
    return {
        "size": size,
        "host_size": F.length(h).cast("double"),
        "path_size": F.length(p).cast("double"),
        "query_size": F.length(query).cast("double"),
        "depth": _count(p, "/[^/]"),
        "labels": F.when(F.length(h) > 0, _count(h, "[.]") + 1.0).otherwise(0.0),
        "digits": F.when(size > 0, _count(text, "[0-9]") / size).otherwise(0.0),
        "host_digits": F.when(F.length(h) > 0, _count(h, "[0-9]") / F.length(h)).otherwise(0.0),
        "entropy": entropy(text),
        "host_entropy": entropy(h),
        "parameters": F.when(F.length(query) > 0, _count(query, "&") + 1.0).otherwise(0.0),
        "hyphens": _count(text, "[-_]"),
        "signs": _count(text, "[^A-Za-z0-9:/.?&=#_-]"),
        "capitals": _count(text, "[A-Z]"),
        "fragment": F.contains(text, F.lit("#")).cast("double"),
        "secure": F.startswith(F.lower(text), F.lit("https://")).cast("double"),
    }


def suffix_statistics(described: DataFrame) -> DataFrame:
    """Per suffix: URLs, mean size and share of digits, labelled ones and blocked ones.

    Sums of whole numbers and of sizes are combined map-side, so a suffix may hold any share of the URLs.
    """
    blocked = F.col("verdict") == "block"
    return described.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("urls"),
        (F.sum(F.col("size").cast("long")) / F.count(F.lit(1))).alias("suffix_size"),
        (F.sum(F.round(F.col("digits") * F.col("size")).cast("long")) / F.greatest(F.sum(F.col("size").cast("long")), F.lit(1))).alias("suffix_digits"),
        F.count("verdict").alias("labelled"),
        F.count_if(blocked).alias("blocked"),
    )


class Trees(NamedTuple):
    """A fitted model, or the one verdict known."""

    model: GBTClassificationModel | None
    verdict: str


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features").transform(df)


def _joined(described: DataFrame, stats: DataFrame, own: bool) -> DataFrame:
    """Adds the suffix statistics; `own` leaves a URL's own label out of them."""
    minus = F.col("verdict").isNotNull().cast("int") if own else F.lit(0)
    less = F.coalesce((F.col("verdict") == "block").cast("int"), F.lit(0)) if own else F.lit(0)
    rate = (F.col("blocked") - less + 1.0) / (F.col("labelled") - minus + 2.0)
    return described.join(stats, "suffix").select("*", F.log1p("urls").alias("suffix_urls"), rate.alias("suffix_blocked"))


def describe(urls: DataFrame, rules: Sequence[Rule], key: str, url: str) -> DataFrame:
    """`key`, `url`, `host`, `path`, `rule` and `verdict` (NULL without a rule), `suffix` and the lexical features of every row."""
    u = F.col(f"`{url}`")
    read = urls.select(F.col(f"`{key}`").alias("key"), u.alias("url"), host(u).alias("host"), path(u).alias("path"))
    told = read.select("*", ruled(F.col("host"), F.col("path"), rules).alias("r")).select("key", "url", "host", "path", "r.rule", "r.verdict")
    own = features(F.col("url"), F.col("host"), F.col("path"))
    return told.select("*", suffix(F.col("host")).alias("suffix"), *[own[n].alias(n) for n in LEXICAL])


def fit(described: DataFrame, stats: DataFrame, rows: int = ROWS) -> Trees:
    """Boosted trees from the rows of `describe` that have a verdict."""
    sample = described.where(F.col("verdict").isNotNull()).orderBy(F.xxhash64("url"), "url", "key").limit(rows)
    train = written(_joined(sample, stats, own=True).select((F.col("verdict") == "block").cast("double").alias("label"), *LEXICAL, *SUFFIX))
    seen = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(seen) < 2:
        return Trees(None, "block" if 1.0 in seen else "allow")
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=0.2, seed=7)
    return Trees(learner.fit(_assembled(train)), "")


def judged(described: DataFrame, stats: DataFrame, trees: Trees) -> DataFrame:
    """`described` with `learnt`, the trees' verdict (`block` or `allow`) for every row."""
    if trees.model is None:
        return described.withColumn("learnt", F.lit(trees.verdict))
    out = trees.model.transform(_assembled(_joined(described, stats, own=False)))
    return out.select(*described.columns, F.when(F.col("prediction") == 1.0, "block").otherwise("allow").alias("learnt"))


def filter_urls(urls: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", rows: int = ROWS) -> DataFrame:
    """`key`, `host`, `path`, `rule` (NULL where none fits) and `verdict` of every row.

    URLs that a rule decides are the labelled ones; the trees fitted on them decide the others.
    """
    described = describe(urls, rules, key, url)
    stats = written(suffix_statistics(described))
    out = judged(described, stats, fit(described, stats, rows))
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", "learnt").alias("verdict"))
