"""Joins by key, interval, prefix and fallback level."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.stats import md5_int
from tallyframe.plans.session import GROUP_ROWS
from tallyframe.plans.skew import position, running, with_group


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return df, or fail where a key has more than one row."""
    bad = duplicate_keys(df, keys).head(1)
    if bad:
        raise ValueError(f"key {keys} is not unique, e.g. {bad[0].asDict()}")
    return df


def glue(blocks: Sequence[DataFrame], key: str, check: bool = True) -> DataFrame:
    """Column-wise union of feature blocks by key. All blocks must have unique keys.

    The blocks share one hash partitioning of the key, so after the first join nothing moves again
    except the block being added.
    """
    if check:
        for b in blocks:
            assert_unique(b, [key])
    return reduce(lambda a, b: a.join(b, key, "left"), blocks)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest `order` per key, as a map-side combined maximum (no window)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    top = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("r"))
    return top.select(*[F.col(k) if c in keys else F.col(f"r.{c}") for c in df.columns for k in [c]])


#: Days beyond any date, and the level whose pieces span them.
FAR_DAY, TOP = 1 << 23, 24


def interval_join(events: DataFrame, windows: DataFrame, ts: str, lo: str, hi: str, keys: Sequence[str] = ()) -> DataFrame:
    """Events whose date lies in [lo, hi] of a window; a NULL bound is open, a window that ends before it starts is empty.

    Days form dyadic pieces: piece n of level l is the days whose number shifted right by l is n. A window of up to
    2^l days touches one or two pieces of level l, and stands in these alone; an event stands in its piece of every level
    that some window has (a level per size class of the windows, TOP + 1 at most). So the join is an equi-join on
    (keys, level, piece), at least a quarter of whose rows on average pass the exact bounds, and no row is copied more
    often the longer a window is. Hot pieces are left to the skew splitting of adaptive execution.
    """
    day = F.unix_date(F.col(ts).cast("date"))
    start = F.coalesce(F.unix_date(F.col(lo).cast("date")), F.lit(-FAR_DAY))
    end = F.coalesce(F.unix_date(F.col(hi).cast("date")), F.lit(FAR_DAY))
    w = windows.withColumn("_lo", start).withColumn("_hi", end).where("_lo <= _hi")
    w = w.withColumn("_l", F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.length(F.bin(F.col("_hi") - F.col("_lo")))))
    levels = sorted(r["_l"] for r in w.select("_l").distinct().collect())
    piece = lambda d: F.call_function("shiftright", d, F.col("_l"))
    w = w.withColumn("_n", F.explode(F.array_distinct(F.array(piece(F.col("_lo")), piece(F.col("_hi"))))))
    e = events.withColumn("_day", day).withColumn("_l", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_n", piece(F.col("_day")))
    return e.join(w, [*keys, "_l", "_n"]).where("_day BETWEEN _lo AND _hi").drop("_l", "_n", "_day", "_lo", "_hi")


def dense_panel(entities: DataFrame, facts: DataFrame, key: str, slot: str, slots: Column, fill: dict[str, float]) -> DataFrame:
    """Every entity in every generated slot with its facts, zero where there are none.

    `slots` is an array expression per entity; it is unfolded in place instead of a cross join.
    """
    panel = entities.select(key, F.explode(slots).alias(slot))
    return panel.join(facts, [key, slot], "left").fillna(fill)


def new_elements(a: Column, b: Column) -> Column:
    """1 where list b has an element list a lacks; a NULL list counts as empty."""
    empty = F.array().cast("array<string>")
    left = F.coalesce(F.transform(a, lambda x: x.cast("string")), empty)
    right = F.coalesce(F.transform(b, lambda x: x.cast("string")), empty)
    return (F.size(F.array_except(right, left)) > 0).cast("int")


def snapshot_at(facts: DataFrame, t: str | Column, lo: str = "valid_from", hi: str = "valid_to") -> DataFrame:
    """Facts valid at one moment: valid_from <= t < valid_to, an open end never expires."""
    at = F.lit(t).cast("timestamp") if isinstance(t, str) else t
    return facts.where((F.col(lo) <= at) & (F.col(hi).isNull() | (F.col(hi) > at)))


def asof_join(left: DataFrame, facts: DataFrame, keys: Sequence[str], ts: str, lo: str, values: Sequence[str], hi: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """For every left row the newest fact of its key with lo <= ts (and ts < hi where given).

    Both sides are merged into one ordered stream per key and the newest fact so far is a running
    maximum: linear work, one shuffle, no pairs; hot keys are cut into chunks.
    """
    fact = F.struct(F.col(lo).alias("lo"), *([F.col(hi).alias("hi")] if hi else []), *[F.col(v) for v in values])
    a = left.select(*[F.col(k) for k in keys], F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    b = facts.where(F.col(lo).isNotNull()).select(*[F.col(k) for k in keys], F.col(lo).alias("_t"), F.lit(0).alias("_side"), fact.alias("_fact"))
    merged = running(a.unionByName(b, allowMissingColumns=True), keys, ["_t", "_side"], maxes={"_last": F.col("_fact")}, group_rows=group_rows)
    out = merged.where("_side = 1")
    ok = F.col("_last.hi").isNull() | (F.col("_last.hi") > F.col("_t")) if hi else F.lit(True)
    return out.select("_row.*", F.when(ok, F.col("_last.lo")).alias(lo), *[F.when(ok, F.col(f"_last.{v}")).alias(v) for v in values])


def timeline(facts: DataFrame, entity: tuple[str, object] | None = None, attribute: str | None = None, key: str = "entity_id") -> DataFrame:
    """Facts in order of validity within each entity, optionally of one entity (column, value) or attribute."""
    out = facts
    if entity:
        out = out.where(F.col(entity[0]) == entity[1])
    if attribute:
        out = out.where(F.col("attribute") == attribute)
    return out.orderBy(key, "attribute", "valid_from")


def expire(facts: DataFrame, ids: DataFrame, t: str, key: str = "fact_id") -> DataFrame:
    """Set valid_to of the listed open facts."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    end = F.when(F.col("_hit") & F.col("valid_to").isNull(), F.lit(t).cast("timestamp")).otherwise(F.col("valid_to"))
    return facts.join(hit, key, "left").withColumn("valid_to", end).drop("_hit")


def pool_index(df: DataFrame, segment: Sequence[str], order: Sequence[str]) -> DataFrame:
    """0-based position within the segment and the segment's size."""
    out = position(df, segment, order, "pool_idx").withColumn("pool_idx", F.col("pool_idx") - 1)
    return with_group(out, segment, F.count(F.lit(1)).alias("pool_size"))


def match_donors(targets: DataFrame, pool: DataFrame, target: str, donor: str, levels: Sequence[Sequence[str]], seed: int = 42) -> DataFrame:
    """One donor per target: the first level whose segment has any donor, picked by hash(id + seed).

    Every level is an equi-join on (segment, index); the index exists at most once per segment, so
    a target meets exactly one donor even where one segment holds most of the pool.
    """
    left, done = targets, []
    for i, cols in enumerate(levels, 1):
        cols = list(cols)
        p = pool.select(*cols, donor)
        indexed = position(p, cols, [donor], "pool_idx").withColumn("pool_idx", F.col("pool_idx") - 1)
        sizes = p.groupBy(*cols).agg(F.count(F.lit(1)).alias("_size"))
        t = left.join(sizes, cols) if cols else left.withColumn("_size", sizes.scalar())
        draw = md5_int(F.concat(F.col(target).cast("string"), F.lit(f":{seed}")))
        t = t.where(F.col("_size") > 0).withColumn("pool_idx", F.pmod(draw, F.col("_size")))
        hit = t.join(indexed, [*cols, "pool_idx"])
        done.append(hit.select(target, donor, F.lit(i).alias("match_level")))
        if not cols:
            break  # everybody left has been matched against the whole pool
        left = left.join(sizes.select(*cols), cols, "left_anti")
    return reduce(DataFrame.unionByName, done)


def band_lookup(col: str | Column, bands: Sequence[tuple[float, float, str]]) -> Column:
    """Label of the half-open band [lo, hi); above all bands the last label, below the first."""
    c = F.col(col) if isinstance(col, str) else col
    out = None
    for lo, hi, label in bands:
        cond = (c >= lo) & (c < hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.when(c >= bands[-1][1], bands[-1][2]).when(c.isNotNull(), bands[0][2])


def trace_lineage(features: DataFrame, prefixes: Sequence[tuple[str, str, str, str]], col: str = "feature") -> DataFrame:
    """First prefix (in map order) a feature name starts with: source table, column and group.

    The map is configuration of a few dozen rows and becomes one CASE, so no join is needed.
    """
    hit = None
    for prefix, tbl, src, group in prefixes:
        val = F.struct(F.lit(prefix).alias("matched_prefix"), F.lit(tbl).alias("source_table"), F.lit(src).alias("source_column"), F.lit(group).alias("data_group"))
        cond = F.col(col).startswith(prefix)
        hit = F.when(cond, val) if hit is None else hit.when(cond, val)
    out = features.withColumn("_hit", hit)
    status = F.when(F.col("_hit").isNull(), "unmapped").otherwise("mapped")
    return out.select(*features.columns, "_hit.*", status.alias("status"))


def trace_prefixes(features: DataFrame, prefixes: DataFrame, values: Sequence[str], col: str = "feature", prefix: str = "prefix", order: str | None = "ord") -> DataFrame:
    """`trace_lineage` for a map of any size, held as a table: `matched_prefix`, the map's `values`, `status`.

    Each distinct name is cut once per length that occurs among the prefixes (the lengths come to the driver, one
    number each) and the cuts meet the map in one equi-join; of several hits the lowest `order` wins, or the longest
    prefix where `order` is None, and equal ones by their values. NULL names and prefixes match nothing; an empty prefix
    matches every name.
    """
    m = prefixes.where(F.col(prefix).isNotNull()).withColumn("_len", F.length(prefix))
    lengths = sorted(r[0] for r in m.select("_len").distinct().collect())
    rank = F.col(order) if order else -F.col("_len")
    m = m.select(F.col(prefix).alias("_cut"), F.struct(rank.alias("rank"), F.col(prefix).alias("matched_prefix"), *values).alias("_hit"))
    m = m.groupBy("_cut").agg(F.min("_hit").alias("_hit"))
    size = F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))
    names = features.select(F.col(col).alias("_name")).where("_name IS NOT NULL").distinct().withColumn("_len", size).where(F.length("_name") >= F.col("_len"))
    best = names.select("_name", F.expr("left(_name, _len)").alias("_cut")).join(m, "_cut").groupBy("_name").agg(F.min("_hit").alias("_hit"))
    out = features.join(best, F.col(col) == F.col("_name"), "left")
    status = F.when(F.col("_hit").isNull(), "unmapped").otherwise("mapped")
    return out.select(*[features[c] for c in features.columns], *[F.col(f"_hit.{c}").alias(c) for c in ["matched_prefix", *values]], status.alias("status"))


def lineage_coverage(traced: DataFrame) -> DataFrame:
    mapped = F.sum((F.col("status") == "mapped").cast("long"))
    return traced.agg(F.count(F.lit(1)).alias("total"), mapped.alias("mapped"), F.round(mapped / F.count(F.lit(1)), 4).alias("coverage"))


def lookup(features: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """Feature rows of the listed users."""
    return features.join(users.select(key), key, "left_semi")


def cascade_lookup(df: DataFrame, tables: Sequence[tuple[str, Sequence[str], DataFrame]], value: str, fallback: str) -> DataFrame:
    """Value from the first table that knows the row's keys; `level` tells which one it was."""
    out, hits = df, []
    for i, (level, keys, tbl) in enumerate(tables):
        t = tbl.select(*keys, F.col(value).alias(f"_v{i}"))
        out = out.join(t, list(keys), "left")
        hits.append((level, F.col(f"_v{i}")))
    val = F.coalesce(*[h for _, h in hits], F.lit(fallback))
    level = reduce(lambda acc, lh: acc.when(lh[1].isNotNull(), lh[0]), hits[1:], F.when(hits[0][1].isNotNull(), hits[0][0])).otherwise("fallback")
    return out.select(*df.columns, val.alias(value), level.alias("level"))


def last_n(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], n: int, name: str) -> DataFrame:
    """The newest n rows of each key as a list, newest first; cut to n before anything is collected."""
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    cut = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    packed = F.sort_array(F.collect_list(F.struct("_rn", *cols)))
    return cut.groupBy(key).agg(F.transform(packed, lambda r: F.struct(*[r[c].alias(c) for c in cols])).alias(name))


def assemble_context(customers: DataFrame, products: DataFrame, consultations: DataFrame, segments: DataFrame, customer: str, product: str, order: Sequence[str], cols: Sequence[str], n: int = 3) -> DataFrame:
    """One row per customer: product facts, segment and the last n consultations (empty list if none)."""
    recent = last_n(consultations, customer, order, cols, n, "consultations")
    out = customers.join(products, product, "left").join(segments, customer, "left").join(recent, customer, "left")
    return out.withColumn("n_consultations", F.coalesce(F.size("consultations"), F.lit(0)))
