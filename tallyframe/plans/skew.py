"""Ordered per-key work that survives hot keys.

A window partitioned by a key puts all rows of that key into one task. These functions first look
at the largest group. Below `GROUP_ROWS` they use the plain window. Above it (and for orders over
the whole table) they range-partition by (keys, order), so that a hot key spans many chunks, work
inside the chunks and pass a small table across chunk borders. Only keys that straddle a border
have a row in that table, so it has fewer rows than there are chunks and can be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.plans.session import GROUP_ROWS, written

CHUNK = "_chunk"


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Row counts of the biggest group and of the table, in one pass that combines map-side."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    biggest, total = counts.agg(F.max("n"), F.sum("n")).first()
    return biggest or 0, total or 0


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return group_sizes(df, keys)[0]


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, total: int) -> DataFrame:
    """Range-partition by (keys, order) into chunks of about `rows` rows, tagged `_chunk`."""
    n = max(2, -(-total // rows))
    ranged = df.repartitionByRange(n, *keys, *order)
    return written(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _borders(parts: DataFrame, keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(CHUNK) if keys else Window.partitionBy(F.lit(0)).orderBy(CHUNK)


def _on(keys: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    cond = left[CHUNK] == right["_c"]
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_k_{k}"])
    return cond


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add inclusive running sums and running maxima per key, in the given (total) order."""
    sums, maxes = sums or {}, maxes or {}
    exprs = {**sums, **maxes}

    def total_of(n: str) -> Column:
        return F.sum(n) if n in sums else F.max(n)

    work = df.select("*", *[c.alias(n) for n, c in exprs.items()])
    biggest, total = group_sizes(df, keys)
    if biggest <= group_rows:
        by = [F.col(k) for k in keys] or [F.lit(0)]
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return work.select(*df.columns, *[total_of(n).over(w).alias(n) for n in exprs])
    work = chunked(work, keys, order, group_rows, total)
    totals = work.groupBy(*keys, CHUNK).agg(*[total_of(n).alias(n) for n in exprs])
    before = _borders(totals, keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(CHUNK).alias("_c"),
        F.count(F.lit(1)).over(before).alias("_prev"),
        *[total_of(n).over(before).alias(f"_o_{n}") for n in exprs],
    ).where("_prev > 0")
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = work.select(*df.columns, CHUNK, *[total_of(n).over(w).alias(n) for n in exprs])

    def joined(n: str) -> Column:
        if n in sums:
            return F.coalesce(local[n], F.lit(0)) + F.coalesce(offsets[f"_o_{n}"], F.lit(0))
        return F.greatest(local[n], offsets[f"_o_{n}"])

    return local.join(F.broadcast(offsets), _on(keys, local, offsets), "left").select(
        *[local[c] for c in df.columns], *[joined(n).alias(n) for n in exprs]
    )


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", group_rows: int = GROUP_ROWS) -> DataFrame:
    """row_number per key (1-based) that also works for hot keys and for no key at all."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, group_rows=group_rows)


def lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    build: Callable[[DataFrame, list[str]], DataFrame],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Apply `build(frame, partition_columns)` whose rows look at most `rows` rows back.

    For hot keys every chunk also receives the `rows` rows that precede it (marked `_halo`), so a
    bounded window sees the same rows as it would over the whole key; halo rows are dropped at the
    end. `build` must keep the columns it is given.
    """
    biggest, total = group_sizes(df, keys)
    if biggest <= group_rows:
        return build(df, list(keys))
    work = chunked(df, keys, order, group_rows, total)
    parts = work.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    by_chunk = _borders(parts, keys)
    upto = by_chunk.rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(CHUNK).alias("_c"),
        F.row_number().over(by_chunk).alias("_i"),
        F.sum("_n").over(upto).alias("_end"),
        F.lead("_n").over(by_chunk).alias("_next_n"),
        F.col("_n"),
    )
    # A chunk feeds the next one; where the next one is shorter than the halo, also later ones.
    sources = parts.where(F.col("_next_n").isNotNull()).withColumn(
        "_step", F.explode(F.when(F.col("_next_n") >= rows, F.sequence(F.lit(1), F.lit(1))).otherwise(F.sequence(F.lit(1), F.lit(rows))))
    )
    a, b = sources.alias("a"), parts.alias("b")
    same = F.col("b._i") == F.col("a._i") + F.col("a._step")
    for k in keys:
        same = same & F.col(f"a._k_{k}").eqNullSafe(F.col(f"b._k_{k}"))
    feeds = a.join(b, same).select(
        *[F.col(f"a._k_{k}") for k in keys],
        F.col("a._c").alias("_c"),
        F.col("b._c").alias("_to"),
        (F.col("b._end") - F.col("b._n") - F.col("a._end")).alias("_between"),
    ).where(F.col("_between") < rows)
    back = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(o).desc() for o in order])
    tails = work.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= rows)
    halo = (
        tails.join(F.broadcast(feeds), _on(keys, tails, feeds))
        .where(F.col("_r") + F.col("_between") <= rows)
        .select(*[tails[c] for c in df.columns], F.col("_to").alias(CHUNK), F.lit(True).alias("_halo"))
    )
    both = work.select(*df.columns, CHUNK, F.lit(False).alias("_halo")).unionByName(halo)
    return build(both, [*keys, CHUNK]).where(~F.col("_halo")).drop(CHUNK, "_halo")


def with_group(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Add group aggregates to every row by a join with the aggregated table.

    Unlike an aggregate window this combines map-side and lets adaptive execution split hot keys.
    """
    small = df.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(*aggs)
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(small[f"_g_{k}"])
    return df.join(small, cond).drop(*[f"_g_{k}" for k in keys])


def value_positions(df: DataFrame, keys: Sequence[str], value: str, weights: dict[str, Column], group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per (keys, value) with summed `weights` and their inclusive running sums `cum_*`.

    The order statistics of a column (ranks, curves, quantiles) depend on it only through this
    table, so ties never travel as single rows.
    """
    counts = df.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    return running(counts, keys, [value], {f"cum_{n}": F.col(n) for n in weights}, group_rows=group_rows)
