"""Exact linear-interpolation quantiles of whole columns without gathering a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.session import GROUP_ROWS, written
from tallyframe.plans.skew import running


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], group_rows: int = GROUP_ROWS) -> dict[str, list[float | None]]:
    """`{column: [quantile per probability]}`, NULLs ignored, same rule as `percentile`.

    One method at every size, for all columns at once: the values are counted (one row per column and
    distinct value, combined map-side), counts are summed up in value order, and the rows that hold
    the wanted order statistics are returned. NaN counts as the largest value, after Infinity; an
    interpolation between -Infinity and Infinity is NaN. The driver sees two values per probability.
    """
    cols = list(cols)
    if not cols:
        return {}
    cell = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    cells = df.select(F.explode(cell).alias("x")).select("x.*").where("v IS NOT NULL")
    counts = written(cells.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    totals = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return {c: [None] * len(probs) for c in cols}
    spots = {i: [p * (n - 1) for p in probs] for i, n in totals.items()}
    ranks = {i: sorted({r for s in x for r in (math.floor(s), math.ceil(s))}) for i, x in spots.items()}
    wanted = F.element_at(F.create_map(*[F.lit(x) for i, r in ranks.items() for x in (i, r)]), F.col("c"))
    summed = running(counts, ["c"], ["v"], {"upto": F.col("n")}, group_rows=group_rows)
    hits = F.filter(wanted, lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    found = {(r["c"], r["r"]): r["v"] for r in summed.select("c", "v", F.explode(hits).alias("r")).collect()}

    def at(i: int, spot: float) -> float:
        lo, hi = found[i, math.floor(spot)], found[i, math.ceil(spot)]
        share = spot - math.floor(spot)
        return lo if share == 0 or lo == hi else (1 - share) * lo + share * hi

    return {c: [at(i, s) for s in spots[i]] if i in spots else [None] * len(probs) for i, c in enumerate(cols)}
