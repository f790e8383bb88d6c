"""Ordered per-entity features.

`order` must be total within a key. Bounded look-back goes through `plans.skew.lookback`, so an
entity with very many rows is cut into chunks that overlap by exactly the rows a window needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.stats import array_mean
from tallyframe.plans.session import GROUP_ROWS
from tallyframe.plans.skew import largest_group, lookback, position, with_group


def recent_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, rank: str = "recency", newest: bool = True) -> DataFrame:
    """The k newest (or oldest) rows per key, rank 1 = newest (oldest).

    Spark cuts every task's rows to k per key before the shuffle when k is within
    `spark.sql.optimizer.windowGroupLimitThreshold`; for larger k the same cut is made here on
    salted sub-groups, so that a hot key never reaches one task as a whole.
    """
    desc = [F.col(o).desc() if newest else F.col(o).asc() for o in order]
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        salt = F.pmod(F.xxhash64(*order), F.lit(64))
        part = Window.partitionBy(*keys, "_salt").orderBy(*desc)
        df = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k).drop("_salt", "_r")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*desc))).where(F.col(rank) <= k)


def lag_ratio(df: DataFrame, keys: Sequence[str], order: Sequence[str], num: str, base: str, name: str = "change", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(num - previous base) / previous base; 0 where the previous base is missing or 0."""
    def build(f: DataFrame, by: list[str]) -> DataFrame:
        prev = F.lag(base).over(Window.partitionBy(*by).orderBy(*order))
        return f.withColumn("_prev", prev)

    out = lookback(df, keys, order, 1, build, group_rows)
    val = F.when(F.col("_prev").isNull() | (F.col("_prev") == 0), 0.0).otherwise((F.coalesce(num, F.lit(0.0)) - F.col("_prev")) / F.col("_prev"))
    return out.withColumn(name, val).drop("_prev")


def rolling_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], windows: Sequence[int], stats: Sequence[str] = ("mean", "std", "min", "max"), group_rows: int = GROUP_ROWS) -> DataFrame:
    """`{col}_roll{w}_{stat}` over the last w rows, short at the start; std of one row is 0."""
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}

    def build(f: DataFrame, by: list[str]) -> DataFrame:
        base = Window.partitionBy(*by).orderBy(*order)
        new = {}
        for w in windows:
            win = base.rowsBetween(-(w - 1), 0)
            for c in cols:
                for s in stats:
                    e = fns[s](c).over(win)
                    new[f"{c}_roll{w}_{s}"] = F.coalesce(e, F.lit(0.0)) if s == "std" else e
        return f.select("*", *[e.alias(n) for n, e in new.items()])

    return lookback(df, keys, order, max(windows) - 1, build, group_rows)


def rolling_slope(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, w: int, name: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Least-squares slope of the last w values on 0..n-1; NULLs are skipped, fewer than two values give 0."""
    def build(f: DataFrame, by: list[str]) -> DataFrame:
        vals = F.collect_list(F.col(col).cast("double")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(w - 1), 0))
        return f.withColumn("_v", vals)

    out = lookback(df, keys, order, w - 1, build, group_rows)
    n = F.size("_v").cast("double")
    mid = (n - 1) / 2
    cross = F.aggregate(F.transform("_v", lambda y, i: (i - mid) * y), F.lit(0.0), lambda s, x: s + x)
    slope = F.when(n >= 2, cross / (n * (n * n - 1) / 12)).otherwise(0.0)
    return out.withColumn(name or f"{col}_slope{w}", slope).drop("_v")


def derivatives(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """First and second difference, 0 where undefined."""
    def build(f: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        p1, p2 = F.lag(col, 1).over(w), F.lag(col, 2).over(w)
        x = F.col(col)
        return f.select(
            "*",
            F.coalesce(x - p1, F.lit(0.0)).alias(f"{col}_velocity"),
            F.coalesce(x - 2 * p1 + p2, F.lit(0.0)).alias(f"{col}_acceleration"),
        )

    return lookback(df, keys, order, 2, build, group_rows)


def step_velocity(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, steps: Sequence[int], group_rows: int = GROUP_ROWS) -> DataFrame:
    """(x_t - x_{t-w}) / w, 0 for the first w rows."""
    def build(f: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return f.select("*", *[F.coalesce((F.col(col) - F.lag(col, s).over(w)) / s, F.lit(0.0)).alias(f"{col}_vel{s}") for s in steps])

    return lookback(df, keys, order, max(steps), build, group_rows)


#: A weight below exp(-UNDERFLOW) is 0 as a double; powers up to exp(SPAN) are safe to multiply a double by.
UNDERFLOW, SPAN, SEGMENT = 745.2, 345.0, 100_000


def _carried(df: DataFrame, keys: Sequence[str], pos: str, x: str, log_a: float, largest: int, name: str, group_rows: int) -> DataFrame:
    """Add `name`, the sum of a^(p - i) x_i over all rows i up to a row's own position p, per key.

    A segment of positions acts on the sum as an affine map: slope a^length, offset its own weighted sum. Offsets of
    rows are running sums inside segments short enough that powers of a neither overflow nor vanish; the
    segments' maps are composed by the same function, one level up, and every row adds what its segment is handed.
    No weight that a double can hold is left out (values beyond 1e150 would overflow), and no segment is longer than SEGMENT or `group_rows`.
    """
    reach = math.ceil(UNDERFLOW / -log_a)
    if reach <= 8:  # so few rows back count at all

        def build(f: DataFrame, by: list[str]) -> DataFrame:
            w = Window.partitionBy(*by).orderBy(pos)
            return f.withColumn(name, sum((F.coalesce(F.lag(x, i).over(w), F.lit(0.0)) * math.exp(i * log_a) for i in range(1, reach + 1)), F.col(x)))

        return lookback(df, keys, [pos], reach, build, group_rows)
    length = max(2, min(int(SPAN / -log_a), SEGMENT, group_rows))
    inside = F.pmod(F.col(pos), F.lit(length))
    rows = df.withColumn("_seg", F.floor(F.col(pos) / length))
    w = Window.partitionBy(*keys, "_seg").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.exp(inside * log_a) * F.sum(F.col(x) * F.exp(inside * -log_a)).over(w))
    if largest <= length:
        return rows.drop("_seg")
    ends = rows.where(inside == length - 1).select(*keys, F.col("_seg").alias("_at"), F.col(name).alias("_offset"))
    handed = _carried(ends, keys, "_at", "_offset", log_a * length, -(-largest // length), "_carry", group_rows)
    handed = handed.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_at") + 1).alias("_next"), F.col("_carry").alias("_handed"))
    same = rows["_seg"] == handed["_next"]
    for k in keys:
        same = same & rows[k].eqNullSafe(handed[f"_k_{k}"])
    full = rows.join(handed, same, "left")
    return full.select(*df.columns, (F.col(name) + F.coalesce(F.exp((inside + 1) * log_a) * F.col("_handed"), F.lit(0.0))).alias(name))


def _decayed(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, decays: dict[str, float], adjust: bool, group_rows: int) -> DataFrame:
    """Exponential averages from weighted sums carried over segments; with `adjust` divided by the sum of the weights."""
    largest = largest_group(df, keys)
    x = F.coalesce(F.col(col).cast("double"), F.lit(0.0))
    out = position(df, keys, order, "_pos", group_rows).withColumn("_pos", F.col("_pos") - 1).withColumn("_x", x)
    for n, d in decays.items():
        if d >= 1:
            out = out.withColumn(n, F.col("_x"))
            continue
        log_a = math.log1p(-d)
        # without adjustment the first value starts the recursion, as if it had been there forever
        out = out.withColumn("_w", F.col("_x") if adjust else F.when(F.col("_pos") == 0, F.col("_x") / d).otherwise(F.col("_x")))
        out = _carried(out, keys, "_pos", "_w", log_a, largest, n, group_rows).drop("_w")
        weights = -F.call_function("expm1", (F.col("_pos") + 1) * log_a) if adjust else F.lit(1.0)
        out = out.withColumn(n, F.col(n) * d / weights)
    return out.drop("_pos", "_x")


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, decays: dict[str, float], group_rows: int = GROUP_ROWS) -> DataFrame:
    """e = d x + (1 - d) e_prev, started at the first value, per named decay; NULL counts as 0."""
    return _decayed(df, keys, order, col, {f"{col}_ema_{n}": d for n, d in decays.items()}, False, group_rows)


def ewm(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, halflife: float, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Weighted mean with weights 0.5^(age / halflife), normalised over the rows seen so far."""
    d = 1 - math.exp(-math.log(2) / halflife)
    return _decayed(df, keys, order, col, {f"{col}_recency": d}, True, group_rows)


def period_attention(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, periods: Sequence[int] = (7, 30, 90), group_rows: int = GROUP_ROWS) -> DataFrame:
    """Softmax over the mean absolute value of the last 7 / 30 / 90 rows."""
    def build(f: DataFrame, by: list[str]) -> DataFrame:
        base = Window.partitionBy(*by).orderBy(*order)
        return f.select("*", *[F.avg(F.abs(F.coalesce(F.col(col), F.lit(0.0)))).over(base.rowsBetween(-(p - 1), 0)).alias(f"_a{p}") for p in periods])

    out = lookback(df, keys, order, max(periods) - 1, build, group_rows)
    top = F.greatest(*[F.col(f"_a{p}") for p in periods])
    e = [F.exp(F.col(f"_a{p}") - top) for p in periods]
    total = sum(e[1:], e[0])
    return out.select(*df.columns, *[(x / total).alias(f"{col}_att{p}") for x, p in zip(e, periods)])


def time_constants(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, lags: Sequence[int], group_rows: int = GROUP_ROWS) -> DataFrame:
    """clip(1 / (1 - |autocorrelation| + 1e-6), 0, 100) in a trailing window of max(2 lag, 10) rows.

    The series is centred on the column's mean over the whole table.
    """
    mean = df.agg(F.avg(F.coalesce(F.col(col), F.lit(0.0)))).first()[0] or 0.0
    sizes = {lag: max(2 * lag, 10) for lag in lags}

    def build(f: DataFrame, by: list[str]) -> DataFrame:
        base = Window.partitionBy(*by).orderBy(*order)
        x = F.coalesce(F.col(col).cast("double"), F.lit(0.0)) - mean
        return f.select("*", *[F.collect_list(x).over(base.rowsBetween(-(s - 1), 0)).alias(f"_s{lag}") for lag, s in sizes.items()])

    out = lookback(df, keys, order, max(sizes.values()) - 1, build, group_rows)

    def constant(lag: int) -> Column:
        seg = F.col(f"_s{lag}")
        n = F.size(seg)
        c1, c0 = F.slice(seg, lag + 1, F.greatest(n - lag, F.lit(0))), F.slice(seg, 1, F.greatest(n - lag, F.lit(0)))
        cov = array_mean(F.zip_with(c1, c0, lambda a, b: a * b))
        var = array_mean(F.transform(seg, lambda v: v * v))
        ac = F.when((n > lag) & (var > 1e-10), cov / var).otherwise(0.0)
        raw = 1.0 - F.abs(ac) + 1e-6
        return F.when(raw == 0, 100.0).otherwise(F.least(F.greatest(1.0 / raw, F.lit(0.0)), F.lit(100.0))).alias(f"{col}_tc{lag}")

    return out.select(*df.columns, *[constant(lag) for lag in lags])


def day_offset(df: DataFrame, keys: Sequence[str], date: str, name: str = "day_offset") -> DataFrame:
    """Days between a row and its entity's newest row."""
    out = with_group(df, keys, F.max(date).alias("_last"))
    return out.withColumn(name, F.datediff("_last", date)).drop("_last")


def consecutive_run(df: DataFrame, keys: Sequence[str], order: str, flag: str, n: int) -> DataFrame:
    """Length of the newest unbroken run of true flags and whether it reaches n. Two combined aggregates."""
    broken = with_group(df, keys, F.max(F.when(~F.col(flag), F.col(order))).alias("_broken"))
    run = F.sum((F.col("_broken").isNull() | (F.col(order) > F.col("_broken"))).cast("long"))
    return broken.groupBy(*keys).agg(run.alias("run_length"), (run >= n).cast("int").alias("triggered"))


def trend_alert(df: DataFrame, keys: Sequence[str], period: str, reject_rate: str, pass_rate: str, window: int = 7, min_rise: float = 0.02, warn: float = 0.95) -> DataFrame:
    """Alert where the reject rate rose in every step of the last periods by at least `min_rise` in total, else where the newest pass rate is low."""
    last = recent_k(df, keys, [period], window, "_r")
    per = last.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(period), F.col(reject_rate).alias("r")))).alias("s"),
        F.max(F.when(F.col("_r") == 1, F.col(pass_rate))).alias("latest_pass"),
    )
    r = F.transform("s", lambda x: x["r"])
    n = F.size(r)
    steps = F.zip_with(F.slice(r, 2, F.greatest(n - 1, F.lit(0))), F.slice(r, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b > a)
    rise = F.get(r, n - 1) - F.get(r, F.lit(0))
    rising = (n >= 3) & F.forall(steps, lambda x: x) & (rise >= min_rise)
    low = (n >= 2) & (F.col("latest_pass") < warn)
    return per.select(*keys, n.alias("periods"), rise.alias("rise"), F.when(rising, "rising").when(low, "low_pass_rate").otherwise("none").alias("alert"))


def sliding_windows(df: DataFrame, ts: str, window: int, stride: int) -> DataFrame:
    """Tag every row with each date window [start, start + window) it lies in.

    Windows start at the table's first day and advance by `stride` days while they fit; a table
    shorter than one window gets a single window that ends on its last day. The windows of a row
    follow from its date, so nothing is joined.
    """
    first, last = df.agg(F.min(F.col(ts).cast("date")), F.max(F.col(ts).cast("date"))).first()
    span = (last - first).days
    day = F.datediff(F.col(ts).cast("date"), F.lit(first))
    if span < window:
        out = df.withColumn("win_id", F.lit(0)).withColumn("win_start", F.date_sub(F.lit(last), window))
        return out.where(F.col(ts).cast("date") < F.lit(last))
    count = (span - window) // stride + 1
    lo = F.greatest(F.floor((day - window) / stride) + 1, F.lit(0))
    hi = F.least(F.floor(day / stride), F.lit(count - 1))
    ids = F.when(lo <= hi, F.sequence(lo, hi))
    out = df.withColumn("win_id", F.explode(F.transform(ids, lambda i: i.cast("int"))))
    return out.withColumn("win_start", F.date_add(F.lit(first), F.col("win_id") * stride))
