"""Building history lists from events and turning lists into features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.lists import drop_last, drop_last_if_longer, pad_to, tail
from tallyframe.functions.stats import array_moments
from tallyframe.operators.aggs import top_values
from tallyframe.operators.windows import recent_k
from tallyframe.plans.session import GROUP_ROWS
from tallyframe.plans.skew import largest_group, position

def collect_sequences(df: DataFrame, key: str, order: Sequence[str], cols: dict[str, str | Column], segment_rows: int | None = None, newest: int | None = None, oldest: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One ordered list per column and entity: (key, segment, lists...), oldest first.

    An entity is one row, whatever its length. An operator that uses a fixed number of events passes
    `newest` or `oldest`: the others are cut by rank before anything is collected, so a list has at
    most that many entries. Only a caller that asks for `segment_rows` gets segments: rows of at most
    that many events, segment 0 the newest; no event is dropped.
    """
    moved = {n: c for n, c in cols.items() if not isinstance(c, str) or c not in order}  # the order's own columns travel once
    field = {n: f"_s_{n}" if n in moved else c for n, c in cols.items()}
    work = df.select(key, *order, *[(F.col(c) if isinstance(c, str) else c).alias(f"_s_{n}") for n, c in moved.items()])
    if newest is not None:
        work = recent_k(work, [key], order, newest, "_rank").drop("_rank")
    if oldest is not None:
        work = recent_k(work, [key], order, oldest, "_rank", newest=False).drop("_rank")
    biggest = largest_group(df, [key]) if segment_rows is not None else 0
    if segment_rows is None or biggest <= segment_rows:
        work = work.withColumn("segment", F.lit(0).cast("long"))
    elif biggest <= group_rows:
        # newest first in one window; its shuffle by the key also serves the lists
        rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
        work = work.withColumn("segment", F.floor((rank - 1) / segment_rows).cast("long"))
    else:
        ordered = position(work, [key], order, "_pos", group_rows)
        sizes = df.groupBy(F.col(key).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
        ordered = ordered.join(sizes, ordered[key].eqNullSafe(sizes["_g"])).drop("_g")
        work = ordered.withColumn("segment", F.floor((F.col("_n") - F.col("_pos")) / segment_rows).cast("long"))
    packed = F.sort_array(F.collect_list(F.struct(*order, *[f"_s_{n}" for n in moved]))).alias("_l")
    out = work.groupBy(key, "segment").agg(packed)
    return out.select(key, "segment", *[F.col(f"_l.{field[n]}").alias(n) for n in cols])


def lag_features(df: DataFrame, seqs: dict[str, float], k: int = 200, truncate_last: int = 0, prefix: str = "lag", as_columns: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Newest-first fixed-length lists per column, padded with the column's value.

    A NULL list gives NULL. `as_columns` unfolds to k columns per list at the very end.
    """
    arrays = {f"{prefix}_{c}": pad_to(F.reverse(drop_last(c, truncate_last)).cast("array<double>"), k, F.lit(float(p))) for c, p in seqs.items()}
    out = df.select(*keep, *[a.alias(n) for n, a in arrays.items()])
    if not as_columns:
        return out
    return out.select(*keep, *[F.get(n, F.lit(i)).alias(f"{n}_{i + 1:03d}") for n in arrays for i in range(k)])


@dataclass(frozen=True)
class Densify:
    """One list to unfold into `length` right-aligned columns `{prefix}_{001..}`."""

    column: str
    prefix: str
    length: int
    fill: float = 0.0
    dtype: str = "double"


def densify(df: DataFrame, specs: Sequence[Densify], keep: Sequence[str] = ()) -> DataFrame:
    """Right-aligned fixed columns: the newest element is last, missing ones on the left are `fill`."""
    cols = []
    for s in specs:
        c = F.col(s.column)
        fill = F.lit(s.fill).cast(s.dtype)
        cols += [F.coalesce(F.get(c, F.size(c) - s.length + i).cast(s.dtype), fill).alias(f"{s.prefix}_{i + 1:03d}") for i in range(s.length)]
    return df.select(*keep, *cols)


def densify_time(df: DataFrame, spec: Densify) -> DataFrame:
    """Per position of a densified epoch-second list: delta, hour, day of week (0 = Sunday), weekend, count."""
    def at(i: int) -> Column:
        return F.col(f"{spec.prefix}_{i:03d}")

    new = {}
    for i in range(1, spec.length + 1):
        c, tag = at(i), f"{i:03d}"
        seen = c != spec.fill
        ts = F.timestamp_seconds(c.cast("long"))
        dow = F.dayofweek(ts) - 1
        prev = at(i - 1) if i > 1 else None
        new[f"{spec.prefix}_tdelta_{tag}"] = F.when(seen & (prev != spec.fill), c - prev).otherwise(F.lit(0).cast(spec.dtype)) if i > 1 else F.lit(0).cast(spec.dtype)
        new[f"{spec.prefix}_hour_{tag}"] = F.when(seen, F.hour(ts)).otherwise(0)
        new[f"{spec.prefix}_dow_{tag}"] = F.when(seen, dow).otherwise(0)
        new[f"{spec.prefix}_weekend_{tag}"] = F.when(seen & dow.isin(0, 6), 1).otherwise(0)
        new[f"{spec.prefix}_cumcount_{tag}"] = F.when(seen, i).otherwise(0)
    return df.select("*", *[e.alias(n) for n, e in new.items()])


def rolling_list_stats(df: DataFrame, amounts: str, days: str, windows: Sequence[int], metrics: Sequence[str] = ("sum", "mean", "std", "count", "days_active"), truncate_last: int = 0, prefix: str = "roll") -> DataFrame:
    """`{prefix}_w{w}d_{metric}` over the pairs no older than w days before the newest day in the list."""
    a, d = drop_last(amounts, truncate_last), drop_last(days, truncate_last)
    out = df.withColumn("_p", F.arrays_zip(a.alias("a"), d.alias("d"))).withColumn("_top", F.array_max(d))
    out = out.select("*", *[F.filter("_p", _window_test(w)).alias(f"_w{w}") for w in windows])
    out = out.select("*", *[array_moments(F.transform(f"_w{w}", lambda p: p["a"].cast("double"))).alias(f"_m{w}") for w in windows])
    cols = []
    for w in windows:
        m = F.col(f"_m{w}")
        exprs = {
            "sum": m["mean"] * m["n"],
            "mean": m["mean"],
            "std": F.when(m["n"] > 1, F.sqrt(m["m2"] / F.greatest(m["n"] - 1, F.lit(1.0)))).otherwise(0.0),
            "count": m["n"],
            "days_active": F.size(F.array_distinct(F.transform(f"_w{w}", lambda p: p["d"]))).cast("double"),
        }
        cols += [F.coalesce(exprs[x], F.lit(0.0)).alias(f"{prefix}_w{w}d_{x}") for x in metrics]
    return out.select(*df.columns, *cols)


def _window_test(w: int):
    return lambda p: (F.col("_top") - p["d"]) <= w


def multihot_fit(df: DataFrame, col: str, n: int, truncate_last: int = 0) -> list:
    """The n most frequent list elements, ties in value order."""
    return top_values(df.select(F.explode(drop_last(col, truncate_last)).alias("v")), "v", n)


def multihot_transform(df: DataFrame, col: str, vocab: Sequence, binary: bool = True, others: bool = True, prefix: str = "mh", truncate_last: int = 0) -> DataFrame:
    """`{prefix}_top01..` presence (or counts) per vocabulary entry and the count of other elements."""
    c = F.coalesce(drop_last(col, truncate_last), F.array().cast(df.schema[col].dataType))
    def slot(v):
        if binary:
            return F.array_contains(c, v).cast("double")
        return F.size(F.filter(c, lambda x: x == v)).cast("double")

    cols = [slot(v).alias(f"{prefix}_top{i + 1:02d}") for i, v in enumerate(vocab)]
    if others:
        known = F.array(*[F.lit(v) for v in vocab])
        cols.append(F.size(F.filter(c, lambda x: ~F.array_contains(known, x))).cast("double").alias(f"{prefix}_others"))
    return df.select("*", *cols)


def to_matrix(df: DataFrame, cols: Sequence[str], max_len: int, truncate_last: int = 0, name: str = "matrix") -> DataFrame:
    """(max_len x columns) per entity: the first max_len steps, zero padded."""
    return df.withColumn(name, _matrix([drop_last_if_longer(c, truncate_last) for c in cols], max_len))


def _matrix(lists: Sequence[Column], max_len: int) -> Column:
    zero = F.lit(0.0)
    vals = [pad_to(F.coalesce(c.cast("array<double>"), F.array().cast("array<double>")), max_len, zero).alias(f"v{i}") for i, c in enumerate(lists)]
    return F.transform(F.arrays_zip(*vals), lambda z: F.array(*[F.coalesce(z[f"v{i}"], zero) for i in range(len(vals))]))


def to_matrix_time_based(df: DataFrame, cols: Sequence[str], max_len: int, window_days: int, ts_list: str | None = None, truncate_last: int = 0, keep: str = "last", name: str = "matrix") -> DataFrame:
    """As `to_matrix`, restricted to steps at most window_days older than the entity's newest step.

    Without per-step dates the newest max_len steps are taken. `keep` chooses which max_len of the
    surviving steps stay.
    """
    cut = [drop_last_if_longer(c, truncate_last) for c in cols]
    if ts_list is None:
        return df.withColumn(name, _matrix([tail(c, max_len) for c in cut], max_len))
    ts = drop_last_if_longer(ts_list, truncate_last)
    out = df.withColumn("_ts", ts).withColumn("_from", F.date_sub(F.array_max(F.transform("_ts", lambda t: t.cast("date"))), window_days))
    def inside(c: Column) -> Column:
        kept = F.filter(F.arrays_zip(F.col("_ts").alias("t"), c.alias("v")), lambda p: p["t"].cast("date") >= F.col("_from"))
        vals = F.transform(kept, lambda p: p["v"])
        return tail(vals, max_len) if keep == "last" else F.slice(vals, 1, max_len)

    return out.withColumn(name, _matrix([inside(c) for c in cut], max_len)).drop("_ts", "_from")


@dataclass(frozen=True)
class EventColumns:
    user: str = "user_id"
    amount: str = "amount"
    date: str = "day"
    hour: str = "hour"
    channel: str = "channel"
    code: str = "mcc"
    error: str = "error"


def encode_events(txn: DataFrame, order: Sequence[str], channels: dict[str, float], seq_len: int = 180, width: int = 16, n_codes: int = 60, c: EventColumns = EventColumns()) -> DataFrame:
    """(user, seq_length, steps): per user the newest seq_len events, newest first, `width` numbers each.

    Ten are used: z-amount, hour/24, day of week/7 (0 = Sunday), month/12, weekend, channel/2,
    code rank/n_codes, error, log1p of the day gap and the z-amount step to the next newer event.
    """
    stats = txn.agg(F.avg(c.amount).alias("m"), F.stddev_samp(c.amount).alias("s")).first()
    mean, std = stats["m"] or 0.0, max(stats["s"] or 1.0, 1e-8)
    ranks = {v: i + 1 for i, v in enumerate(top_values(txn, c.code, n_codes))}
    rank_of = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    channel_of = F.create_map(*[F.lit(x) for kv in channels.items() for x in kv])
    recent = recent_k(txn.select(c.user, *{x: None for x in [*order, c.amount, c.date, c.hour, c.channel, c.code, c.error]}), [c.user], order, seq_len, "_r")
    z = (F.col(c.amount) - mean) / std
    newer = Window.partitionBy(c.user).orderBy("_r")
    dow = F.dayofweek(c.date) - 1
    gap = F.abs(F.datediff(F.col(c.date), F.lag(c.date).over(newer)))
    dims = [
        z,
        F.col(c.hour) / 24.0,
        dow / 7.0,
        F.month(c.date) / 12.0,
        dow.isin(0, 6).cast("double"),
        F.coalesce(F.try_element_at(channel_of, F.col(c.channel)), F.lit(1.0)) / 2.0,
        F.coalesce(F.try_element_at(rank_of, F.col(c.code)), F.lit(0)) / float(n_codes),
        F.col(c.error).cast("double"),
        F.log1p(F.coalesce(gap, F.lit(0)).cast("double")),
        F.coalesce(z - F.lag(z).over(newer), F.lit(0.0)),
    ]
    vec = F.array(*[F.coalesce(d.cast("double"), F.lit(0.0)) for d in dims], *[F.lit(0.0)] * (width - len(dims)))
    rows = recent.select(c.user, "_r", vec.alias("v"))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("_r", "v"))), lambda s: s["v"])
    out = rows.groupBy(c.user).agg(packed.alias("steps"))
    zero = F.array_repeat(F.lit(0.0), width)
    return out.select(c.user, F.size("steps").alias("seq_length"), pad_to(F.col("steps"), seq_len, zero).alias("steps"))


def even_offsets(df: DataFrame, list_col: str, days: int = 360, name: str = "day_offset") -> DataFrame:
    """Evenly spaced day offsets of the same length as the list: oldest = days, newest = 0."""
    n = F.size(list_col)
    off = F.transform(list_col, lambda _, i: F.round((n - 1 - i) * days / F.greatest(n - 1, F.lit(1))).cast("int"))
    return df.withColumn(name, off)


def _draw(key: str, i: Column, salt: int, n: int = 10_000) -> Column:
    return F.pmod(F.xxhash64(F.col(key), i, F.lit(salt)), F.lit(n))


def perturb_sequences(df: DataFrame, key: str, amounts: str, codes: str, offsets: str, target_len: str, amount_std: float = 0.1, gap_std: float = 0.1, swap_prob: float = 0.1, seed: int = 42) -> DataFrame:
    """Thin a donor history to about the wanted length and add reproducible noise.

    Every draw is a hash of (key, position, salt): the same input gives the same output on any
    cluster. Amounts get Gaussian noise by Box-Muller, a share of codes moves by 1..5, offsets jitter.
    """
    n = F.size(amounts)
    z = F.transform(F.arrays_zip(F.col(amounts).alias("a"), F.col(codes).alias("c"), F.col(offsets).alias("d")), lambda p, i: F.struct(i.alias("i"), p["a"].alias("a"), p["c"].alias("c"), p["d"].alias("d")))
    rate = F.least(F.col(target_len) * 10000.0 / F.greatest(n, F.lit(1)), F.lit(10000.0))
    kept = F.filter(z, lambda e: (F.col(target_len) >= n) | (_draw(key, e["i"], seed) < rate))

    def gauss(i: Column, salt: int) -> Column:
        u = F.greatest(_draw(key, i, salt) / 10000.0, F.lit(0.0001))
        v = _draw(key, i, salt + 1000) / 10000.0
        return F.sqrt(-2.0 * F.ln(u)) * F.cos(2 * F.pi() * v)

    def code(e: Column) -> Column:
        step = (_draw(key, e["i"], seed + 5, 5) + 1).cast("int")
        moved = F.when(_draw(key, e["i"], seed + 4, 2) == 0, e["c"] + step).otherwise(F.greatest(e["c"] - step, F.lit(1)))
        return F.when(_draw(key, e["i"], seed + 3, 100) < int(swap_prob * 100), moved).otherwise(e["c"])

    out = df.withColumn("_k", kept)
    return out.select(
        *[c for c in df.columns if c not in (amounts, codes, offsets)],
        F.transform("_k", lambda e: F.round(e["a"] * (1.0 + amount_std * gauss(e["i"], seed + 1)), 2)).alias(amounts),
        F.transform("_k", code).alias(codes),
        F.transform("_k", lambda e: F.greatest(F.lit(0), F.least(F.round(e["d"] * (1.0 + gap_std * gauss(e["i"], seed + 2))).cast("int"), F.lit(3650)))).alias(offsets),
    )


def holdings_sequences(snap: DataFrame, key: str, month: str, products: Sequence[str]) -> DataFrame:
    """Monthly product flags per entity as lists, with counts, acquisitions, churns and totals.

    One row per (entity, month) is expected, so a list is as long as the entity's months.
    """
    flags = F.struct(F.col(month), *[F.coalesce(F.col(p), F.lit(0)).cast("int").alias(p) for p in products])
    h = snap.groupBy(key).agg(F.sort_array(F.collect_list(flags)).alias("_h"))
    lists = h.select(key, *[F.col(f"_h.{p}").alias(f"seq_{p}") for p in products], F.size("_h").alias("months_observed"))
    cols = [F.col(f"seq_{p}") for p in products]
    months = F.sequence(F.lit(0), F.col("months_observed") - 1)

    def per_month(fn) -> Column:
        return F.transform(months, lambda m: sum((fn(c, m) for c in cols[1:]), fn(cols[0], m)))

    def change(sign: int) -> Column:
        def at(m):
            parts = [F.greatest(sign * (F.get(c, m) - F.get(c, m - 1)), F.lit(0)) for c in cols]
            return sum(parts[1:], parts[0])

        return F.when(F.col("months_observed") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("months_observed") - 1, F.lit(1))), at)).otherwise(F.array(F.lit(0)))

    out = lists.withColumns({"seq_num_products": per_month(lambda c, m: F.get(c, m)), "seq_acquisitions": change(1), "seq_churns": change(-1)})
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return out.withColumns(
        {
            "total_acquisitions": total("seq_acquisitions"),
            "total_churns": total("seq_churns"),
            "product_diversity": sum((F.array_max(c) for c in cols[1:]), F.array_max(cols[0])),
        }
    )
