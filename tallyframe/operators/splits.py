"""Train / validation / test assignment as a column, and leakage checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.lists import last_element
from tallyframe.functions.profile import per_column
from tallyframe.functions.stats import md5_unit
from tallyframe.plans.quantiles import exact_quantiles

TRAIN, VAL, TEST = "train", "val", "test"


def temporal_split(df: DataFrame, date: str, train: float = 0.7, val: float = 0.15, gap: int = 7, name: str = "_split") -> DataFrame:
    """Cut the calendar span; rows inside the gaps get NULL."""
    lo, hi = df.agg(F.min(F.col(date).cast("date")), F.max(F.col(date).cast("date"))).first()
    span = (hi - lo).days
    train_end = lo + timedelta(days=int(span * train))
    val_start = train_end + timedelta(days=gap)
    val_end = val_start + timedelta(days=int(span * val))
    test_start = val_end + timedelta(days=gap)
    d = F.col(date).cast("date")
    split = F.when(d <= train_end, TRAIN).when((d >= val_start) & (d <= val_end), VAL).when(d >= test_start, TEST)
    return df.withColumn(name, split)


def quantile_split(df: DataFrame, col: str, train: float = 0.7, val: float = 0.15, gap: int = 7, name: str = "_split") -> DataFrame:
    """Cut at quantiles of the column. For dates the gap days before each cut are dropped (NULL)."""
    kind = dict(df.dtypes)[col]
    temporal = kind.startswith(("date", "timestamp"))
    v = F.unix_micros(F.col(col).cast("timestamp")).cast("double") if temporal else F.col(col).cast("double")
    a, b = exact_quantiles(df.select(v.alias("v")), ["v"], [train, train + val])["v"]
    g = gap * 86_400_000_000 if temporal else 0
    split = F.when(v < a - g, TRAIN).when((v < b - g) & (v >= a), VAL).when(v >= b, TEST)
    return df.withColumn(name, split)


def hash_split(df: DataFrame, key: str, fracs: tuple[float, float] = (0.8, 0.1), seed: int = 42, name: str = "_split") -> DataFrame:
    """Stable assignment by a hash of the key: independent of row order and partitioning."""
    u = md5_unit(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.withColumn(name, F.when(u < fracs[0], TRAIN).when(u < fracs[0] + fracs[1], VAL).otherwise(TEST))


def task_val_mask(df: DataFrame, strategies: dict[str, str], key: str, date: str, frac: float = 0.1, seed: int = 42) -> DataFrame:
    """`val_{task}`: validation rows per task, by hash for "random" and by the newest dates for "latest"."""
    u = md5_unit(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    day = F.unix_date(F.col(date).cast("date")).cast("double")
    cut = exact_quantiles(df.select(day.alias("d")), ["d"], [1 - frac])["d"][0] if "latest" in strategies.values() else None
    return df.withColumns({f"val_{t}": (u < frac) if s == "random" else (day >= cut) for t, s in strategies.items()})


#: Groups that the tasks' moments are merged in before the last merge.
MERGE_SLOTS = 64
#: Joint rows, both means, both sums of squared deviations, that of products, and joint rows that are not finite.
MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy", "bad")


def _joint_moments(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Moments of every (label, feature) pair over the rows where both are given; x and y are (values, given, not finite).

    Columns are centred on their own mean first, so that the products lose no digits.
    """
    parts = []
    for values, given, bad in (x, y):
        ok = given & ~bad
        mean = np.where(ok, values, 0.0).sum(0) / np.maximum(ok.sum(0), 1)
        parts.append((np.where(ok, values - mean, 0.0), ok.astype(float), given.astype(float), (given & bad).astype(float), mean))
    (xc, xm, xg, xb, x0), (yc, ym, yg, yb, y0) = parts
    n = ym.T @ xm
    safe = np.maximum(n, 1.0)
    sx, sy = ym.T @ xc, yc.T @ xm
    cxx, cyy = ym.T @ (xc * xc) - sx * sx / safe, (yc * yc).T @ xm - sy * sy / safe
    return [n, x0 + sx / safe, y0[:, None] + sy / safe, cxx, cyy, yc.T @ xc - sx * sy / safe, yg.T @ xb + yb.T @ (xg - xb)]


def _merge_moments(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> list[np.ndarray]:
    n = a[0] + b[0]
    safe = np.maximum(n, 1.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    w = a[0] * b[0] / safe
    share = b[0] / safe
    return [n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w, a[6] + b[6]]


def leakage_corr(df: DataFrame, feats: Sequence[str], labels: Sequence[str], threshold: float = 0.95, min_rows: int = 10) -> DataFrame:
    """(feature, label, corr, n, leak) for every pair over the rows where both are given, all pairs in one scan.

    A task multiplies blocks of value and mask matrices and keeps the moments of all pairs (seven numbers each); they are
    merged in MERGE_SLOTS groups and once more. The correlation is NULL where it is not defined: no joint rows, no
    spread, or a value that is not finite. A feature name that is also a label name is left to `column_overlap`.
    """
    feats, labels = list(feats), list(labels)
    cols = list(dict.fromkeys([*feats, *labels]))
    xi, yi = [cols.index(c) for c in feats], [cols.index(c) for c in labels]
    state = "label int, slot int, " + ", ".join(f"{m} array<double>" for m in MOMENTS)
    arrow = pa.schema([("label", pa.int32()), ("slot", pa.int32()), *[(m, pa.list_(pa.float64())) for m in MOMENTS]])

    def rows(total: Sequence[np.ndarray], slot: int) -> dict[str, list]:
        at = {"label": list(range(len(labels))), "slot": [slot] * len(labels)}
        return at | {m: [v.tolist() for v in total[i]] for i, m in enumerate(MOMENTS)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if not b.num_rows:
                continue
            given = np.column_stack([np.asarray(c.is_valid()) for c in b.columns])
            values = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in b.columns])
            bad = ~np.isfinite(values)
            part = _joint_moments(*[(values[:, i], given[:, i], bad[:, i]) for i in (xi, yi)])
            total = part if total is None else _merge_moments(total, part)
        if total is not None:
            yield pa.RecordBatch.from_pydict(rows(total, TaskContext.get().partitionId() % MERGE_SLOTS), schema=arrow)

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for b in table.to_batches(max_chunksize=64):
            for r in zip(*[b.column(m).to_pylist() for m in MOMENTS]):
                part = [np.asarray(v) for v in r]
                total = part if total is None else _merge_moments(total, part)
        keep = {"label": [table["label"][0].as_py()], "slot": [table["slot"][0].as_py()]}
        return pa.Table.from_pydict(keep | {m: [v.tolist()] for m, v in zip(MOMENTS, total)}, schema=arrow)

    part = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(measure, state)
    one = part.groupBy("label", "slot").applyInArrow(merge, state).groupBy("label").applyInArrow(merge, state)
    pairs = one.select("label", F.posexplode(F.arrays_zip(*MOMENTS)).alias("feature", "m")).select("label", "feature", "m.*")
    asked = [(y, x) for y, a in enumerate(labels) for x, b in enumerate(feats) if a != b]
    all_pairs = df.sparkSession.createDataFrame([(y, x, labels[y], feats[x]) for y, x in asked], "_y int, _x int, label string, feature string")
    spread = F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy"))
    corr = F.when((F.col("bad") == 0) & (F.col("n") > 1) & (F.col("cxx") > 0) & (F.col("cyy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cxy") / spread)))
    found = pairs.select(F.col("label").alias("_y"), F.col("feature").alias("_x"), corr.alias("corr"), (F.col("n") + F.col("bad")).cast("long").alias("n"))
    out = all_pairs.join(found, ["_y", "_x"], "left").select("feature", "label", "corr", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    leak = F.coalesce((F.abs("corr") >= threshold) & (F.col("n") >= min_rows), F.lit(False)).cast("int")
    return out.withColumn("leak", leak)


def leakage_seq_len(df: DataFrame, cols: Sequence[str], limit: int = 16) -> DataFrame:
    """(column, max_len, leak): lists longer than the months before the label window."""
    sizes = per_column(df, list(cols), lambda c: {"max_len": F.coalesce(F.max(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0))})
    return sizes.withColumn("leak", (F.col("max_len") > limit).cast("int"))


def leakage_snapshot(df: DataFrame, pairs: dict[str, str], threshold: float = 0.9) -> DataFrame:
    """(column, n, match_last, match_prev, leak): the snapshot equals the last list element too often."""
    def stats(c: str) -> dict[str, Column]:
        s = F.col(pairs[c])
        ok = F.col(c).isNotNull() & (F.size(s) >= 2)
        return {
            "n": F.sum(F.when(ok, 1).otherwise(0)),
            "match_last": F.avg(F.when(ok, (F.col(c) == last_element(s)).cast("double"))),
            "match_prev": F.avg(F.when(ok, (F.col(c) == F.get(s, F.size(s) - 2)).cast("double"))),
        }

    out = per_column(df, list(pairs), stats)
    return out.withColumn("leak", F.coalesce((F.col("match_last") > threshold).cast("int"), F.lit(0)))


def split_integrity(df: DataFrame, date: str, split: str = "_split") -> DataFrame:
    """(train_max, val_min, val_max, test_min, overlap_train_val, overlap_val_test)."""
    d = F.col(date).cast("date")

    def edge(fn, s: str) -> Column:
        return fn(F.when(F.col(split) == s, d))

    out = df.agg(edge(F.max, TRAIN).alias("train_max"), edge(F.min, VAL).alias("val_min"), edge(F.max, VAL).alias("val_max"), edge(F.min, TEST).alias("test_min"))
    return out.select(
        "*",
        F.coalesce((F.col("train_max") >= F.col("val_min")).cast("int"), F.lit(0)).alias("overlap_train_val"),
        F.coalesce((F.col("val_max") >= F.col("test_min")).cast("int"), F.lit(0)).alias("overlap_val_test"),
    )


def column_overlap(features: DataFrame, labels: DataFrame, key: str | None = None) -> list[str]:
    """Names that occur in both frames (other than the key)."""
    return sorted(set(features.columns) & set(labels.columns) - {key})
