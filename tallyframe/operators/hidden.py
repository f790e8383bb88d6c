"""Hidden Markov states of histories of any length, one row per step.

A history is cut into segments of `length` steps. What a segment does to a vector of state
probabilities is a k x k transfer matrix, the product of its steps' transition and emission
matrices; products are associative, so nodes of FAN segments, then nodes of FAN nodes, have matrices of
their own. On the way down every node hands each child the probabilities that reach it from the left (all
earlier steps) and from the right (all later ones), and every segment finishes its own steps by the
usual forward and backward recursions. The result does not depend on `length`, a task holds segments
or nodes only, and one history may span any number of tasks.

Defined results: a NULL or NaN value tells nothing about the state (its density counts as 1); NULL keys
form one history; `order` has to be total within a key; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.latent import HmmModel
from tallyframe.plans.session import GROUP_ROWS, written
from tallyframe.plans.skew import position

#: Steps of a segment, and children of a node.
LENGTH, FAN = 512, 256

_VECTOR = T.ArrayType(T.DoubleType())


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], dims: Sequence[str], length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(k, seg, steps): the steps (pos, v) of every segment in order; `k` is the struct of the keys. A stored table."""
    rows = position(df.select(*keys, *[c for c in order if c not in keys], *[F.col(d).cast("double").alias(f"_d{i}") for i, d in enumerate(dims)]), keys, order, "_pos", group_rows)
    v = F.array(*[F.coalesce(f"_d{i}", F.lit(float("nan"))) for i in range(len(dims))])
    at = F.col("_pos") - 1
    step = F.struct(at.alias("pos"), v.alias("v"))
    cut = rows.select(F.struct(*keys).alias("k"), F.floor(at / length).alias("seg"), step.alias("s"))
    return written(cut.groupBy("k", "seg").agg(F.sort_array(F.collect_list("s")).alias("steps")))


def _densities(x: np.ndarray, m: HmmModel) -> np.ndarray:
    """Density of every step under every state, up to a factor per step."""
    d = x[..., None, :] - m.mean
    logp = -0.5 * np.nan_to_num(d * d / m.var + np.log(2 * np.pi * m.var), nan=0.0).sum(-1)
    return np.exp(logp - logp.max(-1, keepdims=True)) + 1e-300


def _blocks(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, sizes, padded values) of segments of similar size."""
    size = pdf["steps"].map(len).to_numpy()
    like = np.ceil(np.log2(size))
    for b in np.unique(like):
        at = np.flatnonzero(like == b)
        x = np.full((at.size, size[at].max(), len(pdf["steps"].iloc[at[0]][0]["v"])), np.nan)
        for row, i in enumerate(at):
            x[row, : size[i]] = [s["v"] for s in pdf["steps"].iloc[i]]
        yield at, size[at], x


def _transfer(m: HmmModel):
    k = len(m.start)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = [None] * len(pdf)
            for at, size, x in _blocks(pdf) if len(pdf) else ():
                b = _densities(x, m)
                first = (pdf["seg"].to_numpy()[at] == 0)[:, None, None]
                p = np.where(first, np.eye(k), m.trans) * b[:, 0][:, None, :]
                for t in range(1, x.shape[1]):
                    p = np.where((t < size)[:, None, None], p @ (m.trans * b[:, t][:, None, :]), p)
                    p /= p.max((1, 2), keepdims=True)
                for row, i in enumerate(at):
                    out[i] = p[row].ravel()
            yield pdf[["k", "seg"]].rename(columns={"seg": "i"}).assign(m=out)

    return run


def _product(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for kids in pdf["kids"]:
                p = np.eye(k)
                for kid in kids:
                    p = p @ np.reshape(kid["m"], (k, k))
                    p /= p.max()
                out.append(p.ravel())
            yield pdf[["k", "i"]].assign(m=out)

    return run


def _handed(k: int):
    """What reaches every child from the left and from the right of its node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, kids, left, right in zip(pdf["k"], pdf["kids"], pdf["left"], pdf["right"]):
                mats = [np.reshape(x["m"], (k, k)) for x in kids]
                a, b = np.asarray(left), np.asarray(right)
                lefts, rights = [], []
                for m in mats:
                    lefts.append(a)
                    a = a @ m
                    a = a / a.sum()
                for m in reversed(mats):
                    rights.append(b)
                    b = m @ b
                    b = b / b.sum()
                rows += [(key, x["i"], lo, hi) for x, lo, hi in zip(kids, lefts, reversed(rights))]
            yield pd.DataFrame(rows, columns=["k", "i", "left", "right"])

    return run


def reached(segs: DataFrame, m: HmmModel, fan: int = FAN) -> DataFrame:
    """(k, seg, steps, left, right): every segment with what reaches it from both sides."""
    k = len(m.start)
    key = segs.schema["k"]
    node = T.StructType([key, T.StructField("i", T.LongType()), T.StructField("m", _VECTOR)])
    carry = T.StructType([key, T.StructField("i", T.LongType()), T.StructField("left", _VECTOR), T.StructField("right", _VECTOR)])
    now = segs.mapInPandas(_transfer(m), node)
    last = segs.agg(F.max("seg")).first()[0] or 0
    levels = []
    while True:
        kids = F.sort_array(F.collect_list(F.struct("i", "m")))
        levels.append(written(now.groupBy("k", F.floor(F.col("i") / fan).alias("p")).agg(kids.alias("kids")).withColumnRenamed("p", "i")))
        last //= fan
        if not last:
            break
        now = levels[-1].mapInPandas(_product(k), node)
    ends = levels.pop().withColumn("left", F.array(*[F.lit(float(x)) for x in m.start])).withColumn("right", F.array(*[F.lit(1.0)] * k))
    down = ends.mapInPandas(_handed(k), carry)
    while levels:
        got = down.select(F.col("k").alias("_k"), F.col("i").alias("_i"), "left", "right")
        below = levels.pop()
        down = below.join(got, below["k"].eqNullSafe(got["_k"]) & (below["i"] == got["_i"])).drop("_k", "_i").mapInPandas(_handed(k), carry)
    got = written(down).select(F.col("k").alias("_k"), F.col("i").alias("_i"), "left", "right")
    return segs.join(got, segs["k"].eqNullSafe(got["_k"]) & (segs["seg"] == got["_i"])).drop("_k", "_i")


def _finished(pdf: pd.DataFrame, m: HmmModel) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, sizes, values, state probabilities, summed transition probabilities) of segments of similar size."""
    for at, size, x in _blocks(pdf):
        rows, n, _ = x.shape
        b = _densities(x, m)
        left, right = (np.array([np.asarray(v) for v in pdf[c].iloc[at]]) for c in ("left", "right"))
        first = (pdf["seg"].to_numpy()[at] == 0)[:, None]
        fwd, bwd = np.zeros((rows, n, len(m.start))), np.zeros((rows, n, len(m.start)))
        f = np.where(first, left, left @ m.trans) * b[:, 0]
        fwd[:, 0] = f / f.sum(-1, keepdims=True)
        for t in range(1, n):
            f = (fwd[:, t - 1] @ m.trans) * b[:, t]
            fwd[:, t] = f / f.sum(-1, keepdims=True)
        after = right
        xi = np.zeros((len(m.start),) * 2)
        for t in range(n - 1, -1, -1):
            inside = (t < size)[:, None]
            bwd[:, t] = np.where(inside, after, 1.0)
            nxt = b[:, t] * after
            before = fwd[:, t - 1] if t else left
            p = before[:, :, None] * m.trans * nxt[:, None, :]
            some = inside[:, :, None] & (~first[:, :, None] if t == 0 else True)
            xi += np.where(some, p / p.sum((1, 2), keepdims=True), 0.0).sum(0)
            back = nxt @ m.trans.T
            after = np.where(inside, back / back.sum(-1, keepdims=True), after)
        g = fwd * bwd
        g /= g.sum(-1, keepdims=True)
        yield at, size, x, g * (np.arange(n) < size[:, None])[:, :, None], xi


def posteriors(segs: DataFrame, m: HmmModel, fan: int = FAN) -> DataFrame:
    """The keys, `pos` (0-based), `state` and `probs` of every step."""
    key = segs.schema["k"]
    out = T.StructType([key, T.StructField("pos", T.LongType()), T.StructField("state", T.IntegerType()), T.StructField("probs", _VECTOR)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, size, x, g, _ in _finished(pdf, m) if len(pdf) else ():
                probs = g[np.arange(x.shape[1]) < size[:, None]]  # the steps of all segments in order
                some = pdf.iloc[at]
                pos = np.concatenate([[s["pos"] for s in steps] for steps in some["steps"]])
                yield pd.DataFrame({"k": np.repeat(some["k"].to_numpy(object), size), "pos": pos, "state": probs.argmax(1).astype(np.int32), "probs": list(probs)})

    return reached(segs, m, fan).mapInPandas(run, out).select("k.*", "pos", "state", "probs")


def _sums(m: HmmModel) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, d = m.mean.shape
        acc = {"start": np.zeros((k, 1)), "trans": np.zeros((k, k)), "w": np.zeros((k, d)), "x": np.zeros((k, d)), "xx": np.zeros((k, d))}
        for pdf in batches:
            for at, _, x, g, xi in _finished(pdf, m) if len(pdf) else ():
                acc["start"][:, 0] += g[pdf["seg"].to_numpy()[at] == 0, 0].sum(0)
                acc["trans"] += xi
                there = ~np.isnan(x)
                y = np.nan_to_num(x)
                acc["w"] += np.einsum("rtk,rtd->kd", g, there.astype(float))
                acc["x"] += np.einsum("rtk,rtd->kd", g, y)
                acc["xx"] += np.einsum("rtk,rtd->kd", g, y * y)
        yield pd.DataFrame([(n, i, j, a[i, j]) for n, a in acc.items() for i in range(a.shape[0]) for j in range(a.shape[1])], columns=["name", "i", "j", "v"])

    return run


def improved(segs: DataFrame, m: HmmModel, fan: int = FAN) -> HmmModel:
    """One round of expectation maximisation; the driver sees the k (1 + k + 3 d) sums only."""
    k, d = m.mean.shape
    rows = reached(segs, m, fan).mapInPandas(_sums(m), "name string, i int, j int, v double").groupBy("name", "i", "j").agg(F.sum("v").alias("v")).collect()
    acc = {n: np.zeros(s) for n, s in (("start", (k, 1)), ("trans", (k, k)), ("w", (k, d)), ("x", (k, d)), ("xx", (k, d)))}
    for r in rows:
        acc[r["name"]][r["i"], r["j"]] = r["v"]
    w = np.maximum(acc["w"], 1e-9)
    mean = acc["x"] / w
    return HmmModel(
        (acc["start"][:, 0] + 1e-9) / (acc["start"].sum() + 1e-9 * k),
        (acc["trans"] + 1e-6) / (acc["trans"] + 1e-6).sum(1, keepdims=True),
        mean,
        np.maximum(acc["xx"] / w - mean * mean, 1e-3),
    )
