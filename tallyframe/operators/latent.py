"""Hidden-state features, point-cloud persistence and similarity graphs.

Sequences and point clouds reach Python one bounded list per row; Spark partitions and merges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.stats import array_sum
from tallyframe.operators.search import knn
from tallyframe.plans.components import components
from tallyframe.plans.session import GROUP_ROWS, written


@dataclass(frozen=True)
class HmmModel:
    """Gaussian hidden Markov model with independent dimensions."""

    start: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    var: np.ndarray


def _packed(steps: Sequence) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of an Arrow batch as padded blocks of similar length: (positions, lengths, values)."""
    arrays = [np.array([list(v) for v in s], dtype="float64") for s in steps]
    size = np.array([len(x) for x in arrays])
    out = []
    for bucket in np.unique(np.ceil(np.log2(np.maximum(size, 1)))):
        at = np.flatnonzero((np.ceil(np.log2(np.maximum(size, 1))) == bucket) & (size > 0))
        if len(at):
            block = np.zeros((len(at), size[at].max(), arrays[at[0]].shape[1]))
            for row, i in enumerate(at):
                block[row, : size[i]] = arrays[i]
            out.append((at, size[at], block))
    return out


def _posteriors(x: np.ndarray, size: np.ndarray, m: HmmModel) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities per step (zero beyond a sequence's end) and summed transition probabilities.

    All sequences of the block move through the recursions together, one step at a time.
    """
    rows, n, _ = x.shape
    k = len(m.start)
    d = x[:, :, None, :] - m.mean
    logp = -0.5 * (d * d / m.var + np.log(2 * np.pi * m.var)).sum(-1)
    b = np.exp(logp - logp.max(-1, keepdims=True)) + 1e-300
    fwd, bwd = np.zeros((rows, n, k)), np.ones((rows, n, k))
    f = m.start * b[:, 0]
    fwd[:, 0] = f / f.sum(-1, keepdims=True)
    for t in range(1, n):
        f = (fwd[:, t - 1] @ m.trans) * b[:, t]
        fwd[:, t] = f / f.sum(-1, keepdims=True)
    xi = np.zeros((k, k))
    for t in range(n - 2, -1, -1):
        inside = (t + 1 < size)[:, None]
        nxt = b[:, t + 1] * bwd[:, t + 1]
        w = nxt @ m.trans.T
        bwd[:, t] = np.where(inside, w / w.sum(-1, keepdims=True), 1.0)
        p = fwd[:, t][:, :, None] * m.trans * nxt[:, None, :]
        p = np.where(inside[:, :, None], p / p.sum((1, 2), keepdims=True), 0.0)
        xi += p.sum(0)
    g = fwd * bwd
    g /= g.sum(-1, keepdims=True)
    return g * (np.arange(n) < size[:, None])[:, :, None], xi


def hmm_fit(seqs: DataFrame, steps: str, states: int, dims: int, rounds: int = 10) -> HmmModel:
    """Expectation maximisation over one list of step vectors per row.

    `seqs` is read once per round, so it should be a stored table. A round is one Spark job: tasks add up the expected counts of their sequences and Spark sums the
    k (2 + 2d + k) cells; the driver sees only those sums.
    """
    spread = seqs.select(F.explode(steps).alias("v")).agg(
        *[F.percentile_approx(F.get("v", F.lit(d)), [(i + 0.5) / states for i in range(states)], 10000).alias(f"q{d}") for d in range(dims)],
        *[F.var_pop(F.get("v", F.lit(d))).alias(f"s{d}") for d in range(dims)],
    ).first()
    mean = np.array([[spread[f"q{d}"][i] for d in range(dims)] for i in range(states)], dtype="float64")
    var = np.tile([max(spread[f"s{d}"] or 1.0, 1e-3) for d in range(dims)], (states, 1)).astype("float64")
    trans = np.full((states, states), 0.3 / max(states - 1, 1))
    np.fill_diagonal(trans, 0.7)
    m = HmmModel(np.full(states, 1 / states), trans, mean, var)
    for _ in range(rounds):
        rows = seqs.select(F.col(steps).alias("v")).mapInPandas(_expected(m), "name string, i int, j int, v double").groupBy("name", "i", "j").agg(F.sum("v").alias("v")).collect()
        acc = {n: np.zeros(s) for n, s in (("start", (states, 1)), ("trans", (states, states)), ("w", (states, 1)), ("x", (states, dims)), ("xx", (states, dims)))}
        for r in rows:
            acc[r["name"]][r["i"], r["j"]] = r["v"]
        w = np.maximum(acc["w"], 1e-9)
        mu = acc["x"] / w
        m = HmmModel(
            (acc["start"][:, 0] + 1e-9) / (acc["start"].sum() + 1e-9 * states),
            (acc["trans"] + 1e-6) / (acc["trans"] + 1e-6).sum(1, keepdims=True),
            mu,
            np.maximum(acc["xx"] / w - mu * mu, 1e-3),
        )
    return m


def _expected(m: HmmModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, d = m.mean.shape
        acc = {"start": np.zeros((k, 1)), "trans": np.zeros((k, k)), "w": np.zeros((k, 1)), "x": np.zeros((k, d)), "xx": np.zeros((k, d))}
        for pdf in batches:
            for _, size, x in _packed(pdf["v"]):
                g, xi = _posteriors(x, size, m)
                acc["start"][:, 0] += g[:, 0].sum(0)
                acc["trans"] += xi
                acc["w"][:, 0] += g.sum((0, 1))
                acc["x"] += np.einsum("rtk,rtd->kd", g, x)
                acc["xx"] += np.einsum("rtk,rtd->kd", g, x * x)
        yield pd.DataFrame([(n, i, j, a[i, j]) for n, a in acc.items() for i in range(a.shape[0]) for j in range(a.shape[1])], columns=["name", "i", "j", "v"])

    return run


def hmm_decode(seqs: DataFrame, keys: Sequence[str], steps: str, m: HmmModel, prefix: str = "hmm") -> DataFrame:
    """State of the newest step, its probabilities, expected dwell time and transition entropy per sequence."""
    k = len(m.start)
    keep = [f for f in seqs.schema.fields if f.name in keys]
    out = T.StructType([*keep, T.StructField(f"{prefix}_state", T.IntegerType()), T.StructField(f"{prefix}_probs", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            last = np.tile(m.start, (len(pdf), 1))
            for at, size, x in _packed(pdf[steps]):
                last[at] = _posteriors(x, size, m)[0][np.arange(len(at)), size - 1]
            res = pdf[[f.name for f in keep]].copy()
            res[f"{prefix}_state"] = [int(np.argmax(p)) for p in last]
            res[f"{prefix}_probs"] = [p.tolist() for p in last]
            yield res

    dwell = [float(1 / max(1 - m.trans[i, i], 1e-9)) for i in range(k)]
    ent = [float(-(m.trans[i] * np.log(np.maximum(m.trans[i], 1e-12))).sum()) for i in range(k)]
    state = F.col(f"{prefix}_state")
    return seqs.select(*keys, steps).mapInPandas(run, out).withColumns({
        f"{prefix}_dwell": F.get(F.array(*[F.lit(x) for x in dwell]), state),
        f"{prefix}_transition_entropy": F.get(F.array(*[F.lit(x) for x in ent]), state),
    })


def _tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of points: both ends and the length of its edges, the death times of components."""
    n = len(x)
    dist = np.linalg.norm(x - x[0], axis=1)
    near = np.zeros(n, np.int64)
    seen = np.zeros(n, bool)
    seen[0] = True
    to, out = np.zeros(n - 1, np.int64), np.zeros(n - 1)
    for e in range(n - 1):
        i = int(np.argmin(np.where(seen, np.inf, dist)))
        to[e], out[e] = i, dist[i]
        seen[i] = True
        new = np.linalg.norm(x - x[i], axis=1)
        closer = ~seen & (new < dist)
        dist[closer], near[closer] = new[closer], i
    return near[to], to, out


H0_STATS = ("num_features", "mean_lifetime", "max_lifetime", "std_lifetime", "entropy", "total_persistence", "mean_birth", "mean_death")


def _h0(points: np.ndarray) -> list[float]:
    x = points[~np.isnan(points).any(axis=1)] if len(points) else points
    if len(x) < 2:
        return [0.0] * len(H0_STATS)
    d = _tree(x)[2]
    total = d.sum()
    p = d / total if total > 0 else d
    ent = float(-(p * np.log(p + 1e-12)).sum()) if total > 0 else 0.0
    return [float(len(d)), float(d.mean()), float(d.max()), float(d.std()) if len(d) > 1 else 0.0, ent, float(total), 0.0, float(d.mean())]


#: Points of one cell of a cloud; clouds up to this size are worked on in one row.
PART = 2048
#: Points of a region, which one task deals into cells, and of the sample that places the regions' borders.
REGION, SAMPLE = 1 << 15, 1 << 16
EDGE = "k long, u long, v long, d double"


def _cuts(x: np.ndarray, p: int, first: int = 0):
    """Cuts that deal points into p parts of like size: (dimension, cut, left, right), or the number of a part."""
    if p <= 1 or len(x) < 2 or not np.ptp(x, axis=0).max() > 0:
        return first
    dim, left = int(np.argmax(np.ptp(x, axis=0))), p // 2
    mine = x[:, dim]
    cut = np.quantile(mine, left / p, method="lower")
    if cut == mine.max():
        cut = mine[mine < cut].max()
    return dim, float(cut), _cuts(x[mine <= cut], left, first), _cuts(x[mine > cut], p - left, first + left)


def _part(cuts, x: np.ndarray) -> np.ndarray:
    """The part of every point."""
    out, todo = np.zeros(len(x), np.int64), [(cuts, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if isinstance(at, int):
            out[rows] = at
        elif rows.size:
            low = x[rows, at[0]] <= at[1]
            todo += [(at[2], rows[low]), (at[3], rows[~low])]
    return out


def _cells(x: np.ndarray) -> np.ndarray:
    """The cell of every point: the widest dimension is cut at its median until a cell holds PART points at most."""
    out, todo, n = np.zeros(len(x), np.int64), [np.arange(len(x))], 0
    while todo:
        rows = todo.pop()
        if rows.size <= PART:
            out[rows], n = n, n + 1
        else:
            mine = x[rows, int(np.argmax(np.ptp(x[rows], axis=0)))]
            order = np.argpartition(mine, rows.size // 2)
            todo += [rows[order[: rows.size // 2]], rows[order[rows.size // 2 :]]]
    return out


def _stack(vs) -> np.ndarray:
    return np.array([list(q) for q in vs], dtype="float64")


def _placed(spots: DataFrame, large: DataFrame) -> DataFrame:
    """(g, c, id, v): points (g, id, v) with the cell they lie in. A bounded sample places the regions, which decides only how work is dealt."""
    many = {r["g"]: -(-r["n"] // REGION) for r in large.where(F.col("n") > REGION).select("g", "n").collect()}
    total = large.agg(F.sum("n")).first()[0]
    chosen = spots.where(F.pmod(F.xxhash64("v"), F.lit(max(1, total // SAMPLE))) == 0).join(large.where(F.col("n") > REGION).select("g"), "g")
    sample = chosen.select("g", "v").limit(2 * SAMPLE).toPandas() if many else pd.DataFrame({"g": [], "v": []})
    borders = {g: _cuts(_stack(vs), many[g]) for g, vs in sample.groupby("g")["v"]}

    def region(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part = np.zeros(len(pdf), np.int64)
            for g, rows in pdf.groupby("g").indices.items():
                part[rows] = _part(borders.get(g, 0), _stack(pdf["v"].iloc[rows]))
            yield pdf.assign(p=part)

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(c=pdf["p"] * (1 << 24) + _cells(_stack(pdf["v"])))[["g", "c", "id", "v"]]

    dealt = spots.select("g", "id", "v").mapInPandas(region, "g long, id long, v array<double>, p long")
    return written(dealt.groupBy("g", "p").applyInPandas(deal, "g long, c long, id long, v array<double>"))


def _gap(lo: list, hi: list, low: list, high: list):
    """Least distance of two boxes."""
    return F.sqrt(sum((F.pow(F.greatest(c - b, a - d, F.lit(0.0)), 2) for a, b, c, d in zip(lo, hi, low, high)), F.lit(0.0)))


def _own_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The radius of every cell: what nine tenths of the edges of its own points' tree do not exceed."""
    for pdf in batches:
        q = [float(np.quantile(_tree(_stack(vs))[2], 0.9)) if len(vs) > 1 else math.inf for vs in pdf["vs"]]
        yield pdf[["g", "c"]].assign(q=q)


def _met_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (k, u, v, d, sure) of the tree of every cell's own points and its guests.

    `sees` tells how far from a point the cell knows all points. An edge that joins a component to another
    is sure to be in the cloud's tree if the component sees as far as the edge is long at all its points.
    """
    for pdf in batches:
        for g, ids, vs, sees in zip(pdf["g"], pdf["ids"], pdf["vs"], pdf["sees"]):
            a, b, d = _tree(_stack(vs))
            ids, sure, out, over = np.asarray(ids, np.int64), np.zeros(len(d), bool), list(sees), list(range(len(vs)))

            def root(x: int) -> int:
                while over[x] != x:
                    over[x] = x = over[over[x]]
                return x

            for e in np.lexsort((np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b]), d)).tolist():
                x, y = root(int(a[e])), root(int(b[e]))
                sure[e] = d[e] < max(out[x], out[y])
                over[x], out[y] = y, min(out[x], out[y]) if sure[e] else -1.0
            yield pd.DataFrame({"k": g, "u": np.minimum(ids[a], ids[b]), "v": np.maximum(ids[a], ids[b]), "d": d, "sure": sure})


def _reaches(pdf: pd.DataFrame) -> pd.DataFrame:
    """(g, r, reach, n) of a cloud's components from edges that connect them: the longest edge on the way to the largest one, by a pass over sorted edges."""
    g, size = pdf["k"].iloc[0], {}
    for r, n in zip(pdf["a"][pdf["d"].isna()].tolist(), pdf["n"][pdf["d"].isna()].tolist()):
        size[r] = n
    top = max(size, key=lambda r: (size[r], r))
    over, members, reach = {r: r for r in size}, {r: [r] for r in size}, dict.fromkeys(size, math.inf)
    reach[top] = 0.0

    def root(x: int) -> int:
        while over[x] != x:
            over[x] = x = over[over[x]]
        return x

    edges = pdf[pdf["d"].notna()].sort_values("d")
    for a, b, d in zip(edges["a"].tolist(), edges["b"].tolist(), edges["d"].tolist()):
        x, y, t = root(a), root(b), root(top)
        if x != y:
            if t in (x, y):
                for r in members[y if x == t else x]:
                    reach[r] = d
            if len(members[x]) > len(members[y]):
                x, y = y, x
            over[x] = y
            members[y] += members.pop(x)
    return pd.DataFrame({"g": g, "r": list(reach), "reach": list(reach.values())})


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges within the visitors' reach that make a least forest of the components that visit a cell and those of the cell."""
    for pdf in batches:
        for row in pdf.itertuples():
            of = np.asarray(row.of, np.int64)
            order = np.argsort(of, kind="stable")
            y, of, theirs = _stack(row.here)[order], of[order], np.asarray(row.others, np.int64)[order]
            cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            x, mine, ids, far = _stack(row.vs), np.asarray(row.rs, np.int64), np.asarray(row.ids, np.int64), np.asarray(row.bs)
            out = []
            for i in range(0, len(x), 256):
                gaps = np.linalg.norm(x[i : i + 256, None] - y[None], axis=2)
                low = np.minimum.reduceat(gaps, cut, axis=1)
                r, j = np.nonzero((low <= far[i : i + 256, None]) & (of[cut][None] != mine[i : i + 256, None]))
                ends = np.append(cut, of.size)
                at = np.array([s + int(gaps[p, s:e].argmin()) for p, s, e in zip(r, ends[j], ends[j + 1])], np.int64)
                out.append(pd.DataFrame({"u": ids[i + r], "v": theirs[at], "d": low[r, j], "a": mine[i + r], "b": of[at]}))
            best, over, keep = pd.concat(out).sort_values("d").drop_duplicates(["a", "b"]), {}, []

            def root(q: int) -> int:
                while q in over:
                    over[q] = q = over.get(over[q], over[q])
                return q

            for a, b in zip(best["a"].tolist(), best["b"].tolist()):
                a, b = root(a), root(b)
                keep.append(a != b)
                if a != b:
                    over[a] = b
            best = best[np.array(keep, bool)]
            yield pd.DataFrame({"k": row.g, "u": np.minimum(best["u"], best["v"]), "v": np.maximum(best["u"], best["v"]), "d": best["d"]})


#: One of so many points is a scout, which also visits the cells farther off.
SCOUTS = 64


def _candidates(spots: DataFrame, large: DataFrame, dims: int) -> DataFrame:
    """Edges (k, u, v, d) that hold a minimum spanning tree of each cloud's points (g, id, v).

    Points are dealt into cells by place. A cell's own points and those near its box give a tree, whose sure
    edges make components. The trees and links of neighbouring cells connect these; no edge of a minimum
    spanning tree between two of them is longer than the longest edge on the way from one of them to the
    largest, its reach. So every component but the largest visits the cells within its reach.
    """
    placed = _placed(spots, large)
    axis = range(dims)
    v = [F.get("v", F.lit(i)) for i in axis]
    lists = placed.groupBy("g", "c").agg(F.collect_list("v").alias("vs")).mapInPandas(_own_trees, "g long, c long, q double")
    boxes = placed.groupBy("g", "c").agg(F.min("id").alias("one"), *[F.min(x).alias(f"lo{i}") for i, x in enumerate(v)], *[F.max(x).alias(f"hi{i}") for i, x in enumerate(v)])
    boxes = written(boxes.join(lists, ["g", "c"]))
    lo, hi, low, high = ([F.col(f"{n}{i}") for i in axis] for n in ("lo", "hi", "to_lo", "to_hi"))
    to = boxes.select("g", F.col("c").alias("to"), F.col("q").alias("to_q"), *[x.alias(f"to_lo{i}") for i, x in enumerate(lo)], *[x.alias(f"to_hi{i}") for i, x in enumerate(hi)])
    slack = 1 + 1e-9  # boxes and points round differently
    near = boxes.join(F.broadcast(to), "g").where((F.col("c") != F.col("to")) & (_gap(lo, hi, low, high) <= F.col("to_q") * slack))
    near = written(near.select("g", "c", "to", "q", "to_q", *low, *high))
    # A cell's radius is no larger than that of the cells around, so that a sparse cell asks few points of a dense one.
    radius = written(boxes.select("g", "c", "q").unionByName(near.select("g", F.col("to").alias("c"), "q")).groupBy("g", "c").agg(F.min("q").alias("t")))
    near = near.join(radius.withColumnRenamed("c", "to"), ["g", "to"])
    gap = _gap(v, v, low, high)
    scout = F.pmod(F.xxhash64("id"), F.lit(SCOUTS)) == 0
    guests = placed.join(near, ["g", "c"]).withColumn("gap", gap).where((F.col("gap") <= F.col("t")) | (scout & (F.col("gap") <= F.col("to_q"))))
    met = placed.join(radius, ["g", "c"]).select("g", "c", "id", "v", (F.col("t") / slack).alias("sees")).unionByName(guests.select("g", F.col("to").alias("c"), "id", "v", (F.col("t") / slack - F.col("gap")).alias("sees")))
    met = met.groupBy("g", "c").agg(*[F.collect_list(x).alias(n) for x, n in (("id", "ids"), ("v", "vs"), ("sees", "sees"))])
    edges = written(met.mapInPandas(_met_trees, f"{EDGE}, sure boolean"))
    roots = written(components(edges.where("sure").select(F.col("u").alias("a"), F.col("v").alias("b"))))
    now = written(placed.join(roots.withColumnRenamed("node", "id"), "id", "left").select("g", "c", "id", "v", F.coalesce("root", "id").alias("r")))

    pair = boxes.select(F.col("g").alias("k"), F.col("one").alias("u"), F.lag("one").over(Window.partitionBy("g").orderBy("c")).alias("v")).where("v IS NOT NULL")
    spot = placed.join(F.broadcast(boxes.select(F.col("one").alias("id"))), "id").select(F.col("id"), F.col("v").alias("p"))
    pair = pair.join(spot.select(F.col("id").alias("u"), F.col("p").alias("p")), "u").join(spot.select(F.col("id").alias("v"), F.col("p").alias("o")), "v")
    length = F.sqrt(F.aggregate(F.zip_with("p", "o", lambda x, y: F.pow(x - y, 2)), F.lit(0.0), lambda s, x: s + x))
    links = written(pair.select("k", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), length.alias("d")))
    every = edges.where("NOT sure").drop("sure").unionByName(links)
    ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("u", "v")]
    cross = every.join(ends[0], "u", "left").join(ends[1], "v", "left").select("k", F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b"), "d").where("a <> b")
    cross = cross.groupBy("k", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))
    sizes = now.groupBy(F.col("g").alias("k"), F.col("r").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    told = sizes.select("k", "a", F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("d"), "n").unionByName(cross.withColumn("n", F.lit(None).cast("long")))
    reach = written(told.groupBy("k").applyInPandas(_reaches, "g long, r long, reach double").where("reach > 0"))

    pure = now.groupBy("g", F.col("c").alias("to")).agg(F.min("r").alias("r0"), F.max("r").alias("r1"))
    cells = to.join(pure, ["g", "to"])
    guests = now.join(reach, ["g", "r"])
    asked = guests.groupBy("g", "c").agg(F.max("reach").alias("t")).join(boxes, ["g", "c"]).join(F.broadcast(cells), "g")
    asked = asked.where((F.col("c") != F.col("to")) & (_gap(lo, hi, low, high) <= F.col("t") * slack)).select("g", "c", "to", "r0", "r1", *low, *high)
    came = guests.join(asked, ["g", "c"]).where((F.col("r0") != F.col("r")) | (F.col("r1") != F.col("r"))).where(gap <= F.col("reach") * slack)
    came = came.groupBy("g", F.col("to").alias("c")).agg(*[F.collect_list(x).alias(n) for x, n in (("id", "ids"), ("v", "vs"), ("r", "rs"), ("reach", "bs"))])
    own = now.groupBy("g", "c").agg(F.collect_list("id").alias("others"), F.collect_list("v").alias("here"), F.collect_list("r").alias("of"))
    found = written(came.join(own, ["g", "c"]).mapInPandas(_nearest, EDGE))
    return edges.drop("sure").unionByName(links).unionByName(found)


def h0_persistence(df: DataFrame, key: str, dims: Sequence[str], order: Sequence[str], prefix: str = "h0") -> DataFrame:
    """Component-lifetime statistics of each entity's point cloud, over all its points.

    The lifetimes are the edge lengths of the cloud's minimum spanning tree, which no order of the points
    changes (`order` names columns that tell rows apart). Clouds of up to PART points are one row each; the
    distinct points of larger ones are dealt into cells by place, and a cell meets only what lies as near as a
    tree's edge can be long. Copies of a point add lifetimes of 0.
    """
    kind = df.schema[key].dataType
    v = F.array(*[F.col(d).cast("double") for d in dims])
    full = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    points = written(df.select(F.col(key).alias("k"), v.alias("v")).withColumn("v", F.when(full, F.col("v"))))
    large = points.groupBy("k").agg(F.count("v").alias("n")).where(F.col("n") > PART)
    large = written(large.select(F.col("k").alias("_k"), "n", F.monotonically_increasing_id().alias("g")))
    same = F.col("k").eqNullSafe(F.col("_k"))
    clouds = points.join(large, same, "left_anti").groupBy("k").agg(F.collect_list("v").alias("_pts"))
    names = [f"{prefix}_{s}" for s in H0_STATS]
    out = T.StructType([T.StructField(key, kind), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_h0(_stack(pts)) for pts in pdf["_pts"]]
            res = pd.DataFrame(rows, columns=names)
            res.insert(0, key, pdf["k"].to_numpy())
            yield res

    small = clouds.mapInPandas(run, out)
    if large.isEmpty():
        return small
    spots = points.where("v IS NOT NULL").join(large, same).groupBy("g", "v").agg(F.count(F.lit(1)).alias("w"))
    spots = written(spots.withColumn("id", F.monotonically_increasing_id()))
    lives = _lifetimes(_candidates(spots, large, len(dims)), T.LongType()).select(F.col("k").alias("g"), "d", F.lit(1).cast("long").alias("w"))
    lives = written(lives.unionByName(spots.groupBy("g").agg((F.sum("w") - F.count("w")).alias("w")).select("g", F.lit(0.0).alias("d"), "w")))
    total = lives.groupBy("g").agg(F.sum(F.col("d") * F.col("w")).alias("_t"), F.sum("w").alias("_n"))
    w, mean = F.col("w"), F.col("_t") / F.col("_n")
    p = F.col("d") / F.col("_t")
    spread = F.sqrt(F.sum(w * F.pow(F.col("d") - mean, 2)) / F.first("_n"))
    entropy = F.coalesce(-F.sum(F.when(F.col("_t") > 0, w * p * F.log(p + 1e-12))), F.lit(0.0))
    stats = [F.first("_n").cast("double"), F.first(mean), F.max("d"), spread, entropy, F.first("_t"), F.lit(0.0), F.first(mean)]
    rows = lives.join(F.broadcast(total), "g").groupBy("g").agg(*[s.alias(n) for s, n in zip(stats, names)])
    return small.unionByName(rows.join(large, "g").select(F.col("_k").alias(key), *names))


def _lifetimes(edges: DataFrame, kind: T.DataType) -> DataFrame:
    """(k, d): edge lengths of each key's minimum spanning tree, from edges (k, u, v, d) that connect its points.

    While a key has more edges than a task should hold, every component takes its least edge, and the
    components that these join become one (Boruvka); the rest is one pass over the sorted edges per key.
    Equal lengths are told apart by their ends, so no round closes a cycle.
    """
    now = edges.groupBy("k", F.col("u").alias("a"), F.col("v").alias("b")).agg(F.min(F.struct("d", "u", "v")).alias("e"))
    now = written(now)
    taken = []
    while (now.groupBy("k").count().agg(F.max("count")).first()[0] or 0) > GROUP_ROWS:
        both = now.unionByName(now.select("k", F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        best = written(both.groupBy("k", "a").agg(F.min(F.struct("e", "b")).alias("m")).select("k", "a", "m.*"))
        taken.append(best.select("k", "e").distinct().select("k", "e.d"))
        back = best.select(F.col("a").alias("b"), F.col("b").alias("c"))
        up = written(best.join(back, "b").select("a", F.when(F.col("c") == F.col("a"), F.least("a", "b")).otherwise(F.col("b")).alias("r")))
        while True:
            jumped = written(up.join(up.select(F.col("a").alias("r"), F.col("r").alias("to")), "r").select("a", F.col("to").alias("r"), (F.col("r") != F.col("to")).alias("moved")))
            up = jumped.select("a", "r")
            if jumped.where("moved").isEmpty():
                break
        joined = now.join(up.withColumnRenamed("r", "ra"), "a").join(up.select(F.col("a").alias("b"), F.col("r").alias("rb")), "b").where("ra <> rb")
        now = written(joined.groupBy("k", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("e").alias("e")))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["d", "u", "v"])
        over: dict[int, int] = {}

        def root(x: int) -> int:
            while x in over:
                over[x] = x = over.get(over[x], over[x])
            return x

        keep = np.zeros(len(pdf), bool)
        for at, (a, b) in enumerate(zip(pdf["a"].tolist(), pdf["b"].tolist())):
            a, b = root(a), root(b)
            if a != b:
                over[a], keep[at] = b, True
        return pdf.loc[keep, ["k", "d"]]

    rest = now.select("k", "a", "b", "e.*").groupBy("k").applyInPandas(last, T.StructType([T.StructField("k", kind), T.StructField("d", T.DoubleType())]))
    for t in taken:
        rest = rest.unionByName(t)
    return rest


def global_h0(df: DataFrame, key: str, dims: Sequence[str], prefix: str = "pop") -> DataFrame:
    """The same statistics of the cloud of all entities' means, on every entity's row."""
    means = written(df.groupBy(key).agg(*[F.avg(d).alias(d) for d in dims]))
    stats = h0_persistence(means.withColumn("_one", F.lit(1)), "_one", dims, [key], prefix).drop("_one")
    return means.select(key).withColumn("_s", stats.select(F.struct("*")).scalar()).select(key, "_s.*")


def knn_graph(vectors: DataFrame, key: str, vec: str, k: int, find: Callable[..., DataFrame] = knn) -> DataFrame:
    """Symmetric cosine neighbour graph with self loops, weighted D^-1/2 A D^-1/2: (src, dst, w).

    `find` is the exact search, whose work is the square of the rows, or `neighbours.indexed_knn` for large tables.
    """
    near = written(find(vectors.select(F.col(key).alias("src"), vec), vectors.select(F.col(key).alias("dst"), vec), "src", "dst", vec, k).select("src", "dst"))
    both = written(near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(vectors.select(F.col(key).alias("src"), F.col(key).alias("dst"))).distinct())
    deg = both.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    j = both.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("deg2")), "dst")
    return j.select("src", "dst", (1.0 / F.sqrt(F.col("deg") * F.col("deg2"))).alias("w"))


def _padded(col: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for missing ones) and which are known, a row for each list."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    there = np.arange(width) < sizes[:, None]
    flat = col.flatten()
    x, known = np.zeros(there.shape), there.copy()
    x[there] = pc.fill_null(flat, pa.scalar(0, flat.type)).to_numpy(zero_copy_only=False)
    known[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    return x, known


def _added(b: pa.RecordBatch, least: int = 1) -> pa.RecordBatch:
    """Rows (node, w, x, s) of a node that has `least` of them or more as one: the sum of w * x and of s, element by element.

    Elements that are NULL are left out; where all are, the sum is NULL. Other rows stay as they are.
    """
    codes = b["node"].dictionary_encode(null_encoding="encode").indices.to_numpy()
    few = np.bincount(codes)[codes] < least
    some = b.filter(pa.array(~few))
    if not some.num_rows:
        return b
    codes = codes[~few]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    size = lambda c: pc.fill_null(pc.list_value_length(some[c]), 0).to_numpy(zero_copy_only=False)
    sizes = np.maximum(size("x"), size("s"))
    w = some["w"].to_numpy(zero_copy_only=False)
    lost = some["w"].is_null().to_numpy(zero_copy_only=False)
    (x, known), (s, more) = (_padded(some[c], int(sizes.max())) for c in ("x", "s"))
    known &= ~lost[:, None]
    x = np.where(known, x * w[:, None], 0.0)
    total = np.add.reduceat((x + s)[order], starts, axis=0)
    known = np.logical_or.reduceat((known | more)[order], starts, axis=0)
    longest = np.maximum.reduceat(sizes[order], starts)
    there = np.arange(total.shape[1]) < longest[:, None]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(longest)]), pa.int32()), pa.array(total[there], mask=~known[there]))
    empty = pa.nulls(len(starts))
    new = [some["node"].take(pa.array(order[starts])), empty.cast(pa.float64()), empty.cast(b.schema.field("x").type), lists.cast(b.schema.field("s").type)]
    return pa.Table.from_batches([b.filter(pa.array(few)), pa.RecordBatch.from_arrays(new, schema=b.schema)]).combine_chunks().to_batches()[0]


def _added_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a batch has of one node as one row, if that is shorter."""
    for b in batches:
        if b.num_rows:
            yield _added(b, 3)


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their nodes as one row for each node; the last one of a batch goes with the next batch."""
    last = None
    for b in batches:
        if b.num_rows:
            b = _added(b if last is None else pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0])
            yield b.slice(0, b.num_rows - 1).select(["node", "s"])
            last = b.slice(b.num_rows - 1)
    if last is not None:
        yield last.select(["node", "s"])


def propagate(edges: DataFrame, emb: DataFrame, key: str, vec: str, layers: int = 2) -> DataFrame:
    """Mean over layers 0..L of the neighbour-weighted sums of the embeddings.

    Vectors travel whole and as they are given: once to the edges that end in them and from there,
    with the weight of the edge, to the node where the sums are taken. What a batch holds of one node
    is added before that, so a hub node costs no single task. Sets the session's bytes of an Arrow batch.
    """
    spark = emb.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    items = "float" if emb.schema[vec].dataType == T.ArrayType(T.FloatType(), emb.schema[vec].dataType.containsNull) else "double"
    many = T.ArrayType(T.DoubleType())
    empty = lambda name: F.lit(None).cast(many).alias(name)
    layer = emb.select(F.col(key).alias("node"), F.col(vec).cast(f"array<{items}>").alias("x")).where(F.size("x") > 0)

    def form(x: DataFrame) -> T.StructType:
        return T.StructType([T.StructField("node", emb.schema[key].dataType), T.StructField("w", T.DoubleType()), T.StructField("x", x.schema["x"].dataType), T.StructField("s", many)])

    def added(rows: DataFrame) -> DataFrame:
        sums = T.StructType([T.StructField("node", emb.schema[key].dataType), T.StructField("s", many)])
        return rows.repartition("node").sortWithinPartitions("node").mapInArrow(_added_up, sums)

    total = layer.select("node", F.lit(1.0).alias("w"), "x", empty("s"))
    for at in range(layers):
        sent = edges.join(layer.select(F.col("node").alias("dst"), "x"), "dst").select(F.col("src").cast(emb.schema[key].dataType).alias("node"), F.col("w").cast("double").alias("w"), "x", empty("s"))
        sent = sent.mapInArrow(_added_before, form(layer))
        if at + 1 < layers:  # read by the next layer and by the mean
            layer = written(added(sent).select("node", F.col("s").alias("x")))
            sent = layer.select("node", F.lit(1.0).alias("w"), "x", empty("s"))
        if sent.schema["x"].dataType != total.schema["x"].dataType:
            total = total.withColumn("x", F.col("x").cast(many))
            sent = sent.withColumn("x", F.col("x").cast(many))
        total = total.unionByName(sent)
    return added(total).select(F.col("node").alias(key), F.transform("s", lambda x: x / (layers + 1)).alias(vec))


def poincare(emb: DataFrame, vec: str, curvature: float = 1.0) -> DataFrame:
    """Vectors squashed into the unit ball by tanh(norm / 2), with their norm and depth."""
    norm = F.greatest(F.sqrt(array_sum(F.transform(vec, lambda x: x * x))), F.lit(1e-8))
    out = emb.withColumn("_n", norm).withColumn(f"{vec}_norm", F.tanh(F.col("_n") / 2))
    depth = F.atanh(F.least(F.col(f"{vec}_norm"), F.lit(0.999))) / max(math.sqrt(curvature), 1e-6)
    out = out.withColumn(f"{vec}_depth", depth)
    return out.withColumn(vec, F.transform(vec, lambda x: x / F.col("_n") * F.col(f"{vec}_norm"))).drop("_n")


def merchant_svd(hist: DataFrame, key: str, cls: str, weight: str, n_classes: int, dim: int = 8) -> DataFrame:
    """Unit-length projection of each entity's class shares on the leading right singular vectors.

    `hist` has one row per (key, class). The class-by-class product matrix is n_classes squared and is
    the only thing that leaves the cluster.
    """
    from tallyframe.operators.learners import _gram

    total = hist.groupBy(F.col(key).alias("_g")).agg(F.sum(weight).alias("_t"))
    shares = hist.join(total, F.col(key) == F.col("_g")).drop("_g")
    per = shares.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(cls).cast("int"), F.col(weight) / F.greatest(F.col("_t"), F.lit(1e-10))))).alias("_m"))
    vec = per.select(key, F.array(*[F.coalesce(F.try_element_at("_m", F.lit(i)), F.lit(0.0)) for i in range(n_classes)]).alias("_v"))
    _, g, _ = _gram(vec, F.col("_v"), n_classes)
    _, v = np.linalg.eigh(g)
    top = v[:, ::-1][:, : min(dim, n_classes)].T
    top = top * np.where(top.sum(1) < 0, -1.0, 1.0)[:, None]  # a fixed sign per direction
    coords = [array_sum(F.zip_with("_v", F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b)) for row in top]
    out = vec.select(key, F.array(*coords).alias("_c"))
    norm = F.sqrt(array_sum(F.transform("_c", lambda x: x * x))) + 1e-8
    return out.withColumn("_n", norm).select(key, F.transform("_c", lambda x: x / F.col("_n")).alias("brand_embedding"))
