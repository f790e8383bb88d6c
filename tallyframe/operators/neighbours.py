"""Approximate nearest neighbours by cosine: an inverted index of cells with exact re-ranking.

A bounded sample of the corpus is clustered into cells; every row of the corpus is then filed under
the cell whose centre is most similar. A query looks into its `probes` most similar cells, and what it
finds there is ranked by exact similarities, so an answer is only ever incomplete, never wrong.
`tuned_probes` measures on sampled queries how many cells the wanted recall takes; with all cells the
search is exact (and `search.knn` stays for that).

Sizes. A row of the corpus is stored once. For a search, the rows of a cell meet the queries that
look into it: both are dealt into blocks of about `block` rows, so a cell (or copies of one vector)
may hold any share of the corpus. With as many cells as the square root of the rows, a query is compared with
probes x sqrt(rows) of them. Centres, MAX_CELLS at most, travel with the tasks; the table of block
counts has one row per cell and is broadcast.

Defined results: rows without a vector, with a NULL or NaN in it, or of length 0 are neither indexed
nor answered; ties rank by id; repeated rows are found as often as they occur; an empty corpus or
empty queries give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.search import BLOCK, best_matches, knn
from tallyframe.plans.session import written

#: Cells at most, rows of the sample they are fitted on, sampled queries that `tuned_probes` measures with.
MAX_CELLS, SAMPLE_ROWS, TUNE_QUERIES = 1 << 16, 200_000, 256


@dataclass(frozen=True)
class Index:
    """`rows` (id, v of unit length, w, cell) and the unit centres of the cells."""

    rows: DataFrame
    centres: np.ndarray


def _unit(df: DataFrame, key: str, vec: str, weight: str | None = None) -> DataFrame:
    """(id, v, w): usable vectors scaled to length 1."""
    v = F.col(vec).cast("array<double>")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(key).alias("id"), v.alias("v"), w.alias("w")).withColumn("z", size)
    return rows.where((F.col("z") > 0) & ~F.isnan("z")).select("id", F.transform("v", lambda x: x / F.col("z")).alias("v"), "w")


def _sampled(rows: DataFrame, total: int, want: int) -> DataFrame:
    """About `want` rows of `total`, chosen by the hash of their id."""
    if total <= want:
        return rows
    return rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(want / total * (1 << 30)))


def fit_cells(rows: DataFrame, total: int, cells: int | None = None, sample: int = SAMPLE_ROWS, seed: int = 1) -> np.ndarray:
    """Centres of `cells` cells (the square root of the rows, MAX_CELLS at most), fitted on about `sample` rows."""
    cells = min(cells or math.ceil(math.sqrt(total)), MAX_CELLS, max(1, total))
    few = written(_sampled(rows, total, max(sample, 4 * cells)).select(array_to_vector("v").alias("features")))
    model = KMeans(k=cells, maxIter=10, seed=seed, distanceMeasure="cosine").fit(few) if cells > 1 else None
    centres = np.array(model.clusterCenters()) if model else np.array([few.first()[0].toArray()])
    size = np.linalg.norm(centres, axis=1)
    return centres[size > 0] / size[size > 0, None]


def nearest_cells(centres: np.ndarray, vec: str, probes: int) -> Column:
    """The `probes` cells most similar to a unit vector, best first; cell 0 of an empty index."""
    if not len(centres):
        return F.array(F.lit(0))

    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x, out = np.array(v.tolist(), dtype="float64"), []
        for lo in range(0, len(x), 512):
            sims = x[lo : lo + 512] @ centres.T
            if probes == 1:
                out += list(sims.argmax(1)[:, None].astype(np.int32))
            else:
                out += list(np.argsort(-sims, axis=1, kind="stable")[:, :probes].astype(np.int32))
        return pd.Series(out)

    return run(F.col(vec))


def build(corpus: DataFrame, key: str, vec: str, cells: int | None = None, weight: str | None = None, sample: int = SAMPLE_ROWS) -> Index:
    """File every row of the corpus under its cell; the index is a stored table."""
    rows = written(_unit(corpus, key, vec, weight))
    total = rows.count()
    if not total:
        return Index(rows.withColumn("cell", F.lit(0)), np.zeros((0, 0)))
    centres = fit_cells(rows, total, cells, sample)
    return Index(written(rows.withColumn("cell", F.get(nearest_cells(centres, "v", 1), F.lit(0)))), centres)


def _best(k: int, exclude_same: bool):
    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"q": [], "c": [], "s": []})
        c = c.sort_values("id")  # equal similarities keep id order
        x, y = (np.array(d["v"].tolist()) for d in (q, c))
        return best_matches(x, y, c["w"].to_numpy(), q["id"].to_numpy(), c["id"].to_numpy(), k, exclude_same)

    return run


def dealt(index: Index, queries: DataFrame, probes: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Corpus rows and queries under the tiles (cell, c, q) in which they meet."""
    asked = written(queries.withColumn("cell", F.explode(nearest_cells(index.centres, "v", probes))))
    parts = lambda d, n: d.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n))
    tiles = F.broadcast(parts(index.rows, "cs").join(parts(asked, "qs"), "cell"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(f"{n}s")).cast("int").alias(n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"{n}s") - 1)).alias(n)
    rows = index.rows.join(tiles, "cell").select("id", "v", "w", "cell", own("c"), every("q"))
    return rows, asked.join(tiles, "cell").select("id", "v", "cell", own("q"), every("c"))


def search(index: Index, queries: DataFrame, qid: str, vec: str, k: int, probes: int, cid: str = "match", exclude_same: bool = True, block: int = BLOCK) -> DataFrame:
    """(qid, cid, similarity, rank): the k best corpus rows in each query's `probes` nearest cells."""
    rows, asked = dealt(index, _unit(queries, qid, vec).select("id", "v"), probes, block)
    out = T.StructType([T.StructField("q", queries.schema[qid].dataType), T.StructField("c", index.rows.schema["id"].dataType), T.StructField("s", T.DoubleType())])
    tile = ("cell", "c", "q")
    met = rows.groupBy(*tile).cogroup(asked.groupBy(*tile)).applyInPandas(_best(k, exclude_same), out)
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), F.asc("c")))).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(qid), F.col("c").alias(cid), F.col("s").alias("similarity"), "rank")


def recall(found: DataFrame, exact: DataFrame, qid: str, cid: str) -> DataFrame:
    """One row: `queries` and `links` of the exact answer, `hits` of them that were found, and their share `recall`."""
    hit = exact.join(found.select(qid, cid).distinct().withColumn("_hit", F.lit(1)), [qid, cid], "left")
    return hit.agg(F.count_distinct(qid).alias("queries"), F.count(F.lit(1)).alias("links"), F.count("_hit").alias("hits")).withColumn("recall", F.when(F.col("links") > 0, F.col("hits") / F.col("links")).otherwise(1.0))


def tuned_probes(index: Index, target: float = 0.95, k: int = 10, sample: int = TUNE_QUERIES, exclude_same: bool = True) -> int:
    """The fewest cells (a doubling number, or all) whose recall on sampled rows of the corpus is `target` or more.

    The sampled rows are compared with the whole corpus once, so the cost grows as the rows.
    """
    cells, total = len(index.centres), index.rows.count()
    if cells <= 1:
        return 1
    few = written(_sampled(index.rows, total, sample).select(F.col("id").alias("qid"), "v"))
    corpus = index.rows.select(F.col("id").alias("match"), "v", "w")
    exact = written(knn(few, corpus, "qid", "match", "v", k, weight="w", exclude_same=exclude_same).select("qid", "match"))
    probes = 1
    while probes < cells:
        found = search(index, few, "qid", "v", k, probes, exclude_same=exclude_same)
        if recall(found, exact, "qid", "match").first()["recall"] >= target:
            return probes
        probes *= 2
    return cells


def indexed_knn(queries: DataFrame, corpus: DataFrame, qid: str, cid: str, vec: str, k: int, weight: str | None = None, exclude_same: bool = True, target: float = 0.95, cells: int | None = None) -> DataFrame:
    """As `search.knn`, through an index tuned to the wanted recall."""
    index = build(corpus, cid, vec, cells, weight)
    name = f"{cid}_match" if cid == qid else cid
    return search(index, queries, qid, vec, k, tuned_probes(index, target, k, exclude_same=exclude_same), name, exclude_same)
