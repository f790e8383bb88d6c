"""Diversified re-ranking and nearest neighbours over vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.functions.stats import dot
from tallyframe.plans.session import GROUP_ROWS, written
from tallyframe.plans.skew import largest_group


#: Candidates of one key, with their vectors, up to which they are sorted into one task.
CANDIDATES = GROUP_ROWS // 16


def _greedy(base: DataFrame, key: str, pick: T.StructType, k: int, scored: Callable[[DataFrame], DataFrame], best: Column, hot: bool) -> DataFrame:
    """(key, p, c): the k picks of every key, each the least `best` of the candidates that are left.

    `scored` adds the columns that `best` reads, given the picks so far in `_c`. The candidates are
    shuffled once and all rounds are windows over them; `hot` keys (more than CANDIDATES rows) take a
    combined aggregate and a join per round instead, so that they meet in no single task.
    """
    none = F.array().cast(T.ArrayType(pick))
    grown = F.when(F.col("_b").isNull(), F.col("_c")).otherwise(F.concat("_c", F.array(F.col("_b")))).alias("_c")
    cand = base.withColumn("_c", none)
    for at in range(k):
        if hot:
            chosen = scored(cand).groupBy(key).agg(F.first("_c").alias("_c"), best.alias("_b")).select(key, grown)
            cand = base.join(chosen, key) if at + 1 < k else chosen
        else:
            cand = scored(cand).withColumn("_b", best.over(Window.partitionBy(key))).select(*base.columns, grown)
    slim = F.transform("_c", lambda c: F.struct(*[c[f.name].alias(f.name) for f in pick.fields if f.name not in ("v", "row")]))
    picks = cand.select(key, slim.alias("_c"))
    return (picks if hot and k else picks.groupBy(key).agg(F.first("_c").alias("_c"))).select(key, F.posexplode("_c").alias("p", "c"))


def mmr(df: DataFrame, key: str, item: str, score: str, vec: str, k: int, lam: float = 0.7, min_score: float | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """Maximal marginal relevance: the k chosen items per key with rank and value.

    No candidate is cut off, see `_greedy`; vectors travel once and as they are given. Ties go to the
    higher score, then the smaller item. A missing vector is unlike every other.
    """
    rows = (df if min_score is None else df.where(F.col(score) >= min_score)).where(F.col(key).isNotNull())
    hot = largest_group(rows, [key]) > candidates
    rows = rows.select(key, F.col(item).alias("_i"), F.col(score).alias("_o"), F.col(vec).alias("_v"))
    if hot:
        rows = rows.join(rows.groupBy(key).agg(F.min("_o").alias("_lo"), F.max("_o").alias("_hi")), key)
    else:
        w = Window.partitionBy(key)
        rows = rows.withColumns({"_lo": F.min("_o").over(w), "_hi": F.max("_o").over(w)})
    rel = F.when(F.col("_hi") > F.col("_lo"), (F.col("_o") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))).otherwise(F.col("_o") - F.col("_lo"))
    base = _unit(rows.select(key, "_i", F.col("_o").cast("double").alias("_s"), "_v", rel.alias("_rel")))
    base = written(base) if hot else base  # read once per round
    types = {f.name: f.dataType for f in base.schema.fields}
    # field names have to survive inside the aggregate buffer, so the struct is cast once by name
    pick = T.StructType([T.StructField(n, t) for n, t in (("neg", T.DoubleType()), ("negs", T.DoubleType()), ("i", types["_i"]), ("v", types["_v"]))])

    def scored(cand: DataFrame) -> DataFrame:
        sims = F.transform("_c", lambda c: F.coalesce(dot(F.col("_v"), c["v"]), F.lit(0.0)))
        worst = F.greatest(F.coalesce(F.array_max(sims), F.lit(0.0)), F.lit(0.0))
        return cand.withColumn("_val", lam * F.col("_rel") - (1.0 - lam) * worst)

    taken = F.exists("_c", lambda c: c["i"] == F.col("_i"))
    best = F.min(F.when(~taken, F.struct((-F.col("_val")).alias("neg"), (-F.col("_s")).alias("negs"), F.col("_i").alias("i"), F.col("_v").alias("v"))))
    out = _greedy(base, key, pick, k, scored, best, hot)
    return out.select(key, F.col("c.i").alias(item), (-F.col("c.negs")).alias(score), (F.col("p") + 1).alias("rank"), (-F.col("c.neg")).alias("mmr"))


def _unit(df: DataFrame) -> DataFrame:
    """`_v` as doubles of unit length; NULL where it has none."""
    size = F.sqrt(dot(F.col("_v"), F.col("_v")))
    df = df.withColumn("_v", F.transform("_v", lambda x: x.cast("double"))).withColumn("_z", size)
    return df.withColumn("_v", F.when(F.col("_z") > 0, F.transform("_v", lambda x: x / F.col("_z")))).drop("_z")


def dpp(df: DataFrame, key: str, item: str, score: str, vec: str, k: int, lam: float = 0.7, candidates: int = CANDIDATES) -> DataFrame:
    """Greedy determinantal ranking of all candidates of a key: (key, item, score, rank).

    The kernel of two items is the product of their qualities (a blend of the score's share of the
    key's best score and 1) times their cosine; 1e-8 is added to its diagonal. Adding an item
    multiplies the determinant by what is left of its diagonal entry after projecting on the chosen
    items, so each round takes the item with the most left. The projections are rows of the
    Cholesky factor, computed for all candidates from the chosen items alone, see `_greedy`. Ties go
    to the higher score, then the smaller item; a missing vector is unlike every other.
    """
    rows = df.where(F.col(key).isNotNull())
    hot = largest_group(rows, [key]) > candidates
    rows = rows.select(key, F.col(item).alias("_i"), F.col(score).cast("double").alias("_s"), F.col(vec).alias("_v"))
    top = F.max("_s").alias("_top")
    rows = rows.join(rows.groupBy(key).agg(top), key) if hot else rows.withColumn("_top", F.max("_s").over(Window.partitionBy(key)))
    quality = lam * F.col("_s") / (F.col("_top") + 1e-12) + (1.0 - lam)
    base = _unit(rows.select(key, "_i", "_s", "_v", quality.alias("_q")))
    base = written(base) if hot else base  # read once per round
    kinds = {f.name: f.dataType for f in base.schema.fields}
    numbers = T.ArrayType(T.DoubleType())
    pick = T.StructType(
        [T.StructField("left", T.DoubleType()), T.StructField("negs", T.DoubleType()), T.StructField("i", kinds["_i"]), T.StructField("v", kinds["_v"]), T.StructField("q", T.DoubleType()), T.StructField("row", numbers)]
    )

    def project(row: Column, c: Column) -> Column:
        kernel = F.col("_q") * c["q"] * F.coalesce(dot(F.col("_v"), c["v"]), F.lit(0.0))
        return F.array_append(row, (kernel - dot(row, F.slice(c["row"], 1, F.size(row)))) / F.sqrt(-c["left"]))

    def scored(cand: DataFrame) -> DataFrame:
        return cand.withColumn("_row", F.aggregate("_c", F.array().cast(numbers), project))

    left = F.col("_q") * F.col("_q") + 1e-8 - F.coalesce(dot(F.col("_row"), F.col("_row")), F.lit(0.0))
    taken = F.exists("_c", lambda c: c["i"] == F.col("_i"))
    best = F.min(F.when(~taken, F.struct((-F.greatest(left, F.lit(1e-300))).alias("left"), (-F.col("_s")).alias("negs"), F.col("_i").alias("i"), F.col("_v").alias("v"), F.col("_q").alias("q"), F.col("_row").alias("row"))))
    out = _greedy(base, key, pick, k, scored, best, hot)
    return out.select(key, F.col("c.i").alias(item), (-F.col("c.negs")).alias(score), (F.col("p") + 1).alias("rank"))


#: Queries or corpus rows of one block, and bytes of its vectors.
BLOCK, BLOCK_BYTES = 4096, 1 << 20


def _best_at(x: np.ndarray, y: np.ndarray, w: np.ndarray, ids: np.ndarray, match: np.ndarray, k: int, exclude_same: bool, slab: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of `ids`, rows of `match` (in ascending order) and weighted product of the k best for each of `ids`, the first of equal ones.

    The k-th largest of the maxima of strips of columns is at most a row's k-th best similarity, so
    only what reaches it is sorted.
    """
    out, cuts, weighted = [], len(match) // 64 * 64, not (w == 1).all()
    odd = not all(np.isfinite(a).all() for a in (x, y, w))
    for lo in range(0, len(x), slab):
        own = ids[lo : lo + slab]
        sims = x[lo : lo + slab] @ y.T
        if weighted:
            sims *= w[None, :]
        if exclude_same and match.dtype == object:
            sims[own[:, None] == match[None, :]] = -np.inf
        elif exclude_same:
            first, last = np.searchsorted(match, own, "left"), np.searchsorted(match, own, "right")
            for r in np.flatnonzero((last > first) & (own == own)):
                sims[r, first[r] : last[r]] = -np.inf
        if odd:
            sims[np.isnan(sims)] = -np.inf
        least = -np.inf
        if cuts // 64 >= k:
            tops = sims[:, :cuts].reshape(len(own), 64, -1).max(1)
            least = np.partition(tops, -k, axis=1)[:, -k, None]
        row, col = np.divmod(np.flatnonzero(sims >= least), len(match))
        s = sims[row, col]
        at = np.lexsort((col, -s, row))
        row, col, s = row[at], col[at], s[at]
        top = (np.arange(len(row)) - np.searchsorted(row, row) < k) & np.isfinite(s)
        out.append((row[top] + lo, col[top], s[top]))
    return tuple(np.concatenate(a) for a in zip(*out))


def best_matches(x: np.ndarray, y: np.ndarray, w: np.ndarray, ids: np.ndarray, match: np.ndarray, k: int, exclude_same: bool, slab: int = 512) -> pd.DataFrame:
    """(q, c, s): the k best of `match` for each of `ids`, see `_best_at`."""
    row, col, s = _best_at(x, y, w, ids, match, k, exclude_same, slab)
    return pd.DataFrame({"q": ids[row], "c": match[col], "s": s})


def _pack(block: int):
    """Rows (id, v, w) as blocks (ids, v, w, n) of at most `block` rows in the order of their ids."""

    def packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(set(pc.list_value_length(batch["v"]).to_pylist())) > 1:
            raise ValueError("vectors of different lengths")
        flat = batch["v"].flatten()
        v = pc.fill_null(flat, pa.scalar(float("nan"), flat.type)).to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        order = pd.Series(batch["id"].to_pandas()).sort_values(kind="stable").index.to_numpy()
        w, most = batch["w"].to_numpy(zero_copy_only=False), min(block, max(256, BLOCK_BYTES // max(1, v[:1].nbytes)))
        for lo in range(0, len(order), most):
            at = order[lo : lo + most]
            ids = batch["id"].take(pa.array(at))
            yield pa.RecordBatch.from_pydict({"ids": pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids), "v": [v[at].tobytes()], "w": [w[at].astype("float64").tobytes()], "n": pa.array([len(at)], pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held, rows = [*held, b], rows + b.num_rows
            if rows >= block:
                table = pa.Table.from_batches(held).combine_chunks()
                whole = rows // block * block
                for part in table.slice(0, whole).combine_chunks().to_batches():
                    yield from packed(part)
                held, rows = table.slice(whole).to_batches(), rows - whole
        for part in pa.Table.from_batches(held).combine_chunks().to_batches() if rows else ():
            yield from packed(part)

    return run


def _nearest(k: int, exclude_same: bool, width: str, kind: pa.DataType):
    """Pairs of a corpus block and a query block as the k best corpus rows of each query, over all corpus blocks of the task."""

    def rows(ids: pa.Scalar, v: pa.Scalar, n: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(v.as_buffer(), width).reshape(n, -1).astype("float64")
        size = np.linalg.norm(x, axis=1)
        return ids.values.to_pandas().to_numpy(), x / np.where(size > 0, size, 1.0)[:, None]

    def best(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["row", "s", "c"], ascending=[True, False, True], na_position="first", kind="stable")
        return found[found.groupby("row").cumcount() < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[bytes, list] = {}
        for b in batches:
            cid, y, mine = None, None, None
            for at in range(b.num_rows):
                get = lambda c: b[c][at]  # noqa: B023, E731
                if mine is None or not get("cv").equals(mine):
                    mine = get("cv")
                    cid, y = rows(get("cids"), mine, get("cn").as_py())
                    w = np.frombuffer(get("cw").as_buffer(), "float64")
                if (own := get("q").as_py()) not in queries:
                    queries[own] = [*rows(get("qids"), get("qv"), get("qn").as_py()), [], 0]
                q = queries[own]
                row, col, s = _best_at(q[1], y, w, q[0], cid, k, exclude_same)
                q[2].append(pd.DataFrame({"row": row, "c": cid[col], "s": s}))
                q[3] += len(row)
                if q[3] > 8 * k * len(q[0]):
                    q[2] = [best(pd.concat(q[2]))]
                    q[3] = len(q[2][0])
        for ids, _, found, _ in queries.values():
            got = best(pd.concat(found))
            ids = pd.Series(ids)[got["row"].to_numpy()]
            yield pa.RecordBatch.from_arrays([*(pa.Array.from_pandas(c).cast(t) for c, t in zip((ids, got["c"]), kind)), pa.array(got["s"].to_numpy())], ["q", "c", "s"])

    return run


def knn(queries: DataFrame, corpus: DataFrame, qid: str, cid: str, vec: str, k: int, weight: str | None = None, exclude_same: bool = True, block: int = BLOCK) -> DataFrame:
    """Exact k nearest corpus rows by cosine for every query: (qid, cid, similarity, rank).

    Queries are dealt by hash into parts of about `block` rows, the corpus is stored once as packed
    blocks. Every part of the queries meets every block in a cartesian product, which shuffles nothing:
    a task holds its queries, reads one block after the other, multiplies the two and keeps the k best
    per query. So the driver sees one count only, disk grows as the rows (and the k found ones for each
    of the few parts that the blocks are read in) and only the work grows as the pairs. `weight` (for
    instance an age decay) multiplies the similarity. Ties rank by id. Rows without a vector are
    neither found nor answered. Sets the session's bytes of an Arrow batch, as a row is a block.
    """
    spark = queries.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    kinds = {queries.schema[vec].dataType.elementType, corpus.schema[vec].dataType.elementType}
    item, width = ("float", "float32") if kinds == {T.FloatType()} else ("double", "float64")
    one = F.lit(1.0)
    sides = [d.select(F.col(i).alias("id"), F.col(vec).cast(f"array<{item}>").alias("v"), w.alias("w")).where("v IS NOT NULL") for d, i, w in ((queries, qid, one), (corpus, cid, F.col(weight).cast("double") if weight else one))]
    types = [queries.schema[qid].dataType, corpus.schema[cid].dataType]
    form = lambda t: T.StructType([T.StructField("ids", T.ArrayType(t)), T.StructField("v", T.BinaryType()), T.StructField("w", T.BinaryType()), T.StructField("n", T.IntegerType())])
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, -(-sides[0].count() // block))
    asked = sides[0].repartition(parts, "id").mapInArrow(_pack(block), form(types[0]))
    asked = asked.select(F.concat(F.spark_partition_id().cast("string"), F.lit(":"), F.monotonically_increasing_id().cast("string")).alias("q"), F.col("ids").alias("qids"), F.col("v").alias("qv"), F.col("n").alias("qn"))
    blocks = written(sides[1].mapInArrow(_pack(block), form(types[1])))
    blocks = blocks.coalesce(max(1, -(-3 * cores // parts))).select(F.col("ids").alias("cids"), F.col("v").alias("cv"), F.col("w").alias("cw"), F.col("n").alias("cn"))
    out = T.StructType([*(T.StructField(n, t) for n, t in zip("qc", types)), T.StructField("s", T.DoubleType())])
    kind = [f.type for f in to_arrow_schema(out)][:2]
    met = blocks.crossJoin(asked.hint("shuffle_replicate_nl")).mapInArrow(_nearest(k, exclude_same, width, kind), out)
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), F.asc("c")))).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(qid), F.col("c").alias(f"{cid}_match" if cid == qid else cid), F.col("s").alias("similarity"), "rank")


def age_decay(df: DataFrame, ts: str, now: str, half_life_days: float, name: str = "decay") -> DataFrame:
    """0.5 ^ (age / half-life); rows without a time do not decay."""
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp"))) / 86400.0
    return df.withColumn(name, F.coalesce(F.exp(-age * float(np.log(2)) / half_life_days), F.lit(1.0)))
