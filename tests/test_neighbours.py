"""The cell index against brute force: exactness with all cells, recall, skew, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import latent, neighbours, search

SCHEMA = "id long, v array<double>"


def clustered(n, groups=40, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(groups, size=n)] + 0.15 * rng.normal(size=(n, dims))


def brute(x, queries, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in queries:
        s = u @ u[q]
        s[q] = -np.inf
        out[q] = sorted(range(len(x)), key=lambda i: (-round(s[i], 12), i))[:k]
    return out


def answers(df):
    got = {}
    for r in df.orderBy("rank").collect():
        got.setdefault(r["id"], []).append(r["match"])
    return got


def test_all_cells_are_exact_in_small_blocks(spark):
    x = clustered(600)
    x[::3] = x[0]  # copies of one vector hold a third of all rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    index = neighbours.build(df, "id", "v", cells=12)
    assert index.rows.count() == 600
    got = answers(neighbours.search(index, df.where("id % 20 = 0"), "id", "v", 5, len(index.centres), block=50))
    want = brute(x, range(0, 600, 20), 5)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert set(got) == set(want)
    for q in want:  # equal vectors differ in the last bits, so similarities are compared
        assert np.allclose([u[q] @ u[i] for i in got[q]], [u[q] @ u[i] for i in want[q]], atol=1e-12)


def test_few_cells_reach_the_recall_and_compare_few_rows(spark):
    x = clustered(4000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    index = neighbours.build(df, "id", "v")
    probes = neighbours.tuned_probes(index, 0.95, 5)
    assert probes <= len(index.centres) // 4
    q = df.where("id % 20 = 0")
    exact = search.knn(q.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "match"), "qid", "match", "v", 5)
    found = neighbours.search(index, q.withColumnRenamed("id", "qid"), "qid", "v", 5, probes, exclude_same=True)
    told = neighbours.recall(found, exact, "qid", "match").first()
    assert told["queries"] == 200 and told["links"] == 1000 and told["recall"] >= 0.9


@pytest.mark.parametrize("n", [1000, 4000])
def test_hot_cells_are_dealt_and_copies_stay_linear(spark, n):
    x = clustered(n)
    x[: n // 3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    index = neighbours.build(df, "id", "v")
    few = neighbours._unit(df.where("id % 20 = 0"), "id", "v").select("id", "v")
    rows, asked = neighbours.dealt(index, few, 4, block=100)
    sizes = [r["count"] for r in rows.groupBy("cell", "c", "q").count().collect()]
    assert max(sizes) <= 200  # about a block, however hot the cell
    assert rows.count() <= 4 * n and asked.count() <= 4 * (n // 20) * (1 + n // 3 // 100)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "id long, v array<double>, w string, cell int")
    index = neighbours.build(df, "id", "v", cells=2)
    assert index.rows.count() == 5
    got = {(r["id"], r["match"], round(r["similarity"], 6), r["rank"]) for r in neighbours.search(index, df.where("id in (1, 2, 3)"), "id", "v", 3, len(index.centres)).collect()}
    assert got == {(1, 6, 1.0, 1), (1, 6, 1.0, 2), (1, None, 0.707107, 3)}
    none = df.limit(0)
    assert neighbours.search(neighbours.build(none, "id", "v"), df, "id", "v", 3, 1).count() == 0
    assert neighbours.search(index, none, "id", "v", 3, 1).count() == 0
    assert neighbours.tuned_probes(neighbours.build(none, "id", "v")) == 1


def test_weights_and_graph(spark):
    x = clustered(300, groups=6)
    df = spark.createDataFrame([(i, v.tolist(), 0.5 + (i % 2) / 2) for i, v in enumerate(x)], "id long, v array<double>, decay double")
    a = search.knn(df.select(F.col("id").alias("qid"), "v"), df, "qid", "id", "v", 3, "decay")
    b = neighbours.indexed_knn(df.select(F.col("id").alias("qid"), "v"), df, "qid", "id", "v", 3, "decay", target=1.0)
    assert neighbours.recall(b, a, "qid", "id").first()["recall"] >= 0.95
    graph = latent.knn_graph(df, "id", "v", 4, find=neighbours.indexed_knn)
    assert graph.where("src = dst").count() == 300 and graph.exceptAll(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).count() == 0


def test_exact_search_shuffles_no_pairs(spark, capsys):
    """Blocks meet in a cartesian product; ids come twice and may be missing, as may vectors and their numbers."""
    x = clustered(120, groups=5, dims=6)
    rows = [(i % 100 if i else None, v.astype("float32").tolist()) for i, v in enumerate(x)] + [(200, None), (201, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (202, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    found = search.knn(df.withColumnRenamed("id", "q"), df, "q", "id", "v", 3, block=16)
    found.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan
    u = np.array([np.array(v, dtype="float64") / np.linalg.norm(np.array(v, dtype="float64")) for _, v in rows[:120]])
    best = {}
    for at, (q, _) in enumerate(rows[:120]):
        sims = [(round(float(u[at] @ u[i]), 9), c) for i, (c, _) in enumerate(rows[:120]) if c != q or q is None] + [(0.0, 202)]
        best[q] = sorted([*best.get(q, []), *(s for s, _ in sims)], reverse=True)[:3]
    best[202] = [0.0] * 3
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r["q"], []).append(round(r["similarity"], 9))
    assert set(got) == set(best)
    for q in best:
        assert np.allclose(got[q], best[q], atol=2e-9)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_propagation_sums_whole_vectors(spark, capsys, kind):
    """A hub, repeated keys, vectors of other lengths, missing numbers and weights, against the sums by node and dimension."""
    rows = [(i, [float(i + d) for d in range(3)]) for i in range(50)] + [(7, [1.0, 2.0, 3.0]), (8, [5.0]), (9, [None, 1.0, None]), (60, None), (61, []), (62, [None]), (None, [1.0, 1.0, 1.0])]
    emb = spark.createDataFrame(rows, f"id long, v array<{kind}>").repartition(3)
    links = [(0, i, 0.5) for i in range(50)] + [(i, 0, 0.25) for i in range(1, 50)] + [(1, 9, None), (2, 60, 1.0), (3, 62, 1.0), (70, 9, 2.0), (71, 99, 1.0), (None, 4, 1.0), (5, None, 1.0)]
    edges = spark.createDataFrame(links, "src long, dst long, w double")
    layer = total = emb.select(F.col("id").alias("node"), F.posexplode(F.col("v").cast("array<double>")).alias("d", "x"))
    for _ in range(2):
        layer = edges.join(layer.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "d").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        total = total.unionByName(layer)
    want = {}
    for r in total.groupBy("node", "d").agg((F.sum("x") / 3).alias("x")).collect():
        want.setdefault(r["node"], {})[r["d"]] = r["x"]
    out = latent.propagate(edges, emb, "id", "v", 2)
    out.explain()
    assert "Generate" not in capsys.readouterr().out
    got = {r["id"]: r["v"] for r in out.collect()}
    assert set(got) == set(want)
    for node, cells in want.items():
        assert len(got[node]) == len(cells)
        for d, x in cells.items():
            assert (got[node][d] is None) == (x is None) and (x is None or abs(got[node][d] - x) < 1e-9), (node, d)
