"""The chunked plans must give exactly what the plain windows give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyframe.operators import aggs, evaluate, generators, joins, ranks, sequences, windows
from tallyframe.plans import quantiles, skew

BIG, SMALL = 10**9, 7


@pytest.fixture(scope="module")
def events(spark):
    """One key holds a third of the rows; values have many ties."""
    rng = np.random.default_rng(1)
    data = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{int(rng.integers(0, 40))}"
        data.append((key, int(rng.integers(0, 100)), i, float(np.round(rng.normal(10, 4), 1))))
    return spark.createDataFrame(data, "k string, t int, id int, x double").repartition(5).cache()


def same(a, b, digits=9):
    ra, rb = rows(a), rows(b)
    assert len(ra) == len(rb)
    for p, q in zip(ra, rb):
        for u, v in zip(p, q):
            if isinstance(u, float) and u is not None and v is not None:
                assert math.isclose(u, v, rel_tol=10**-digits, abs_tol=10**-digits), (p, q)
            else:
                assert u == v, (p, q)


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sums_and_maxima(events, keys):
    def run(limit):
        return skew.running(events, keys, ["t", "id"], {"s": F.col("x"), "n": F.lit(1).cast("long")}, {"m": F.struct("t", "id")}, limit).select("id", F.round("s", 6).alias("s"), "n", F.col("m.id").alias("m"))

    same(run(BIG), run(SMALL))


def test_position_is_total(events):
    got = skew.position(events, [], ["t", "id"], "p", SMALL).select("t", "id", "p").orderBy("p").collect()
    assert [r["p"] for r in got] == list(range(1, 601))
    assert [(r["t"], r["id"]) for r in got] == sorted((r["t"], r["id"]) for r in got)


@pytest.mark.parametrize("width", [2, 5, 40])
def test_rolling_windows(events, width):
    def run(limit):
        out = windows.rolling_rows(events, ["k"], ["t", "id"], ["x"], [width], group_rows=limit)
        return out.select("id", *[F.round(c, 9).alias(c) for c in out.columns if c.startswith("x_")])

    same(run(BIG), run(SMALL))


def test_lag_family(events):
    def run(limit):
        out = windows.derivatives(events, ["k"], ["t", "id"], "x", limit)
        out = windows.step_velocity(out, ["k"], ["t", "id"], "x", [3, 11], limit)
        out = windows.rolling_slope(out, ["k"], ["t", "id"], "x", 6, group_rows=limit)
        out = windows.lag_ratio(out, ["k"], ["t", "id"], "x", "x", group_rows=limit)
        return out.drop("k", "t")

    same(run(BIG), run(SMALL))


def test_exponential_averages(events, spark):
    def run(limit):
        out = windows.ema(events, ["k"], ["t", "id"], "x", {"a": 0.3, "b": 0.6}, limit)
        return windows.ewm(out, ["k"], ["t", "id"], "x", 2.0, limit).select("id", "x_ema_a", "x_ema_b", "x_recency")

    same(run(BIG), run(40))
    # against the recursion itself
    pdf = events.where("k = 'hot'").toPandas().sort_values(["t", "id"])
    e, want = None, {}
    for r in pdf.itertuples():
        e = r.x if e is None else 0.3 * r.x + 0.7 * e
        want[r.id] = e
    got = {r["id"]: r["x_ema_a"] for r in run(BIG).collect()}
    assert all(math.isclose(got[i], v, rel_tol=1e-9) for i, v in want.items())


def test_exponential_averages_across_batches(spark):
    df = spark.range(500).select(F.lit("a").alias("k"), F.col("id"), (F.col("id") % 7).cast("double").alias("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = [r["x_recency"] for r in windows.ewm(df, ["k"], ["id"], "x", 3.0).orderBy("id").collect()]
        ema = [r["x_ema_a"] for r in windows.ema(df, ["k"], ["id"], "x", {"a": 0.25}).orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    xs, w = [i % 7 for i in range(500)], 0.5 ** (1 / 3.0)
    num = den = 0.0
    e = None
    for x, g, h in zip(xs, got, ema):
        num, den = x + w * num, 1 + w * den
        e = x if e is None else 0.25 * x + 0.75 * e
        assert math.isclose(g, num / den, rel_tol=1e-9) and math.isclose(h, e, rel_tol=1e-9, abs_tol=1e-12)


def test_attention_and_time_constants(events):
    def run(limit):
        out = windows.period_attention(events, ["k"], ["t", "id"], "x", group_rows=limit)
        return windows.time_constants(out, ["k"], ["t", "id"], "x", [1, 7], limit).drop("k", "t")

    same(run(BIG), run(30), 6)


def test_asof_join(events, spark):
    left = events.select("k", F.col("t").alias("at"), F.col("id").alias("lid")).where("id % 2 = 0")
    facts = events.select("k", F.col("t").alias("since"), F.col("id").alias("fid")).where("id % 5 = 0")
    a = joins.asof_join(left, facts, ["k"], "at", "since", ["fid"])
    b = joins.asof_join(left, facts, ["k"], "at", "since", ["fid"], group_rows=SMALL)
    same(a, b)
    l, f = left.collect(), facts.collect()
    want = {}
    for r in l:
        past = [(q["since"], q["fid"]) for q in f if q["k"] == r["k"] and q["since"] <= r["at"]]
        want[r["lid"]] = max(past)[1] if past else None
    assert {r["lid"]: r["fid"] for r in a.collect()} == want


def test_value_positions_auc_and_gini(events):
    y = events.withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    for keys in (["k"], []):
        same(ranks.auc(y, keys, "y", "x"), ranks.auc(y, keys, "y", "x", group_rows=SMALL))
        same(ranks.gini(y.withColumn("z", F.abs("x")), keys, "z"), ranks.gini(y.withColumn("z", F.abs("x")), keys, "z", group_rows=SMALL))
    pdf = y.toPandas()
    pos, neg = pdf[pdf.y == 1].x.to_numpy(), pdf[pdf.y == 0].x.to_numpy()
    wins = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert math.isclose(ranks.auc(y, [], "y", "x").first()[0], wins)


def test_spearman_matches_rank_correlation(events):
    df = events.withColumn("z", F.col("x") * 2 + F.col("id") % 5)
    pdf = df.toPandas()
    want = pdf.x.rank().corr(pdf.z.rank())
    assert math.isclose(ranks.spearman(df, [], "x", "z").first()[0], want, rel_tol=1e-9)
    assert math.isclose(ranks.spearman(df, [], "x", "z", group_rows=SMALL).first()[0], want, rel_tol=1e-9)


@pytest.mark.parametrize("col", ["x", "t"])
def test_exact_quantiles_of_chunked_columns(events, col):
    probs = [0.0, 0.013, 0.25, 0.5, 0.77, 0.995, 1.0]
    direct = quantiles.exact_quantiles(events, [col], probs)[col]
    chunked = quantiles.exact_quantiles(events, [col], probs, group_rows=SMALL)[col]
    assert np.allclose(direct, chunked, atol=1e-12)
    assert np.allclose(direct, np.quantile(events.toPandas()[col], probs), atol=1e-9)


def test_exact_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_quantiles(df, ["v"], [0.5]) == {"v": [None]}
    assert quantiles.exact_quantiles(df, ["v"], [0.5], group_rows=0) == {"v": [None]}


def test_exact_quantiles_of_odd_values(spark):
    """Infinity, NaN, NULL, constants and denormals, all columns in one call, plain and chunked."""
    inf, nan = math.inf, math.nan
    cols = {
        "inf": [float(i) for i in range(198)] + [inf, -inf],
        "nan": [float(i) for i in range(199)] + [nan],
        "flat": [7.0] * 200,
        "tiny": [i * 5e-324 for i in range(200)],
        "some": [None if i % 3 else float(i) for i in range(200)],
        "gone": [None] * 200,
        "ends": [inf] * 100 + [-inf] * 100,
    }
    df = spark.createDataFrame([(i, *(v[i] for v in cols.values())) for i in range(200)], "id int, " + ", ".join(f"{c} double" for c in cols))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for rows_ in (1_000_000, 10):
        got = quantiles.exact_quantiles(df, list(cols), probs, group_rows=rows_)
        for c, v in cols.items():
            here = sorted((x for x in v if x is not None), key=lambda x: (x != x, x))
            for p, g in zip(probs, got[c]):
                if not here:
                    assert g is None
                    continue
                s = p * (len(here) - 1)
                lo, hi = here[math.floor(s)], here[math.ceil(s)]
                want = lo if lo == hi or s == math.floor(s) else (1 - s % 1) * lo + (s % 1) * hi
                assert (g != g and want != want) or g == want or math.isclose(g, want, rel_tol=1e-12), (c, p)


def test_grouped_quantiles(events):
    got = generators.grouped_quantiles(events, ["k"], "x", [0.0, 0.3, 1.0], SMALL).collect()
    pdf = events.toPandas()
    for r in got:
        assert np.allclose(r["q"], np.quantile(pdf[pdf.k == r["k"]].x, [0, 0.3, 1]))


def test_segmented_sequences_keep_every_event(events):
    one = sequences.collect_sequences(events, "k", ["t", "id"], {"ids": "id"}).collect()
    many = sequences.collect_sequences(events, "k", ["t", "id"], {"ids": "id"}, segment_rows=10).collect()
    assert all(len(r["ids"]) <= 10 for r in many)
    for r in one:
        parts = sorted((q["segment"], q["ids"]) for q in many if q["k"] == r["k"])
        assert [i for _, ids in reversed(parts) for i in ids] == r["ids"]
        assert all(len(ids) == 10 for _, ids in parts[:-1])


def test_histories_are_one_row_per_entity(events):
    """Cut lists hold exactly the newest or oldest events; no cut changes the grain."""
    whole = {r["k"]: r["ids"] for r in sequences.collect_sequences(events, "k", ["t", "id"], {"ids": "id"}).collect()}
    new = sequences.collect_sequences(events, "k", ["t", "id"], {"ids": "id"}, newest=3).collect()
    old = sequences.collect_sequences(events, "k", ["t", "id"], {"ids": "id"}, oldest=3).collect()
    assert len(new) == len(old) == len(whole)
    assert all(r["ids"] == whole[r["k"]][-3:] for r in new) and all(r["ids"] == whole[r["k"]][:3] for r in old)


def test_recent_k_beyond_the_window_limit(spark, events):
    a = windows.recent_k(events, ["k"], ["t", "id"], 30).select("k", "id", "recency")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    try:
        b = windows.recent_k(events, ["k"], ["t", "id"], 30).select("k", "id", "recency")
        same(a, b)
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_recent_k_cuts_before_the_shuffle(events):
    plan = windows.recent_k(events, ["k"], ["t", "id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_uplift_metrics_chunked(events):
    df = events.withColumns({"tr": F.col("id") % 2, "y": (F.col("id") % 7 == 0).cast("int"), "u": F.col("x")})
    same(evaluate.uplift_metrics(df, "u", "tr", "y", "id"), evaluate.uplift_metrics(df, "u", "tr", "y", "id", group_rows=SMALL))


def test_qini_by_hand(spark):
    data = [(1, 0.9, 1, 1), (2, 0.8, 0, 0), (3, 0.7, 1, 1), (4, 0.6, 0, 1), (5, 0.5, 1, 0), (6, 0.4, 0, 0)]
    df = spark.createDataFrame(data, "id int, u double, t int, y int")
    vals, nt, yt, nc, yc = [], 0, 0.0, 0, 0.0
    for _, _, t, y in data:
        nt, yt, nc, yc = (nt + 1, yt + y, nc, yc) if t else (nt, yt, nc + 1, yc + y)
        vals.append(0.0 if not nt or not nc else yt - yc * nt / nc)
    perfect = 2 - 1 * 3 / 3
    assert math.isclose(evaluate.uplift_metrics(df, "u", "t", "y", "id").first()["qini"], sum(vals) / 6 / perfect)


def test_consistency_chunked(spark, events):
    df = events.withColumn("text", F.concat_ws(" ", F.lit("a"), (F.col("id") % 5).cast("string"), (F.col("t") % 3).cast("string")))
    same(evaluate.consistency(df, ["k"], "id", "text", 4), evaluate.consistency(df, ["k"], "id", "text", 4, group_rows=SMALL))


def test_median_gap_counts_same_day_pairs(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-01"), ("a", "2024-01-01"), ("a", "2024-01-11"), ("b", "2024-01-05")], "u string, d string").withColumn("d", F.to_date("d"))
    got = {r["u"]: r["median_gap"] for r in aggs.median_gap(df, "u", "d").collect()}
    assert got == {"a": 0.0}  # gaps 0, 0, 10


def test_written_tables_use_the_named_folder(spark, events):
    from tallyframe.plans.session import shared_dir, written

    out = written(events)
    assert out.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared_dir(spark).lstrip("/"))
    assert out.count() == 600
