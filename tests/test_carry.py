"""Carried averages, dyadic intervals and segmented hidden states against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import hidden, joins, latent, windows


def plain_ema(xs, d):
    out, e = [], None
    for x in xs:
        e = x if e is None else d * x + (1 - d) * e
        out.append(e)
    return out


def plain_ewm(xs, d):
    out, num, den = [], 0.0, 0.0
    for x in xs:
        num, den = x + (1 - d) * num, 1 + (1 - d) * den
        out.append(num / den)
    return out


@pytest.mark.parametrize("segment, group", [(100_000, 2_000_000), (40, 2_000_000), (7, 50)])
def test_averages_carry_over_segments(spark, monkeypatch, segment, group):
    """Values from 1e-30 to 1e30, weights from almost none to almost all, a hot key and NULL keys: all paths agree."""
    monkeypatch.setattr(windows, "SEGMENT", segment)
    rng = random.Random(1)
    series = {"hot": 900, "b": 50, None: 120, "one": 1}
    rows = [(k, i, rng.choice([-1, 1]) * 10.0 ** rng.uniform(-30, 30)) for k, n in series.items() for i in range(n)]
    for k, at in (("hot", 3), ("b", 0)):  # one huge value, then tiny ones: the weight must never be cut
        rows = [(q, i, 1e30 if (q, i) == (k, at) else (x * 1e-40 if q == "b" and i > at else x)) for q, i, x in rows]
    rows = [(k, i, None if i % 41 == 40 else x) for k, i, x in rows]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(5)
    decays = {"sure": 1.0, "fast": 1 / 3, "slow": 1 / 21, "sharp": 0.999, "lazy": 1e-7}
    got = windows.ema(df, ["k"], ["t"], "x", decays, group)
    got = windows.ewm(got, ["k"], ["t"], "x", 5.0, group)
    found = {(r["k"], r["t"]): r for r in got.collect()}
    assert len(found) == len(rows)
    for k, n in series.items():
        xs = [x or 0.0 for q, _, x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])]
        big = [max(map(abs, xs[: i + 1])) for i in range(n)]
        for name, d in decays.items():
            for i, want in enumerate(plain_ema(xs, d)):
                assert found[k, i][f"x_ema_{name}"] == pytest.approx(want, rel=1e-9, abs=1e-13 * big[i]), (k, i, name)
        d = 1 - 0.5**0.2
        for i, want in enumerate(plain_ewm(xs, d)):
            assert found[k, i]["x_recency"] == pytest.approx(want, rel=1e-9, abs=1e-13 * big[i])


@pytest.mark.parametrize("group", [2_000_000, 50])
def test_no_weight_is_cut(spark, monkeypatch, group):
    """One value of 1e30, then zeros: what is left of it counts as long as its weight is a double."""
    monkeypatch.setattr(windows, "SEGMENT", 64)
    df = spark.range(1500).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.when(F.col("id") == 0, 1e30).otherwise(0.0).alias("x"))
    got = [r["x_ema_h"] for r in windows.ema(df, ["k"], ["t"], "x", {"h": 0.5}, group).orderBy("t").collect()]
    for i in range(1, 1500):
        want = 1e30 * 0.5**i
        assert got[i] == pytest.approx(want, rel=1e-9) if i < 1020 else 0 <= got[i] <= 1e-270


def test_averages_stay_in_the_jvm(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS t", "double(id) AS x")
    plan = windows.ema(df, ["k"], ["t"], "x", {"a": 0.3})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_interval_join_of_any_length(spark):
    rng = random.Random(2)
    day = lambda n: dt.date(1969, 6, 1) + dt.timedelta(days=n)
    events = [(rng.choice(["a", "b", None]), i, day(rng.randint(0, 900)) if i % 31 else None) for i in range(400)]
    spans = [(0, 0), (5, 5), (3, 4), (10, 900), (-5000, 5000), (200, 199), (None, 300), (400, None), (None, None), (255, 511), (256, 511)]
    spans += [(a, a + rng.choice([0, 1, 6, 29, 30, 31, 127, 128, 400])) for a in (rng.randint(-50, 900) for _ in range(60))]
    wins = [(rng.choice(["a", "b"]), n, None if a is None else day(a), None if b is None else day(b)) for n, (a, b) in enumerate(spans)]
    e = spark.createDataFrame(events, "k string, id int, d date")
    w = spark.createDataFrame(wins, "k string, w int, lo date, hi date")
    inside = lambda d, lo, hi: d is not None and (lo is None or lo <= d) and (hi is None or d <= hi)
    keyed = sorted((i, n) for k, i, d in events for q, n, lo, hi in wins if k == q and inside(d, lo, hi))
    free = sorted((i, n) for _, i, d in events for _, n, lo, hi in wins if inside(d, lo, hi))
    got = joins.interval_join(e, w, "d", "lo", "hi", ["k"])
    assert got.columns == ["k", "id", "d", "w", "lo", "hi"] and sorted((r["id"], r["w"]) for r in got.collect()) == keyed
    got = joins.interval_join(e, w.drop("k"), "d", "lo", "hi")
    assert sorted((r["id"], r["w"]) for r in got.collect()) == free
    assert joins.interval_join(e, w.limit(0), "d", "lo", "hi", ["k"]).count() == 0
    assert joins.interval_join(e.limit(0), w, "d", "lo", "hi", ["k"]).count() == 0


def test_interval_join_copies_no_row_by_length(spark):
    """An event stands once per size class of the windows, a window at most twice, open ones included."""
    e = spark.range(1000).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    w = spark.sql("SELECT DATE '1990-01-01' AS lo, CAST(NULL AS DATE) AS hi UNION ALL SELECT DATE '2000-01-05', DATE '2001-01-05'")
    plan = joins.interval_join(e, w, "d", "lo", "hi")
    assert plan.count() == 1000 + 367
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "explode([9,23])" in text and "Cartesian" not in text


def hidden_rows(spark, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(k, t, None if rng.random() < 0.05 else float(rng.normal(4 * ((t // 9) % 2), 1)), float(rng.normal())) for k, n in (("a", 61), ("b", 1), (None, 30), ("c", 7)) for t in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t int, x double, y double").repartition(4)


MODEL = latent.HmmModel(np.array([0.5, 0.3, 0.2]), np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.1, 0.3, 0.6]]), np.array([[0.0, 0.0], [4.0, 0.5], [2.0, -1.0]]), np.array([[1.0, 1.0], [1.5, 0.5], [4.0, 2.0]]))


def plain_states(rows, m):
    """Forward and backward over whole histories in logarithms, and the expected transitions."""
    out, trans = {}, np.zeros((3, 3))
    for k in {r[0] for r in rows}:
        x = np.array([[np.nan if v is None else v for v in r[2:]] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])], float)
        d = x[:, None, :] - m.mean
        lb = np.where(np.isnan(d), 0.0, -0.5 * (d * d / m.var + np.log(2 * np.pi * m.var))).sum(-1)
        a, b = np.zeros_like(lb), np.zeros_like(lb)
        a[0] = np.log(m.start) + lb[0]
        for t in range(1, len(x)):
            a[t] = np.logaddexp.reduce(a[t - 1][:, None] + np.log(m.trans), axis=0) + lb[t]
        for t in range(len(x) - 2, -1, -1):
            b[t] = np.logaddexp.reduce(np.log(m.trans) + lb[t + 1] + b[t + 1], axis=1)
        total = np.logaddexp.reduce(a[-1])
        for t in range(len(x)):
            out[k, t] = np.exp(a[t] + b[t] - total)
            if t:
                trans += np.exp(a[t - 1][:, None] + np.log(m.trans) + lb[t] + b[t] - total)
    return out, trans


@pytest.mark.parametrize("length, fan", [(1, 2), (7, 3), (1000, 256)])
def test_hidden_states_do_not_depend_on_segments(spark, length, fan):
    rows, df = hidden_rows(spark)
    want, trans = plain_states(rows, MODEL)
    segs = hidden.segments(df, ["k"], ["t"], ["x", "y"], length, group_rows=20)
    got = {(r["k"], r["pos"]): r for r in hidden.posteriors(segs, MODEL, fan).collect()}
    assert set(got) == set(want)
    for at, p in want.items():
        assert np.allclose(got[at]["probs"], p, atol=1e-9) and got[at]["state"] == int(np.argmax(p))
    new = hidden.improved(segs, MODEL, fan)
    assert np.allclose(new.trans, (trans + 1e-6) / (trans + 1e-6).sum(1, keepdims=True), atol=1e-9)
    assert np.allclose(new.start, sum(want[k, 0] for k in ("a", "b", "c", None)) / 4, atol=1e-6)
    x = np.array([[w, v] for (k, t), w in want.items() for v in [next(r[2] for r in rows if r[:2] == (k, t))] if v is not None], dtype=object)
    weight, value = np.stack(x[:, 0]), x[:, 1].astype(float)
    assert np.allclose(new.mean[:, 0], (weight * value[:, None]).sum(0) / weight.sum(0), atol=1e-9)
    none = hidden.segments(df.limit(0), ["k"], ["t"], ["x", "y"], length)
    assert hidden.posteriors(none, MODEL, fan).count() == 0
