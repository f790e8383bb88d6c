"""Prefix maps and glossaries held as tables, mergeable version statistics, blocked correlations."""

import itertools
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import glossary, joins, splits
from tallyframe.plans.session import written
from tallyframe.sources import versions


def lineage(df):
    return {(r["feature"], r["matched_prefix"], r["src"], r["status"]) for r in df.collect()}


def test_prefix_table_equals_the_case_form(spark):
    names = ["abc_1", "ab", "a", "", None, "xyz", "abcd", "äbc", "abc_1"]
    maps = [("abc", "s1"), ("a", "s2"), ("ab", "s3"), ("ä", "s4"), ("abc", "s5")]
    f = spark.createDataFrame([(n,) for n in names], "feature string")
    m = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(maps)] + [(None, -1, "null")], "prefix string, ord int, src string")
    want = joins.trace_lineage(f, [(p, s, "", "") for p, s in maps]).withColumnRenamed("source_table", "src")
    got = joins.trace_prefixes(f, m, ["src"])
    assert lineage(got) == lineage(want) and got.count() == len(names)
    longest = {r[0]: r[1] for r in joins.trace_prefixes(f, m, [], order=None).select("feature", "matched_prefix").collect()}
    assert longest == {"abc_1": "abc", "ab": "ab", "a": "a", "": None, None: None, "xyz": None, "abcd": "abc", "äbc": "ä"}


def test_prefix_table_odd_maps(spark):
    f = spark.createDataFrame([("a",), (None,), ("",)], "feature string")
    empty = spark.createDataFrame([], "prefix string, ord int, src string")
    assert {r["status"] for r in joins.trace_prefixes(f, empty, ["src"]).collect()} == {"unmapped"}
    everything = spark.createDataFrame([("", 0, "all")], "prefix string, ord int, src string")
    assert lineage(joins.trace_prefixes(f, everything, ["src"])) == {("a", "", "all", "mapped"), ("", "", "all", "mapped"), (None, None, None, "unmapped")}
    assert joins.trace_prefixes(f.limit(0), everything, ["src"]).count() == 0


def test_prefix_map_of_100_000_rows_is_one_equi_join(spark):
    m = spark.range(100_000).select(F.concat(F.lit("k"), F.col("id").cast("string"), F.lit("_")).alias("prefix"), F.col("id").alias("ord"), F.col("id").alias("src"))
    f = spark.range(0, 200_000, 20).select(F.concat(F.lit("k"), F.col("id").cast("string"), F.lit("_x")).alias("feature"), "id")
    out = joins.trace_prefixes(f, m, ["src"])
    assert out.where("status = 'mapped' AND src = id").count() == 5_000 and out.where("status = 'unmapped'").count() == 5_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_hits(texts, terms):
    known = {t.lower() for t in terms if t}
    out = []
    for key, text in texts:
        low = (text or "").lower()
        out += [(key, t, i, i + len(t)) for t in known for i in range(len(low)) if low.startswith(t, i)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("term_chars, text_chars", [(glossary.TERM_CHARS, glossary.TEXT_CHARS), (6, 40)])
def test_glossary_positions_in_one_and_in_many_blocks(spark, term_chars, text_chars):
    texts = [(1, "aaaa bAb"), (2, None), (3, ""), (4, "x" * 70_000 + "ab é€😀ab"), (1, "aaaa bAb"), (None, "ab"), (6, "nothing here")]
    terms = ["a", "AA", "ab", "ab", "b a", "", None, "😀", "nothing", "absent"]
    d = spark.createDataFrame(texts, "id long, text string")
    g = spark.createDataFrame([(t,) for t in terms], "term string")
    got = glossary.glossary_hits(d, "id", "text", g, "term", term_chars=term_chars, text_chars=text_chars)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_hits(texts, terms)


def test_glossary_of_100_000_terms_and_empty_ones(spark):
    g = spark.range(100_000).select(F.concat(F.lit("term"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("term"), F.col("id").alias("feature"))
    d = spark.range(200).select("id", F.concat(F.lit("see TERM"), F.lpad((F.col("id") * 501).cast("string"), 6, "0")).alias("text"))
    hits = glossary.glossary_hits(d, "id", "text", g, "term")
    assert hits.count() == 200 and {tuple(r) for r in hits.select("start", "end").distinct().collect()} == {(4, 14)}
    assert glossary.glossary_hits(d, "id", "text", g.limit(0), "term").count() == 0
    assert glossary.glossary_hits(d.limit(0), "id", "text", g, "term").count() == 0


def test_glossary_grounding(spark):
    d = spark.createDataFrame([(1, "Monthly spend rose", ["spend", "visits", "spend"]), (2, None, ["spend"]), (3, "spend", None)], "id long, text string, feats array<string>")
    g = spark.createDataFrame([("SPEND", "spend"), ("rose", "spend"), ("visit", "visits")], "term string, feature string")
    out = glossary.glossary_grounding(d, "id", "text", "feats", g, "term", "feature")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 1, 0.5), (2, 1, 0, 0.0), (3, 0, 0, 0.0)]


def store(spark, rows, home, mode="append"):
    spark.createDataFrame(rows, "part int, x double, name string").write.partitionBy("part").mode(mode).parquet(home)
    return spark.read.schema("x double, name string, part int").parquet(home)


def test_states_of_versions_read_only_new_partitions(spark, tmp_path):
    home = str(tmp_path / uuid.uuid4().hex)
    rng = np.random.default_rng(1)
    make = lambda p, n, shift: [(p, None if rng.random() < 0.2 else float(shift + rng.normal()), "a" if rng.random() < 0.5 else None) for _ in range(n)]
    data = store(spark, make(1, 50, 1e9) + make(2, 3, 1e9) + make(None, 4, 0.0) + [(3, None, None)], home)
    cols = ["x", "name"]
    first = written(versions.refresh_states(data, "part", cols))
    data = store(spark, make(4, 40, -1e9) + make(2, 5, 1e9), home)
    again = versions.refresh_states(data, "part", cols, first)
    pruned = [x.split("]")[0] for x in again._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1:]]
    asked = [x for x in pruned if x]
    assert asked and all("2" in x and "4" in x and "1" not in x.split("IN")[-1] for x in asked), pruned
    got = {r["column"]: r for r in versions.profile_states(again, data, "v2").collect()}
    want = {r["column"]: r for r in versions.profile_version(data, "v2").where(F.col("column").isin(cols)).collect()}
    for c in cols:
        for k in ("row_count", "column_count", "schema_hash", "null_pct"):
            assert got[c][k] == want[c][k]
        for k in ("mean", "std"):
            assert got[c][k] == pytest.approx(want[c][k], rel=1e-9, abs=1e-6)
    kept = versions.refresh_states(data, "part", cols, written(again))
    assert kept.count() == again.count() == 2 * 5


def test_states_follow_dropped_partitions_and_empty_data(spark, tmp_path):
    home = str(tmp_path / uuid.uuid4().hex)
    data = store(spark, [(1, 1.0, "a"), (2, 5.0, "b")], home)
    states = written(versions.refresh_states(data, "part", ["x"]))
    assert states.count() == 2
    left = spark.read.schema("x double, name string, part int").option("basePath", home).parquet(f"{home}/part=1")
    out = versions.refresh_states(left, "part", ["x"], states)
    assert [(r["part"], r["mean"]) for r in out.collect()] == [("1", 1.0)]
    assert versions.merge_states(states.limit(0)).count() == 0


def test_blocked_correlations(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=(n, 5)) + [0, 1e8, -1e8, 0, 0]
    x[:, 3] = 7.0
    x[:, 4] = 3 * x[:, 0] + 1
    gaps = rng.random((n, 5)) < 0.3
    gaps[:, 2] |= np.arange(n) > 4
    rows = [tuple(None if g else float(v) for v, g in zip(a, b)) for a, b in zip(x, gaps)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(7)
    got = {(r["feature"], r["label"]): r for r in splits.leakage_corr(df, list("abcd"), ["e", "a"]).collect()}
    assert len(got) == 7  # a against itself is left out
    for f, y in itertools.product("abcd", "ea"):
        if f == y:
            continue
        i, j = "abcde".index(f), "abcde".index(y)
        ok = ~gaps[:, i] & ~gaps[:, j]
        assert got[f, y]["n"] == ok.sum()
        if f == "d" or ok.sum() < 2:
            assert got[f, y]["corr"] is None and got[f, y]["leak"] == 0
        else:
            assert got[f, y]["corr"] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-7)
    assert got["a", "e"]["leak"] == 1 and got["c", "e"]["leak"] == 0


def test_blocked_correlations_odd_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), None), (float("inf"), 1.0), (2.0, 3.0)], "a double, y double")
    r = splits.leakage_corr(df, ["a"], ["y"]).collect()[0]
    assert (r["corr"], r["n"], r["leak"]) == (None, 3, 0)
    r = splits.leakage_corr(df.where("y IS NOT NULL AND a < 10"), ["a"], ["y"], min_rows=2).collect()[0]
    assert (r["corr"], r["n"], r["leak"]) == (pytest.approx(1.0), 2, 1)
    r = splits.leakage_corr(df.limit(0), ["a"], ["y"]).collect()[0]
    assert (r["corr"], r["n"], r["leak"]) == (None, 0, 0)


def test_blocked_correlations_scan_once(spark, tmp_path):
    rng = np.random.default_rng(5)
    cols = [f"f{i}" for i in range(400)] + [f"y{i}" for i in range(16)]
    home = str(tmp_path / "wide")
    spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(60, 416))], ", ".join(f"{c} double" for c in cols)).write.parquet(home)
    out = splits.leakage_corr(spark.read.parquet(home), cols[:400], cols[400:])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and out.count() == 6400
