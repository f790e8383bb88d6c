import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from llm_fixtures import ls, odd  # noqa: F401
from tallyframe.llm import pii
from test_corpus_operators import low, plain_components, plain_overlaps, WORD  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(ls):
    docs, out = ls.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in cp.STAGES:
        nxt = cp.written(f(ls, docs, SF))
        out.append((name, docs, nxt))
        docs = nxt
    return {n: ([r.asDict() for r in a.collect()], [r.asDict() for r in b.collect()], a.columns, b.columns) for n, a, b in out}


def test_columns_and_names(stages):
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "pieces"]
    for n in ("language", "near_duplicates", "decontamination", "personal_data"):
        assert stages[n][2] == stages[n][3]


def test_language_keeps_prose(stages):
    before, after, *_ = stages["language"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"])}


def test_one_of_each_group_stays(stages):
    before, after, *_ = stages["near_duplicates"]
    want = {c for _, n, c in plain_components([(r["doc_id"], r["text"]) for r in before])}
    assert {r["doc_id"] for r in after} == want and len(after) == len(want)


def test_contaminated_documents_go(ls, stages):
    before, after, *_ = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in ls.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = [r for r in before if len(r["text"]) < 6000]
    kept = {r["doc_id"] for r in after}
    for r in short:
        assert (r["doc_id"] in kept) == (not plain_overlaps(r["text"], items))
    assert len(kept) < len(before)


def test_personal_data_is_gone(stages):
    before, after, *_ = stages["personal_data"]
    find, texts = pii.finder(), {r["doc_id"]: r["text"] for r in before}
    for r in after:
        assert not [s for s in find(r["text"]) if s[1] < 4]
        assert (r["text"] == texts[r["doc_id"]]) == (not find(texts[r["doc_id"]]))
        assert r["n_chars"] == len(r["text"])


def test_pieces_decode_to_the_text(stages):
    before, after, *_ = stages["pieces"]
    assert {r["doc_id"]: r["text"] for r in after} == {r["doc_id"]: r["text"] for r in before}


def test_three_splits_of_every_document(stages):
    before, after, *_ = stages["pieces"]
    drawn = {}
    for r in after:
        drawn.setdefault(r["doc_id"], {})[r["sample"]] = tuple(r["ids"])
    assert set(drawn) == {r["doc_id"] for r in before}
    assert all(len(set(d.values())) == len(d) for d in drawn.values())
    assert all(set(drawn[r["doc_id"]]) == {1, 2, 3} for r in before if len(r["text"]) > 20)


def test_odd_rows_pass_every_stage(ls):
    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (None, "some words of plain text here", "en", None, 5), (2, "123 456", "en", "s", 7), (2, "the same text twice", None, "s", 3), (2, "the same text twice", "en", "s", 3), (3, "word " * 20000, "en", "s", 1)]
    df = ls.createDataFrame([(*r, "extra", 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _overlap string, score double").withColumns({"_l": F.lit("l"), "_CLASS": F.lit("c"), "_doc": F.lit("d")})
    for make in (lambda: df, lambda: df.limit(0), lambda: df.withColumn("lang", df["lang"].substr(0, 0)).where("lang is null")):
        docs = make()
        for _, f in cp.STAGES[:-1]:
            docs = cp.written(f(ls, docs, SF))
            assert docs.columns == df.columns
            assert {(r["_overlap"], r["_l"], r["_CLASS"], r["_doc"]) for r in docs.collect()} <= {("extra", "l", "c", "d")}
        docs = cp.written(cp.STAGES[-1][1](ls, docs, SF))
        assert docs.columns[0] == "doc_id"
    assert {r["doc_id"] for r in cp.near_duplicates(ls, df, SF).collect()} >= {0, 1, 2, 3}


def test_run(ls, stages):
    assert cp.run(ls, SF).count() == len(stages["pieces"][1])


def test_texts_are_read_by_one_function_call(ls):
    """A filter on a Python function's result repeats the call below it, with a second worker a task."""
    docs = ls.read.parquet(f"{SF}/documents.parquet")
    for stage in (cp.language_id, cp.near_duplicates):
        plan = stage(ls, docs, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, plan
