"""Every registered query against its SQL on the smallest test tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import __spark_entry__ as entry  # noqa: E402
from check import TABLES, norm  # noqa: E402

from tallyframe.catalog.registry import QUERIES, SQL  # noqa: E402  filled by the entry module


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "user_id" in df.columns


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert not any("pipeline" in n or n.startswith("op") and n[2:3].isdigit() for n in QUERIES)
