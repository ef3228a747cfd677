"""Every query with SQL is held against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lispmill.plans import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The rules' queries have one shape; tests/test_rules.py covers the rules, so a few stand for them here.
NAMES = [n for n in queries.SQL if not n.startswith("rule_") or n in ("rule_list", "rule_comments", "rule_cyclic_dependency", "rule_inappropriate_collection", "rule_nested_forms")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
