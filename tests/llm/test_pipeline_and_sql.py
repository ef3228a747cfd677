from __future__ import annotations

import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from lispmill.llm import registry
from tests.llm.helpers import awkward, clashing, prose

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), c.execute(registry.oracle_sql()[name]).df()
    plain = lambda x: "" if pd.isna(x) else str(float(x)) if isinstance(x, Number) else str(x)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(want.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_stages_take_effect_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, texts, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
            kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] >= kept[1] >= kept[2] == kept[3]
    assert {r.doc_id for r in docs.collect()} == kept[3]
    clean = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()}
    assert len(kept[0] & clean) >= 0.95 * len(clean)
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not [d for d in kept[2] if any(i in texts[d] for i in items)]


def test_empty_tables(spark, tmp_path):
    for name, spec in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], spec).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, q in registry.queries().items():
        assert q(spark, str(tmp_path)).count() == 0, name


def test_awkward_rows_through_all_stages(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns of names that stages use for their own."""
    docs = clashing(awkward(spark, [prose(k, 60) for k in range(6)] + [prose(3, 60) + " more"]), "sig", "root", "length", "_spans", "score", "cell", "least")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, None), (100, None, 1), (101, 0, 0), (None, 1, 1), (10**6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, prose(5, 60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == docs.columns, name
    kept = [r.doc_id for r in df.collect()]
    # of equal and of near texts the least id stays; a leaked document goes
    assert sorted(i for i in kept if i is not None and i >= 100) == [100, 101, 102, 103, 104] and 1 in kept and 2 not in kept and 4 in kept and kept.count(5) == 1 and None in kept
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(kept)
