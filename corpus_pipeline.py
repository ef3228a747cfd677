"""A training-data pipeline: each stage works on all that its predecessor kept.

Stages take (spark, docs, sf_dir). All but the last return the columns of ``documents``; the last returns the
packed pieces of the documents that are left. Rows with nulls, repeated rows and empty tables are treated as
the stages' operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lispmill.llm import decontaminate, packing, secrets, shingle_join, toxicity
from lispmill.llm.common import shared_dir, table

#: Of the near-duplicate stage: words of a shingle, and the Jaccard similarity of shingles that links. SimHash's Gray index names
#: the candidates, every link is verified, and an exact join adds the links that fingerprints cannot tell.
SHINGLE, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.drop_similar(docs, SHINGLE, SIMILARITY)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("secrets", redact_secrets), ("packing", pack)]
#: No stage but the secret scan can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written in the shared folder and read again."""
    docs, to = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{to}/{k}")
        docs = spark.read.parquet(f"{to}/{k}")
    return docs
