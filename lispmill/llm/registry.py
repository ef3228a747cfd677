"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from lispmill.llm import decontaminate, langid, licenses, media, packing, secrets, sharding, simhash, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_simhash_dedup": simhash.op2_simhash_dedup,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_media_columns": media.op5_media_columns,
        "op6_language_id": langid.op6_language_id,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_token_counts": tokens.op8_token_counts,
        "op9_compact_shards": sharding.op9_compact_shards,
        "op10_secret_scan": secrets.op10_secret_scan,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op9_compact_shards": sharding.oracle(), "op10_secret_scan": secrets.oracle()}
