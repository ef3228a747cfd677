"""Findings as files arrive: the node table and the row rules are stateless, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lispmill.operators.registry import RULES
from lispmill.plans.analyze import Config, findings, select
from lispmill.sources import files


def source_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, text) of source files that arrive in a folder."""
    raw = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).format("text").load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.col("path").rlike(files.SUFFIX))


def stream_findings(sources: DataFrame, config: Config | None = None) -> DataFrame:
    """Findings of the enabled row rules over a stream of (path, text); rules over files need a batch."""
    config = config or Config()
    rules = [r.id for r in select(config) if RULES[r.id].row]
    kept = sources if config.analyze_tests else files.prune_tests(sources)
    return findings(files.nodes(kept), config, rules)
