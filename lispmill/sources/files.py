"""Scans: directories and files of Lisp source, and any DataFrame of (path, text)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lispmill.sources.parser import SCHEMA, WIDE, parse_batches
from lispmill.sources.shared import shared_dir

SUFFIX = r"(?i)\.clj[sc]?$"
TEST_PATH = r"/tests?/|[_-]test\.clj$"


def scan(spark: SparkSession, *paths: str, analyze_tests: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(path, text) of the source files under the paths. Files that aren't source are passed over; a path that is
    named twice is read twice. Test files go unless ``analyze_tests``."""
    out = None
    for p in paths:
        found = spark.read.text(p, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "path string, text string")
    out = out.where(F.col("path").rlike(SUFFIX.replace("(?i)", "") if case_sensitive else SUFFIX))
    return out if analyze_tests else prune_tests(out)


def prune_tests(sources: DataFrame) -> DataFrame:
    return sources.where(~F.col("path").rlike(TEST_PATH))


def nodes(sources: DataFrame, whole: bool = False, heads: frozenset[str] | None = None) -> DataFrame:
    """The node table of (path, text) rows; files that cannot be read give no rows. Lists carry as much of their subtree as
    the rules read, or all of it (``whole``, for rendering). ``heads``: all is read, and the lists with these heads are the
    rows, for rules that judge no others (``registry.heads_of``)."""
    from lispmill.operators import design, functional, idioms, registry  # noqa: F401  they say what they read

    deep = WIDE | registry.DEEP
    return sources.select("path", "text").mapInArrow(lambda batches: parse_batches(batches, deep, whole, heads), SCHEMA)


def written(nodes_: DataFrame) -> DataFrame:
    """The node table as a table in the shared folder: sources are parsed once, and each reader takes the columns it needs."""
    spark = nodes_.sparkSession
    to = f"{shared_dir(spark)}/nodes-{uuid.uuid4().hex}"
    nodes_.write.option("compression", "zstd").parquet(to)
    return spark.read.schema(nodes_.schema).parquet(to)


def comments(nodes_: DataFrame) -> DataFrame:
    return nodes_.where("type = 'Comment'").select("path", "value", "line", "col")


def top_level_definitions(nodes_: DataFrame) -> DataFrame:
    return nodes_.where("depth = 0 and type = 'List' and head in ('defn', 'defn-')").select("path", "id", F.get("kids", F.lit(1))["v"].alias("name"), "line")
