"""Function measures, raw and as histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lispmill.functions.dsl import the_head, the_kids, the_sub, call, first, is_call, is_symbol, kid, kids_of, last_kid, plain_parameter, where, yes
from lispmill.operators.design import call_depth

METRICS = {"lines_of_code": "lines_of_code", "parameter_count": "parameter_count", "max_nesting_depth": "nesting_depth", "max_message_chain": "message_chain_length", "max_consecutive_primitive_params": "consecutive_primitives"}


def function_stats(nodes: DataFrame) -> DataFrame:
    """A row per function: lines (to its last form's first line), parameters, call depth, longest access chain, and
    longest run of plain parameters."""
    p = first(F.filter(the_kids(), lambda x: x["t"] == "Vector"))
    own = kids_of(p)
    rest_at = F.coalesce(F.array_min(F.transform(F.filter(own, lambda x: x["v"] == "&"), lambda x: x["k"])), F.lit(1 << 20))
    counted = F.size(where(own, lambda x: (x["k"] < rest_at) & ((x["t"] != "Symbol") | plain_parameter(x))))
    longest = F.aggregate(own, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), lambda s, x: F.struct(F.when(yes(is_symbol(x) & ~x["v"].isin("_", "&")), s["now"] + 1).otherwise(F.lit(0)).alias("now"), F.greatest(s["best"], F.when(yes(is_symbol(x) & ~x["v"].isin("_", "&")), s["now"] + 1).otherwise(F.lit(0))).alias("best")))["best"]
    path = lambda x: first(where(the_sub(), lambda y: (y["p"] == x["i"]) & (y["k"] == 2) & (y["t"] == "Vector")))["n"]
    chains = F.transform(where(the_sub(), lambda x: is_call(x, "get-in", "->", "some->")), lambda x: F.when(x["h"] == "get-in", F.coalesce(path(x), F.lit(0))).otherwise(F.greatest(x["n"] - 2, F.lit(0))))
    name = F.when(the_head() == "fn", F.lit("anonymous-fn")).otherwise(kid(1)["v"])
    lists = nodes.where(((call("defn", "defn-", "defsc", "fp/defsc")) & (F.col("n") > 2) & (kid(1)["t"] == "Symbol")) | call("fn"))
    return lists.select(
        "path", name.alias("function_name"), (last_kid()["l"] - F.col("line") + 1).alias("lines_of_code"), F.coalesce(F.when(p.isNotNull(), counted), F.lit(0)).alias("parameter_count"),
        call_depth().alias("max_nesting_depth"), F.coalesce(F.array_max(chains), F.lit(0)).alias("max_message_chain"), F.coalesce(F.when(p.isNotNull(), longest), F.lit(0)).alias("max_consecutive_primitive_params"),
    )


def raw_stats(stats: DataFrame) -> DataFrame:
    """(function_name, metric_type, metric_value): the measures turned to rows."""
    named = stats.select("function_name", *[F.col(k).alias(v) for k, v in METRICS.items()])
    return named.unpivot("function_name", list(METRICS.values()), "metric_type", "metric_value")


def histograms(stats: DataFrame) -> DataFrame:
    """(metric_type, metric_value, function_count) of all measures, from one aggregation."""
    return raw_stats(stats).groupBy("metric_type", "metric_value").agg(F.count("*").alias("function_count")).orderBy("metric_type", "metric_value")


def write_histograms(stats: DataFrame, folder: str) -> None:
    """One CSV folder for each measure: <measure>_stats."""
    for m in METRICS.values():
        histograms(stats).where(F.col("metric_type") == m).select(F.col("metric_value").alias(m), "function_count").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{m}_stats")
