"""Predicates over a node row: columns, its children (``kids``) and its subtree (``sub``), all JVM expressions.

An entry of ``kids`` or ``sub`` has: i (place from the node, 0 is itself), p (parent's place), d (depth from the
node), k (index in its parent), t (type), v (value), h (head), n (children), z (subtree size), l and c (line, column).
Entries are in document order. ``kids`` count their places from the node as well.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lispmill.sources.parser import ENTRY


def the_sub() -> Column:
    return F.col("sub")


def the_kids() -> Column:
    return F.col("kids")


def the_head() -> Column:
    return F.col("head")


def the_path() -> Column:
    return F.col("path")


def is_list() -> Column:
    """This node is a list."""
    return F.col("type") == "List"


ENTRIES = f"array<{ENTRY}>"


def no(x: Column) -> Column:
    """Not true: false or unknown."""
    return ~F.coalesce(x, F.lit(False))


def yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def any_of(*xs: Column) -> Column:
    return reduce(lambda a, b: a | b, [yes(x) for x in xs])


def all_of(*xs: Column) -> Column:
    return reduce(lambda a, b: a & b, [yes(x) for x in xs])


def call(*heads: str) -> Column:
    """This node is a list headed by one of the symbols."""
    return is_list() & the_head().isin(*heads)


def kid(j: int) -> Column:
    return F.get(the_kids(), F.lit(j))


def last_kid() -> Column:
    return F.get(the_kids(), F.col("n") - 1)


def kids_from(j: int) -> Column:
    return F.filter(the_kids(), lambda x: x["k"] >= j)


def is_call(x: Column, *heads: str) -> Column:
    return (x["t"] == "List") & (x["h"].isin(*heads) if heads else x["h"].isNotNull())


def is_symbol(x: Column, *values: str) -> Column:
    return (x["t"] == "Symbol") & (x["v"].isin(*values) if values else F.lit(True))


def is_number(x: Column, value: str) -> Column:
    return (x["t"] == "Number") & (x["v"] == value)


def kids_of(x: Column) -> Column:
    return F.filter(the_sub(), lambda y: y["p"] == x["i"])


def kid_of(x: Column, j: int) -> Column:
    return F.get(kids_of(x), F.lit(j))


def last_of(x: Column) -> Column:
    return F.get(kids_of(x), x["n"] - 1)


def under(x: Column) -> Column:
    """The entry and all below it."""
    return F.filter(the_sub(), lambda y: (y["i"] >= x["i"]) & (y["i"] < x["i"] + x["z"]))


def some(xs: Column, f: Callable[[Column], Column]) -> Column:
    return F.exists(xs, lambda x: yes(f(x)))


def where(xs: Column, f: Callable[[Column], Column]) -> Column:
    return F.filter(xs, lambda x: yes(f(x)))


def first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def local(name: Column) -> Column:
    """The part of a symbol behind its namespace."""
    return F.regexp_replace(name, r"^.*/(?=.)", "")


def space(name: Column) -> Column:
    """The namespace of a qualified symbol, else null."""
    return F.when(name.rlike(r"^[^/]+/."), F.regexp_extract(name, r"^([^/]+)/", 1))


def inside(*heads: str) -> Column:
    return F.arrays_overlap("enclosing", F.array(*[F.lit(h) for h in heads]))


def plain_parameter(x: Column) -> Column:
    """A symbol that binds a name: not _ or &, no interop and no namespace."""
    return is_symbol(x) & ~x["v"].isin("_", "&") & ~x["v"].startswith(".") & ~x["v"].contains("/")


def parameters() -> Column:
    """The first parameter vector of a definition (a null entry if there is none)."""
    return first(F.filter(the_kids(), lambda x: (x["k"] >= 2) & (x["t"] == "Vector")))


def body() -> Column:
    """The forms behind the first parameter vector."""
    p = parameters()
    return F.filter(the_kids(), lambda x: x["k"] > p["k"])


def pairs_of(vector: Column) -> Column:
    """(name, value) of a binding vector's pairs."""
    own = kids_of(vector)
    return F.transform(F.filter(own, lambda x: (x["k"] % 2 == 0) & (x["k"] + 1 < vector["n"])), lambda x: F.struct(x.alias("name"), F.get(own, x["k"] + 1).alias("value")))


def reaching(defs: DataFrame) -> DataFrame:
    """(path, bad): of (path, name, bad, uses) definitions, the names that are bad or reach one through the names they use.

    A file's definitions meet in one row. They are closed in rounds, at most as many as there are definitions; once a round
    adds no name, the rest costs nothing."""
    own = F.array_sort(F.collect_list(F.struct("name", "bad", "uses")))
    first_ = lambda d: F.transform(F.filter(d, lambda x: x["bad"]), lambda x: x["name"])
    grown = lambda d, s: F.array_union(s, F.transform(F.filter(d, lambda x: F.arrays_overlap(x["uses"], s)), lambda x: x["name"]))
    files = defs.groupBy("path").agg(own.alias("d")).where(F.exists("d", lambda x: x["bad"]))
    d = F.col("d")
    state = lambda names, before: F.struct(names.alias("names"), before.alias("before"))
    step = lambda s, _: F.when(F.size(s["names"]) == s["before"], s).otherwise(state(grown(d, s["names"]), F.size(s["names"])))
    return files.select("path", F.aggregate(F.sequence(F.lit(1), F.size(d)), state(first_(d), F.lit(-1)), step, lambda s: s["names"]).alias("bad"))


def deepest(entries: Column, value: Callable[[Column, Column], Column]) -> Column:
    """The greatest ``value(entry, its parent's value)`` over a subtree in document order (null for the first one's parent).

    Only the line of entries above the current one is kept, so a step costs the depth and not the size."""
    zero = F.struct(F.array().cast("array<int>").alias("line"), F.lit(None).cast("int").alias("best"))

    def step(s: Column, x: Column) -> Column:
        own = value(x, F.get(s["line"], x["d"] - 1)).cast("int")
        line = F.concat(F.slice(s["line"], F.lit(1), x["d"]), F.array(own))
        return F.struct(line.alias("line"), F.greatest(s["best"], own).alias("best"))

    return F.aggregate(entries, zero, step, lambda s: s["best"])


FINDING = "struct<rule_id:string,message:string,line:int,col:int,severity:string>"


def found(rule_id: str, severity: str, cond: Column, message: Column | str, at: Column | None = None, severity_of: Column | None = None) -> Column:
    """A finding where the condition holds, else null; at the node, or at an entry."""
    line, col = (F.col("line"), F.col("col")) if at is None else (at["l"], at["c"])
    text = F.lit(message) if isinstance(message, str) else message
    one = F.struct(F.lit(rule_id).alias("rule_id"), text.alias("message"), line.alias("line"), col.alias("col"), (F.lit(severity) if severity_of is None else severity_of).alias("severity"))
    return F.when(yes(cond), one)


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts])
