"""Rules on functional style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lispmill.functions.dsl import (
    the_head, is_list, the_kids, the_sub, any_of, call, first, found, inside, is_call, is_symbol, kid, kid_of, kids_from, kids_of, last_kid, last_of, no, pairs_of, reaching, some, text, under, where, yes,
)
from lispmill.operators.registry import FUNCTIONAL, HINT, INFO, WARNING, row_rule, table_rule

# Functions that make lazy sequences, that consume them, and that have effects.
LAZY = ("map", "filter", "remove", "for", "lazy-seq", "mapcat", "lazy-cat", "keep", "distinct", "interpose", "iterate", "repeat", "repeatedly", "cycle")
EAGER = ("into", "run!", "doseq", "reduce", "transduce", "mapv", "dorun", "doall", "sequence")
EFFECTS = ("println", "print", "printf", "prn", "pr", "swap!", "reset!", "add-watch", "remove-watch", "send", "send-off", "alter-var-root", "spit", "aset")
WRAPPERS = ("first", "last", "second", "nth", "count", "empty?", "not-empty", "seq", "take", "distinct", "sort", "reverse", "doall")


@row_rule("explicit-recursion", FUNCTIONAL, INFO, "Recursion that filter, map or reduce would say.")
def explicit_recursion() -> Column:
    name, tail = kid(1)["v"], last_kid()
    again = some(F.filter(the_sub(), lambda x: x["i"] > 0), lambda x: (x["t"] == "List") & (x["h"] == name))
    other = kid_of(tail, 3)
    shape = is_call(tail, "if") & is_call(kid_of(tail, 1), "empty?") & (tail["n"] >= 4) & (other["t"] == "List")
    let_if = is_call(other, "let") & is_call(last_of(other), "if")
    kind = F.when(is_call(other, "if") | let_if, F.lit("filter")).when(is_call(other, "cons"), F.lit("map")).when(is_call(other) & (other["n"] >= 2), F.lit("reduce"))
    return F.when(call("defn", "defn-") & (F.col("n") >= 3), found("explicit-recursion", INFO, again & shape & kind.isNotNull(), text("`", name, "` calls itself to do what `", kind, "` does.")))


def filtering(x: Column) -> Column:
    return is_call(x, "filter", "remove")


@row_rule("inefficient-filtering", FUNCTIONAL, HINT, "Filters whose result is mostly thrown away, and filters of filters.")
def inefficient_filtering() -> Column:
    rule, a = "inefficient-filtering", kid(1)
    bound = where(pairs_of(a), lambda p: is_call(p["value"], "first") & is_call(kid_of(p["value"], 1), "filter"))
    value = first(bound)["value"]
    nested = (the_head().isin("nil?", "not") & is_call(a, "seq") & filtering(kid_of(a, 1)))
    wrapped = the_head().isin(*WRAPPERS) & any_of(filtering(a), filtering(kid(2)) & the_head().isin("take", "sort"))
    mapped = (the_head() == "map") & filtering(last_kid())
    steps = kids_from(1)
    is_filter = lambda x: filtering(x) | is_symbol(x, "filter", "remove")
    threaded = the_head().isin("->>", "->") & (F.size(where(steps, is_filter)) >= 2)
    # a first of filter right in a let's bindings is reported by that let
    in_let = (F.col("up_type") == "Vector") & inside("let") & (the_head() == "first") & (F.col("idx") % 2 == 1) & is_call(a, "filter")
    return F.when(is_list() & the_head().isNotNull(), F.coalesce(
        F.when(call("let") & (a["t"] == "Vector"), found(rule, HINT, F.size(bound) > 0, "Only the first match of a `filter` is bound: `some` stops there.", value)),
        found(rule, HINT, (wrapped | nested | mapped) & no(in_let), text("`", the_head(), "` over a filtered sequence does work twice.")),
        found(rule, HINT, threaded, text("Several filters in one `", the_head(), "` could be one.")),
    ))


@table_rule("lazy-side-effects", FUNCTIONAL, WARNING, "Side effects in lazy sequence operations, also through functions of the file.", lazy_context_funcs=LAZY, side_effect_funcs=EFFECTS)
def lazy_side_effects(nodes: DataFrame, lazy_context_funcs: tuple, side_effect_funcs: tuple) -> DataFrame:
    symbols = lambda xs: F.array_distinct(F.transform(where(xs, is_symbol), lambda x: x["v"]))
    used = symbols(F.filter(the_sub(), lambda x: x["i"] > 2))
    effects = F.array(*[F.lit(x) for x in side_effect_funcs])
    defs = nodes.where(call("defn", "defn-") & (F.col("depth") == 0)).select("path", kid(1)["v"].alias("name"), F.arrays_overlap(used, effects).alias("bad"), used.alias("uses"))
    consumed = some(F.filter(the_sub(), lambda x: x["i"] > 0), lambda x: is_call(x, *EAGER))
    bodied = the_head().isin("for", "lazy-seq", "lazy-cat")
    fn = kid(1)
    in_fn = F.when(bodied, symbols(F.filter(the_sub(), lambda x: x["i"] > 1))).when(fn["t"].isin("FnLiteral", "List"), symbols(under(fn))).when(fn["t"] == "Symbol", F.array(fn["v"]))
    lazy = nodes.where(call(*lazy_context_funcs) & ~inside(*EAGER) & no(consumed)).select("path", "line", "col", "ast", "head", F.coalesce(in_fn, F.array().cast("array<string>")).alias("uses"))
    own = F.filter("uses", lambda u: u.isin(*side_effect_funcs))
    through = F.array_intersect("uses", F.coalesce("bad", F.array().cast("array<string>")))
    hit = lazy.join(reaching(defs), "path", "left").withColumn("effect", F.coalesce(F.get(own, F.lit(0)), F.get(F.array_sort(through), F.lit(0)))).where("effect is not null")
    return hit.select(F.lit("lazy-side-effects").alias("rule_id"), text("`", the_head(), "` is lazy, so when `", F.col("effect"), "` happens is left open.").alias("message"), "path", "line", "col", F.lit(WARNING).alias("severity"), "ast")


@row_rule("overabstracted-composition", FUNCTIONAL, HINT, "comp of more than a few functions.", most=3)
def long_composition(most: int) -> Column:
    return found("overabstracted-composition", HINT, call("comp") & (F.col("n") - 1 > most), text("`comp` of ", F.col("n") - 1, " functions, more than ", F.lit(most), "."))


@row_rule("overuse-of-high-order-functions", FUNCTIONAL, WARNING, "map of a lambda that applies its argument twice.")
def apply_twice() -> Column:
    fn = kid(1)
    param = F.when(fn["t"] == "FnLiteral", F.lit("%")).otherwise(kid_of(first(where(kids_of(fn), lambda x: x["t"] == "Vector")), 0)["v"])
    short = F.when(fn["t"] == "FnLiteral", F.lit("%1")).otherwise(param)
    fits = lambda x: (x["t"].isin("List", "FnLiteral")) & (x["h"] == "apply-twice") & (x["n"] >= 3) & kid_of(x, 2)["v"].isin(param, short)
    lambda_ = (fn["t"] == "FnLiteral") | is_call(fn, "fn")
    return F.when(call("map") & (F.col("n") >= 2), found("overuse-of-high-order-functions", WARNING, lambda_ & some(under(fn), fits), "`map` over a lambda that applies a function twice."))


@row_rule("inefficient-generator", FUNCTIONAL, HINT, "gen/such-that, whose predicate may rarely hold.")
def such_that() -> Column:
    return found("inefficient-generator", HINT, call("gen/such-that") & (F.col("n") >= 3), "`gen/such-that` throws away every value its predicate turns down.")


@row_rule("premature-optimization", FUNCTIONAL, WARNING, "Generic retry logic.")
def with_retry() -> Column:
    return found("premature-optimization", WARNING, call("with-retry"), "`with-retry` around a call: is it known to fail?")


@row_rule("trivial-lambda", FUNCTIONAL, INFO, "Lambdas that pass their arguments on as they are.")
def trivial_lambda() -> Column:
    params = first(F.filter(the_kids(), lambda x: x["t"] == "Vector"))
    form = last_kid()
    names = F.transform(kids_of(params), lambda x: x["v"])
    plain = no(some(kids_of(params), lambda x: ~is_symbol(x) | (x["v"] == "&")))
    args = F.filter(kids_of(form), lambda x: x["k"] > 0)
    same = (F.transform(args, lambda x: x["v"]) == names) & no(some(args, lambda x: x["t"] != "Symbol")) & (F.size(names) > 0)
    as_fn = call("fn") & params.isNotNull() & (form["k"] == params["k"] + 1) & (params["k"] <= 2) & is_call(form) & plain & same
    own = F.transform(kids_from(1), lambda x: x["v"])
    count = F.size(own)
    wanted = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(F.lit("%"), i.cast("string")))
    as_literal = (F.col("type") == "FnLiteral") & the_head().isNotNull() & ((count == 0) | ((count == 1) & own[0].isin("%", "%1")) | ((count > 1) & (own == wanted)))
    called = F.when(F.col("type") == "FnLiteral", the_head()).otherwise(form["h"])
    return F.when(F.col("type").isin("List", "FnLiteral"), found("trivial-lambda", INFO, any_of(as_fn, as_literal), text("The lambda only passes its arguments on: `", called, "` does.")))


@row_rule("underutilizing-features: use-mapcat", FUNCTIONAL, HINT, "apply concat over map.")
def use_mapcat() -> Column:
    return found("underutilizing-features: use-mapcat", HINT, call("apply") & (F.col("n") == 3) & is_symbol(kid(1), "concat") & is_call(kid(2), "map"), "`mapcat` joins `map` and `apply concat`.")
