"""Namespaces, definitions, bindings, and which definition a symbol means.

A binding holds in a run of document order: ``from_id`` to ``to_id``. A use meets the bindings of its name in
its file by an equi-join on (path, name), and takes the one whose run begins last before it: the innermost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lispmill.functions.dsl import the_head, the_kids, the_sub, call, first, is_symbol, kid, kids_from, kids_of, last_kid, pairs_of, parameters, plain_parameter, some, text, under, where, yes

# Names of the core that every namespace has.
CORE = ("map", "filter", "reduce", "apply", "partial", "comp", "first", "rest", "last", "count", "empty?", "seq", "assoc", "dissoc", "get", "get-in", "update", "update-in", "conj", "into", "merge", "keys", "vals", "str", "println", "print", "inc", "dec", "+", "-", "*", "/", "=", "<", ">", "<=", ">=", "not=", "not", "nil?", "some?", "vec", "set", "list", "range", "take", "drop", "sort", "sort-by", "group-by", "concat", "reverse", "identity", "atom")
FORMS = ("def", "if", "do", "let", "quote", "var", "fn", "loop", "recur", "throw", "try", "monitor-enter", "monitor-exit", "new", "set!", ".")
END = 1 << 30


def namespaces(nodes: DataFrame) -> DataFrame:
    """(path, namespace) of each file's first ns form."""
    return nodes.where((F.col("depth") == 0) & call("ns")).groupBy("path").agg(F.min_by(first(where(kids_from(1), is_symbol))["v"], "id").alias("namespace"))


def aliases(nodes: DataFrame) -> DataFrame:
    """(path, alias, origin, kind) of :require, :refer and :import clauses, colons and all."""
    vectors = nodes.where((F.col("type") == "Vector") & F.array_contains("enclosing", "ns"))
    after = lambda key: first(where(the_kids(), lambda x: F.get(the_kids(), x["k"] - 1)["v"] == key))
    named = vectors.select("path", after(":as")["v"].alias("alias"), kid(0)["v"].alias("origin"), F.lit("namespace").alias("kind")).where("alias is not null")
    requires = nodes.where((F.col("type") == "List") & F.array_contains("enclosing", "ns") & (kid(0)["v"].isin(":require", ":import")))
    refers = requires.select("path", F.explode(where(the_sub(), lambda x: (x["t"] == "Vector") & (x["d"] == 2) & some(the_sub(), lambda y: (y["p"] == x["p"]) & (y["k"] == x["k"] - 1) & (y["v"] == ":refer")))).alias("r"), "sub")
    referred = refers.select("path", F.explode(kids_of(F.col("r"))["v"]).alias("alias"), first(where(the_sub(), lambda x: (x["p"] == F.col("r.p")) & (x["k"] == 0)))["v"].alias("origin"), F.lit("referred").alias("kind"))
    imports = requires.where(kid(0)["v"] == ":import").select("path", F.explode(where(the_sub(), lambda x: is_symbol(x) & x["v"].contains("."))["v"]).alias("origin"))
    classes = imports.select("path", F.regexp_replace("origin", r"^.*\.", "").alias("alias"), "origin", F.lit("java_class").alias("kind"))
    return named.unionByName(referred).unionByName(classes)


def definitions(nodes: DataFrame) -> DataFrame:
    """Top-level definitions; the first of a name in a file counts."""
    kinds = F.when(the_head().isin("def", "defonce"), "variable").otherwise("function")
    d = nodes.where((F.col("depth") == 0) & call("defn", "defn-", "defmacro", "defmethod", "defmulti", "def", "defonce") & (kid(1)["t"] == "Symbol"))
    return d.groupBy("path", kid(1)["v"].alias("name")).agg(F.min_by(F.struct("id", kinds.alias("kind"), (the_head() == "defn-").alias("is_private"), last_kid()["t"].alias("value_type"), "line"), "id").alias("d")).select("path", "name", "d.*")


def bindings(nodes: DataFrame) -> DataFrame:
    """(path, name, kind, def_id, from_id, to_id): definitions, parameters, and let and loop names."""
    top = definitions(nodes).select("path", "name", "kind", F.col("id").alias("def_id"), F.lit(0).alias("from_id"), F.lit(END).alias("to_id"))
    end = F.col("id") + F.col("size")
    lists = nodes.where(call("defn", "defn-", "defmacro", "fn", "let", "loop"))
    p = F.when(the_head().isin("let", "loop"), kid(1)).when(the_head() == "fn", first(F.filter(the_kids(), lambda x: (x["k"] >= 1) & (x["t"] == "Vector")))).otherwise(parameters())
    # names nested in vectors and map patterns bind too; let values do not
    pattern = F.when(the_head().isin("let", "loop"), F.flatten(F.transform(pairs_of(p), lambda q: under(q["name"])))).otherwise(F.filter(under(p), lambda x: x["i"] > p["i"]))
    kind = F.when(the_head().isin("let", "loop"), "variable").otherwise("parameter")
    local = lists.select("path", F.explode(where(pattern, plain_parameter)).alias("b"), kind.alias("kind"), F.col("id"), end.alias("to_id"), (p["i"] + p["z"]).alias("behind"), the_head().isin("let", "loop").alias("is_let"))
    inner = local.select("path", F.col("b.v").alias("name"), "kind", (F.col("id") + F.col("b.i")).alias("def_id"), (F.col("id") + F.when(F.col("is_let"), F.col("behind")).otherwise(F.col("b.i"))).alias("from_id"), "to_id")
    return top.unionByName(inner)


def resolve(nodes: DataFrame) -> DataFrame:
    """(path, id, name, kind, def_id) of each symbol that a binding, an alias or the core explains; others are unknown."""
    uses = nodes.where("type = 'Symbol'").select("path", "id", F.col("value").alias("name"))
    b = bindings(nodes).withColumnRenamed("path", "b_path").withColumnRenamed("name", "b_name")
    met = uses.join(b, (F.col("path") == F.col("b_path")) & (F.col("name") == F.col("b_name")) & (F.col("id") >= F.col("from_id")) & (F.col("id") < F.col("to_id")))
    inner = met.groupBy("path", "id").agg(F.max_by(F.struct("kind", "def_id"), F.struct("from_id", "def_id")).alias("d"))
    space = F.regexp_extract("name", r"^([^/]+)/.", 1)
    named = aliases(nodes).groupBy("path", "alias").agg(F.min("kind").alias("alias_kind"))
    out = uses.join(inner, ["path", "id"], "left").withColumn("alias", F.when(space != "", space).otherwise(F.col("name"))).join(named, ["path", "alias"], "left")
    kind = F.coalesce("d.kind", F.when(space != "", F.when(F.col("alias_kind") == "namespace", "aliased")).otherwise(F.col("alias_kind")), F.when(F.col("name").isin(*FORMS), "core-special-form").when(F.col("name").isin(*CORE), "core-function"), F.lit("unknown"))
    return out.select("path", "id", "name", kind.alias("kind"), F.col("d.def_id").alias("def_id"))


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(path, id, fingerprint) of every node: alike for subtrees alike but for places, comments and docs."""
    return nodes.where("ast is not null").select("path", "id", F.substring(F.sha2("ast", 256), 1, 16).alias("fingerprint"))


def rendered(nodes: DataFrame) -> DataFrame:
    """(path, id, code) of lists: source text on one line. Where a row doesn't hold the list's whole subtree (see
    ``files.nodes``) the code is null."""
    opens = F.create_map(*[F.lit(x) for kv in {"List": "(", "Vector": "[", "Map": "{", "Set": "#{", "FnLiteral": "#(", "Quote": "'", "Deref": "@", "SyntaxQuote": "`", "Unquote": "~", "UnquoteSplice": "~@"}.items() for x in kv])
    closes = F.create_map(*[F.lit(x) for kv in {"List": ")", "Vector": "]", "Map": "}", "Set": "}", "FnLiteral": ")"}.items() for x in kv])
    before = lambda x: F.when((x["k"] > 0) & (x["i"] > 0), F.lit(" ")).otherwise(F.lit(""))
    leaf = lambda x: F.when(x["t"] == "String", text('"', x["v"], '"')).when(x["t"] == "VarQuote", text("#'", x["v"])).otherwise(x["v"])
    # closing marks of an entry: of itself if it has no members, and of all that end with it
    ends = lambda x: F.array_join(F.transform(F.reverse(F.filter(the_sub(), lambda y: (y["i"] <= x["i"]) & (y["i"] + y["z"] == x["i"] + 1))), lambda y: F.coalesce(F.try_element_at(closes, y["t"]), F.lit(""))), "")
    code = F.array_join(F.transform(the_sub(), lambda x: text(before(x), F.try_element_at(opens, x["t"]), F.when(x["n"] == 0, leaf(x)), ends(x))), "")
    return nodes.where("type in ('List', 'FnLiteral')").select("path", "id", F.when(F.size(the_sub()) == F.col("size"), code).alias("code"))
