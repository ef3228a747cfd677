"""Rules on design: function-level measures, effects, collections, wrappers, comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lispmill.functions.dsl import (
    the_head, is_list, the_kids, the_path, the_sub, any_of, body, call, deepest, first, found, inside, is_call, is_number, is_symbol, kid, kid_of, kids_from, kids_of, last_kid, last_of, local, no, pairs_of, parameters, plain_parameter, reaching, some, space, text, under, where, yes,
)
from lispmill.operators.registry import HINT, INFO, TRADITIONAL, WARNING, row_rule, table_rule

# Word lists of the rules.
REDUNDANT = ("function to", "method to", "this function", "this method", "calls", "returns", "defines", "creates", "sets", "gets", "increments", "decrements")
OBVIOUS = ("initialize", "start", "end", "validate", "check", "store", "save", "transform", "convert", "process", "handle", "manage", "update", "delete", "create", "add", "remove", "get", "set", "main function", "helper function", "utility function")
DEODORANT = ("hack", "workaround", "temporary", "quick fix", "dirty", "ugly", "bad", "terrible", "awful", "sorry", "apologize", "don't ask", "magic number", "hardcoded", "hard coded", "kludge", "bodge", "duct tape")
CODE_LIKE = r"^\s*[(\[{]|^\s*def[a-z-]*\s|^\s*(let|loop|require|import)\s*\[|^\s*(if|when|case|recur|->|->>)\s*\(|^\s*cond\s*$|^\s*ns\s+[a-z]"
RESPONSIBILITIES = {
    "I/O": ("println", "print", "printf", "slurp", "spit", "read", "read-line", "with-open"),
    "data-transformation": ("map", "filter", "reduce", "str", "assoc", "dissoc", "get", "get-in", "update", "conj", "into", "merge", "select-keys", "rename-keys", "group-by", "partition", ">=", "<=", ">", "<", "=", "not=", "inc", "dec", "+", "-", "*", "/"),
    "validation": ("valid?", "spec/valid?", "nil?", "empty?", "blank?", "number?", "string?", "keyword?", "pos?", "neg?", "zero?", "even?", "odd?"),
    "error-handling": ("try", "catch", "throw", "ex-info", "ex-data", "ex-message", "assert"),
    "logging": ("log", "debug", "info", "warn", "error", "trace"),
    "network": ("http/get", "http/post", "http/put", "http/delete", "client/get", "client/post", "request", "response"),
    "persistence": ("insert", "update", "delete", "select", "save", "find", "query", "create", "drop"),
    "configuration": ("config", "env", "property", "setting", "param"),
}
DECISIONS = ("if", "when", "cond", "case", "and", "or", "while", "loop")
PAIRS = (("I/O", "data-transformation"), ("I/O", "validation"), ("I/O", "persistence"), ("network", "logging"))
TRIPLES = (("I/O", "data-transformation", "validation"), ("network", "data-transformation", "logging"))
#: Parts of a name that tell a responsibility, beside the names.
PARTS = {"validation": ("valid",), "error-handling": ("error", "exception"), "logging": ("log",), "network": ("http", "request"), "persistence": ("db", "sql"), "configuration": ("config", "env")}
SPECIAL = ("let", "if", "when", "cond", "case", "do", "loop", "recur", "fn", "quote", "var", "def", "set!", "monitor-enter", "monitor-exit", "throw", "try", "catch", "finally", "new", ".")
EFFECTS = {
    "I/O": ("println", "print", "printf", "prn", "pr", "read", "read-line", "read-string", "spit", "slurp"),
    "state-mutation": ("swap!", "reset!", "alter", "commute", "ref-set", "send", "send-off", "deliver", "compare-and-set!", "set!"),
    "logging": ("log", "debug", "info", "warn", "error", "fatal", "trace"),
    "database": ("insert", "update", "delete", "execute", "query", "save", "persist"),
    "network": ("get", "post", "put", "delete", "request", "send", "publish"),
    "file-system": ("delete-file", "copy", "move", "mkdir", "rmdir"),
    "time": ("now", "current-time", "system-time", "current-time-millis", "nano-time"),
    "random": ("rand", "rand-int", "rand-nth", "random", "shuffle", "uuid"),
}
PURE_NAMES = ("calculate", "compute", "transform", "convert", "parse", "format", "validate", "check", "filter", "map", "reduce", "process", "get", "find", "search", "extract", "build", "create")
EFFECT_NAMES = ("save", "send", "write", "log", "print", "persist", "update", "insert", "delete")
IGNORED_SPACES = ("clojure.core", "cljs.core", "clojure.string", "clojure.set", "clojure.walk", "clojure.zip", "clojure.data", "clojure.edn", "clojure.java.io", "clojure.pprint", "clojure.repl")
ALIASES = {"str": "clojure.string", "set": "clojure.set", "walk": "clojure.walk", "data": "clojure.data", "io": "clojure.java.io", "json": "clojure.data.json", "csv": "clojure.data.csv", "xml": "clojure.data.xml", "zip": "clojure.zip", "test": "clojure.test", "spec": "clojure.spec.alpha", "s": "clojure.spec.alpha", "gen": "clojure.spec.gen.alpha", "edn": "clojure.edn"}
CORE_SPACES = ("clojure.core", "clojure.main", "clojure.repl")
#: Namespaces whose every call has the effect: whole names, and parts of names.
EFFECT_SPACES = {"I/O": (("io", "clojure.java.io"), ()), "logging": (("timbre",), ("log",)), "database": (("korma", "honeysql", "next.jdbc"), ("db", "sql")), "network": (("clj-http", "aleph"), ("http", "client")), "file-system": (("io", "clojure.java.io"), ("file",)), "time": (("clj-time",), ("time",)), "random": ((), ("random", "uuid"))}
INPUTS = ("slurp", "line-seq", "clojure.java.io/reader", "clojure.data.json/read-str", "json/read-str", "clojure.edn/read-string", "edn/read-string", "clojure.xml/parse", "http/get", "clj-http.client/get", "http/post", "clj-http.client/post")
SANITIZERS = ("clojure.string/trim", "str/trim", "clojure.string/triml", "str/triml", "clojure.string/trimr", "str/trimr", "clojure.string/escape", "str/escape", "clojure.core/int", "int", "clojure.core/long", "long", "clojure.core/double", "double", "clojure.core/boolean", "boolean", "clojure.core/keyword", "keyword", "clojure.spec.alpha/valid?", "s/valid?", "clojure.spec.alpha/conform", "s/conform")
STRING_TESTS = ("clojure.string/includes?", "str/includes?", "clojure.string/starts-with?", "str/starts-with?", "clojure.string/ends-with?", "str/ends-with?")


def is_defn() -> Column:
    return call("defn", "defn-")


def below() -> Column:
    """All entries below the node."""
    return F.filter(the_sub(), lambda x: x["i"] > 0)


def heads_below(keep=None) -> Column:
    """Heads of the lists below the node, in document order."""
    return F.transform(where(below(), lambda x: (x["t"] == "List") & x["h"].isNotNull() & (keep(x["h"]) if keep else F.lit(True))), lambda x: x["h"])


@row_rule("comments", TRADITIONAL, INFO, "Empty, long, stale, obvious and apologetic comments, and code in comments.", report_todo=True, report_fixme=True, report_empty=True, report_redundant=True, report_obvious=True, report_deodorant=True, report_commented_code=True, report_docstring=False, min_comment_length=5, max_comment_length=120)
def comments(report_todo: bool, report_fixme: bool, report_empty: bool, report_redundant: bool, report_obvious: bool, report_deodorant: bool, report_commented_code: bool, report_docstring: bool, min_comment_length: int, max_comment_length: int) -> Column:
    """``report_docstring`` is kept for configuration files; no docstring is a comment."""
    body_ = F.trim(F.regexp_replace("value", r"^[;#!]+", ""))
    low, size = F.lower(body_), F.octet_length(body_)
    has = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    code = body_.rlike(CODE_LIKE) | (F.length(F.regexp_replace(body_, r"[^(\[{]", "")) >= 2)
    tests = (
        (report_empty, size == 0, "Empty comment."), (min_comment_length > 0, (size > 0) & (size < min_comment_length), "Comment is too short to be useful."), (max_comment_length > 0, size > max_comment_length, "Comment is too long."),
        (report_todo, low.contains("todo"), "TODO comment."), (report_fixme, low.contains("fixme"), "FIXME comment."), (report_commented_code, code, "Commented-out code."), (report_deodorant, has(DEODORANT), "Deodorant comment."),
        (report_redundant, has(REDUNDANT), "Redundant comment."), (report_obvious, has(OBVIOUS), "Obvious comment."),
    )
    kind = F.coalesce(*[F.when(test, F.lit(m)) for on, test, m in tests if on], F.lit(None).cast("string"))
    worse = F.when(kind.isin("FIXME comment.", "Commented-out code.", "Deodorant comment."), F.lit(WARNING)).otherwise(F.lit(INFO))
    return F.when(F.col("type") == "Comment", found("comments", INFO, kind.isNotNull(), kind, severity_of=worse))


def call_depth() -> Column:
    """The deepest chain of calls below the node; vectors, maps and lambdas are passed through, other nodes end it."""

    def depth(x: Column, up: Column) -> Column:
        through = x["t"].isin("List", "Vector", "Map", "FnLiteral")
        # in document order a list's first member comes right behind it
        head = F.get(the_sub(), x["i"] + 1)
        counted = (x["t"] == "List") & (x["h"].isNotNull() | yes((x["n"] > 0) & (head["t"] == "Keyword")))
        return F.when(x["i"] == 0, F.lit(0)).when(up < 0, F.lit(-1)).when(counted, up + 1).when(through, up).otherwise(F.lit(-1))

    return deepest(the_sub(), depth)


@row_rule("deeply-nested", TRADITIONAL, WARNING, "Function bodies with deep call stacks.", max_depth=15)
def deeply_nested(max_depth: int) -> Column:
    return F.when(is_defn() & (F.col("size") > max_depth), found("deeply-nested", WARNING, call_depth() > max_depth, text("Calls in '", kid(1)["v"], "' go deeper than ", F.lit(max_depth), ".")))


def snake(x: Column) -> Column:
    return (x["t"] == "Keyword") & x["v"].rlike(r"^:[a-z0-9]+(_[a-z0-9]+)+$")


@row_rule("external-data-coupling:direct-external-schema-usage", TRADITIONAL, WARNING, "snake_case keys of outside data read from parameters.")
def external_schema() -> Column:
    names = F.transform(where(kids_of(kid(2)), is_symbol), lambda x: x["v"])
    on_param = lambda x: is_symbol(x) & F.array_contains(names, x["v"])
    key = lambda x: kid_of(x, 0)
    hit = lambda x: (x["t"] == "List") & (
        (snake(key(x)) & on_param(kid_of(x, 1))) | (is_call(x, "get", "clojure.core/get", "cljs.core/get") & on_param(kid_of(x, 1)) & snake(kid_of(x, 2))) | (is_call(x, "get-in", "clojure.core/get-in", "cljs.core/get-in") & on_param(kid_of(x, 1)) & (kid_of(x, 2)["t"] == "Vector") & some(kids_of(kid_of(x, 2)), snake))
    )
    one = first(where(F.filter(the_sub(), lambda x: x["i"] > kid(2)["i"]), hit))
    at = F.when(snake(key(one)), key(one)).when(is_call(one, "get", "clojure.core/get", "cljs.core/get"), kid_of(one, 2)).otherwise(first(where(kids_of(kid_of(one, 2)), snake)))
    adapter = F.lower(kid(1)["v"]).rlike(r"transform|parse|to-internal|map-external|external-to")
    return F.when(call("defn") & (F.col("n") >= 4) & (kid(2)["t"] == "Vector"), found("external-data-coupling:direct-external-schema-usage", WARNING, one.isNotNull() & ~adapter, text("Direct use of external key ", at["v"], " in '", kid(1)["v"], "'."), at))


@row_rule("divergent-change", TRADITIONAL, WARNING, "Functions with several responsibilities.", responsibility_threshold=2, complexity_threshold=15)
def divergent_change(responsibility_threshold: int, complexity_threshold: int) -> Column:
    def role(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, names in reversed(RESPONSIBILITIES.items()):
            part = [h.contains(p) for p in PARTS.get(k, ())]
            out = F.when(reduce(lambda a, b: a | b, part, h.isin(*names)), F.lit(k)).otherwise(out)
        return out

    roles = F.filter(F.transform(heads_below(), role), lambda r: r.isNotNull())
    kinds = F.array_sort(F.array_distinct(roles))
    has_all = lambda groups: reduce(lambda a, b: a | b, [reduce(lambda x, y: x & y, [F.array_contains(kinds, r) for r in g]) for g in groups])
    decisions = F.size(heads_below(lambda h: h.isin(*DECISIONS))) + 1
    n = F.size(kinds)
    divergent = ((n == 2) & has_all(PAIRS) & (F.size(roles) >= 3)) | ((n >= 3) & has_all(TRIPLES)) | (n > 3)
    bad = ((n >= responsibility_threshold) & divergent) | ((decisions > complexity_threshold) & (n >= 2))
    return F.when(is_defn(), found("divergent-change", WARNING, bad, text("Function '", kid(1)["v"], "' mixes responsibilities: ", F.array_join(kinds, ", "), ".")))


@table_rule("external-data-coupling", TRADITIONAL, WARNING, "String tests on data that came in unchecked.")
def external_data(nodes: DataFrame) -> DataFrame:
    """The argument of a string test flows from an input call: directly, by let names, or as a function's last form."""
    dirty = lambda x: some(under(x), lambda y: is_call(y, *INPUTS)) & no(some(under(x), lambda y: is_call(y, *SANITIZERS)))
    clean = yes(some(under(last_kid()), lambda y: is_call(y, *SANITIZERS)))
    uses = F.when(clean, F.array().cast("array<string>")).otherwise(F.transform(where(under(last_kid()), is_symbol), lambda y: y["v"]))
    defs = nodes.where(is_defn() & (F.col("depth") == 0)).select("path", kid(1)["v"].alias("name"), yes(dirty(last_kid())).alias("bad"), uses.alias("uses"))
    roots = nodes.where((F.col("depth") == 0) & is_list()).join(reaching(defs), "path", "left")
    named = F.coalesce("bad", F.array().cast("array<string>"))
    taints = lambda x, names: no(some(under(x), lambda y: is_call(y, *SANITIZERS))) & some(under(x), lambda y: (is_call(y, *INPUTS)) | (is_symbol(y) & F.array_contains(names, y["v"])))
    pairs = F.flatten(F.transform(where(the_sub(), lambda x: is_call(x, "let")), lambda x: pairs_of(kid_of(x, 1))))
    flows = F.aggregate(pairs, named, lambda s, p: F.when(yes((p["name"]["t"] == "Symbol") & taints(p["value"], s)), F.concat(s, F.array(p["name"]["v"]))).otherwise(s))
    hit = first(where(the_sub(), lambda x: is_call(x, *STRING_TESTS) & taints(kid_of(x, 1), flows)))
    out = roots.withColumn("hit", hit).where("hit is not null")
    return out.select(F.lit("external-data-coupling").alias("rule_id"), text("Unsanitized external data used in `", F.col("hit.h"), "`.").alias("message"), "path", F.col("hit.l").alias("line"), F.col("hit.c").alias("col"), F.lit(WARNING).alias("severity"), "ast")


@row_rule("feature-envy", TRADITIONAL, WARNING, "Functions that mostly call one other namespace.", min_total_calls=5, min_external_calls=3, envy_threshold=0.7, ignore_namespaces=IGNORED_SPACES)
def feature_envy(min_total_calls: int, min_external_calls: int, envy_threshold: float, ignore_namespaces: tuple) -> Column:
    # the definition itself is a call like any other; its file's name is its own namespace
    own = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\.clj[sc]?$", 1), "_", "-")
    calls = F.concat(F.array(the_head()), heads_below(lambda h: ~h.isin(*SPECIAL)))
    outside = F.filter(F.transform(calls, lambda h: F.when(h.contains("/"), F.regexp_extract(h, r"^([^/]*)/", 1))), lambda s: s.isNotNull() & ~s.isin(*ignore_namespaces, "") & (s != own))
    n, e = F.size(calls), F.size(outside)
    names = F.array_sort(F.array_distinct(outside))
    most = F.element_at(F.array_sort(F.transform(names, lambda s: F.struct((-F.size(F.filter(outside, lambda o: o == s))).alias("n"), s.alias("s")))), 1)["s"]
    return F.when(is_defn(), found("feature-envy", WARNING, (n >= min_total_calls) & (e >= min_external_calls) & (e >= n * envy_threshold - 1e-9), text("Function '", kid(1)["v"], "' envies namespace '", F.when(e > 0, most), "': ", e, " of ", n, " calls are external.")))


@row_rule("hidden-side-effects", TRADITIONAL, WARNING, "Effects that a function's name does not tell.")
def hidden_side_effects() -> Column:
    def told_by(h: Column) -> Column:
        """All effects of a call, in the order of the classes."""
        qualified = h.rlike(r"^[^/]*/[^/]*$")
        name, of = F.when(qualified, F.regexp_extract(h, r"/([^/]*)$", 1)).otherwise(h), F.when(qualified, F.regexp_extract(h, r"^([^/]*)/", 1))
        out = []
        for k, names in EFFECTS.items():
            whole, parts = EFFECT_SPACES.get(k, ((), ()))
            hit = any_of(name.isin(*names), *([of.isin(*whole)] if whole else []), *[of.contains(p) for p in parts], *([h.isin("System/currentTimeMillis", "System/nanoTime")] if k == "time" else []), *([h.contains("Random")] if k == "random" else []))
            out.append(F.when(hit, F.lit(k)))
        return F.filter(F.array(*out), lambda e: e.isNotNull())

    effects = F.array_distinct(F.flatten(F.transform(heads_below(), told_by)))
    name = F.lower(kid(1)["v"])
    has = lambda words: reduce(lambda a, b: a | b, [name.contains(w) for w in words])
    told = name.endswith("!") | has(EFFECT_NAMES)
    bad = (F.size(effects) > 0) & ~told & (has(PURE_NAMES) | (F.size(F.array_remove(effects, "logging")) > 0))
    return F.when(is_defn(), found("hidden-side-effects", WARNING, bad, text("Function '", kid(1)["v"], "' has hidden side effects: ", F.array_join(effects, ", "), ".")))


def literal_kind(x: Column) -> Column:
    """Collection type that an expression makes."""
    of_call = (
        F.when(x["h"].isin("vector", "vec"), "Vector").when(x["h"].isin("list", "list*", "map"), "List").when(x["h"].isin("hash-map", "array-map", "sorted-map", "sorted-map-by"), "Map")
        .when(x["h"].isin("hash-set", "set", "sorted-set", "sorted-set-by"), "Set").otherwise("List")
    )
    return F.when(x["t"].isin("Vector", "Map", "Set"), x["t"]).when((x["t"] == "List") & x["h"].isNotNull(), of_call).when(x["t"].isin("List", "Quote"), F.lit("List"))


@table_rule("inappropriate-collection", TRADITIONAL, HINT, "Collection functions used against their nature.")
def inappropriate_collection(nodes: DataFrame) -> DataFrame:
    a, b, n = kid(1), kid(2), F.col("n")
    defs = nodes.where(call("def", "defonce") & (F.col("depth") == 0) & (n >= 3)).groupBy("path", kid(1)["v"].alias("arg")).agg(F.min_by(literal_kind(last_kid()), "id").alias("def_kind"))
    heads = ("last", "nth", "some", "first", "empty?", "count", "sequence", "contains?", "reduce", "map", "apply", "concat", "reverse", "merge", "assoc-in", "get-in", "zipmap", "take", "for", "filter", "remove", "into", "doall", "=", ">", "not", "keys", "seq")
    rows = nodes.where(call(*heads)).withColumn("arg", F.when(a["t"] == "Symbol", a["v"])).join(defs, ["path", "arg"], "left")
    kind = F.when(a["t"].isin("Vector", "Map", "Set", "List", "Quote"), F.when(a["t"].isin("List", "Quote"), F.lit("List")).otherwise(a["t"])).otherwise(F.col("def_kind"))
    quoted = lambda x: (x["t"] == "Quote") | is_call(x, "quote")
    path_of_one = lambda x: (x["t"] == "Vector") & (x["n"] == 1)
    negated = is_call(a, "not") | (is_call(a, "comp") & is_symbol(kid_of(a, 1), "not")) | ((a["t"] == "FnLiteral") & (a["h"] == "not"))
    tests = [
        ("last", kind == "Vector", "`last` on a vector is linear: consider `peek`."), ("nth", kind == "List", "`nth` on a list is linear: consider a vector."),
        ("some", (a["t"] == "FnLiteral") & (b["t"] == "Vector"), "`some` over a vector literal: consider a set."), ("first", is_call(a, "filter"), "`first` of `filter`: consider `some`."),
        ("empty?", is_call(a, "filter"), "`empty?` of `filter`: consider `not-any?`."), ("count", is_call(a, "filter"), "`count` of `filter` builds a sequence."),
        ("sequence", is_call(a, "mapcat") & (a["n"] >= 2) & (n >= 3), "`sequence` of `mapcat`: consider a transducer."), ("contains?", kind.isin("Vector", "List") & b["t"].isin("Keyword", "String", "Symbol"), "`contains?` looks up indexes in this collection: consider a set."),
        ("reduce", quoted(b), "`reduce` over a quoted form."), ("map", is_symbol(a, "identity"), "`map identity` does nothing."), ("map", last_kid()["t"] == "Map", "`map` over a map literal: consider `reduce-kv`."),
        ("apply", (is_symbol(a, "hash-map") & b["t"].isin("Vector", "Symbol")) | is_symbol(a, "concat"), "`apply` here: consider `into` or `mapcat`."), ("concat", some(kids_from(1), lambda x: is_call(x, "concat")), "Nested `concat`."),
        ("reverse", is_call(a, "map", "filter", "remove", "take", "drop"), "`reverse` of a lazy sequence: consider `into ()`."), ("merge", n > 4, "`merge` of many maps: consider `into`."),
        ("assoc-in", path_of_one(b), "`assoc-in` with one key: consider `assoc`."), ("get-in", path_of_one(b), "`get-in` with one key: consider `get`."), ("zipmap", is_call(a, "range"), "`zipmap` over `range`: consider a vector."),
        ("take", is_call(b, "repeatedly"), "`take` of `repeatedly`: give it the count."), ("for", (a["t"] == "Vector") & (a["n"] == 2) & is_call(b), "`for` with one binding: consider `map`."),
        ("filter", negated, "`filter` of `not`: consider `remove`."), ("remove", negated, "`remove` of `not`: consider `filter`."),
        ("into", ((a["t"] == "Vector") & (a["n"] == 0) & no(is_call(b, "comp"))) | ((a["t"] == "Set") & (a["n"] == 0)), "`into` an empty literal: consider `vec` or `set`."), ("doall", is_call(a, "map"), "`doall` of `map`: consider `mapv`."),
        ("=", is_number(a, "0") & is_call(b, "count"), "`(= 0 (count x))`: consider `empty?`."), (">", is_call(a, "count") & is_number(b, "0"), "`(> (count x) 0)`: consider `seq`."),
        ("not", is_call(a, "empty?") | (is_call(a, "zero?") & is_call(kid_of(a, 1), "count")), "Negated emptiness: consider `seq`."), ("keys", is_call(a, "group-by"), "`keys` of `group-by`: consider `distinct`."), ("seq", is_call(a, "count"), "`seq` of `count`."),
    ]
    message = F.coalesce(*[F.when(yes((the_head() == h) & c), F.lit(m)) for h, c, m in tests])
    out = rows.withColumn("message", message).where("message is not null")
    return out.select(F.lit("inappropriate-collection").alias("rule_id"), "message", "path", "line", "col", F.lit(HINT).alias("severity"), "ast")


def only_call() -> Column:
    """The single body form if it is a call."""
    b = body()
    return F.when((F.size(b) == 1) & is_call(first(b)), first(b))


def arguments(x: Column) -> Column:
    return F.transform(F.filter(kids_of(x), lambda y: y["k"] > 0), lambda y: F.struct(y["t"].alias("t"), y["v"].alias("v")))


@row_rule("library-locker", TRADITIONAL, INFO, "Functions that only wrap a library's.", excluded_libraries=("clojure.core", "clojure.string", "clojure.set", "clojure.walk"), min_param_count=1)
def library_locker(excluded_libraries: tuple, min_param_count: int) -> Column:
    c, p = only_call(), F.transform(kids_of(parameters()), lambda x: F.struct(x["t"].alias("t"), x["v"].alias("v")))
    a, n = arguments(c), F.size(p)
    tail = F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.greatest(n, F.lit(0)))
    before = F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))
    fixed = no(some(before, lambda x: ~x["t"].isin("String", "Number", "Keyword", "Bool", "Nil", "Map", "Vector")))
    same = (n > 0) & (((F.size(a) >= n) & (tail == p) & fixed) | (F.array_sort(a) == F.array_sort(p)))
    lib = space(c["h"])
    return F.when(is_defn() & (kid(2)["t"] != "String"), found("library-locker", INFO, c.isNotNull() & lib.isNotNull() & ~lib.isin(*excluded_libraries, "") & (n >= min_param_count) & same, text("Function '", kid(1)["v"], "' only wraps `", c["h"], "`.")))


@row_rule("linear-collection-scan", TRADITIONAL, WARNING, "Chains and scans that pass over collections more than needed.")
def linear_scan() -> Column:
    a, b, n, tail = kid(1), kid(2), F.col("n"), last_kid()
    three, many = ("map", "filter", "remove"), ("map", "filter", "remove", "reduce", "mapcat")
    filt = lambda x: is_call(x, "filter")
    deep = lambda x: some(kids_of(x), lambda y: is_call(y, *many))
    zeros = some(kids_of(a), lambda x: (x["k"] % 2 == 1) & is_number(x, "0"))
    words = lambda *w: some(below(), lambda x: is_symbol(x, *w))
    tests = [
        (the_head().isin(*three) & is_call(tail, *three), WARNING, "Chained sequence operations pass over the collection twice."),
        ((n == 2) & is_call(a, "sort", "sort-by"), WARNING, "Sorting only to take one result."), ((the_head() == "map") & (n >= 3) & is_symbol(a, "println", "prn", "print"), WARNING, "`map` for side effects: consider `run!`."),
        (((the_head() == "not") & is_call(a, "empty?") & filt(kid_of(a, 1))) | ((the_head() == "not-empty") & filt(a)), WARNING, "Filtering to test for any: consider `some`."), (the_head().isin("first", "last") & filt(a), INFO, "Filtering to take one: consider `some`."),
        (the_head().isin(">", "pos?") & some(kids_from(1), lambda x: (x["t"] == "List") & (x["n"] == 2) & filt(kid_of(x, 1))), INFO, "Counting a filter to compare."),
        (the_head().isin(*many) & some(kids_from(1), lambda x: is_call(x, *many) & deep(x)), INFO, "Three nested sequence operations."), ((the_head() == "concat") & some(kids_from(1), lambda x: is_call(x, "concat")), INFO, "Nested `concat`."),
        ((the_head() == "reduce") & is_symbol(a, "+", "*", "min", "max", "and", "or"), HINT, "`reduce` of a built-in: consider `apply`."), ((the_head() == "for") & (a["t"] == "Vector") & (a["n"] == 2) & (b["t"] == "List") & (b["n"] == 2), HINT, "`for` with one binding: consider `map`."),
        ((the_head() == "take") & is_call(b, "drop"), HINT, "`take` of `drop`: consider `subvec`."), ((the_head() == "take") & is_call(b, "repeatedly"), HINT, "`take` of `repeatedly`: give it the count."), ((the_head() == "map") & (tail["t"] == "Map"), HINT, "`map` over a map literal."),
        (the_head().isin("=", ">") & some(kids_from(1), lambda x: is_call(x, "count")), HINT, "Comparing a count scans the collection."), ((the_head() == "loop") & words("when", "seq", "first", "recur"), HINT, "Manual loop over a collection: consider `reduce`."),
        ((the_head() == "loop") & zeros & words("inc", "recur"), HINT, "Manual counting loop."), ((the_head() == "count") & filt(a), INFO, "Counting a filter."),
    ]
    return F.when(is_list() & the_head().isNotNull(), F.coalesce(*[found("linear-collection-scan", s, c, m) for c, s, m in tests]))


@row_rule("long-function", TRADITIONAL, WARNING, "Functions over many lines.", max_lines=57)
def long_function(max_lines: int) -> Column:
    lines = F.transform(the_sub(), lambda x: x["l"])
    span = F.array_max(lines) - F.array_min(lines) + 1
    return F.when(call("defn"), found("long-function", WARNING, span > max_lines, text("'", kid(1)["v"], "' has ", span, " lines, more than ", F.lit(max_lines), ".")))


@row_rule("long-parameter-list", TRADITIONAL, WARNING, "Functions with many parameters.", heads=("defn",), max_parameters=9)
def long_parameters(max_parameters: int) -> Column:
    p = F.when(kid(2)["t"] == "Vector", kid(2)).when((kid(2)["t"] == "String") & (kid(3)["t"] == "Vector"), kid(3))
    own = kids_of(p)
    count = F.size(F.filter(own, lambda x: x["v"] != "&")) + F.coalesce(F.aggregate(where(own, lambda x: (x["t"] == "Vector") & (F.get(own, x["k"] - 1)["v"] == "&")), F.lit(0), lambda s, x: s + x["n"] - 1), F.lit(0))
    return F.when(call("defn"), found("long-parameter-list", WARNING, p.isNotNull() & (count > max_parameters), text("'", kid(1)["v"], "' takes ", count, " parameters, more than ", F.lit(max_parameters), "."), p))


@row_rule("message-chains", TRADITIONAL, WARNING, "Long chains of access.", max_length=7)
def message_chains(max_length: int) -> Column:
    gets = deepest(the_sub(), lambda x, up: F.when(x["i"] == 0, F.lit(1)).when(yes((x["k"] == 1) & is_call(x, "get") & (up > 0)), up + 1).otherwise(F.lit(0)))
    step = lambda x: (x["t"] == "Keyword") | is_call(x, "get", "get-in", ".")
    steps = F.size(where(kids_from(2), step))
    return F.coalesce(
        F.when(call("get"), found("message-chains", WARNING, gets >= max_length, text("Nested `get` of depth ", gets, "."))),
        F.when(call("get-in"), found("message-chains", WARNING, (F.col("n") == 3) & (kid(2)["t"] == "Vector") & (kid(2)["n"] >= max_length), text("`get-in` path of ", kid(2)["n"], " keys."))),
        F.when(call("->", "->>"), found("message-chains", WARNING, steps >= max_length, text("Chain of ", steps, " accesses in `", the_head(), "`."))),
    )


@row_rule("middle-man", TRADITIONAL, HINT, "Functions that only pass their arguments on.")
def middle_man() -> Column:
    c, names = only_call(), F.transform(kids_of(parameters()), lambda x: x["v"])
    args = F.filter(kids_of(c), lambda y: y["k"] > 0)
    values, n = F.transform(args, lambda x: x["v"]), F.size(names)
    tail = F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.greatest(n, F.lit(0)))
    symbols = no(some(F.slice(args, F.greatest(F.size(args) - n + 1, F.lit(1)), F.greatest(n, F.lit(0))), lambda x: x["t"] != "Symbol"))
    lead = F.slice(values, F.lit(1), F.greatest(F.size(values) - n, F.lit(0)))
    return F.when(call("defn"), found("middle-man", HINT, c.isNotNull() & (n > 0) & (F.size(values) >= n) & (tail == names) & symbols & no(F.arrays_overlap(lead, names)), text("Function '", kid(1)["v"], "' only delegates to `", c["h"], "`.")))


@row_rule("namespaced-keys-neglect", TRADITIONAL, INFO, "Needs context that no scan provides: it never fires.")
def namespaced_keys() -> Column:
    return found("namespaced-keys-neglect", INFO, F.lit(False), "")


@row_rule("positional-return-values", TRADITIONAL, WARNING, "Results whose places carry meaning.")
def positional_returns() -> Column:
    tail = F.when(is_call(last_kid(), "let"), last_of(last_kid())).otherwise(last_kid())
    head = kid_of(tail, 0)
    bad = ((tail["t"] == "Vector") | ((tail["t"] == "List") & head["t"].isin("Number", "String", "Keyword", "Bool", "Nil"))) & (tail["n"] >= 2)
    return F.when(call("defn", "fn") & (F.col("n") >= F.when(the_head() == "fn", 3).otherwise(4)), found("positional-return-values", WARNING, bad, "Function returns a collection whose elements are told by position. Consider a map.", tail))


@row_rule("primitive-obsession", TRADITIONAL, HINT, "Parameters that are all primitive.", heads=("defn", "defn-", "defrecord"), run=8)
def primitive_obsession(run: int) -> Column:
    """Exactly two plain parameters of a function, or a run of them; a parameter without a type counts as primitive."""
    at = F.lit(2) + (kid(2)["t"] == "String").cast("int")
    p = F.get(the_kids(), at + (F.get(the_kids(), at)["t"] == "Map").cast("int"))
    own = kids_of(p)
    plain = lambda x: is_symbol(x) & (x["v"] != "_") & ~x["v"].startswith("&")
    typed = F.get(own, F.lit(0))["v"].rlike("^[A-Z]") & ~F.get(own, F.lit(1))["v"].rlike("^[A-Z]")
    both = the_head().isin("defn", "defn-") & (p["n"] == 2) & no(some(own, lambda x: ~plain(x))) & no(typed)
    start = F.struct(F.lit(0).alias("now"), F.lit(-1).alias("at"))
    step = lambda s, x: F.when(s["now"] >= run, s).otherwise(F.struct(F.when(yes(plain(x)), s["now"] + 1).otherwise(F.lit(0)).alias("now"), F.when(yes(plain(x)) & (s["now"] > 0), s["at"]).otherwise(x["k"]).alias("at")))
    longest = F.aggregate(own, start, step)
    where_ = F.when(both, first(own)).otherwise(F.get(own, longest["at"]))
    return F.when(call("defn", "defn-", "defrecord") & (kid(1)["t"] == "Symbol"), found("primitive-obsession", HINT, (p["t"] == "Vector") & (both | (longest["now"] >= run)), text("'", kid(1)["v"], "' takes primitive parameters one after the other."), where_))


@row_rule("shotgun-surgery", TRADITIONAL, WARNING, "Functions that call many namespaces.", max_external_dependencies=4, max_namespace_usage=6)
def shotgun_surgery(max_external_dependencies: int, max_namespace_usage: int) -> Column:
    full = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    own = F.regexp_replace(F.regexp_replace(F.regexp_extract("path", r"^[^/]*/(.*)$", 1), r"\.clj$", ""), "/", ".")
    named = F.transform(heads_below(lambda h: h.rlike(r"^[^/]*/[^/]*$")), lambda h: F.regexp_extract(h, r"^([^/]*)/", 1))
    outside = F.filter(F.transform(named, lambda s: F.coalesce(F.try_element_at(full, s), s)), lambda s: ~s.isin(*CORE_SPACES) & (s != own))
    kinds = F.size(F.array_distinct(outside))
    return F.when(is_defn(), found("shotgun-surgery", WARNING, (kinds > max_external_dependencies) | (F.size(outside) > max_namespace_usage), text("Function '", kid(1)["v"], "' makes ", F.size(outside), " calls to ", kinds, " namespaces.")))


@row_rule("string-map-keys", TRADITIONAL, INFO, "Strings as keys of map literals.")
def string_keys() -> Column:
    keys = where(the_kids(), lambda x: (x["k"] % 2 == 0) & (x["t"] == "String"))
    return F.when(F.col("type") == "Map", found("string-map-keys", INFO, (F.col("n") % 2 == 0) & (F.size(keys) > 0), text("String key \"", first(keys)["v"], "\" in map literal. Consider a keyword."), first(keys)))


@row_rule("unnecessary-abstraction", TRADITIONAL, HINT, "Local functions used once, and functions that only look up a key.")
def unnecessary_abstraction() -> Column:
    pairs = pairs_of(kid(1))
    rest = F.filter(the_sub(), lambda x: x["i"] >= kid(1)["i"] + kid(1)["z"])
    once = where(pairs, lambda p: is_symbol(p["name"]) & (p["value"]["t"] == "FnLiteral") & (F.size(where(rest, lambda x: is_symbol(x) & (x["v"] == p["name"]["v"]))) == 1))
    b = first(body())
    simple = (F.size(body()) == 1) & (b["t"] == "List") & (((kid_of(b, 0)["t"] == "Keyword") & (b["n"] == 2)) | (is_call(b, "get") & b["n"].isin(3, 4)))
    return F.coalesce(
        F.when(call("let") & (kid(1)["t"] == "Vector"), found("unnecessary-abstraction", HINT, F.size(once) > 0, text("Local function '", first(once)["name"]["v"], "' is used once."), first(once)["name"])),
        F.when(call("defn"), found("unnecessary-abstraction", HINT, simple, text("Function '", kid(1)["v"], "' only looks up a key."), kid(1))),
    )


# --- rules over files -------------------------------------------------------------------------------------


@table_rule("cyclic-dependency", TRADITIONAL, WARNING, "Pairs of functions of a file that call each other.")
def cyclic(nodes: DataFrame) -> DataFrame:
    defs = nodes.where(is_defn() & (F.col("n") >= 3))
    calls = defs.select("path", "id", kid(1)["v"].alias("a"), F.explode(F.filter(the_sub(), lambda x: (x["t"] == "List") & (x["i"] > 0))).alias("c")).select("path", "a", F.col("c.h").alias("b"), F.col("c.l").alias("line"), F.col("c.c").alias("col")).where("b is not null and a <> b")
    edges = calls.groupBy("path", "a", "b").agg(F.min(F.struct("line", "col")).alias("at"))
    back = edges.select("path", F.col("b").alias("a"), F.col("a").alias("b"))
    hit = edges.join(back, ["path", "a", "b"], "left_semi").where("a < b")
    return hit.select(F.lit("cyclic-dependency").alias("rule_id"), text("`", F.col("a"), "` and `", F.col("b"), "` call each other.").alias("message"), "path", "at.line", "at.col", F.lit(WARNING).alias("severity"), F.lit(None).cast("string").alias("ast"))


def combinations(names: Column, low: int, high: int) -> Column:
    """All sub-arrays of low to high members, in order, of an array of at most 8: the bits of a number choose."""
    masks = F.sequence(F.lit(0), F.expr("int(power(2, least(size(names), 8))) - 1"))
    chosen = F.filter(masks, lambda m: F.bit_count(m).between(low, high))
    return F.transform(chosen, lambda m: F.filter(names, lambda x, i: F.expr("true") & (F.call_function("getbit", m, i) == 1)))


@table_rule("data-clumps", TRADITIONAL, WARNING, "Parameters that occur together in several functions.", min_clump_size=3, max_parameters_check=8, max_clump_size=6, min_occurrences=2, similarity_threshold=0.7)
def data_clumps(nodes: DataFrame, min_clump_size: int, max_parameters_check: int, max_clump_size: int, min_occurrences: int, similarity_threshold: float) -> DataFrame:
    """Members of a key share all its names, so their similarity is 1: a threshold above that reports nothing. No group is cut off."""
    p = parameters()
    groups = nodes.where(call("defn", "defn-", "defmacro")).select("path", "id", p["l"].alias("line"), p["c"].alias("col"), F.transform(where(kids_of(p), plain_parameter), lambda x: x["v"]).alias("names")).where(F.size("names").between(min_clump_size, max_parameters_check) & F.lit(similarity_threshold <= 1))
    keys = groups.select("path", "id", "line", "col", F.explode(F.array_distinct(F.transform(combinations(F.col("names"), min_clump_size, max_clump_size), lambda c: F.array_join(F.array_sort(c), ",")))).alias("clump"))
    often = keys.groupBy("clump").agg(F.count("*").alias("times")).where(F.col("times") >= min_occurrences)
    hit = keys.join(often, "clump")
    return hit.select(F.lit("data-clumps").alias("rule_id"), text("Parameters ", F.col("clump"), " travel together through ", F.col("times"), " functions.").alias("message"), "path", "line", "col", F.lit(WARNING).alias("severity"), F.lit(None).cast("string").alias("ast"))


CORE = ("map", "filter", "reduce", "apply", "partial", "comp", "let", "when", "if", "cond", "case", "defn", "def", "assoc", "dissoc", "get", "get-in", "update", "update-in", "first", "rest", "last", "count", "empty?", "seq", "+", "-", "*", "/", "=", "<", ">", "<=", ">=", "not=")


@table_rule("duplicated-code", TRADITIONAL, WARNING, "Definitions alike but for names and literals.", tokens=5)
def duplicated(nodes: DataFrame, tokens: int) -> DataFrame:
    """A definition's shape: its nodes in order with literals and names that are not of the core left out."""
    shape = F.array_join(F.transform(the_sub(), lambda x: F.concat_ws(":", x["d"], F.when(x["t"] == "Symbol", F.when(x["v"].isin(*CORE, "defn-", "defmacro", "defmethod"), x["v"]).otherwise(F.lit("VAR"))).otherwise(x["t"]))), " ")
    blocks = nodes.where(call("defn", "defn-", "defmacro", "defmethod") & (F.col("size") >= tokens)).select("path", "id", "line", "col", "ast", F.sha2(shape, 256).alias("shape"))
    # the first of each shape and the count so far, from (shape, file) totals: a common shape is not gathered in one task
    in_file = Window.partitionBy("shape", "path").orderBy("id")
    per_file = blocks.groupBy("shape", "path").agg(F.count("*").alias("n"))
    totals = per_file.groupBy("shape").agg(F.sum("n").alias("total"), F.min("path").alias("first_path")).where("total > 1")
    hit = blocks.withColumn("k", F.row_number().over(in_file)).join(totals, "shape").where("path <> first_path or k > 1")
    return hit.select(F.lit("duplicated-code").alias("rule_id"), text("Duplicated code: this shape occurs ", F.col("total"), " times, first in ", F.col("first_path"), ".").alias("message"), "path", "line", "col", F.lit(WARNING).alias("severity"), "ast")
