"""Rules on idioms of the language: mostly filters on one row, its children and its subtree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lispmill.functions.dsl import (
    the_head, is_list, the_kids, the_path, the_sub, all_of, any_of, call, deepest, first, FINDING, found, inside, is_call, is_number, is_symbol, kid, kid_of, kids_from, kids_of, last_of, local, no, pairs_of, parameters, plain_parameter, reaching, some, space, text, under, where, yes,
)
from lispmill.operators.registry import CLOJURE, HINT, INFO, WARNING, reads_deeply, row_rule, table_rule

# Names that the rules must know.
BLOCKING = ("Thread/sleep", "slurp", "spit", "await", "deref", "future-call", "locking", "@", ".readLine", ".acquire", "java.net.Socket.")
BARRIERS = ("thread", "future", "delay", "lazy-seq")
HEAVY = ("jdbc/execute!", "jdbc/query", "jdbc/insert!", "sql/execute!", "sql/query", "sql/insert!", "client/get", "client/post", "client/put", "client/request", "http/get", "http/post", "http/put", "http/request", "car/wcar", "redis/wcar", "aws/invoke", "kafka/send", "kafka/send!", "producer/send", "producer/send!")
DYNAMIC_ALLOWED = ("*out*", "*err*", "*in*", "*ns*", "*warn-on-reflection*", "*file*", "*compile-path*", "*command-line-args*", "*agent*", "*math-context*", "*print-length*", "*print-level*", "*data-readers*", "*default-data-reader-fn*")
RESOURCE_WORDS = ("db", "conn", "pool", "tx", "transaction", "client", "producer", "socket", "ds", "redis", "kafka", "s3", "http", "writer", "session")
SENTINELS = ("done", "end", "eof", "close", "stop", "exit", "complete", "finish", "eos", "poison", "bye", "quit", "terminat", "closed", "finished", "completed", "synced", "return", "break", "nil", "last-item", "shutdown")
CANDIDATES = ("map", "filter", "remove", "reduce", "mapcat", "keep", "distinct", "sort", "sort-by", "group-by", "partition", "take", "drop", "take-while", "drop-while", "assoc", "dissoc", "update", "merge", "select-keys", "str/replace", "str/trim", "str/upper-case", "str/lower-case", "str/split", "vec", "set", "seq", "into", "mapv", "filterv", "reduce-kv", "keys", "vals", "first", "last", "rest", "next", "assoc-in", "update-in", "get", "get-in", "concat", "reverse", "upper-case", "lower-case", "trim", "replace", "split", "count", "join", "str/join", "capitalize", "str/capitalize", "boolean")
CONDITIONALS = ("if", "when", "if-not", "when-not", "if-let", "when-let", "if-some", "when-some", "cond", "case")
TRACKED = ("let", "when", "if", "when-let", "if-let", "when-some", "if-some", "when-not", "if-not", "loop", "binding", "with-open", "with-local-vars", "doseq", "dotimes", "for", "try", "catch", "cond", "case")
RESOURCES = ("reader", "writer", "stream", "socket", "connection")
DEFINING = ("defn", "defn-", "def", "defonce", "defmacro", "defmulti", "defprotocol", "defrecord", "deftype")
MUTATORS = ("set!", "alter-var-root", "agent-send", "agent-send-off", "intern")
JAVA_MUTATORS = (".add", ".put", ".remove", ".clear", ".addAll", ".putAll", ".removeAll", ".retainAll", ".set", ".insert", ".delete", ".append")
SIDE_EFFECTS = ("println", "print", "prn", "printf", "spit", "def", "defonce", "intern")
TEST_NAMESPACES = ("clojure.repl", "clojure.test", "clojure.tools.namespace.repl", "clojure.pprint", "alex-and-georges.debug-repl")
SAFE_NAMESPACES = ("user", "build", "dev", "core", "main", "test", "repl")
REFERENCES = ("atom", "volatile!", "ref", "agent")
UPDATES = ("swap!", "reset!", "send", "send-off", "alter", "commute", "vreset!", "vswap!")
THREADING = ("->", "->>", "some->", "some->>")
BODY_FORMS = ("let", "loop", "letfn", "binding", "with-local-vars", "with-open", "with-out-str", "with-in-str", "locking", "future", "promise", "testing", "doseq", "dotimes", "deftest", "go", "go-loop", "thread", "alt!", "alts!", "with-redefs", "with-bindings", "when", "when-not", "when-let", "when-some")
DOMAINS = {
    "STRING": ("str", "name", "namespace", "pr-str"),
    "MAP": ("get", "first", "last", "nth", "assoc", "dissoc", "update", "update-in", "assoc-in", "keys", "vals", "select-keys"),
    "SEQ": ("seq", "map", "filter", "reduce", "into", "concat", "reverse", "sort", "take", "drop", "rest", "next", "mapv", "filterv", "remove", "vector", "conj"),
    "LOGIC": ("count", "pos?", "neg?", "zero?", "inc", "dec", "+", "-", "=", "boolean", "not", "and", "or", "<", ">", "<=", ">=", "empty?", "not-empty"),
    "IO": ("slurp", "spit", "read-string", "println", "print", "prn"),
}
RT_ADVICE = {"iter": "seq", "get": "get", "assoc": "assoc", "conj": "conj", "count": "count", "nth": "nth", "first": "first", "rest": "rest", "seq": "seq", "cons": "cons", "empty": "empty", "meta": "meta", "with-meta": "with-meta", "print": "print", "load": "require", "var": "var", "deref": "deref"}

reads_deeply(*TRACKED, *CANDIDATES)


def goes(name: Column) -> Column:
    return name.isin("go", "go-loop") | name.endswith("/go") | name.endswith("/go-loop")


def blocks(name: Column) -> Column:
    return name.contains("!!") | name.isin(*BLOCKING) | name.startswith("clj-http.client/") | name.startswith("http/") | name.contains("jdbc/execute!")


def barrier(name: Column) -> Column:
    return name.isin(*BARRIERS) | name.endswith("/thread") | name.endswith("/future")


def unsheltered(xs: Column, hit, shelter) -> Column:
    """Entries that hit, with no sheltering list above them; shelters cover runs of the document order."""
    return F.aggregate(
        xs,
        F.struct(F.lit(-1).alias("until"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.struct(
            F.when((x["i"] > s["until"]) & yes((x["t"] == "List") & shelter(x["h"])), x["i"] + x["z"] - 1).otherwise(s["until"]).alias("until"),
            F.when((x["i"] > s["until"]) & yes(hit(x)), F.concat(s["out"], F.array(x["v"]))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )


@table_rule("blocking-inside-go", CLOJURE, WARNING, "Blocking calls inside go blocks, also through functions of the same file.")
def blocking_inside_go(nodes: DataFrame) -> DataFrame:
    used = unsheltered(the_sub(), lambda x: (x["t"] == "Symbol"), barrier)
    block = unsheltered(the_sub(), lambda x: ((x["t"] == "Symbol") & blocks(x["v"])) | (x["t"] == "Deref"), barrier)
    defs = nodes.where(call("defn", "defn-", "def") & (F.col("depth") == 0)).select("path", kid(1)["v"].alias("name"), (F.size(block) > 0).alias("bad"), F.array_distinct(used).alias("uses"))
    gos = nodes.where(is_list() & goes(the_head())).select("path", "line", "col", "ast", "head", (F.size(block) > 0).alias("own"), F.array_distinct(used).alias("uses"))
    hit = gos.join(reaching(defs), "path", "left").where(F.col("own") | F.coalesce(F.arrays_overlap("uses", "bad"), F.lit(False)))
    return hit.select(F.lit("blocking-inside-go").alias("rule_id"), text("`", the_head(), "` parks its thread on a blocking call, here or in a function it uses.").alias("message"), "path", "line", "col", F.lit(WARNING).alias("severity"), "ast")


@row_rule("case-with-non-literal-test-values", CLOJURE, WARNING, "case tests that are symbols or hold symbols.")
def case_tests() -> Column:
    plain = lambda x: is_symbol(x) & ~x["v"].isin("true", "false", "nil")
    tests = where(the_kids(), lambda x: (x["k"] >= 2) & (x["k"] % 2 == 0) & (x["k"] < F.col("n") - 1) & (plain(x) | ((x["t"] == "List") & some(under(x), plain))))
    return found("case-with-non-literal-test-values", WARNING, call("case") & (F.size(tests) > 0), text("Test `", first(tests)["v"], "` is compared as a symbol: `case` takes constants."), first(tests))


def runs_of(pairs: Column, begins, goes_on) -> Column:
    """Longest run: of consecutive pairs, the first of which begins it and each next of which goes on from the one before."""
    steps = F.transform(pairs, lambda p, i: F.struct(p["name"]["v"].alias("name"), yes(begins(p)).alias("begins")))
    goes = F.zip_with(F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))), F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0))), lambda b, p: yes(goes_on(b, p)))
    marked = F.zip_with(steps, F.concat(F.array(F.lit(False)), goes), lambda x, g: F.struct(x["name"].alias("name"), x["begins"].alias("begins"), F.coalesce(g, F.lit(False)).alias("goes")))
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(None).cast("string").alias("name"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(x["goes"] & (s["now"] > 0), s["now"] + 1).when(x["begins"], F.lit(1)).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"), F.when(now > s["best"], x["name"]).otherwise(s["name"]).alias("name"))

    return F.aggregate(F.coalesce(marked, F.array().cast("array<struct<name:string,begins:boolean,goes:boolean>>")), state, step)


def mentions(x: Column, name: Column) -> Column:
    return some(under(x), lambda y: is_symbol(y) & (y["v"] == name))


@row_rule("conditional-build-up", CLOJURE, HINT, "A let symbol that conditional rebindings build up.")
def conditional_build_up() -> Column:
    pairs = pairs_of(kid(1))
    run = runs_of(
        pairs,
        lambda p: is_symbol(p["name"]) & no(mentions(p["value"], p["name"]["v"])),
        lambda b, p: (b["name"]["v"] == p["name"]["v"]) & is_call(p["value"], "if", "clojure.core/if", "cljs.core/if") & (p["value"]["n"] == 4) & mentions(kid_of(p["value"], 2), p["name"]["v"]) & (kid_of(p["value"], 3)["v"] == p["name"]["v"]) & (kid_of(p["value"], 3)["t"] == "Symbol"),
    )
    lets = call("let", "clojure.core/let", "cljs.core/let") & (kid(1)["t"] == "Vector") & (kid(1)["n"] >= 6)
    return F.when(lets, found("conditional-build-up", HINT, run["best"] >= 3, text("`", run["name"], "` grows over ", run["best"] - 1, " conditional bindings in a row; one `cond->` says it.")))


@row_rule("direct-use-of-clojure-lang-rt", CLOJURE, WARNING, "Calls of the runtime's internal class.", allowed_functions=())
def runtime_calls(allowed_functions: tuple) -> Column:
    name = F.regexp_extract(the_head(), r"^(?:clojure\.lang\.)?RT/(.*)$", 1)
    advice = F.create_map(*[F.lit(x) for kv in RT_ADVICE.items() for x in kv])
    return found("direct-use-of-clojure-lang-rt", WARNING, is_list() & the_head().rlike(r"^(clojure\.lang\.)?RT/") & ~name.isin(*allowed_functions, ""), text("`", the_head(), "` reaches into the runtime class; the public way is `", F.coalesce(F.try_element_at(advice, name), F.lit("a core function")), "`."))


def earmuffed(x: Column) -> Column:
    return is_symbol(x) & x["v"].rlike(r"^\*.+\*$") & ~x["v"].isin(*DYNAMIC_ALLOWED)


def resource_named(x: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(F.regexp_replace(x["v"], r"^\*|\*$", "")), "-"), F.array(*[F.lit(w) for w in RESOURCE_WORDS]))


@row_rule("dynamically-scoped-singleton-resource", CLOJURE, WARNING, "Dynamic variables passed to functions of heavy resources.")
def dynamic_resource() -> Column:
    args = where(kids_from(1), earmuffed)
    return found("dynamically-scoped-singleton-resource", WARNING, call(*HEAVY) & (F.size(args) > 0), text("`", the_head(), "` takes its resource from the dynamic `", first(args)["v"], "`; hand it over as an argument."), first(args))


@row_rule("excessive-refers", CLOJURE, WARNING, "Namespaces that refer everything, or more than a few names.", max_explicit_refers=6)
def excessive_refers(max_explicit_refers: int) -> Column:
    keys = where(the_sub(), lambda x: (x["t"] == "Keyword") & x["v"].contains("refer"))
    after = lambda x: first(F.filter(the_sub(), lambda y: (y["p"] == x["p"]) & (y["k"] == x["k"] + 1)))
    whole = some(keys, lambda x: (after(x)["t"] == "Keyword") & (after(x)["v"] == ":all"))
    widest = F.array_max(F.transform(where(keys, lambda x: after(x)["t"] == "Vector"), lambda x: after(x)["n"]))
    name = kid(1)["v"]
    return F.when(the_head() == "ns", F.coalesce(
        found("excessive-refers", WARNING, whole, text("`", name, "` refers every name of another namespace.")),
        found("excessive-refers", WARNING, widest > max_explicit_refers, text("`", name, "` refers ", widest, " names of one namespace; an alias is clearer.")),
    ))


@row_rule("immutability-violation", CLOJURE, WARNING, "Mutation of state, arrays, Java objects or global definitions.")
def immutability() -> Column:
    local_scope = any_of(F.col("in_function"), F.col("in_let"), F.col("in_loop"), F.col("in_binding"))
    sent = some(under(kid(2)), lambda x: is_call(x, *SIDE_EFFECTS))
    message = (
        F.when(the_head().isin("def", "defonce") & local_scope, text("`", the_head(), "` below the top level redefines a global."))
        .when((the_head() == "ref-set") & ~inside("dosync"), F.lit("`ref-set` needs a `dosync` around it."))
        .when(the_head().startswith("aset"), text("`", the_head(), "` writes to an array in place."))
        .when(the_head().isin(*JAVA_MUTATORS), text("`", the_head(), "` changes a Java object in place."))
        .when(the_head().isin(*MUTATORS), text("`", the_head(), "` changes state behind the reader's back."))
        .when(the_head().isin("send", "send-off") & (F.col("n") >= 3) & sent, F.lit("An agent's action has effects beyond the agent."))
    )
    return F.when(is_list() & the_head().isNotNull() & ~the_path().endswith("user.clj") & ~the_path().contains("/dev/"), found("immutability-violation", WARNING, message.isNotNull(), message))


@row_rule("implicit-namespace-dependencies", CLOJURE, WARNING, ":use without :only, standalone use, and :refer :all.")
def implicit_dependencies() -> Column:
    dev = the_path().rlike("(^|/)(dev|tests?)/|_test\\.clj")
    exempt = lambda x: dev & x.isin(*TEST_NAMESPACES)
    has_only = lambda x: some(kids_of(x), lambda y: (y["t"] == "Keyword") & (y["v"] == ":only"))
    specs = where(kids_from(1), lambda x: (is_symbol(x) & ~exempt(x["v"])) | ((x["t"] == "Vector") & ~exempt(kid_of(x, 0)["v"]) & ~has_only(x)))
    used = F.array_join(F.transform(specs, lambda x: F.when(x["t"] == "Symbol", x["v"]).otherwise(kid_of(x, 0)["v"])), ", ")
    all_refer = where(F.filter(the_sub(), lambda x: x["d"].between(1, 2)), lambda x: x["t"].isin("Vector", "List") & some(kids_of(x), lambda y: (y["v"] == ":refer") & some(kids_of(x), lambda z: (z["k"] == y["k"] + 1) & (z["v"] == ":all"))) & ~exempt(kid_of(x, 0)["v"]))
    names = F.array_join(F.transform(all_refer, lambda x: kid_of(x, 0)["v"]), ", ")
    quoted = where(kids_from(1), lambda x: (x["t"] == "Quote") & no(some(under(x), lambda y: y["v"] == ":only")))
    key = first(the_kids())
    clause = is_list() & (key["t"] == "Keyword") & ~the_path().endswith("project.clj")
    shown = F.array_join(F.transform(quoted, lambda x: F.coalesce(first(where(under(x), is_symbol))["v"], F.lit(""))), ", ")
    return F.coalesce(
        F.when(clause & (key["v"] == ":use"), found("implicit-namespace-dependencies", WARNING, F.size(specs) > 0, text("`:use` without `:only` takes in all of ", used, "."))),
        F.when(clause & (key["v"] == ":require"), found("implicit-namespace-dependencies", WARNING, F.size(all_refer) > 0, text("`:refer :all` takes in all of ", names, "."))),
        F.when(call("use") & ~the_path().endswith("project.clj"), found("implicit-namespace-dependencies", WARNING, F.size(quoted) > 0, text("A bare `use` takes in all of ", shown, "."))),
    )


@row_rule("improper-emptiness-check", CLOJURE, HINT, "Roundabout tests for empty collections.")
def emptiness() -> Column:
    counted = lambda x: is_call(x, "count") & (x["n"] == 2)
    a, b = kid(1), kid(2)
    left = counted(a) & ((is_number(b, "0") & the_head().isin("=", "==", "not=", ">")) | (is_number(b, "1") & (the_head() == ">=")))
    right = counted(b) & ((is_number(a, "0") & the_head().isin("=", "==", "not=", "<")) | (is_number(a, "1") & (the_head() == "<=")))
    empty = the_head().isin("=", "==")
    advice = F.when(empty, F.lit("(empty? xs)")).otherwise(F.lit("(seq xs)"))
    calls = F.col("type").isin("List", "FnLiteral")
    return F.when(calls & the_head().isNotNull(), F.coalesce(
        found("improper-emptiness-check", HINT, the_head().isin("not", "when-not", "if-not") & is_call(a, "empty?"), text("`", the_head(), "` of `empty?`: `(seq xs)` asks the same.")),
        found("improper-emptiness-check", HINT, the_head().isin("zero?", "pos?") & is_call(a, "count"), text("`", the_head(), "` of a count walks the whole collection to see if it is empty.")),
        found("improper-emptiness-check", HINT, (F.col("n") == 3) & (left | right), text("`", the_head(), "` on a `count` asks for emptiness: `", advice, "` does without counting.")),
    ))


@row_rule("map-with-nil-values", CLOJURE, WARNING, "Explicit nil values in map literals and assoc.")
def nil_values() -> Column:
    in_map = where(the_kids(), lambda x: (x["k"] % 2 == 1) & (x["t"] == "Nil"))
    skip = F.when((F.col("n") - 1) % 2 == 1, 2).otherwise(1)
    in_assoc = where(the_kids(), lambda x: (x["k"] >= skip) & ((x["k"] - skip) % 2 == 1) & (x["t"] == "Nil"))
    return F.coalesce(
        F.when(F.col("type") == "Map", found("map-with-nil-values", WARNING, F.size(in_map) > 0, "The map spells out a nil for this key.", first(in_map))),
        F.when(call("assoc", "clojure.core/assoc"), found("map-with-nil-values", WARNING, F.size(in_assoc) > 0, "`assoc` puts a literal nil under a key.", first(in_assoc))),
    )


@row_rule("marker-protocol", CLOJURE, INFO, "Protocols without methods.")
def marker_protocol() -> Column:
    return found("marker-protocol", INFO, call("defprotocol") & (F.col("n") >= 2) & no(some(kids_from(2), lambda x: is_call(x))), text("Protocol `", kid(1)["v"], "` declares nothing to implement."))


def sentinel(x: Column) -> Column:
    name = F.lower(F.regexp_replace(local(x["v"]), "^:+", ""))
    return x["t"].isin("Keyword", "Symbol", "String") & reduce(lambda a, b: a | b, [name.contains(s) for s in SENTINELS])


@row_rule("misuse-of-channel-closing-semantics", CLOJURE, WARNING, "Sentinel values in place of closing a channel.")
def sentinels() -> Column:
    in_go = F.exists("enclosing", goes)
    marked = where(under(kid(2)), sentinel)
    any_marked = where(F.filter(the_sub(), lambda x: x["i"] > 0), lambda x: sentinel(x) & ~x["v"].isin("=", "not="))
    minus = some(the_kids(), lambda x: is_number(x, "-1"))
    puts = the_head().isin("put!", ">!", ">!!") | the_head().endswith("/put!") | the_head().endswith("/>!") | the_head().endswith("/>!!")
    rule = "misuse-of-channel-closing-semantics"
    return F.when(is_list(), F.coalesce(
        found(rule, WARNING, (first(the_kids())["t"] == "Keyword") & in_go & sentinel(first(the_kids())), text("`", first(the_kids())["v"], "` asks for an end mark; a closed channel yields nil by itself.")),
        F.when(puts & (F.col("n") >= 3), found(rule, WARNING, F.size(marked) > 0, text("`", the_head(), "` sends the end mark ", first(marked)["v"], " where `close!` would do."))),
        F.when(the_head().isin("=", "not=") & in_go, found(rule, WARNING, (F.size(any_marked) > 0) | minus, text("Compared with the end mark ", F.coalesce(first(any_marked)["v"], F.lit("-1")), "; `close!` needs none."))),
        F.when(the_head().isin("contains?", "get") & in_go & (F.col("n") >= 3), found(rule, WARNING, F.size(marked) > 0, text("Looks for the end mark ", first(marked)["v"], " in a message."))),
    ))


@row_rule("misuse-of-dynamic-scope", CLOJURE, WARNING, "Custom dynamic variables, defined or bound.")
def dynamic_scope() -> Column:
    name = first(where(kids_from(1), is_symbol))
    bound = where(kids_of(kid(1)), lambda x: (x["k"] % 2 == 0) & is_symbol(x) & ~x["v"].isin(*DYNAMIC_ALLOWED) & ~resource_named(x))
    return F.coalesce(
        F.when(call("def"), found("misuse-of-dynamic-scope", WARNING, earmuffed(name) & ~resource_named(name), text("`", name["v"], "` is a dynamic variable of our own."), name)),
        F.when(call("binding") & (kid(1)["t"] == "Vector"), found("misuse-of-dynamic-scope", WARNING, F.size(bound) > 0, text("`binding` rebinds `", first(bound)["v"], "` for all that it calls."), first(bound))),
    )


@row_rule("misused-threading", CLOJURE, WARNING, "Threading macros over lambdas or mixed domains.", domains=5)
def misused_threading(domains: int) -> Column:
    steps = kids_from(1)
    lambdas = some(steps, lambda x: (x["t"] == "FnLiteral") | ((x["t"] == "List") & (kid_of(x, 0)["t"] == "FnLiteral")))

    def domain(x: Column) -> Column:
        head = kid_of(x, 0)
        name = F.when(x["t"].isin("Symbol", "Keyword"), x["v"]).when((x["t"] == "List") & head["t"].isin("Symbol", "Keyword"), head["v"])
        out = F.when(name.startswith(":"), F.lit("MAP")).when(name.startswith("."), F.lit("INTEROP"))
        for k, names in DOMAINS.items():
            out = out.when(name.isin(*names), F.lit(k))
        return out.when(name.rlike(r"clojure\.string|^(str|string)/"), F.lit("STRING")).when(name.rlike(r"java\.io|^io/|http|json|edn"), F.lit("IO"))

    kinds = F.size(F.array_distinct(F.filter(F.transform(steps, domain), lambda x: x.isNotNull())))
    why = F.when(lambdas, F.lit(" has a lambda as a step, to move the threaded value.")).otherwise(text(" runs through values of ", kinds, " kinds."))
    return F.when(call("->", "->>", "some->", "some->>") & (F.col("n") >= 3), found("misused-threading", WARNING, lambdas | (kinds >= domains), text("`", the_head(), "`", why)))


@row_rule("monolithic-namespace-split", CLOJURE, WARNING, "load and in-ns that split a namespace over files.")
def split_namespace() -> Column:
    return found("monolithic-namespace-split", WARNING, is_list() & local(the_head()).isin("load", "in-ns") & no((F.col("up_type") == "List") & (F.col("up_head") == "comment")), text("`", the_head(), "` spreads one namespace over several files."))


@row_rule("multiple-evaluation-in-macros", CLOJURE, WARNING, "Macro parameters evaluated more than once.")
def multiple_evaluation() -> Column:
    arities = F.filter(the_kids(), lambda x: (x["k"] >= 2) & (x["t"] == "List"))
    single = parameters()
    repeated = lambda names, forms: where(names, lambda x: plain_parameter(x) & (F.size(where(forms, lambda y: is_symbol(y) & (y["v"] == x["v"]))) > 1))
    rest = F.filter(the_sub(), lambda x: x["i"] >= single["i"] + single["z"])
    one = repeated(kids_of(single), rest)
    many = F.flatten(F.transform(arities, lambda a: repeated(kids_of(kid_of(a, 0)), F.filter(under(a), lambda x: x["i"] >= kid_of(a, 0)["i"] + kid_of(a, 0)["z"]))))
    hits = F.when(single.isNotNull(), one).otherwise(many)
    names = F.array_join(F.array_sort(F.transform(hits, lambda x: x["v"])), " ")
    return F.when(call("defmacro"), found("multiple-evaluation-in-macros", WARNING, F.size(hits) > 0, text("Macro `", kid(1)["v"], "` may evaluate ", names, " more than once.")))


@table_rule("namespace-load-side-effects", CLOJURE, WARNING, "Dependencies loaded in functions or behind definitions.")
def load_side_effects(nodes: DataFrame) -> DataFrame:
    loads = ("require", "use", "import", "load", "load-file", "requiring-resolve")
    lists = nodes.where(is_list() & the_head().isin("ns", *loads, *DEFINING)).select("path", "id", "line", "col", "head", "ast", "enclosing")
    before = Window.partitionBy("path").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    seen = lists.withColumn("spaces", F.coalesce(F.sum((the_head() == "ns").cast("int")).over(before), F.lit(0))).withColumn("defs", F.coalesce(F.max(the_head().isin(*DEFINING).cast("int")).over(before), F.lit(0)))
    around = inside("defn", "defn-", "fn", "letfn")
    in_function = around & (the_head() != "requiring-resolve")
    later = ~around & ((F.col("spaces") > 1) | (F.col("defs") > 0))
    message = F.when(in_function, text("`", the_head(), "` runs each time the function does.")).otherwise(text("`", the_head(), "` stands behind definitions, so loading depends on their order."))
    skip = F.lower(the_path()).rlike(r"project\.clj$|deps\.edn$|/support/|/scripts/|/dev/|/build/|/repl/|_test\.clj$")
    hits = seen.where(the_head().isin(*loads) & ~inside("ns", "comment") & ~skip & (in_function | later))
    return hits.select(F.lit("namespace-load-side-effects").alias("rule_id"), message.alias("message"), "path", "line", "col", F.lit(WARNING).alias("severity"), "ast")


@row_rule("nested-atoms", CLOJURE, WARNING, "References inside references.")
def nested_atoms() -> Column:
    makes = lambda xs: some(xs, lambda x: is_call(x, *REFERENCES))
    below = F.filter(the_sub(), lambda x: x["i"] > 0)
    names = F.transform(where(pairs_of(kid(1)), lambda p: is_symbol(p["name"]) & makes(under(p["value"]))), lambda p: p["name"]["v"])
    moved = some(F.filter(the_sub(), lambda x: x["i"] >= kid(1)["i"] + kid(1)["z"]), lambda x: is_call(x, *UPDATES) & some(F.filter(under(x), lambda y: (y["i"] > x["i"] + 2)), lambda y: is_symbol(y) & F.array_contains(names, y["v"])))
    return F.coalesce(
        F.when(call(*REFERENCES), found("nested-atoms", WARNING, makes(below), "A reference holds another reference.")),
        F.when(call(*UPDATES), found("nested-atoms", WARNING, makes(below), "A state update makes a new reference.")),
        F.when(call("let") & (kid(1)["t"] == "Vector"), found("nested-atoms", WARNING, (F.size(names) > 0) & moved, "A reference made in this `let` is put into another one.")),
    )


@row_rule("nested-forms", CLOJURE, WARNING, "Chains of nested binding, iteration and conditional forms.", max_consecutive_same_forms=3, max_conditional_depth=4, tracked_forms=TRACKED)
def nested_forms(max_consecutive_same_forms: int, max_conditional_depth: int, tracked_forms: tuple) -> Column:
    tracked = lambda x: is_call(x, *tracked_forms)

    def step(s: Column, x: Column) -> Column:
        # the chain goes to the first tracked form right below its end, or below a `do` there
        inside_do = is_call(x) & (x["p"] == s["do"])
        ok = yes(tracked(x) & ((x["p"] == s["at"]) | inside_do))
        return F.struct(
            F.when(ok, x["i"]).otherwise(s["at"]).alias("at"), F.when(ok, F.lit(-1)).when(yes(is_call(x, "do") & (x["p"] == s["at"])), x["i"]).otherwise(s["do"]).alias("do"),
            F.when(ok, F.concat(s["forms"], F.array(x["h"]))).otherwise(s["forms"]).alias("forms"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("do"), F.array(the_head()).alias("forms"))
    forms = F.aggregate(F.filter(the_sub(), lambda x: x["i"] > 0), begin, step)["forms"]
    n = lambda *names: F.size(F.filter(forms, lambda f: f.isin(*names)))
    bad = (n("let") >= max_consecutive_same_forms) | (n("doseq") >= 2) | (n("for") >= 2) | (n(*CONDITIONALS) >= max_conditional_depth) | (n("when-let") >= 2) | (n("if-let") >= 2)
    return F.when(call(*tracked_forms), found("nested-forms", WARNING, (F.size(forms) >= 2) & bad, text(F.size(forms), " forms one inside the other: ", F.array_join(forms, " > "), ".")))


@row_rule("non-idiomatic-parameter-binding", CLOJURE, INFO, "Optional parameters by & and a vector.")
def optional_by_vector() -> Column:
    other = first(F.filter(the_kids(), lambda x: (x["k"] >= 2) & ~x["t"].isin("String", "Map")))
    own = kids_of(other)
    rest = where(own, lambda x: (x["t"] == "Vector") & (F.get(own, x["k"] - 1)["v"] == "&") & some(kids_of(x), is_symbol))
    return F.when(call("defn", "defn-", "fn"), found("non-idiomatic-parameter-binding", INFO, (other["t"] == "Vector") & (F.size(rest) > 0), text("`", kid(1)["v"], "` takes apart its rest arguments for the optional `", first(kids_of(first(rest)))["v"], "`; arities or a map say it better.")))


@table_rule("non-idiomatic-record-construction", CLOJURE, WARNING, "Positional constructors of records of the file.")
def record_construction(nodes: DataFrame) -> DataFrame:
    records = nodes.where(call("defrecord")).groupBy("path", kid(1)["v"].alias("record")).agg(F.min("id").alias("def_id"))
    uses = nodes.where(is_list() & the_head().rlike(r"^->.|^[^.].*\.$")).select("path", "id", "line", "col", "ast", F.regexp_replace(the_head(), r"^->|\.$", "").alias("record"))
    hits = uses.join(records, ["path", "record"]).where("def_id < id")
    return hits.select(F.lit("non-idiomatic-record-construction").alias("rule_id"), text("Built by position; `map->", F.col("record"), "` names the fields.").alias("message"), "path", "line", "col", F.lit(WARNING).alias("severity"), "ast")


@row_rule("private-multimethods", CLOJURE, WARNING, "Multimethods in private contexts.")
def private_multimethods() -> Column:
    private = lambda x: ((x["t"] == "Keyword") & (x["v"] == ":private")) | ((x["t"] == "Map") & some(kids_of(x), lambda y: y["v"] == ":private"))
    multi = call("defmulti", "defmethod") | some(F.filter(the_sub(), lambda x: x["i"] > 0), lambda x: is_call(x, "defmulti", "defmethod"))
    return F.when(is_list() & the_head().isNotNull() & (F.col("n") >= 2), found("private-multimethods", WARNING, multi & (the_head().isin("defn-", "letfn") | some(the_kids(), private)), "A multimethod that others cannot extend: it is declared private."))


@row_rule("production-doall", CLOJURE, WARNING, "doall outside tests and development code.", allow_in_tests=True, allow_in_dev_code=True, allow_in_repl=True)
def production_doall(allow_in_tests: bool, allow_in_dev_code: bool, allow_in_repl: bool) -> Column:
    places = ((True, r"project\.clj$|deps\.edn$"), (allow_in_tests, r"[_-]test\.clj$|/int-test/"), (allow_in_dev_code, r"/dev/|user\.clj$"), (allow_in_repl, "repl|user|scratch"))
    skip = the_path().rlike("|".join(p for on, p in places if on))
    arg = kid(1)["h"]
    why = (
        F.when(F.col("up_head").isin("defn", "defn-"), F.lit(" in function definition")).when(F.col("up_head").isin("let", "when", "if", "do"), text(" in ", F.col("up_head"), " form"))
        .when(F.col("up_head").isin("map", "mapcat", "filter"), text(" in ", F.col("up_head"), " operation")).when(arg.isin("map", "filter", "mapcat", "remove", "keep"), text(" on ", arg, " result")).otherwise(F.lit(""))
    )
    return found("production-doall", WARNING, call("doall") & ~skip, text("`doall` holds a whole sequence in memory", why, "."))


@row_rule("redundant-do-block", CLOJURE, INFO, "do where the form around it has a body already.")
def redundant_do() -> Column:
    up, k, n = F.col("up_head"), F.col("idx"), F.col("up_n")
    many = F.col("n") > 2
    threaded = up.isin(*THREADING)
    clause = (up.isin("cond", "case") & (k >= 2) & (k % 2 == 0)) | ((up == "condp") & (k >= 3) & (k % 2 == 1))
    branch = up.isin("if", "if-not", "if-let", "if-some") & ((k == 2) | ((k == 3) & (n == 4)))
    in_body = (
        (up.isin(*BODY_FORMS) & (k >= 2)) | ((branch | clause) & ~many) | (up.isin("defn", "defn-", "defmacro") & (k >= 3) & (k == n - 1) & yes(F.col("in_function"))) | ((up == "fn") & (k >= 2) & (k == n - 1))
        | ((up == "try") & (k >= 1)) | ((up == "catch") & (k >= 3)) | ((up == "finally") & (k >= 1))
    )
    chained = (up == "doto") & (k >= 2)
    spliced = some(the_kids(), lambda x: x["t"] == "UnquoteSplice")
    message = (
        F.when(chained, F.lit("`doto` hands its value to `do`, which drops it.")).when(threaded, text("`", up, "` needs no `do` as a step.")).when(F.col("n") == 1, text("An empty `do` in `", up, "`."))
        .when(F.col("n") == 2, text("A `do` around one form in `", up, "`.")).otherwise(text("`", up, "` has a body already, so its `do` adds nothing."))
    )
    return F.when(call("do") & (F.col("up_type") == "List"), found("redundant-do-block", INFO, (((threaded & (k >= 1)) | chained) | (in_body & no(spliced))), message))


@row_rule("single-segment-namespace", CLOJURE, WARNING, "Namespaces of one segment.")
def single_segment() -> Column:
    name = kid(1)["v"]
    skip = F.lower(the_path()).rlike(r"/test/|/scripts/|/dev/|/build/|/support/|project\.clj")
    return F.when(call("ns") & (kid(1)["t"] == "Symbol"), found("single-segment-namespace", WARNING, ~name.contains(".") & ~name.isin(*SAFE_NAMESPACES) & ~skip, text("Namespace `", name, "` has no dot in its name.")))


@row_rule("thread-ignorance", CLOJURE, HINT, "Nested calls and let chains that threading would flatten.", min_let_chain=4, min_nesting_depth=5)
def thread_ignorance(min_let_chain: int, min_nesting_depth: int) -> Column:
    pairs = pairs_of(kid(1))
    uses = lambda b: F.size(where(the_sub(), lambda y: is_symbol(y) & (y["v"] == b["name"]["v"])))
    chain = runs_of(pairs, lambda p: is_symbol(p["name"]), lambda b, p: (p["value"]["t"] == "List") & some(kids_of(p["value"]), lambda y: is_symbol(y) & (y["v"] == b["name"]["v"])) & (uses(b) == 2))["best"]
    named = lambda x: is_call(x, *CANDIDATES)

    # candidates on the path from the node to an entry, which another call ends
    nested = deepest(the_sub(), lambda x, up: F.when(yes(named(x)), F.coalesce(up, F.lit(0)) + 1).when(yes(x["t"] == "List"), F.lit(-99)).otherwise(F.coalesce(up, F.lit(0))))
    return F.coalesce(
        F.when(call("let") & (kid(1)["t"] == "Vector") & (kid(1)["n"] >= 2 * min_let_chain), found("thread-ignorance", HINT, chain >= min_let_chain + 1, text(chain, " bindings each feed only the next one; threading says it in one form."))),
        F.when(call(*CANDIDATES), found("thread-ignorance", HINT, nested >= min_nesting_depth, text(nested, " calls inside each other read from the inside out."))),
    )


@row_rule("unmanaged-resource-io", CLOJURE, WARNING, "I/O resources outside with-open.")
def unmanaged_io() -> Column:
    return found("unmanaged-resource-io", WARNING, is_list() & F.lower(the_head()).rlike("|".join(RESOURCES)) & no(F.col("in_with_open")), "Nothing closes this resource: no `with-open` stands around it.")


@row_rule("unnecessary-into", CLOJURE, HINT, "into where vec, set, seq or a transducer says it.", check_type_transformations=True, check_map_mapping=True, check_transducer_api=True)
def unnecessary_into(check_type_transformations: bool, check_map_mapping: bool, check_transducer_api: bool) -> Column:
    target, source = kid(1), kid(2)
    plain = F.when(target["t"] == "Vector", F.lit("vec")).when(target["t"] == "Set", F.lit("set")).when(target["t"] == "List", F.lit("seq"))
    lazy = is_call(source, "map", "filter", "remove", "keep", "keep-indexed", "distinct", "take", "drop", "take-while", "drop-while") & (source["n"] >= 3)
    none = F.lit(None).cast(FINDING)
    by_type = found("unnecessary-into", HINT, plain.isNotNull() & (target["n"] == 0), text("`", plain, "` turns a collection into this type by itself."))
    by_api = found("unnecessary-into", HINT, lazy, text("`into` of a lazy `", source["h"], "`: as a transducer it makes no sequence in between."))
    # a mapped source is reported by either of the last two checks
    on = [x for x, wanted in ((by_api, check_transducer_api or check_map_mapping), (by_type, check_type_transformations)) if wanted]
    return F.when(call("into") & (F.col("n") == 3), F.coalesce(*on, none))


@row_rule("verbose-checks", CLOJURE, HINT, "Comparisons and arithmetic that core functions name.", check_numeric_comparisons=True, check_boolean_comparisons=True, check_nil_comparisons=True, check_math_operations=True)
def verbose_checks(check_numeric_comparisons: bool, check_boolean_comparisons: bool, check_nil_comparisons: bool, check_math_operations: bool) -> Column:
    a, b = kid(1), kid(2)
    three, r = F.col("n") == 3, "verbose-checks"
    zero_l, zero_r = is_number(a, "0"), is_number(b, "0")
    of = lambda t, v=None: (a["t"] == t if v is None else (a["v"] == v) & (a["t"] == t)) | (b["t"] == t if v is None else (b["v"] == v) & (b["t"] == t))
    odd = is_call(a, "mod", "rem") & (a["n"] == 3) & is_number(kid_of(a, 2), "2") & zero_r
    branches = F.col("n") == 4
    yes_no = branches & (kid(2)["t"] == "Bool") & (kid(3)["t"] == "Bool") & (kid(2)["v"] != kid(3)["v"])
    none = F.lit(None).cast(FINDING)
    on = [
        (check_numeric_comparisons, found(r, HINT, three & the_head().isin("=", ">", "<", ">=", "<=") & (zero_l | zero_r) & ~odd, text("`", the_head(), "` against 0: the core has zero?, pos? and neg?."))),
        (check_boolean_comparisons, found(r, HINT, three & the_head().isin("=", "not=") & of("Bool"), text("`", the_head(), "` against a boolean: the core has true? and false?."))),
        (check_nil_comparisons, found(r, HINT, three & the_head().isin("=", "not=") & of("Nil"), text("`", the_head(), "` against nil: the core has nil? and some?."))),
        (check_math_operations, found(r, HINT, three & (((the_head() == "+") & (is_number(a, "1") | is_number(b, "1"))) | ((the_head() == "-") & is_number(b, "1"))), text("`", the_head(), "` by 1: the core has inc and dec."))),
        (True, found(r, HINT, (the_head() == "if") & yes_no, "Both branches are booleans, so the test says it alone.")),
        (True, found(r, HINT, three & the_head().isin("=", "not=") & odd, "A remainder by 2 is what even? and odd? ask for.")),
    ]
    return F.when(is_list() & the_head().isin("=", ">", "<", ">=", "<=", "not=", "+", "-", "if"), F.coalesce(*[x for wanted, x in on if wanted], none))
