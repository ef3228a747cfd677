"""Source text made from the driver's tables, so that findings can be told from the base columns without parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For each rule: source that it must report, source that it must not, and the lines (from 0) of the reports.
SNIPPETS: dict[str, tuple[str, str, list[int]]] = {
    "blocking-inside-go": ("(defn take-it [c] (<!! c))\n(go (take-it ch))", "(defn take-it [c] (<! c))\n(go (future (<!! ch)))", [1]),
    "case-with-non-literal-test-values": ("(case x\n  limit 1\n  2)", "(case x\n  :limit 1\n  2)", [1]),
    "conditional-build-up": ("(let [m {}\n      m (if a (assoc m :a 1) m)\n      m (if b (assoc m :b 2) m)]\n  m)", "(let [m {}\n      m (if a (assoc m :a 1) m)]\n  m)", [0]),
    "direct-use-of-clojure-lang-rt": ("(clojure.lang.RT/count xs)", "(count xs)", [0]),
    "dynamically-scoped-singleton-resource": ("(jdbc/query\n  *db* sql)", "(jdbc/query\n  db sql)", [1]),
    "excessive-refers": ("(ns my.app (:require [a.b :refer [c d e f g h i]]))", "(ns my.app (:require [a.b :refer [c d e f g h]]))", [0]),
    "immutability-violation": ("(defn f []\n  (def x 1))", "(def x 1)", [1]),
    "implicit-namespace-dependencies": ("(ns my.app\n  (:use a.b))", "(ns my.app\n  (:use [a.b :only [c]]))", [1]),
    "improper-emptiness-check": ("(when (= 0 (count xs)) 1)", "(when (empty? xs) 1)", [0]),
    "map-with-nil-values": ("{:a 1\n :b nil}", "{:a 1\n :b 2}", [1]),
    "marker-protocol": ("(defprotocol Marked \"doc\")", "(defprotocol Marked (run [this]))", [0]),
    "misuse-of-channel-closing-semantics": ("(>! ch :done)", "(>! ch :value)", [0]),
    "misuse-of-dynamic-scope": ("(def ^:dynamic\n  *user* nil)", "(def ^:dynamic\n  *db-conn* nil)", [1]),
    "misused-threading": ("(-> x (#(inc %)) dec)", "(-> x inc dec)", [0]),
    "monolithic-namespace-split": ("(in-ns 'my.app)", "(comment (in-ns 'my.app))", [0]),
    "multiple-evaluation-in-macros": ("(defmacro twice [x]\n  `(+ ~x ~x))", "(defmacro once [x]\n  `(inc ~x))", [0]),
    "namespace-load-side-effects": ("(def a 1)\n(require 'b.c)", "(require 'b.c)\n(def a 1)", [1]),
    "nested-atoms": ("(atom {:a (atom 1)})", "(atom {:a 1})", [0]),
    "nested-forms": ("(doseq [a as]\n  (doseq [b bs] (p a b)))", "(doseq [a as]\n  (p a))", [0]),
    "non-idiomatic-parameter-binding": ("(defn f [a & [b]] a)", "(defn f [a & more] a)", [0]),
    "non-idiomatic-record-construction": ("(defrecord User [a])\n(->User 1)", "(->User 1)\n(map->User {:a 1})", [1]),
    "private-multimethods": ("(defmulti ^:private area :kind)", "(defmulti area :kind)", [0]),
    "production-doall": ("(doall (map f xs))", "(mapv f xs)", [0]),
    "redundant-do-block": ("(when x\n  (do (a) (b)))", "(if x\n  (do (a) (b)))", [1]),
    "single-segment-namespace": ("(ns billing)", "(ns my.billing)", [0]),
    "thread-ignorance": ("(map f (filter g (map h (remove k (take n xs)))))", "(map f (filter g (map h (remove k xs))))", [0]),
    "unmanaged-resource-io": ("(io/reader f)", "(with-open [r (io/reader f)] r)", [0]),
    "unnecessary-into": ("(into [] xs)", "(into xs ys)", [0]),
    "verbose-checks": ("(= x nil)", "(= x y)", [0]),
    "explicit-recursion": ("(defn total [xs]\n  (if (empty? xs) 0 (+ (first xs) (total (rest xs)))))", "(defn total [xs]\n  (reduce + xs))", [0]),
    "inefficient-filtering": ("(first (filter odd? xs))", "(some odd? xs)", [0]),
    "lazy-side-effects": ("(defn show [x] (println x))\n(map show xs)", "(defn show [x] (println x))\n(run! show xs)", [1]),
    "overabstracted-composition": ("(comp a b c d)", "(comp a b c)", [0]),
    "overuse-of-high-order-functions": ("(map (fn [x] (apply-twice f x)) xs)", "(map (fn [x] (f x)) xs)", [0]),
    "inefficient-generator": ("(gen/such-that odd? g)", "(gen/fmap odd? g)", [0]),
    "premature-optimization": ("(with-retry 3 (f))", "(f)", [0]),
    "trivial-lambda": ("(map #(f %) xs)", "(map #(f % 1) xs)", [0]),
    "underutilizing-features: use-mapcat": ("(apply concat (map f xs))", "(mapcat f xs)", [0]),
    "cyclic-dependency": ("(defn a [x] (b x))\n(defn b [x] (a x))", "(defn a [x] (b x))\n(defn b [x] (c x))", [0]),
    "comments": (";; TODO repair", ";; why: upstream order matters", [0]),
    "deeply-nested": ("(defn deep [x]\n  " + "(f " * 16 + "x" + ")" * 16 + ")", "(defn deep [x]\n  " + "(f " * 15 + "x" + ")" * 15 + ")", [0]),
    "external-data-coupling:direct-external-schema-usage": ("(defn show [row]\n  (:first_name row))", "(defn show [row]\n  (:first-name row))", [1]),
    "divergent-change": ("(defn work [x]\n  (println (map inc (filter f x))))", "(defn work [x]\n  (map inc (filter f x)))", [0]),
    "external-data-coupling": ("(defn check [f]\n  (let [s (slurp f)] (str/includes? s \"x\")))", "(defn check [f]\n  (let [s (str/trim (slurp f))] (str/includes? s \"x\")))", [1]),
    "feature-envy": ("(defn f [x]\n  (a/b x) (a/c x) (a/d x) (a/e x) (a/f x))", "(defn f [x]\n  (a/b x) (h x) (i x) (j x) (g x))", [0]),
    "hidden-side-effects": ("(defn calculate-total [x]\n  (swap! state inc))", "(defn swap-total! [x]\n  (swap! state inc))", [0]),
    "inappropriate-collection": ("(def v [1 2])\n(last v)", "(def v '(1 2))\n(last v)", [1]),
    "library-locker": ("(defn fetch [url opts]\n  (http/get url opts))", "(defn fetch [url opts]\n  (http/get url (or opts {})))", [0]),
    "linear-collection-scan": ("(map f (filter g xs))", "(map f xs)", [0]),
    "long-function": ("(defn long-one []\n" + "  (a)\n" * 57 + ")", "(defn long-one []\n" + "  (a)\n" * 56 + ")", [0]),
    "long-parameter-list": ("(defn many\n  [a b c d e f g h i j] a)", "(defn many\n  [a b c d e f g h i] a)", [1]),
    "message-chains": ("(get-in m [:a :b :c :d :e :f :g])", "(get-in m [:a :b :c :d :e :f])", [0]),
    "middle-man": ("(defn pass [a b]\n  (other a b))", "(defn pass [a b]\n  (other b a))", [0]),
    "namespaced-keys-neglect": ("(s/def :id int?)", "(s/def ::id int?)", []),
    "positional-return-values": ("(defn pair [a b]\n  [a b])", "(defn pair [a b]\n  {:a a :b b})", [1]),
    "primitive-obsession": ("(defn wide\n  [a b c d e f g h] a)", "(defn wide\n  [a b c d e f g {h :h}] a)", [1]),
    "shotgun-surgery": ("(defn spread [x]\n  (a/a x) (b/b x) (c/c x) (d/d x) (e/e x))", "(defn spread [x]\n  (a/a x) (b/b x) (c/c x) (d/d x))", [0]),
    "string-map-keys": ("{\"a\" 1}", "{:a 1}", [0]),
    "unnecessary-abstraction": ("(let [f #(inc %)]\n  (f 1))", "(let [f #(inc %)]\n  (f (f 1)))", [0]),
}


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def parts_corpus(part: DataFrame, rule: str) -> DataFrame:
    """A file for each part: blank lines by its size, then source that the rule must report unless the key is a multiple of 3."""
    bad, good, _ = SNIPPETS[rule]
    body = F.when(F.col("p_partkey") % 3 != 0, F.lit(bad)).otherwise(F.lit(good))
    return part.select(F.format_string("src/p%d.clj", F.col("p_partkey")).alias("path"), F.concat(F.repeat(F.lit("\n"), F.col("p_size") % 7), body).alias("text"))


def parts_oracle(rule: str) -> str:
    lines = SNIPPETS[rule][2]
    rows = " UNION ALL ".join(
        f"SELECT {literal(rule)} AS rule_id, 'src/p' || p_partkey || '.clj' AS path, (p_size % 7 + {1 + k})::INTEGER AS line FROM part WHERE p_partkey % 3 <> 0" for k in lines
    )
    return rows or "SELECT '' AS rule_id, '' AS path, 0::INTEGER AS line FROM part WHERE false"


#: What the snippet of one rule gives of another rule that is on by default: (snippet's rule, rule, line from 0).
ALSO = (("improper-emptiness-check", "verbose-checks", 0),)


def every_corpus(part: DataFrame) -> DataFrame:
    """A file for each part with the snippet of one of all rules, by its key."""
    names = sorted(SNIPPETS)
    pick = F.get(F.array(*[F.lit(SNIPPETS[n][0]) for n in names]), (F.col("p_partkey") % len(names)).cast("int"))
    return part.select(F.format_string("src/p%d.clj", F.col("p_partkey")).alias("path"), pick.alias("text"))


def every_oracle(severities: dict[str, str]) -> str:
    """The findings of the given rules over ``every_corpus``: those of each rule's own snippet, and ``ALSO``."""
    names = sorted(SNIPPETS)
    rows = [(n, n, line) for n in names for line in SNIPPETS[n][2]] + list(ALSO)
    values = ", ".join(f"({names.index(of)}, {literal(rule)}, {line + 1}, '{severities[rule]}')" for of, rule, line in rows if rule in severities)
    return f"SELECT rule_id, 'src/p' || p_partkey || '.clj' AS path, line::INTEGER AS line, severity FROM part JOIN (VALUES {values}) AS t(k, rule_id, line, severity) ON p_partkey % {len(names)} = k"


def orders_corpus(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """A function for each order with line items: a parameter and a nested call for each of them, six blank lines apart."""
    n = lineitem.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    o = orders.join(n, F.col("o_orderkey") == F.col("l_orderkey"))
    names = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("p"), i.cast("string"))), " ")
    text = F.concat(F.lit("(defn f"), F.col("o_orderkey"), F.lit(" ["), names, F.lit("]"), F.repeat(F.lit("\n"), F.col("n")), F.repeat(F.lit("(g "), F.col("n")), F.lit("p1"), F.repeat(F.lit(")"), F.col("n")), F.lit(")"))
    return o.select(F.format_string("src/o%d.clj", F.col("o_orderkey")).alias("path"), text.alias("text"))


def comments_corpus(documents: DataFrame) -> DataFrame:
    """A file for each document: every line of its text is a comment, and a call comes last."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r", ""), "\n", "\n;; ")
    return documents.select(F.format_string("src/d%d.clj", F.col("doc_id")).alias("path"), F.concat(F.lit(";; "), lines, F.lit("\n(a)")).alias("text"))


def nested_corpus(part: DataFrame, opens: str, closes: str, depth) -> DataFrame:
    """A file for each part: ``opens`` so many times, a symbol, and ``closes`` as often, in a call that no rule knows."""
    text = F.concat(F.lit("(defn f [x]\n  (known-to-none 1\n    "), F.repeat(F.lit(opens), depth), F.lit("x"), F.repeat(F.lit(closes), depth), F.lit("))"))
    return part.select(F.format_string("src/p%d.clj", F.col("p_partkey")).alias("path"), text.alias("text"))


def patterns_corpus(part: DataFrame, rule: str) -> DataFrame:
    """A file for each part with one of the rule's patterns, by its key."""
    snippets = [s for s, _ in PATTERNS[rule]]
    pick = F.get(F.array(*[F.lit(s) for s in snippets]), (F.col("p_partkey") % len(snippets)).cast("int"))
    return part.select(F.format_string("src/p%d.clj", F.col("p_partkey")).alias("path"), pick.alias("text"))


def patterns_oracle(rule: str) -> str:
    """What each pattern's file must report: message and line."""
    own = PATTERNS[rule]
    values = ", ".join(f"({k}, {line}, {literal(message)})" for k, (_, wanted) in enumerate(own) for line, message in wanted)
    return f"SELECT {literal(rule)} AS rule_id, 'src/p' || p_partkey || '.clj' AS path, line::INTEGER AS line, message FROM part JOIN (VALUES {values}) AS t(k, line, message) ON p_partkey % {len(own)} = k"


def nations_corpus(region: DataFrame, nation: DataFrame) -> DataFrame:
    """A file for each nation: its namespace, an alias, a variable, and a function whose let hides the variable."""
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    low = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z]", "-"))
    text = F.concat(F.lit("(ns geo."), low("r_name"), F.lit("."), low("n_name"), F.lit("\n  (:require [clojure.string :as str]))\n(def key "), F.col("n_nationkey"), F.lit(")\n(defn- show [x]\n  (let [key (inc x)] (str/trim (str key x))))\n(show key)"))
    return n.select(F.format_string("src/n%d.clj", F.col("n_nationkey")).alias("path"), text.alias("text"))


def clumps_corpus(part: DataFrame) -> DataFrame:
    """A function for each part, of three parameters that its key's remainder names."""
    g = F.col("p_partkey") % 701
    text = F.concat(F.lit("(defn f [b"), g, F.lit(" a"), g, F.lit(" c"), g, F.lit("] (g 1))"))
    return part.select(F.format_string("src/p%d.clj", F.col("p_partkey")).alias("path"), text.alias("text"))


def shapes_corpus(part: DataFrame) -> DataFrame:
    """A function for each part whose names and literals are its own, and whose shape is told by its size."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("(defn f"), k, F.lit(" [x"), k, F.lit("]\n  (g"), k, F.repeat(F.concat(F.lit(" "), k), F.col("p_size")), F.lit("))"))
    return part.select(F.format_string("src/p%d.clj", k).alias("path"), text.alias("text"))


def _one(pairs: list[tuple[str, str]]) -> list[tuple[str, list[tuple[int, str]]]]:
    return [(snippet, [(1, message)] if message else []) for snippet, message in pairs]


#: For rules of several patterns: source for each pattern, with the (line, message) that it must report; some report nothing.
PATTERNS: dict[str, list[tuple[str, list[tuple[int, str]]]]] = {
    "linear-collection-scan": _one([
        ("(map f (remove g xs))", "Chained sequence operations pass over the collection twice."), ("(f (sort xs))", "Sorting only to take one result."), ("(map println xs)", "`map` for side effects: consider `run!`."),
        ("(not (empty? (filter f xs)))", "Filtering to test for any: consider `some`."), ("(not-empty (filter f xs))", "Filtering to test for any: consider `some`."), ("(last (filter f xs))", "Filtering to take one: consider `some`."),
        ("(mapcat f (reduce g 0 (map h xs)))", "Three nested sequence operations."), ("(count (filter f xs))", "Counting a filter."), ("(concat a (concat b c))", "Nested `concat`."), ("(reduce max xs)", "`reduce` of a built-in: consider `apply`."),
        ("(for [x xs] (f x))", "`for` with one binding: consider `map`."), ("(take 2 (drop 1 xs))", "`take` of `drop`: consider `subvec`."), ("(take 2 (repeatedly f))", "`take` of `repeatedly`: give it the count."), ("(map f {:a 1})", "`map` over a map literal."),
        ("(= 2 (count xs))", "Comparing a count scans the collection."), ("(loop [s xs]\n  (when (seq s)\n    (f (first s))\n    (recur (next s))))", "Manual loop over a collection: consider `reduce`."), ("(loop [i 0]\n  (f (inc i)))", "Manual counting loop."), ("(map f xs)", ""),
    ]) + [("(pos? (count (filter f xs)))", [(1, "Counting a filter to compare."), (1, "Counting a filter.")])],
    "inappropriate-collection": _one([
        ("(last [1 2])", "`last` on a vector is linear: consider `peek`."), ("(nth '(1 2) 1)", "`nth` on a list is linear: consider a vector."), ("(some #(= % x) [1 2])", "`some` over a vector literal: consider a set."), ("(first (filter f xs))", "`first` of `filter`: consider `some`."),
        ("(empty? (filter f xs))", "`empty?` of `filter`: consider `not-any?`."), ("(count (filter f xs))", "`count` of `filter` builds a sequence."), ("(sequence (mapcat f) xs)", "`sequence` of `mapcat`: consider a transducer."), ("(contains? [1 2] :a)", "`contains?` looks up indexes in this collection: consider a set."),
        ("(reduce f '(1 2))", "`reduce` over a quoted form."), ("(map identity xs)", "`map identity` does nothing."), ("(map f {:a 1})", "`map` over a map literal: consider `reduce-kv`."), ("(apply hash-map kvs)", "`apply` here: consider `into` or `mapcat`."), ("(apply concat xs)", "`apply` here: consider `into` or `mapcat`."),
        ("(concat a (concat b c))", "Nested `concat`."), ("(reverse (map f xs))", "`reverse` of a lazy sequence: consider `into ()`."), ("(merge a b c d)", "`merge` of many maps: consider `into`."), ("(assoc-in m [:a] 1)", "`assoc-in` with one key: consider `assoc`."), ("(get-in m [:a])", "`get-in` with one key: consider `get`."),
        ("(zipmap (range 3) xs)", "`zipmap` over `range`: consider a vector."), ("(take 3 (repeatedly f))", "`take` of `repeatedly`: give it the count."), ("(for [x xs] (f x))", "`for` with one binding: consider `map`."), ("(filter (comp not f) xs)", "`filter` of `not`: consider `remove`."), ("(remove #(not %) xs)", "`remove` of `not`: consider `filter`."),
        ("(into [] xs)", "`into` an empty literal: consider `vec` or `set`."), ("(into #{} xs)", "`into` an empty literal: consider `vec` or `set`."), ("(doall (map f xs))", "`doall` of `map`: consider `mapv`."), ("(= 0 (count xs))", "`(= 0 (count x))`: consider `empty?`."), ("(> (count xs) 0)", "`(> (count x) 0)`: consider `seq`."),
        ("(not (empty? xs))", "Negated emptiness: consider `seq`."), ("(not (zero? (count xs)))", "Negated emptiness: consider `seq`."), ("(keys (group-by f xs))", "`keys` of `group-by`: consider `distinct`."), ("(seq (count xs))", "`seq` of `count`."), ("(into [] (comp f g))", ""), ("(merge a b c)", ""),
    ]),
    "comments": _one([
        (";;", "Empty comment."), (";; abc", "Comment is too short to be useful."), (";; " + "word " * 30, "Comment is too long."), (";; todo: mend this part", "TODO comment."), (";; fixme before the next one", "FIXME comment."), (";; (defn old [x] x)", "Commented-out code."),
        (";; an awful way out of it", "Deodorant comment."), (";; this function adds numbers", "Redundant comment."), (";; validate the thing below", "Obvious comment."), (";; upstream orders by time", ""),
    ]),
    "verbose-checks": _one([
        ("(= x 0)", "`=` against 0: the core has zero?, pos? and neg?."), ("(< 0 x)", "`<` against 0: the core has zero?, pos? and neg?."), ("(= x true)", "`=` against a boolean: the core has true? and false?."), ("(not= x nil)", "`not=` against nil: the core has nil? and some?."),
        ("(+ x 1)", "`+` by 1: the core has inc and dec."), ("(- x 1)", "`-` by 1: the core has inc and dec."), ("(if x true false)", "Both branches are booleans, so the test says it alone."), ("(= (mod x 2) 0)", "A remainder by 2 is what even? and odd? ask for."), ("(- 1 x)", ""), ("(if x true true)", ""),
    ]),
    "inefficient-filtering": _one([
        *[(f"({w} (filter f xs))", f"`{w}` over a filtered sequence does work twice.") for w in ("first", "last", "second", "count", "empty?", "not-empty", "seq", "distinct", "reverse", "doall")], ("(take 2 (remove f xs))", "`take` over a filtered sequence does work twice."),
        ("(sort-by g (filter f xs))", ""), ("(map g (filter f xs))", "`map` over a filtered sequence does work twice."), ("(->> xs (filter f) (remove g))", "Several filters in one `->>` could be one."),
        ("(let [x (first (filter f xs))] x)", "Only the first match of a `filter` is bound: `some` stops there."), ("(filter f xs)", ""),
    ]) + [("(not (seq (filter f xs)))", [(1, f"`{w}` over a filtered sequence does work twice.") for w in ("not", "seq")])],
    "hidden-side-effects": _one([
        *[(f"(defn compute-it [x]\n  ({call} x))", f"Function 'compute-it' has hidden side effects: {effect}.") for call, effect in (("println", "I/O"), ("reset!", "state-mutation"), ("debug", "logging"), ("execute", "database"), ("publish", "network"), ("mkdir", "file-system"), ("System/nanoTime", "time"), ("shuffle", "random"))],
        ("(defn publish-and-log [x]\n  (println x))", ""), ("(defn thing [x]\n  (debug x))", ""), ("(defn thing [x]\n  (rand x))", "Function 'thing' has hidden side effects: random."), ("(defn reset-it! [x]\n  (reset! x 1))", ""),
    ]),
    "divergent-change": _one([
        ("(defn work [x]\n  (println (map f (conj x))))", "Function 'work' mixes responsibilities: I/O, data-transformation."), ("(defn work [x]\n  (println (number? x) (string? x)))", "Function 'work' mixes responsibilities: I/O, validation."),
        ("(defn work [x]\n  (println (find x) (save x)))", "Function 'work' mixes responsibilities: I/O, persistence."), ("(defn work [x]\n  (request x) (warn x) (info x))", "Function 'work' mixes responsibilities: logging, network."),
        ("(defn work [x]\n  (request x) (warn x) (conj x))", "Function 'work' mixes responsibilities: data-transformation, logging, network."), ("(defn work [x]\n  (throw x) (warn x) (nil? x) (find x))", "Function 'work' mixes responsibilities: error-handling, logging, persistence, validation."),
        ("(defn work [x]\n  (println (inc x)))", ""), ("(defn work [x]\n  (nil? x) (throw x) (inc x))", ""),
    ]),
}
