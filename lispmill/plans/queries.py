"""Registered queries of the analysis engine and their SQL: on source text made from tables, and the same algebra on tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lispmill.operators import design, scopes
from lispmill.operators.registry import RULES, heads_of
from lispmill.plans import analyze, corpora, report, stats
from lispmill.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def take(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return take


def _nodes(sources: DataFrame, whole: bool = False, rules: list[str] | None = None) -> DataFrame:
    """The node table (of what the given rules judge); reading text costs far more than its bytes suggest, so it is spread over
    all cores first, by its hash, as dealing in turns sorts all rows."""
    spread = sources.repartition(2 * sources.sparkSession.sparkContext.defaultParallelism, "path", "text")
    return files.nodes(spread, whole, heads_of([RULES[r] for r in rules]) if rules else None)


def _rule_query(rule: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = _nodes(corpora.parts_corpus(table(spark, sf_dir, "part"), rule))
        return analyze.findings(nodes, analyze.ALL, [rule]).select("rule_id", "path", "line")

    return run


for _rule in corpora.SNIPPETS:
    _name = "rule_" + re.sub(r"\W+", "_", _rule)
    QUERIES[_name], SQL[_name] = _rule_query(_rule), corpora.parts_oracle(_rule)


@query("rule_data_clumps", "WITH p AS (SELECT p_partkey, p_partkey % 701 AS g, count(*) OVER (PARTITION BY p_partkey % 701) AS n FROM part) SELECT 'data-clumps' AS rule_id, 'src/p' || p_partkey || '.clj' AS path, 1::INTEGER AS line, 'Parameters a' || g || ',b' || g || ',c' || g || ' travel together through ' || n || ' functions.' AS message FROM p WHERE n >= 2")
def rule_data_clumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(corpora.clumps_corpus(table(spark, sf_dir, "part")))
    return analyze.findings(nodes, analyze.ALL, ["data-clumps"]).select("rule_id", "path", "line", "message")


@query("rule_duplicated_code", "SELECT 'duplicated-code' AS rule_id, path, 1::INTEGER AS line, 'Duplicated code: this shape occurs ' || n || ' times, first in ' || first_path || '.' AS message FROM (SELECT 'src/p' || p_partkey || '.clj' AS path, count(*) OVER (PARTITION BY p_size) AS n, min('src/p' || p_partkey || '.clj') OVER (PARTITION BY p_size) AS first_path FROM part) WHERE path <> first_path")
def rule_duplicated_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(corpora.shapes_corpus(table(spark, sf_dir, "part")))
    return analyze.findings(nodes, analyze.ALL, ["duplicated-code"]).select("rule_id", "path", "line", "message")


def _orders(spark: SparkSession, sf_dir: str, rules: list[str] | None = None) -> DataFrame:
    return _nodes(corpora.orders_corpus(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")), rules=rules)


_PER_ORDER = "SELECT o_orderkey, count(*)::INTEGER AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"


@query("flagship_summary", "SELECT 'long-parameter-list' AS rule_id, count(*) FILTER (n > 9)::BIGINT AS count FROM (" + _PER_ORDER + ") HAVING count(*) FILTER (n > 9) > 0 UNION ALL SELECT 'primitive-obsession', count(*) FILTER (n >= 8 OR n = 2)::BIGINT FROM (" + _PER_ORDER + ") HAVING count(*) FILTER (n >= 8 OR n = 2) > 0")
def flagship_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, parse, detect, sort and count: long parameter lists over a function per order."""
    rules = ["long-parameter-list", "primitive-obsession"]
    return analyze.summary(analyze.findings(_orders(spark, sf_dir, rules), analyze.ALL, rules))


@query("findings_sorted", f"SELECT 'src/o' || o_orderkey || '.clj' AS path, 1::INTEGER AS line, 'long-parameter-list' AS rule_id, 'WARNING' AS severity FROM ({_PER_ORDER}) WHERE n > 9 ORDER BY 1, 2")
def findings_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ["long-parameter-list"]
    found = analyze.findings(_orders(spark, sf_dir, rules), analyze.ALL, rules)
    return analyze.ordered(found).select("path", "line", "rule_id", "severity")


@query("function_stats", f"SELECT 'f' || o_orderkey AS function_name, (n + 1)::INTEGER AS lines_of_code, n AS parameter_count, n AS max_nesting_depth, 0::INTEGER AS max_message_chain, n AS max_consecutive_primitive_params FROM ({_PER_ORDER})")
def function_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.function_stats(_orders(spark, sf_dir)).drop("path")


_METRICS = "SELECT 'f' || o_orderkey AS function_name, unnest([{lines_of_code: n + 1, parameter_count: n, nesting_depth: n, message_chain_length: 0, consecutive_primitives: n}]) AS m FROM (" + _PER_ORDER + ")"
_UNPIVOT = " UNION ALL ".join(f"SELECT function_name, '{m}' AS metric_type, m.{m}::INTEGER AS metric_value FROM ({_METRICS})" for m in stats.METRICS.values())


@query("raw_stats", _UNPIVOT)
def raw_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.raw_stats(stats.function_stats(_orders(spark, sf_dir)))


@query("metric_histograms", f"SELECT metric_type, metric_value, count(*)::BIGINT AS function_count FROM ({_UNPIVOT}) GROUP BY ALL")
def metric_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histograms(stats.function_stats(_orders(spark, sf_dir)))


@query("node_counts", f"SELECT 'src/o' || o_orderkey || '.clj' AS path, (5 + n + 2 * n)::BIGINT AS nodes, (n + 1)::INTEGER AS lists, (n + 1)::INTEGER AS depth FROM ({_PER_ORDER})")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).groupBy("path").agg(F.count("*").alias("nodes"), F.sum((F.col("type") == "List").cast("int")).cast("int").alias("lists"), F.max("depth").alias("depth"))


_LINES = "SELECT doc_id, unnest(l) AS line_text, generate_subscripts(l, 1)::INTEGER AS line FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS l FROM documents)"
_LISTED = lambda words: " OR ".join(f"contains(low, {corpora.literal(w)})" for w in words)


@query(
    "comment_kinds",
    f"""SELECT 'src/d' || doc_id || '.clj' AS path, line, kind FROM (
       SELECT doc_id, line, CASE WHEN octet_length(encode(b)) = 0 THEN 'Empty comment.' WHEN octet_length(encode(b)) < 5 THEN 'Comment is too short to be useful.' WHEN octet_length(encode(b)) > 120 THEN 'Comment is too long.'
         WHEN contains(low, 'todo') THEN 'TODO comment.' WHEN contains(low, 'fixme') THEN 'FIXME comment.' WHEN regexp_matches(b, {corpora.literal(design.CODE_LIKE)}) OR length(regexp_replace(b, '[^(\\[{{]', '', 'g')) >= 2 THEN 'Commented-out code.'
         WHEN {_LISTED(design.DEODORANT)} THEN 'Deodorant comment.' WHEN {_LISTED(design.REDUNDANT)} THEN 'Redundant comment.' WHEN {_LISTED(design.OBVIOUS)} THEN 'Obvious comment.' END AS kind
       FROM (SELECT *, lower(b) AS low FROM (SELECT doc_id, line, trim(regexp_replace(';; ' || line_text, '^[;#!]+', ''), ' ') AS b FROM ({_LINES})))) WHERE kind IS NOT NULL""",
)
def comment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment rule over every line of every document."""
    nodes = _nodes(corpora.comments_corpus(table(spark, sf_dir, "documents")))
    return analyze.findings(nodes, analyze.ALL, ["comments"]).select("path", "line", F.col("message").alias("kind"))


@query("comment_extraction", f"SELECT 'src/d' || doc_id || '.clj' AS path, ';; ' || line_text AS value, line, 1::INTEGER AS col FROM ({_LINES})")
def comment_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.comments(_nodes(corpora.comments_corpus(table(spark, sf_dir, "documents"))))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(corpora.nations_corpus(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")))


@query("namespaces", "SELECT 'src/n' || n_nationkey || '.clj' AS path, 'geo.' || lower(regexp_replace(r_name, '[^A-Za-z]', '-', 'g')) || '.' || lower(regexp_replace(n_name, '[^A-Za-z]', '-', 'g')) AS namespace FROM nation JOIN region ON n_regionkey = r_regionkey")
def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.namespaces(_nations(spark, sf_dir))


@query("namespace_aliases", "SELECT 'src/n' || n_nationkey || '.clj' AS path, 'str' AS alias, 'clojure.string' AS origin, 'namespace' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey")
def namespace_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.aliases(_nations(spark, sf_dir))


@query("definitions", "SELECT 'src/n' || n_nationkey || '.clj' AS path, unnest([{name: 'key', kind: 'variable', is_private: false}, {name: 'show', kind: 'function', is_private: true}], recursive := true) FROM nation JOIN region ON n_regionkey = r_regionkey")
def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.definitions(_nations(spark, sf_dir)).select("path", "name", "kind", "is_private")


@query(
    "symbol_resolution",
    """SELECT 'src/n' || n_nationkey || '.clj' AS path, unnest([{name: 'x', kind: 'parameter', uses: 3}, {name: 'key', kind: 'variable', uses: 4}, {name: 'show', kind: 'function', uses: 2},
       {name: 'str/trim', kind: 'aliased', uses: 1}, {name: 'str', kind: 'namespace', uses: 2}, {name: 'inc', kind: 'core-function', uses: 1}, {name: 'let', kind: 'core-special-form', uses: 1},
       {name: 'def', kind: 'core-special-form', uses: 1}], recursive := true) FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def symbol_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scopes.resolve(_nations(spark, sf_dir)).where("kind <> 'unknown'")
    return out.groupBy("path", "name", "kind").agg(F.count("*").cast("int").alias("uses"))


@query("fingerprints", "SELECT p_partkey, substr(sha256('List[Symbol(comp) ' || array_to_string(list_transform(range(1, (p_size % 7 + 2)::BIGINT), lambda i: 'Symbol(g' || i || ')'), ' ') || ']'), 1, 16) AS fingerprint FROM part")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 7 + 1), lambda i: F.concat(F.lit("g"), i.cast("string"))), "  ")
    src = p.select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit(" (comp\n"), names, F.lit(") ; note")).alias("text"))
    nodes = _nodes(src)
    return scopes.fingerprints(nodes).where("id = 0").select(F.col("path").cast("long").alias("p_partkey"), "fingerprint")


@query("rendered_source", "SELECT p_partkey, '(assoc {:k [' || p_size || ' \"a\"]} (inc ' || p_partkey || '))' AS code FROM part")
def rendered_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("(assoc {:k, ["), F.col("p_size"), F.lit('   "a"]}\n  (inc '), F.col("p_partkey"), F.lit("))"))
    nodes = _nodes(p.select(F.col("p_partkey").cast("string").alias("path"), text.alias("text")), whole=True)
    return scopes.rendered(nodes).where("id = 0").select(F.col("path").cast("long").alias("p_partkey"), "code")


@query("rendered_deeply", "SELECT p_partkey, '(q ' || repeat('(a [b ', (p_size % 8 + 3)::BIGINT) || 'x' || repeat('])', (p_size % 8 + 3)::BIGINT) || ')' AS code FROM part")
def rendered_deeply(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, depth = table(spark, sf_dir, "part"), F.col("p_size") % 8 + 3
    text = F.concat(F.lit("(top (q "), F.repeat(F.lit("(a\n[b "), depth), F.lit("x"), F.repeat(F.lit(" ] )"), depth), F.lit("))"))
    nodes = _nodes(p.select(F.col("p_partkey").cast("string").alias("path"), text.alias("text")), whole=True)
    return scopes.rendered(nodes.where("head = 'q'")).select(F.col("path").cast("long").alias("p_partkey"), "code")


_DEEP = "SELECT {rule} AS rule_id, 'src/p' || p_partkey || '.clj' AS path, 3::INTEGER AS line, count(*)::BIGINT AS times FROM (SELECT p_partkey, unnest(range(1, (p_size % 8 + 4)::BIGINT)) AS level, p_size % 8 + 3 AS depth FROM part) WHERE depth - level + 1 >= {least} GROUP BY p_partkey"


def _deep(spark: SparkSession, sf_dir: str, rule: str, opens: str, closes: str) -> DataFrame:
    nodes = _nodes(corpora.nested_corpus(table(spark, sf_dir, "part"), opens, closes, F.col("p_size") % 8 + 3))
    return analyze.findings(nodes, analyze.ALL, [rule]).groupBy("rule_id", "path", "line").agg(F.count("*").alias("times"))


@query("deep_nested_forms", _DEEP.format(rule="'nested-forms'", least=4))
def deep_nested_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 3 to 10 conditionals, each in a ``do``, below a call of another kind."""
    return _deep(spark, sf_dir, "nested-forms", "(when a (do ", "))")


@query("deep_thread_ignorance", _DEEP.format(rule="'thread-ignorance'", least=5))
def deep_thread_ignorance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 3 to 10 calls, each in a vector."""
    return _deep(spark, sf_dir, "thread-ignorance", "(sort [", "])")


def _patterns_query(rule: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = _nodes(corpora.patterns_corpus(table(spark, sf_dir, "part"), rule))
        return analyze.findings(nodes, analyze.ALL, [rule]).select("rule_id", "path", "line", "message")

    return run


for _rule in corpora.PATTERNS:
    _name = "patterns_" + re.sub(r"\W+", "_", _rule)
    QUERIES[_name], SQL[_name] = _patterns_query(_rule), corpora.patterns_oracle(_rule)


@query("test_file_pruning", "SELECT path FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'src/p' || p_partkey || '.clj' WHEN 1 THEN 'test/p' || p_partkey || '.clj' WHEN 2 THEN 'a/test/p' || p_partkey || '.clj' ELSE 'src/p' || p_partkey || '_test.clj' END AS path FROM part) WHERE path LIKE 'src/p%' AND path NOT LIKE '%\\_test.clj' ESCAPE '\\' OR path LIKE 'test/%'")
def test_file_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("p_size") % 4, F.col("p_partkey")
    path = F.when(k == 0, F.format_string("src/p%d.clj", key)).when(k == 1, F.format_string("test/p%d.clj", key)).when(k == 2, F.format_string("a/test/p%d.clj", key)).otherwise(F.format_string("src/p%d_test.clj", key))
    return files.prune_tests(table(spark, sf_dir, "part").select(path.alias("path"))).select("path")


@query("unreadable_files", "SELECT 'p' || p_partkey AS path FROM part WHERE p_size % 3 <> 0")
def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_size") % 3 == 0, F.lit("(a (b)")).otherwise(F.lit("(a (b))"))
    return _nodes(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), text.alias("text"))).where("id = 0").select("path")


@query(
    "finding_snippets",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS n FROM documents WHERE text IS NOT NULL),
       f AS (SELECT doc_id, n AS line FROM l WHERE regexp_matches(code, '[0-9]'))
       SELECT doc_id, line, string_agg(lpad(n::VARCHAR, 5, ' ') || ': ' || code, chr(10) ORDER BY n) FILTER (trim(code, ' ') <> '' OR n = line) AS code_snippet FROM f JOIN l USING (doc_id) WHERE n BETWEEN line - 4 AND line + 4 GROUP BY doc_id, line""",
)
def finding_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets around every line with a digit of each document."""
    src = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text"))
    lines = src.select("path", F.posexplode(F.split("text", "\n")).alias("k", "code")).where(F.col("code").rlike("[0-9]"))
    found = lines.select(F.lit("digit").alias("rule_id"), F.lit("").alias("message"), "path", (F.col("k") + 1).alias("line"), F.lit(1).alias("col"), F.lit("INFO").alias("severity"), F.lit(None).cast("string").alias("fingerprint"))
    return analyze.snippets(found, src).select(F.col("path").cast("long").alias("doc_id"), "line", "code_snippet")


@query("duplicate_texts", "SELECT doc_id, first_id, copies::BIGINT AS copies FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies FROM documents) WHERE doc_id > first_id")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The algebra of duplicated code on texts: later copies, with the first. Digests are counted first (with partial sums); the
    join back is of rows on one side and one row a digest on the other, which skew handling splits for a common text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("\u0000")), 256).alias("h"))
    often = d.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
    return d.join(often, "h").where("doc_id > first_id").select("doc_id", "first_id", "copies")


@query("part_clumps", "WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey % 40 AS s FROM lineitem ), o AS (SELECT l_orderkey FROM p GROUP BY 1 HAVING count(*) BETWEEN 3 AND 8), q AS (SELECT p.* FROM p JOIN o USING (l_orderkey)) SELECT a.s::BIGINT AS a, b.s::BIGINT AS b, c.s::BIGINT AS c, count(*)::BIGINT AS times FROM q a JOIN q b ON a.l_orderkey = b.l_orderkey AND a.s < b.s JOIN q c ON b.l_orderkey = c.l_orderkey AND b.s < c.s GROUP BY ALL HAVING count(*) >= 2")
def part_clumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The algebra of data clumps on suppliers of orders: triples that occur together more than once."""
    from lispmill.operators.design import combinations

    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 40)).alias("names")).where(F.size("names").between(3, 8))
    keys = sets.select(F.explode(combinations(F.col("names"), 3, 3)).alias("k"))
    return keys.groupBy(F.col("k")[0].alias("a"), F.col("k")[1].alias("b"), F.col("k")[2].alias("c")).agg(F.count("*").alias("times")).where("times >= 2")


@query("mutual_calls", "WITH e AS (SELECT DISTINCT l_partkey % 997 AS a, l_suppkey * 7 % 997 AS b FROM lineitem) SELECT x.a::BIGINT AS a, x.b::BIGINT AS b FROM e x JOIN e y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def mutual_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 997).alias("a"), (F.col("l_suppkey") * 7 % 997).alias("b")).distinct()
    return e.join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").where("a < b")


@query("seen_before", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS before FROM events")
def seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State over document order, as in load-order rules: how often a user's type occurred before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("before"))


@query(
    "longest_runs",
    "SELECT user_id, max(n)::BIGINT AS longest FROM (SELECT user_id, event_type, g, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) GROUP BY ALL) GROUP BY user_id",
)
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands, as in runs of primitive parameters: a user's longest run of one type."""
    a = Window.partitionBy("user_id").orderBy("ts", "event_id")
    b = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("g", F.row_number().over(a) - F.row_number().over(b))
    return rows.groupBy("user_id", "event_type", "g").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("event_summary", "SELECT event_type AS rule_id, count(*)::BIGINT AS count FROM events GROUP BY 1")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.summary(table(spark, sf_dir, "events").withColumnRenamed("event_type", "rule_id"))


@query("supplier_envy", "SELECT s_suppkey, count(*)::BIGINT AS total, count(*) FILTER (c_nationkey <> s_nationkey)::BIGINT AS outside FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 5 AND 10 * count(*) FILTER (c_nationkey <> s_nationkey) >= 7 * count(*)")
def supplier_envy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio test of feature envy on suppliers: line items of customers of other nations."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("s_suppkey").agg(F.count("*").alias("total"), F.sum((F.col("c_nationkey") != F.col("s_nationkey")).cast("long")).alias("outside")).where("total >= 5 and 10 * outside >= 7 * total")


# --- sinks over the findings of one corpus
def _found(spark: SparkSession, sf_dir: str, rule: str = "string-map-keys", parts: str = "true") -> tuple[DataFrame, DataFrame]:
    """Findings and sources; a report reads its findings several times, so they are kept."""
    src = corpora.parts_corpus(table(spark, sf_dir, "part").where(parts), rule)
    return analyze.findings(_nodes(src), analyze.ALL, [rule]).persist(), src


_BAD = "FROM part WHERE p_partkey % 3 <> 0"
_AT = "'src/p' || p_partkey || '.clj'"
_MSG = 'String key "a" in map literal. Consider a keyword.'
_JSON = f"""'{{"rule_id":"string-map-keys","message":"String key \\"a\\" in map literal. Consider a keyword.","filepath":"' || {_AT} || '","location":{{"start_line":' || (p_size % 7 + 1) || ',"start_col":2,"end_line":' || (p_size % 7 + 1) || ',"end_col":3}},"severity":"INFO","ast_fingerprint":"' || substr(sha256('Map[String(a) Number(1)]'), 1, 16) || '"}}'"""
_SOME = f"(SELECT count(*) {_BAD}) > 0"
_EMPTY = "p_partkey % 3 = 0"


def _fixed(column: str, *lines: str, where: str = _SOME) -> str:
    return " UNION ALL ".join(f"SELECT {corpora.literal(x)} AS {column} WHERE {where}" for x in lines)


@query("sink_json", f"SELECT {_JSON} AS json {_BAD}")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_json(_found(spark, sf_dir)[0])


@query("sink_json_array", f"SELECT CASE WHEN row_number() OVER (ORDER BY json) > 1 THEN ',' ELSE '' END || json AS json FROM (SELECT {_JSON} AS json {_BAD}) UNION ALL SELECT unnest(['[', ']'])")
def sink_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.render(*_found(spark, sf_dir), "json")


@query("sink_json_snippet", f"SELECT {_AT} AS path, lpad((p_size % 7 + 1)::VARCHAR, 5, ' ') || ': {{\"a\" 1}}' AS code_snippet {_BAD}".replace("{{", "{").replace("}}", "}"))
def sink_json_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, src = _found(spark, sf_dir)
    return analyze.snippets(found, src).select("path", "code_snippet")


@query("snippets_of_no_code", "SELECT 'src/p' || p_partkey || '.clj' AS path, '// No code found at location or file is empty.' AS code_snippet FROM part WHERE p_partkey % 3 <> 0")
def snippets_of_no_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were emptied after the scan."""
    found, src = _found(spark, sf_dir)
    return analyze.snippets(found.withColumn("line", F.lit(40)), src.withColumn("text", F.lit(""))).select("path", "code_snippet")


@query("sink_text", f"SELECT '[INFO] string-map-keys: {_MSG} [' || {_AT} || ':' || (p_size % 7 + 1) || ':2]' AS text {_BAD} UNION ALL SELECT '- string-map-keys: ' || count(*) {_BAD} HAVING count(*) > 0 UNION ALL " + _fixed("text", "", "---", "Smell Summary:"))
def sink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_text(_found(spark, sf_dir)[0])


@query("sink_text_empty", "SELECT 'No issues found.' AS text")
def sink_text_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_text(_found(spark, sf_dir, parts=_EMPTY)[0])


@query("sink_json_empty", "SELECT unnest(['[', ']']) AS json")
def sink_json_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.render(*_found(spark, sf_dir, parts=_EMPTY), "json")


@query(
    "sink_markdown",
    f"SELECT '| INFO | string-map-keys | {_MSG} | ' || {_AT} || ':' || (p_size % 7 + 1) || ' |' AS markdown {_BAD} UNION ALL SELECT '| string-map-keys | ' || count(*) || ' |' {_BAD} HAVING count(*) > 0 UNION ALL "
    + _fixed("markdown", "| Severity | Rule | Message | Location |", "|---|---|---|---|", "", "### Smell Summary", "", "| Rule | Count |", "|---|---|"),
)
def sink_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_markdown(_found(spark, sf_dir)[0])


@query("sink_markdown_empty", "SELECT 'No issues found.' AS markdown")
def sink_markdown_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_markdown(_found(spark, sf_dir, parts=_EMPTY)[0])


_Q = "&#34;"
_PAGE = _fixed("html", *report.PAGE_TOP, *report.PAGE_END, where="true")


@query(
    "sink_html",
    f"SELECT '<tr><td>INFO</td><td>string-map-keys</td><td>{_MSG.replace(chr(34), _Q)}</td><td>' || {_AT} || '</td><td>' || (p_size % 7 + 1) || '</td><td><pre><mark>' || lpad((p_size % 7 + 1)::VARCHAR, 5, ' ') || ': {{{_Q}a{_Q} 1}}</mark></pre></td></tr>' AS html {_BAD}"
    f" UNION ALL SELECT '<p>' || count(*) || ' findings in ' || count(*) || ' files</p>' {_BAD} UNION ALL SELECT '<tr><td>string-map-keys</td><td>' || count(*) || '</td></tr>' {_BAD} HAVING count(*) > 0 UNION ALL "
    + _PAGE + " UNION ALL " + _fixed("html", *[x for _, x in report.PAGE_FIXED]),
)
def sink_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_html(*_found(spark, sf_dir))


@query("sink_html_empty", _PAGE + " UNION ALL SELECT unnest(['<p>0 findings in 0 files</p>', '<p>No issues found.</p>'])")
def sink_html_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_html(*_found(spark, sf_dir, parts=_EMPTY))


@query("sink_html_head", f"SELECT count(*)::BIGINT AS findings, count(*)::BIGINT AS files, (count(*) > 0)::BIGINT AS rules {_BAD}")
def sink_html_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.html_head(_found(spark, sf_dir)[0])


@query("sink_summary", f"SELECT 'string-map-keys: ' || count(*) AS summary {_BAD} HAVING count(*) > 0 UNION ALL SELECT 'Total: ' || count(*) {_BAD}")
def sink_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_summary(_found(spark, sf_dir)[0])


@query("sink_csv", f"""SELECT 'string-map-keys' AS "RuleID", count(*)::BIGINT AS "Count" {_BAD} HAVING count(*) > 0""")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_csv(_found(spark, sf_dir)[0])


@query("sink_count", f"SELECT count(*)::BIGINT AS count {_BAD}")
def sink_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.render(*_found(spark, sf_dir), "count")


@query("rule_list", "SELECT unnest([" + ", ".join(f"{{id: {corpora.literal(r.id)}, severity: '{r.severity}', group_name: '{r.group}'}}" for _, r in sorted(RULES.items())) + "], recursive := true)")
def rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lispmill.operators.registry import rule_table

    return rule_table(spark).select("id", "severity", F.col("group").alias("group_name"))


@query("all_default_rules", corpora.every_oracle({r.id: r.severity for r in analyze.select(analyze.Config())}))
def all_default_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that is on by default over the files of all rules' corpora: parsed once, then judged."""
    nodes = _nodes(corpora.every_corpus(table(spark, sf_dir, "part")))
    return analyze.findings(files.written(nodes)).select("rule_id", "path", "line", "severity")
