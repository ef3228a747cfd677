"""Sinks: findings as JSON, text, HTML, Markdown, CSV, counts. Each gives a DataFrame of lines or rows; ``write`` saves it.

Order columns (``at``) let a caller put the lines in order; a single ordered file is a choice of the writer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lispmill.functions.dsl import text
from lispmill.plans.analyze import snippets, summary

SNIPPET_FORMATS = ("json-snippet", "json-extended", "jsonsnippet", "json_snippet")
FORMATS = ("json", *SNIPPET_FORMATS, "text", "html", "markdown", "summary", "csv", "count")


def as_json(found: DataFrame) -> DataFrame:
    """One JSON object for each finding; a null fingerprint is left out."""
    place = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("line").alias("end_line"), (F.col("col") + 1).alias("end_col")))
    extra = [c for c in ("code_snippet",) if c in found.columns]
    return found.select(F.to_json(F.struct("rule_id", "message", F.col("path").alias("filepath"), place.alias("location"), "severity", F.col("fingerprint").alias("ast_fingerprint"), *extra)).alias("json"))


def as_json_snippets(found: DataFrame, sources: DataFrame) -> DataFrame:
    return as_json(snippets(found, sources, 4))


def json_array(objects: DataFrame) -> DataFrame:
    """The objects as the lines of one array. Equal objects are told apart by a number, so that one of all is the first."""
    told = objects.withColumn("k", F.row_number().over(Window.partitionBy("json").orderBy(F.lit(1))))
    first = told.agg(F.min(F.struct("json", "k")).alias("first")).select(F.col("first.json").alias("first_json"), F.col("first.k").alias("first_k"))
    led = told.join(F.broadcast(first), (F.col("json") == F.col("first_json")) & (F.col("k") == F.col("first_k")), "left")
    rows = led.select(F.lit(1).alias("part"), F.struct("json", "k").alias("at"), F.concat(F.when(F.col("first_json").isNull(), F.lit(",")).otherwise(F.lit("")), F.col("json")).alias("json"))
    none = F.struct(F.lit("").alias("json"), F.lit(0).alias("k"))
    ends = objects.sparkSession.createDataFrame([(0, "["), (2, "]")], "part int, json string").select("part", none.alias("at"), "json")
    return rows.unionByName(ends).orderBy("part", "at").select("json")


#: Of a line's place in a report: its part, then path, line, column and rule.
AT = "struct<path:string,line:int,col:int,rule_id:string>"


def _at(path: str = "''", line: str = "0", rule: str = "''") -> Column:
    return F.expr(f"struct({path}, {line}, 0, {rule})").cast(AT)


def _lines(found: DataFrame, *lines: tuple[int, str]) -> DataFrame:
    """Fixed lines (part, text) that a report has if there are findings, with their places."""
    some_ = found.limit(1).select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(k).alias("k"), F.lit(t).alias("text")) for k, (p, t) in enumerate(lines)])).alias("l"))
    return some_.select("l.part", _at(line="l.k").alias("at"), "l.text")


def _nothing(found: DataFrame, text_: str) -> DataFrame:
    """A line for a report without findings."""
    return found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).alias("part"), _at().alias("at"), F.lit(text_).alias("text"))


def _ordered(to: str, *parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).orderBy("part", "at").select(F.col("text").alias(to))


NOTHING = "No issues found."


def as_text(found: DataFrame) -> DataFrame:
    """`[SEVERITY] rule: message [path:line:col]` (the path alone without a place), then a summary."""
    place = F.when(F.col("line").isNull(), F.col("path")).otherwise(text(F.col("path"), ":", F.col("line"), ":", F.col("col")))
    rows = found.select(F.lit(0).alias("part"), F.struct("path", "line", "col", "rule_id").cast(AT).alias("at"), text("[", F.col("severity"), "] ", F.col("rule_id"), ": ", F.col("message"), " [", place, "]").alias("text"))
    counts = summary(found).select(F.lit(2).alias("part"), _at(rule="rule_id").alias("at"), text("- ", F.col("rule_id"), ": ", F.col("count")).alias("text"))
    return _ordered("text", _nothing(found, NOTHING), rows, _lines(found, (1, ""), (1, "---"), (1, "Smell Summary:")), counts)


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def html_rows(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of the findings table, with ±8 lines of code, the finding's own one marked; ``html_head`` has the counts."""
    rows = snippets(found, sources, 8, MARKS)
    cells = [_escaped(F.col(c).cast("string")) for c in ("severity", "rule_id", "message", "path", "line")]
    code = F.replace(F.replace(_escaped(F.col("code_snippet")), F.lit(MARKS[0]), F.lit("<mark>")), F.lit(MARKS[1]), F.lit("</mark>"))
    return rows.select("path", "line", "col", "rule_id", text("<tr>", *[text("<td>", c, "</td>") for c in cells], "<td><pre>", code, "</pre></td></tr>").alias("html"))


def html_head(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("findings"), F.countDistinct("path").alias("files"), F.countDistinct("rule_id").alias("rules"))


#: Fixed lines of a page: its head, its end, and (part, line) where there are findings.
PAGE_TOP = (
    "<!DOCTYPE html>", '<html lang="en"><head><meta charset="utf-8"><title>Lispmill findings</title>', "<style>td, th { text-align: left; vertical-align: top } mark { background: moccasin }</style></head><body>", "<h1>Findings</h1>",
)
PAGE_END = ("</body></html>",)
PAGE_FIXED = (
    (1, "<h2>Smell Summary</h2>"), (1, "<table><tr><th>Rule</th><th>Count</th></tr>"), (3, "</table>"), (3, "<h2>All findings</h2>"), (3, "<table><tr><th>Severity</th><th>Rule</th><th>Message</th><th>File</th><th>Line</th><th>Code</th></tr>"), (5, "</table>"),
)
#: Stand for the marked line's begin and end until its text is escaped.
MARKS = ("\u0001", "\u0002")


def as_html(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Lines of a whole page: counts, a table of the rules' counts, a table of the findings."""
    page = found.agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))
    lines = F.array(*[F.lit(x) for x in PAGE_TOP], text("<p>", F.col("n"), " findings in ", F.col("files"), " files</p>"))
    head = page.select(F.posexplode(lines).alias("k", "text")).select(F.lit(0).alias("part"), _at(line="k").alias("at"), "text")
    none = page.where("n = 0").select(F.lit(1).alias("part"), _at().alias("at"), F.lit(f"<p>{NOTHING}</p>").alias("text"))
    counts = summary(found).select(F.lit(2).alias("part"), _at(rule="rule_id").alias("at"), text("<tr><td>", _escaped(F.col("rule_id")), "</td><td>", F.col("count"), "</td></tr>").alias("text"))
    rows = html_rows(found, sources).select(F.lit(4).alias("part"), F.struct("path", "line", "col", "rule_id").cast(AT).alias("at"), F.col("html").alias("text"))
    fixed = _lines(found, *PAGE_FIXED)
    end = page.select(F.lit(6).alias("part"), _at().alias("at"), F.lit(PAGE_END[0]).alias("text"))
    return _ordered("html", head, none, fixed, counts, rows, end)


def markdown_rows(found: DataFrame) -> DataFrame:
    cell = lambda c: F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))
    return found.select("path", "line", "col", "rule_id", text("| ", cell("severity"), " | ", cell("rule_id"), " | ", cell("message"), " | ", cell("path"), ":", cell("line"), " |").alias("markdown"))


def as_markdown(found: DataFrame) -> DataFrame:
    """A table of the findings, then one of the rules' counts."""
    rows = markdown_rows(found).select(F.lit(1).alias("part"), F.struct("path", "line", "col", "rule_id").cast(AT).alias("at"), F.col("markdown").alias("text"))
    counts = summary(found).select(F.lit(3).alias("part"), _at(rule="rule_id").alias("at"), text("| ", F.col("rule_id"), " | ", F.col("count"), " |").alias("text"))
    fixed = _lines(found, (0, "| Severity | Rule | Message | Location |"), (0, "|---|---|---|---|"), (2, ""), (2, "### Smell Summary"), (2, ""), (2, "| Rule | Count |"), (2, "|---|---|"))
    return _ordered("markdown", _nothing(found, NOTHING), fixed, rows, counts)


def as_summary(found: DataFrame) -> DataFrame:
    """The rules' counts, then their total."""
    counts = summary(found).select(F.lit(0).alias("part"), _at(rule="rule_id").alias("at"), text(F.col("rule_id"), ": ", F.col("count")).alias("text"))
    total = found.agg(F.count("*").alias("n")).select(F.lit(1).alias("part"), _at().alias("at"), text("Total: ", F.col("n")).alias("text"))
    return _ordered("summary", counts, total)


def as_csv(found: DataFrame) -> DataFrame:
    return summary(found).select(F.col("rule_id").alias("RuleID"), F.col("count").alias("Count"))


def render(found: DataFrame, sources: DataFrame, form: str = "summary") -> DataFrame:
    if form == "json":
        return json_array(as_json(found))
    if form in SNIPPET_FORMATS:
        return json_array(as_json_snippets(found, sources))
    if form == "text":
        return as_text(found)
    if form == "html":
        return as_html(found, sources)
    if form == "markdown":
        return as_markdown(found)
    if form == "csv":
        return as_csv(found)
    if form == "count":
        return found.agg(F.count("*").alias("count"))
    if form == "summary":
        return as_summary(found)
    raise ValueError(f"unknown format {form}; known: {', '.join(FORMATS)}")


def write(found: DataFrame, sources: DataFrame, form: str, to: str) -> None:
    """Saves a rendering: CSV with a header for the summary forms, text lines for the others."""
    out = render(found, sources, form)
    if len(out.columns) > 1 or form in ("csv", "count"):
        out.coalesce(1).write.mode("overwrite").option("header", True).csv(to)
    else:
        out.write.mode("overwrite").text(to)
