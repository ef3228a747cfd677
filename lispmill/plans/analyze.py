"""From sources to findings: rule selection, one fused scan for all row rules, and joins for the rest."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lispmill.operators import design, functional, idioms  # noqa: F401  they register their rules
from lispmill.operators.registry import CLOJURE, RULES, Rule, heads_of
from lispmill.sources import files

FINDINGS = ("rule_id", "message", "path", "line", "col", "severity", "fingerprint")


@dataclass
class Config:
    """A group's setting beats a rule's; without either only the group of the language's idioms is on."""

    enabled_groups: dict[str, bool] = field(default_factory=dict)
    enabled_rules: dict[str, bool] = field(default_factory=dict)
    rule_config: dict[str, dict[str, Any]] = field(default_factory=dict)
    analyze_tests: bool = False

    def on(self, rule: Rule) -> bool:
        if rule.group in self.enabled_groups and not self.enabled_groups[rule.group]:
            return False
        if rule.id in self.enabled_rules:
            return self.enabled_rules[rule.id]
        return self.enabled_groups.get(rule.group, rule.group == CLOJURE)

    def options(self, rule: Rule) -> dict[str, Any]:
        given = {k.replace("-", "_"): tuple(v) if isinstance(v, list) else v for k, v in self.rule_config.get(rule.id, {}).items()}
        return {k: v for k, v in given.items() if k in rule.options}

    def unknown(self) -> list[str]:
        """Groups, rules and options that nothing knows."""
        groups = {r.group for r in RULES.values()}
        out = [f"group {g}" for g in self.enabled_groups if g not in groups] + [f"rule {r}" for r in {**self.enabled_rules, **self.rule_config} if r not in RULES]
        return out + [f"option {k} of {r}" for r, own in self.rule_config.items() if r in RULES for k in own if k.replace("-", "_") not in RULES[r].options]


ALL = Config(enabled_groups={"clojure-specific": True, "functional": True, "traditional": True})


def select(config: Config) -> list[Rule]:
    return [r for _, r in sorted(RULES.items()) if config.on(r)]


_columns: dict[tuple, Any] = {}


def _column(nodes: DataFrame, rule: Rule, options: dict[str, Any]):
    """A row rule's expression, made once for each JVM: it does not depend on the data."""
    key = (id(nodes.sparkSession.sparkContext._gateway), rule.id, repr(sorted(options.items())))
    if key not in _columns:
        _columns[key] = rule.row(options)
    return _columns[key]


def findings(nodes: DataFrame, config: Config | None = None, rules: list[str] | None = None) -> DataFrame:
    """Findings of the enabled rules (or the named ones) over a node table. It is read once for all row rules
    and once for each table rule, so cache or write it if it is costly."""
    config = config or Config()
    chosen = [RULES[r] for r in rules] if rules is not None else select(config)
    rows = [_column(nodes, r, config.options(r)) for r in chosen if r.row]
    parts = []
    if rows:
        hits = F.filter(F.array(*rows), lambda x: x.isNotNull())
        one = nodes.select("path", "ast", F.explode(hits).alias("f"))
        parts.append(one.select("f.rule_id", "f.message", "path", "f.line", "f.col", "f.severity", "ast"))
    parts += [r.table(nodes, config.options(r)).select("rule_id", "message", "path", "line", "col", "severity", "ast") for r in chosen if r.table]
    if not parts:
        return nodes.limit(0).select(F.lit("").alias("rule_id"), F.lit("").alias("message"), "path", "line", "col", F.lit("").alias("severity"), F.lit("").alias("fingerprint"))
    # comments and findings across files have no subtree to fingerprint
    print_ = F.when(F.col("ast").isNotNull(), F.substring(F.sha2("ast", 256), 1, 16))
    return reduce(DataFrame.unionByName, parts).withColumn("fingerprint", print_).select(*FINDINGS)


def analyze(sources: DataFrame, config: Config | None = None) -> DataFrame:
    """Sorted findings of (path, text) rows."""
    config = config or Config()
    return ordered(findings(files.nodes(sources if config.analyze_tests else files.prune_tests(sources), heads=heads_of(select(config))), config))


def ordered(found: DataFrame) -> DataFrame:
    """A sort reads its input twice, once for the ranges alone; it is dealt before, so the sources are read and judged once."""
    return found.repartition("path", "line").orderBy("path", F.col("line").asc_nulls_first(), "col", "rule_id", "message")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id").agg(F.count("*").alias("count")).orderBy("rule_id")


NO_CODE = "// No code found at location or file is empty."


def snippets(found: DataFrame, sources: DataFrame, around: int = 4, mark: tuple[str, str] = ("", "")) -> DataFrame:
    """Adds ``code_snippet``: the lines within ``around`` of the finding, numbered; blank lines beside it are left out, and the
    finding's line stands in ``mark``.

    Only files with findings are read: their lines of interest are gathered, and each file's text is split once and cut
    to these windows before anything is exploded. A path that is scanned twice gives its snippet once."""
    wanted = found.where("line is not null").groupBy("path").agg(F.collect_set("line").alias("lines"))

    def window(code, at):
        near = F.filter(F.sequence(F.greatest(at - around, F.lit(1)), F.least(at + around, F.size(code))), lambda n: (n == at) | (F.trim(F.get(code, n - 1)) != ""))
        shown = F.transform(near, lambda n: F.concat(F.when(n == at, mark[0]).otherwise(""), F.lpad(n.cast("string"), 5, " "), F.lit(": "), F.get(code, n - 1), F.when(n == at, mark[1]).otherwise("")))
        return F.when(at - around <= F.size(code), F.array_join(shown, "\n")).otherwise(F.lit(""))

    # the text is split once, whatever the number of windows
    cut = F.get(F.transform(F.array(F.split("text", r"\r?\n")), lambda code: F.transform("lines", lambda at: F.struct(at.alias("line"), window(code, at).alias("code_snippet")))), F.lit(0))
    text = sources.join(wanted, "path").select("path", F.explode(cut).alias("w")).groupBy("path", "w.line").agg(F.min("w.code_snippet").alias("code_snippet"))
    code = F.when(F.col("line").isNull(), F.lit("")).when(F.coalesce("code_snippet", F.lit("")) == "", F.lit(NO_CODE)).otherwise(F.col("code_snippet"))
    return found.join(text, ["path", "line"], "left").select(*found.columns, code.alias("code_snippet"))
