"""The rules: what they are called, how severe they are, and the function that makes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

WARNING, INFO, HINT = "WARNING", "INFO", "HINT"
CLOJURE, FUNCTIONAL, TRADITIONAL = "clojure-specific", "functional", "traditional"


@dataclass(frozen=True)
class Rule:
    """``row`` rules give a finding column of a node row; ``table`` rules give findings of the node table."""

    id: str
    group: str
    severity: str
    description: str
    row: Callable[[dict[str, Any]], Column] | None = None
    table: Callable[[DataFrame, dict[str, Any]], DataFrame] | None = None
    options: dict[str, Any] = field(default_factory=dict)
    #: The only heads of lists that a row rule judges; None: it judges other nodes too.
    heads: tuple[str, ...] | None = None


RULES: dict[str, Rule] = {}
#: Heads of lists that a rule looks into at any depth; the reader gives their rows the whole subtree.
DEEP: set[str] = set()


def reads_deeply(*heads: str) -> None:
    DEEP.update(heads)


def _add(rule: Rule) -> None:
    if rule.id in RULES:
        raise ValueError(f"rule {rule.id} is defined twice")
    RULES[rule.id] = rule


def row_rule(rule_id: str, group: str, severity: str, description: str, heads: tuple[str, ...] | None = None, **options: Any):
    """Registers a function that takes the rule's options and gives a nullable finding column, null for all nodes but lists
    with one of the ``heads``, if these are given."""

    def take(f: Callable[..., Column]) -> Callable[..., Column]:
        _add(Rule(rule_id, group, severity, description, row=lambda given: f(**{**options, **given}), options=options, heads=heads))
        return f

    return take


def heads_of(rules: list[Rule]) -> frozenset[str] | None:
    """The heads of lists that these rules judge, or None if one of them judges other nodes too."""
    return None if any(r.heads is None for r in rules) else frozenset(h for r in rules for h in r.heads or ())


def table_rule(rule_id: str, group: str, severity: str, description: str, **options: Any):
    """Registers a function that takes the node table and the options and gives findings."""

    def take(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _add(Rule(rule_id, group, severity, description, table=lambda n, given: f(n, **{**options, **given}), options=options))
        return f

    return take


def rule_table(spark: SparkSession) -> DataFrame:
    from lispmill.plans import analyze  # noqa: F401  all rules register on import

    rows = [(r.id, r.id.replace("-", " ").title(), r.description, r.severity, r.group) for _, r in sorted(RULES.items())]
    return spark.createDataFrame(rows, "id string, name string, description string, severity string, `group` string")
