"""Sorted findings read and judge their sources once, and make rows of what their rules judge only."""

from __future__ import annotations

from lispmill.operators.registry import RULES, heads_of
from lispmill.plans import analyze, corpora
from lispmill.sources import files
from lispmill.sources.parser import node_batch, read_forms

SOURCE = "(defn a [p1 p2 p3 p4 p5 p6 p7 p8 p9 p10]\n (let [x (defn b [y z] y)] (defrecord C [d e])))\n; defn\n(defn- c \"doc\" [x y] x)\n[defn x]"
JUDGED = ["long-parameter-list", "primitive-obsession"]


def test_sources_are_read_once(spark):
    rows = [(f"src/f{k}.clj", SOURCE) for k in range(40)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    src = spark.createDataFrame(rows, "path string, text string").repartition(4, "path").mapInArrow(counted, "path string, text string")
    out = analyze.ordered(analyze.findings(files.nodes(src), analyze.ALL, JUDGED)).collect()
    assert [(r.path, r.line) for r in out] == sorted((r.path, r.line) for r in out) and len(out) > 100
    assert seen.value == len(rows)


def test_rows_of_heads_are_those_among_all_rows():
    heads = heads_of([RULES[r] for r in JUDGED])
    texts = [SOURCE, "(a b)", "", "(x (defn f [a & [b]] (when a b)))"]
    made = [(str(k), read_forms(t)) for k, t in enumerate(texts)]
    got, every = node_batch(made, heads_of=heads), node_batch(made)
    assert got.schema == every.schema
    assert got.to_pylist() == [r for r in every.to_pylist() if r["type"] == "List" and r["head"] in heads]
    assert got.num_rows == 5
    assert node_batch(made[1:2], heads_of=heads).num_rows == 0


def test_rules_of_heads_judge_no_other_rows(spark):
    own = [r for r in RULES.values() if r.heads]
    assert {r.id for r in own} >= set(JUDGED) and heads_of([*own, RULES["comments"]]) is None
    src = spark.createDataFrame([(f"{k}.clj", s) for k, s in enumerate([SOURCE, *[x for pair in corpora.SNIPPETS.values() for x in pair[:2]]])], "path string, text string")
    whole, few = files.nodes(src), files.nodes(src, heads=heads_of(own))
    rows = lambda n: sorted(map(tuple, analyze.findings(n, analyze.ALL, [r.id for r in own]).collect()), key=str)
    assert rows(few) == rows(whole) and len(rows(few)) > 5
