from __future__ import annotations

from collections import Counter

import pytest

from lispmill.operators.registry import RULES, rule_table
from lispmill.plans import analyze, corpora, report, stats
from lispmill.plans.config import generate, load
from lispmill.sources import files

LONG = {r: s for r, s in corpora.SNIPPETS.items()}


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(f"src/{k}_{name}.clj", s[k]) for k in (0, 1) for name, s in ((r.replace(":", "_").replace(" ", "_"), v) for r, v in LONG.items())]
    out = files.nodes(spark.createDataFrame(rows, "path string, text string")).persist()
    yield out
    out.unpersist()


def test_61_rules_in_three_groups():
    assert len(RULES) == 61
    assert Counter(r.group for r in RULES.values()) == {"clojure-specific": 29, "functional": 9, "traditional": 23}


def test_each_rule_on_its_snippets(spark, nodes):
    found = analyze.findings(nodes, analyze.ALL).select("rule_id", "path", "line").collect()
    for rule, (_, _, lines) in LONG.items():
        name = rule.replace(":", "_").replace(" ", "_")
        if rule in ("data-clumps", "duplicated-code"):
            continue
        assert sorted(r.line for r in found if r.rule_id == rule and r.path == f"src/0_{name}.clj") == [k + 1 for k in lines], rule
        assert not [r for r in found if r.rule_id == rule and r.path == f"src/1_{name}.clj"], rule


def test_clumps_and_duplicates_across_files(spark):
    rows = [("a.clj", "(defn f [host port db] (g host))"), ("b.clj", "(defn h [db x host port] (k db 1))"), ("c.clj", "(defn q [host port db] (r host))")]
    n = files.nodes(spark.createDataFrame(rows, "path string, text string"))
    clumps = analyze.findings(n, analyze.ALL, ["data-clumps"]).collect()
    assert sorted((r.path, r.line) for r in clumps) == [("a.clj", 1), ("b.clj", 1), ("c.clj", 1)]
    assert [r.path for r in analyze.findings(n, analyze.ALL, ["duplicated-code"]).collect()] == ["c.clj"]


def test_defaults_and_group_settings():
    ids = lambda c: {r.id for r in analyze.select(c)}
    assert ids(analyze.Config()) == {r.id for r in RULES.values() if r.group == "clojure-specific"}
    assert "explicit-recursion" not in ids(analyze.Config({"functional": False}, {"explicit-recursion": True}))
    assert "explicit-recursion" in ids(analyze.Config({}, {"explicit-recursion": True}))
    assert "explicit-recursion" not in ids(analyze.Config({"functional": True}, {"explicit-recursion": False}))


def test_options_reach_rules(spark):
    n = files.nodes(spark.createDataFrame([("a.clj", "(comp a b c d)")], "path string, text string"))
    c = analyze.Config({"functional": True}, {}, {"overabstracted-composition": {"most": 5}})
    assert analyze.findings(n, c, ["overabstracted-composition"]).count() == 0


def test_empty_null_and_unreadable_sources(spark):
    src = spark.createDataFrame([("a.clj", None), ("b.clj", ""), ("c.clj", "(("), ("d.clj", "{\"a\" 1}"), ("d.clj", "{\"a\" 1}")], "path string, text string")
    assert analyze.findings(files.nodes(src), analyze.ALL, ["string-map-keys"]).count() == 2
    assert files.nodes(src.limit(0)).count() == 0
    assert analyze.findings(files.nodes(src), analyze.ALL, []).count() == 0


def test_renderings(spark):
    src = spark.createDataFrame([("a.clj", "\n{\"a\" 1}\n"), ("b.clj", "{\"b|<\" 1}")], "path string, text string")
    found = analyze.findings(files.nodes(src), analyze.ALL, ["string-map-keys"]).persist()
    for form in report.FORMATS:
        assert report.render(found, src, form).count() >= 1
    assert "\\|" in "".join(r[0] for r in report.as_markdown(found).collect())
    assert "&lt;" in "".join(r[0] for r in report.as_html(found, src).collect())
    assert report.as_text(found).collect()[-1][0] == "- string-map-keys: 2"
    with pytest.raises(ValueError):
        report.render(found, src, "pdf")


def test_scan_prunes_tests_and_other_files(spark, tmp_path):
    for name in ("a.clj", "b.CLJS", "c.txt", "test/d.clj", "e_test.clj"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("(a)")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(files.scan(spark, f"file://{tmp_path}", analyze_tests=True)) == ["a.clj", "b.CLJS", "d.clj", "e_test.clj"]
    assert "e_test.clj" not in names(files.scan(spark, f"file://{tmp_path}"))


def test_measures(spark):
    n = files.nodes(spark.createDataFrame([("a.clj", "(defn f [a b & c]\n (g (h a))\n (-> a b c))\n(fn [x] (get-in x [:a :b :c]))")], "path string, text string"))
    got = {r.function_name: r.asDict() for r in stats.function_stats(n).collect()}
    assert {k: v for k, v in got["f"].items() if k not in ("path", "function_name")} == {"lines_of_code": 3, "parameter_count": 2, "max_nesting_depth": 2, "max_message_chain": 2, "max_consecutive_primitive_params": 2}
    assert got["anonymous-fn"]["max_message_chain"] == 3


def test_config_file_round_trip(tmp_path):
    (tmp_path / "c.yaml").write_text(generate())
    assert {r.id for r in analyze.select(load(tmp_path / "c.yaml"))} == {r.id for r in analyze.select(analyze.Config())}


def test_rule_table(spark):
    assert rule_table(spark).count() == 61
