from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from lispmill import __main__ as cli
from lispmill.plans import analyze
from lispmill.streaming import watch


def test_lists_infos_and_defaults(capsys):
    assert cli.main(["list"]) == 0 and len(capsys.readouterr().out.split("\n")) == 62
    assert cli.main(["info", "comments"]) == 0 and capsys.readouterr().out.startswith("comments\tINFO")
    assert cli.main(["info", "nothing"]) == 1
    assert cli.main(["genconf"]) == 0 and "clojure-specific: true" in capsys.readouterr().out


def test_analyze_and_stats(spark, tmp_path, capsys):
    (tmp_path / "a.clj").write_text('(defn f [a b]\n  {"k" nil})\n')
    where = f"file://{tmp_path}"
    assert cli.main(["analyze", where, "--count-finding", "--timing"]) == 0
    assert capsys.readouterr().out.strip() == "1"
    assert cli.main(["stats", where]) == 0
    assert "parameter_count\t2\t1" in capsys.readouterr().out
    assert cli.main(["analyze", where, "--format", "csv", "--to", f"{where}/out"]) == 0
    assert "map-with-nil-values,1" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert cli.main(["dump", where]) == 0 and '"head":"defn"' in capsys.readouterr().out


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.clj").write_text("(in-ns 'b)")
    found = watch.stream_findings(watch.source_stream(spark, f"file://{tmp_path}/in"), analyze.Config({}, {}))
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.rule_id for r in spark.sql("select rule_id from found").collect()] == ["monolithic-namespace-split"]


def test_entry_imports_without_a_session():
    root = Path(__file__).parent.parent
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= 90, set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "True"], out.stderr
