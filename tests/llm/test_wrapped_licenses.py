from __future__ import annotations

from lispmill.llm import licenses
from tests.llm.helpers import prose


def test_notices_wrapped_over_lines(spark):
    texts, want = [], []
    for label, notices in licenses.TEMPLATES.items():
        for notice in notices:
            w = notice.split()
            for at in range(1, len(w)):
                for before in (0, 29, 70):
                    texts.append(" ".join([*prose(5, before).split(), *w[:at]]) + "\n" + " ".join(w[at:]) + "\n" + prose(6, 80))
                    want.append(label)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert not [texts[k] for k, label in enumerate(want) if label not in got[k].labels.split(",") or got[k].score < 0.9]
