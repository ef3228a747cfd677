"""The rounds of the near-duplicate stage: no pair is verified twice, and labels too many to broadcast change nothing."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from lispmill.llm import shingle_join, simhash
from tests.llm.helpers import awkward, prose
from tests.llm.test_shingle_join import kept


def edited(n: int) -> list[str]:
    """Texts that share much of a few originals, on both sides of 0.8."""
    r, out = random.Random(11), []
    for k in range(n):
        w = prose(300 + k % 3, 120).split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"changed{r.randrange(9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_no_pair_is_verified_twice(spark, monkeypatch, broadcast):
    seen, cut = [], shingle_join.cut

    def noted(df):
        out = cut(df)
        if out.columns == ["a", "b"]:
            seen.append(out)
        return out

    monkeypatch.setattr(shingle_join, "cut", noted)
    monkeypatch.setattr(shingle_join, "NEIGHBOURS", (2, 5))
    monkeypatch.setattr(shingle_join, "TRIED", 16)
    monkeypatch.setattr(shingle_join, "BROADCAST", broadcast)
    monkeypatch.setattr(simhash, "BROADCAST", broadcast)
    docs = awkward(spark, edited(80))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    want = kept(docs.select("doc_id", "text").collect())
    assert sorted(str(x.doc_id) for x in out.collect()) == want
    pairs = Counter(tuple(p) for df in seen for p in df.collect())
    assert max(pairs.values()) == 1
    assert len(seen) >= 3 and len(pairs) > 20
