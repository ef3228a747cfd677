"""The pipeline's near-duplicate stage against every pair's exact similarity."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from lispmill.llm import shingle_join, simhash
from tests.llm.helpers import awkward, clashing, empty, prose


def shingles(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    sets = [shingles(r.text) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(label[k], []).append(r.doc_id)
    return sorted(str(min((i for i in v if i is not None), default=None)) for v in groups.values())


@pytest.mark.parametrize(("neighbours", "one_task"), [((3, 24), 1 << 19), ((), 0)])
def test_links_exactly_the_similar(spark, monkeypatch, neighbours, one_task):
    """Edits spread pairs on both sides of 0.8; texts of two shingles differ in one word; few rounds leave the most to the last."""
    monkeypatch.setattr(shingle_join, "NEIGHBOURS", neighbours)
    monkeypatch.setattr(simhash, "ONE_TASK", one_task)
    monkeypatch.setattr(shingle_join, "TRIED", 64 if one_task else 2)
    r = random.Random(5)
    texts = ["one two three four five six", "one two three four five seven", "one two three four"]
    for k in range(120):
        w = prose(200 + k % 15, 40 + 20 * (k % 15)).split()
        for _ in range(r.randint(0, 1 + len(w) // 40)):
            w[r.randrange(len(w))] = f"changed{r.randrange(9)}"
        texts.append(" ".join(w))
    docs = clashing(awkward(spark, texts), "sig", "root", "n", "_kept_id")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    want = kept(docs.select("doc_id", "text").collect())
    assert sorted(str(x.doc_id) for x in out.collect()) == want
    assert 40 < len(want) < 120


def test_fingerprints_alone_link_close_copies(spark, monkeypatch):
    """What the Gray index names is verified and linked before the exact join sees it."""
    monkeypatch.setattr(shingle_join, "NEIGHBOURS", ())
    monkeypatch.setattr(shingle_join, "_all_left", lambda live, least: live.limit(0).selectExpr("sig as a", "sig as b"))
    base = prose(3, 900).split()
    copies = [" ".join([*base[:k], f"changed{k}", *base[k + 1 :]]) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate([*copies, prose(4, 900)])), "doc_id long, text string")
    assert sorted(x.doc_id for x in shingle_join.drop_similar(docs, 5, 0.8).collect()) == [0, 20]


def test_empty(spark):
    assert corpus_pipeline.drop_near_duplicates(spark, empty(spark), "").count() == 0
