"""The last rounds of the near-duplicate stage: the members of a large group of near copies never become all their pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from lispmill.llm import shingle_join
from lispmill.llm.simhash import BROADCAST
from tests.llm.helpers import prose
from tests.llm.test_shingle_join import kept


def group(n: int, seed: int) -> list[str]:
    """Edits of one text of 150 words; some go so far that few others are similar to them."""
    r, out = random.Random(seed), []
    for _ in range(n):
        w = prose(400, 150).split()
        for k in r.sample(range(0, 150, 5), r.choice([1, 2, 3, 4, 5, 6])):
            w[k] = f"changed{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("block", "widths", "closest", "broadcast"), [(256, (512, 1 << 16), 3, BROADCAST), (7, (64, 128), 1, 0)])
def test_a_group_is_not_expanded_into_its_pairs(spark, monkeypatch, block, widths, closest, broadcast):
    """The same rows are kept as by all pairs, whatever sketches can tell; candidates follow the members, not their pairs."""
    named, all_left = [], shingle_join._all_left

    def noted(*args):
        named.append(out := shingle_join.cut(all_left(*args)))
        return out

    monkeypatch.setattr(shingle_join, "_all_left", noted)
    monkeypatch.setattr(shingle_join, "NEIGHBOURS", (1,))
    monkeypatch.setattr(shingle_join, "TRIED", 2)
    monkeypatch.setattr(shingle_join, "PARTNERS", 1)
    monkeypatch.setattr(shingle_join, "BLOCK", block, raising=False)
    monkeypatch.setattr(shingle_join, "WIDTHS", widths, raising=False)
    monkeypatch.setattr(shingle_join, "CLOSEST", closest, raising=False)
    monkeypatch.setattr(shingle_join, "BROADCAST", broadcast)
    texts = group(240, 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    want = kept(docs.collect())
    assert sorted(str(x.doc_id) for x in out.collect()) == want
    assert 5 < len(want) < 200
    assert named
    if block == 256:
        assert sum(x.count() for x in named) < 8 * len(texts)


def test_sketches_rule_out_no_similar_pair():
    """Sketches differ in no more buckets than the sets in hashes, folded or not."""
    r = np.random.default_rng(3)
    for n in (1, 40, 127, 129, 700, 40_000):
        base = r.integers(0, 1 << 63, n, dtype=np.uint64)
        sets = [np.unique(np.r_[base[k:], r.integers(0, 1 << 63, k, dtype=np.uint64)]) for k in {0, n // 20, n // 8, n // 3}]
        for x, y in combinations(sets, 2):
            a, b = shingle_join.sketch(x), shingle_join.sketch(y)
            width = min(len(a), len(b))
            a, b = shingle_join._folded([a], width), shingle_join._folded([b], width)
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))
