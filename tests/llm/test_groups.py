from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lispmill.llm import decontaminate, simhash
from tests.llm.helpers import awkward, clashing, empty, prose


def plain_fingerprint(text, n=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(xs, distance):
    label = list(range(len(xs)))
    for i in range(len(xs)):
        for j in range(i):
            if (xs[i] ^ xs[j]).bit_count() <= distance and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def close(n, seed, spread):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x = r.getrandbits(64) if k % spread == 0 else out[-1]
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.sampled_from([1, 3, 50, 1000]), st.sampled_from([0, 2, 4, 7]))
def test_gray_index_links_exactly(n, seed, spread, distance):
    xs = close(n, seed, spread)
    got = simhash.link(np.array(xs, np.uint64), distance).tolist()
    label = classes(xs, distance)
    assert got == [min(xs[j] for j in range(len(xs)) if label[j] == label[i]) for i in range(len(xs))]


@pytest.mark.parametrize("cell", [2048, 16])
def test_components_against_brute_force(spark, monkeypatch, cell):
    """Small cells force the split of groups over pairs of parts."""
    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(4)
    base = [prose(k, 120).split() for k in range(12)]
    texts = []
    for k in range(150):
        w = list(base[k % 12]) if k % 3 else list(base[0])
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    docs = clashing(awkward(spark, texts), "fp", "node", "root", "component_id")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(x.text) for x in rows]
    label = classes(fps, 4)
    ids = [min((rows[j].doc_id for j in range(len(rows)) if label[j] == label[i] and rows[j].doc_id is not None), default=None) for i in range(len(rows))]
    got = Counter((x.doc_id, x.fp & (1 << 64) - 1, x.component_id) for x in simhash.near_duplicates(docs).collect())
    assert got == Counter(zip([x.doc_id for x in rows], fps, ids, strict=True))


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 300), st.integers(0, 10**6), st.sampled_from([1, 3, 50]), st.sampled_from([2, 4]))
def test_nearest_partners(n, seed, spread, distance):
    """Each fingerprint that has one within the distance before it in Gray order gets the least different one."""
    xs = np.array(close(n, seed, spread), np.uint64)
    order = xs[np.argsort(simhash.gray_rank(xs), kind="stable")].tolist()
    got = {}
    for a, b in zip(*(x.tolist() for x in simhash.nearest(xs, distance, 2)), strict=True):
        got.setdefault(a, []).append((a ^ b).bit_count())
    for k, x in enumerate(order):
        near = sorted(d for d in ((x ^ y).bit_count() for y in order[:k]) if d <= distance)
        assert sorted(got.get(x, [])) == near[:2]


@pytest.mark.parametrize("one_task", [1 << 19, 0])
def test_components(spark, monkeypatch, one_task):
    """Chains, stars and circles, in one task and by contracted stars."""
    monkeypatch.setattr(simhash, "ONE_TASK", one_task)
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(-5, 40)] + [(100, k) for k in range(101, 200)] + [(300 + k, 300 + (k + 1) % 7) for k in range(7)] + [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(60)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k != v}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark):
    docs = clashing(awkward(spark, ["alpha beta gamma delta", "alpha beta gamma delta", prose(9, 90)]), "fp", "_kept_id")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    label = {}
    for x in docs.collect():
        label.setdefault(plain_fingerprint(x.text), []).append(x.doc_id)
    got = Counter(x.doc_id for x in kept.collect())
    assert sum(got.values()) == len(label) and set(got) <= {min((i for i in v if i is not None), default=None) for v in label.values()}
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0


# --- decontamination
def plain_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row
        row = [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
    return row[-1]


def brute_leaks(text, items):
    """Every window of the documented width against every item, with BM25 and the overlaps said plainly."""
    import math

    out = {}
    ws = decontaminate.words(text)
    known = [i for i in items if i.words]
    if not known:
        return out
    df = Counter(w for i in known for w in set(i.words))
    mean = sum(len(i.words) for i in known) / len(known)
    for item in known:
        width = 64
        while width < len(item.words):
            width *= 4
        tf = Counter(item.words)
        weight = {t: math.log1p((len(known) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(item.words) / mean)) for t, n in tf.items()}
        ask = item.words[: len(item.words) - min(len(item.words), max(3, len(item.words) // 4))]
        reply = Counter(item.words[len(ask) :])
        for start in range(0, len(ws), width):
            passage = ws[start : start + 2 * width]
            score = sum(weight.get(t, 0) for t in set(passage)) / sum(weight.values())
            if score < decontaminate.THRESHOLD - 1e-9:
                continue
            q = plain_order(ask, passage) / len(ask) if ask else 1.0
            a = sum((reply & Counter(passage)).values()) / sum(reply.values())
            if q >= 0.8 and (a >= 0.8 or len(ask) >= 8):
                old = out.get(item.id, (0, 0, 0))
                out[item.id] = max(old, (min(q, a), round(score, 9), -start))
    return {k: v[1] for k, v in out.items()}


def leaky_tables(spark):
    """Items of several lengths; copies whole, with words changed, of the question only, over cuts, and beside long texts."""
    r = random.Random(12)
    items = [(k, prose(1000 + k, 15 + k)) for k in range(40)] + [(60 + k, prose(1100 + k, 90 + 80 * k)) for k in range(3)] + [(90, None), (91, ""), (92, prose(1003, 18)), (93, "two words")]
    held = [prose(50 + k, 150) + " " + items[k][1].upper().replace(" ", "%% ") + " " + prose(80 + k, 40 * k) for k in range(12)]
    for k in range(20):
        w = items[12 + k][1].split()
        for _ in range(1 + k % 4):
            w[r.randrange(len(w))] = "edited"
        held.append(prose(70 + k, 61 + k) + " " + " ".join(w) + " " + prose(20 + k, 30))
    held += [prose(9, 200) + items[41][1] + " " + prose(10, 700), " ".join(items[30][1].split()[:33]), " ".join(items[20][1].split()[:8]), prose(7, 700), items[42][1], "x two words y"]
    return spark.createDataFrame(items, "item_id long, text string"), held


@pytest.mark.parametrize(("batch", "segment", "cells"), [(1 << 15, 1 << 20, 1 << 21), (64, 50, 3)])
def test_matching_against_brute_force(spark, monkeypatch, batch, segment, cells):
    """Also with blocks, segments and bounds so small that every text is cut."""
    for k, v in (("BATCH_WORDS", batch), ("SEGMENT", segment), ("CELLS", cells), ("LOOKUPS", cells)):
        monkeypatch.setattr(decontaminate, k, v)
    items, held = leaky_tables(spark)
    texts = [r.text for r in awkward(spark, held).collect()]
    known = [decontaminate.Item(r.item_id, r.text) for r in items.collect()]
    got = list(decontaminate.leaks(texts, decontaminate.indexes(known)))
    assert [k for k, _ in got] == list(range(len(texts)))
    for k, found in got:
        want = brute_leaks(texts[k], known)
        assert {f[0]: pytest.approx(f[1]) for f in found} == want


def test_leaks_against_brute_force(spark):
    items, held = leaky_tables(spark)
    docs = clashing(awkward(spark, held), "item_id", "score")
    bench = clashing(items, "doc_id")
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in decontaminate.find_leaks(docs, bench).collect()}
    known = [decontaminate.Item(r.item_id, r.text) for r in items.collect()]
    want = {(r.doc_id, i): s for r in docs.collect() for i, s in brute_leaks(r.text, known).items()}
    assert got.keys() == want.keys() and len(got) >= 30
    assert all(abs(got[k] - want[k]) < 1e-8 for k in got)
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    leaky = {d for d, _ in got}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id not in leaky)
    nothing = bench.limit(0)
    assert decontaminate.find_leaks(docs, nothing).count() == 0 and decontaminate.drop_leaks(docs, nothing).count() == docs.count()
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0


def test_slices_find_the_same(spark, monkeypatch):
    """Noisy copies have the same scores, whether the items are one index or several."""
    items, held = leaky_tables(spark)
    docs = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    found = lambda: {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs, items).collect()}
    whole = found()
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 2000)
    parts = found()
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-9 for k in whole)
    assert decontaminate.drop_leaks(docs, items).count() == len(held) - len({d for d, _ in whole})


def test_edited_items_are_found():
    """All one-word and two-word replacements in items of 15 words or more."""
    r = random.Random(2)
    items = [decontaminate.Item(k, prose(500 + k, 15 + k)) for k in range(40)]
    index = decontaminate.indexes(items)
    missed = total = 0
    for item in items:
        for _ in range(6):
            w = list(item.words)
            for i in r.sample(range(len(w)), 1 + total % 2):
                w[i] = "edited"
            (_, found), = decontaminate.leaks([prose(3, 40) + " " + " ".join(w) + " " + prose(4, 40)], index)
            missed += item.id not in {f[0] for f in found}
            total += 1
    assert missed <= 0.02 * total


def test_long_text_in_bounded_memory():
    import tracemalloc

    items = [decontaminate.Item(k, prose(500 + k, 40)) for k in range(300)]
    index = decontaminate.indexes(items)
    text = prose(1, 2000) * 500 + " " + " ".join(items[7].words)
    tracemalloc.start()
    (_, found), = decontaminate.leaks([text], index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[0] for f in found] == [7] and peak < 3 * len(text) + (64 << 20)
