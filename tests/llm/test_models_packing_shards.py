from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lispmill.llm import langid, packing, sharding, toxicity
from tests.llm.helpers import awkward, clashing, empty, prose

STEMS = {"en": "the of and ing er ton".split(), "de": "der ung sch ein lich keit".split(), "fr": "que les eau tion ment é".split()}


# --- language
def test_languages_held_out(spark):
    rows = [(k, prose(k, 40, STEMS[lang]), lang) for k in range(600) for lang in [list(STEMS)[k % 3]]]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "held_out", "score")
    out = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs, rows_each=100)).collect()}
    held = [k for k in out if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(out[k].held_out == (k in held) for k in out)
    assert sum(out[k].lang_pred == list(STEMS)[k % 3] for k in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_undetermined_and_empty(spark):
    docs = awkward(spark, ["123 456 !!", "the of and"])
    out = langid.predict(docs, langid.fit(docs)).collect()
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 100)} == {"und"}
    assert len(out) == docs.count()
    none = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty(spark), none).count() == 0


def test_held_out_rows_teach_nothing(spark):
    rows = [(k, prose(k, 30, STEMS["en"]), "en" if zlib.crc32(str(k).encode()) % 5 else "xx") for k in range(100)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["en"]


def test_training_against_plain_formulas(spark):
    """The idf, the FTRL steps, and the temperature, a coordinate at a time."""
    rows = [(k, prose(k, 25, STEMS[lang]), lang) for k in range(90) for lang in [list(STEMS)[k % 3]]]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    df = sum((langid.counts(t) > 0).astype(int) for _, t, _ in learn)
    assert np.allclose(model.idf, np.log((1 + len(learn)) / (1 + df)) + 1)
    data = [(*model.vector(langid.counts(t)), model.languages.index(lang)) for _, t, lang in sorted(learn, key=lambda r: (r[2], r[0]))]
    held, data = data[::5], [d for k, d in enumerate(data) if k % 5]
    z, n, order = {}, {}, np.random.default_rng(7)

    def weight(j, c):
        x = z.get((j, c), 0.0)
        return 0.0 if abs(x) <= langid.L1 else -(x - math.copysign(langid.L1, x)) / ((langid.BETA + math.sqrt(n.get((j, c), 0.0))) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(data)):
            at, w, y = data[i]
            x = [*zip(at.tolist(), w.tolist(), strict=True), (langid.DIM, 1.0)]
            now = {(j, c): weight(j, c) for j, _ in x for c in range(3)}
            s = [sum(v * now[j, c] for j, v in x) for c in range(3)]
            p = [math.exp(v - max(s)) for v in s]
            p = [v / sum(p) for v in p]
            for j, v in x:
                for c in range(3):
                    g = v * (p[c] - (c == y))
                    old = n.get((j, c), 0.0)
                    z[j, c] = z.get((j, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * now[j, c]
                    n[j, c] = old + g * g
    want = np.array([[weight(j, c) for c in range(3)] for j in sorted({j for j, _ in z})])
    got = np.vstack([model.weights, model.bias])[sorted({j for j, _ in z})]
    assert np.allclose(got, want, atol=1e-5)
    loss = lambda t: -sum(math.log(np.exp(s / t)[y] / np.exp(s / t).sum()) for at, w, y in held for s in [model.logits(at, w)])
    assert loss(model.temperature) <= min(map(loss, np.geomspace(0.05, 20, 61))) + 1e-6


def test_a_bounded_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(k, prose(k, 20), f"dirty{k}" if k % 3 == 0 else "en" if k % 3 == 1 else "de") for k in range(60)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["de", "en"]


def test_counts_of_chunks_add_up(monkeypatch):
    text = prose(3, 400) + " ñandú 😀"
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 97)
    assert (langid.counts(text) == whole).all() and whole.sum() == sum(max(0, len(langid.SPACE.sub(" ", text.lower())) - n) for n in range(3))


# --- toxicity
def labelled(spark, n=800):
    r = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        w = prose(k, 80).split()
        for _ in range(4 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["scumlike", "grubzor", "vilewort"]) + r.choice(["", "ish", "er"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([*labels, (None, 1), (5, None), (10**6, 1)], "doc_id long, toxic int")


def test_toxicity_held_out_and_exact_neighbours(spark):
    docs, labels = labelled(spark)
    docs = clashing(docs, "score", "y")
    model = toxicity.fit(docs, labels)
    out = toxicity.score_toxicity(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.predicted}
    assert not set(model.ids.tolist()) & {r.doc_id for r in held}
    texts = {r.doc_id: r.text for r in docs.collect()}
    examples = [dict(zip(*(x.tolist() for x in model.vector(texts[i])), strict=True)) for i in model.ids.tolist()]
    scores = {r.doc_id: r.score for r in out}
    for r in docs.limit(60).collect():  # neighbours and votes against all cosines
        at, w = model.vector(r.text)
        if not len(at):
            assert scores[r.doc_id] == model.empty_score
            continue
        own = dict(zip(at.tolist(), w.tolist(), strict=True))
        every = [sum(x * e.get(k, 0) for k, x in own.items()) for e in examples]
        order = sorted((k for k, c in enumerate(every) if c > 0), key=lambda k: (-every[k], model.ids[k]))[: toxicity.NEIGHBOURS]
        who, sim = model.nearest(at, w)
        assert np.allclose(sorted(sim), sorted(every[k] for k in order), atol=1e-6) and len(who) == len(order)
        votes = [1 / (1.05 - min(1, every[k])) for k in order]
        raw = sum(v * model.y[k] for v, k in zip(votes, order, strict=True)) / sum(votes) * (0.5 + 0.5 * every[order[0]]) if order else 0.0
        assert abs(scores[r.doc_id] - np.interp(raw, *model.steps)) < 0.02


def test_features_weights_and_frequencies(spark):
    """The vocabulary, document frequencies and TF-IDF weights, counted plainly."""
    docs, labels = labelled(spark, 300)
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect()}
    learn = {i: t for i, t in rows.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id in learn}
    has = {i: toxicity.grams(toxicity.normal(learn[i])) for i in y}
    n1 = sum(y.values())
    n0 = len(y) - n1
    want = set()
    for g in set().union(*has.values()):
        b = sum(y[i] for i in y if g in has[i])
        a = sum(g in has[i] for i in y) - b
        if b >= toxicity.LEAST and math.log((b + 0.5) / (n1 + 1)) - math.log((a + 0.5) / (n0 + 1)) >= toxicity.ODDS:
            want.add(g)
    assert set(model.features) == want and want
    for g in sorted(want)[::40]:
        df = sum(g in toxicity.normal(t) for t in learn.values())
        assert model.idf[model.features.index(g)] == pytest.approx(math.log((1 + len(learn)) / (1 + df)) + 1)


def test_isotonic_against_its_definition():
    r = random.Random(6)
    for n in (1, 2, 7, 30):
        x, y, w = [np.array(v) for v in zip(*((r.random(), r.choice([0.0, 1.0]), r.choice([1.0, 3.0])) for _ in range(n)), strict=True)]
        order = np.argsort(x)
        mean = lambda a, b: (y[order[a:b]] * w[order[a:b]]).sum() / w[order[a:b]].sum()  # noqa: E731, B023
        want = [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(np.interp(x[order], *toxicity.isotonic(x, y, w)), want)


def test_toxicity_edges(spark):
    docs, labels = labelled(spark, 200)
    odd = awkward(spark)
    model = toxicity.fit(docs, labels)
    assert toxicity.score_toxicity(odd, model).count() == odd.count()
    bare = toxicity.fit(odd, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(odd, bare).collect()} == {0.0}
    assert toxicity.score_toxicity(empty(spark), model).count() == 0


# --- packing
def test_pieces_against_the_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    docs = clashing(awkward(spark, ["it's <|endoftext|> a\x1cb\x85c\xa0d", "İ ﬁ ΑΣ. don't 12 34", "é é ñ|??!! x", prose(8, 5000).upper()]), "length", "bucket", "n")
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[r.doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("select", ["norm", "dot"])
@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64 * 64), packing.Limits(64, 64, 700)])
def test_plan_keeps_every_limit(limits, select):
    r = random.Random(1)
    most = min(limits.tokens, int(limits.attention**0.5))
    sizes = Counter(r.randint(1, most) for _ in range(3000))
    bins: dict[int, list[tuple[int, int]]] = {}
    ranks: dict[int, list[int]] = {}
    for length, rank, n, first, offset in packing.plan(dict(sizes), limits, select):
        for k in range(n):
            bins.setdefault(first + k, []).append((offset, length))
            ranks.setdefault(length, []).append(rank + k)
    assert {k: len(v) for k, v in ranks.items()} == sizes and all(sorted(v) == list(range(len(v))) for v in ranks.values())
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(own) <= limits.documents and sum(x * x for _, x in own) <= limits.attention
    if limits == packing.Limits() and select == "norm":
        assert len(bins) <= -(-sum(k * v for k, v in sizes.items()) // 4096) * 1.02 + 1


def test_a_hot_length_is_dealt_out(spark):
    rows = spark.createDataFrame([(k % 7, "same") for k in range(3000)], "doc_id long, text string")
    got = packing.pack_documents(rows).collect()
    assert len(got) == 3000 and len({(r.sequence_id, r.offset) for r in got}) == 3000


# --- shards
def test_store_append_compact_read(spark, tmp_path):
    docs = clashing(awkward(spark, [prose(k, 50) for k in range(60)]), "arrival", "tier")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", base=512, target=8192)
    assert store.versions() == [] and store.manifest().count() == 0
    assert store.append(docs, F.floor(F.col("doc_id") / 4)) == 1
    assert store.compact() == 2
    assert store.append(docs, F.floor(F.col("doc_id") / 4) + 100) == 3
    for version, times in ((1, 1), (2, 1), (3, 2)):
        got = Counter(map(tuple, store.read(version).select(*docs.columns).collect()))
        assert got == Counter({k: v * times for k, v in Counter(map(tuple, docs.collect())).items()})
    assert store.manifest(2).count() < store.manifest(1).count()
    merged = store.manifest(2).where("shard like 'm%'").collect()
    assert merged and all(r.n_bytes < 8192 + 8192 for r in merged)
    assert store.expire().count() > 0


def test_second_writer_of_a_version_fails(spark, tmp_path):
    a, b = (sharding.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    a.commit(a.manifest(), 0)
    with pytest.raises(Exception, match="exist"):
        b.commit(b.manifest(), 0)
    assert a.versions() == [1]


def test_a_crash_between_two_steps_of_a_commit(spark, tmp_path):
    """A writer that dies before its commit file is in place, and a torn commit file, stop no one."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string")
    store.append(docs, F.col("doc_id"))

    def dies(spark, made, to):
        raise KeyboardInterrupt

    dying = sharding.ShardStore(spark, f"file://{tmp_path}/s", put=dies)
    with pytest.raises(KeyboardInterrupt):
        dying.append(docs, F.col("doc_id"))
    assert store.versions() == [1] and store.read().count() == 20
    (tmp_path / "s" / "commits" / "00000002").write_bytes(b"")
    assert store.versions() == [1] and store.read().count() == 20
    assert store.append(docs, F.col("doc_id")) == 3
    assert store.compact() == 4
    assert store.versions() == [1, 3, 4] and store.read().count() == 40 and store.expire().count() > 0


def test_names_that_the_store_uses(spark, tmp_path):
    docs = spark.createDataFrame([(k, "some text", f"s{k}", k * 10, "b", "r") for k in range(30)], "doc_id long, text string, __SHARD string, __arrival long, __batch string, __run_ string")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", base=16, target=64)
    for _ in range(2):
        store.append(docs, F.floor(F.col("doc_id") / 3))
        store.compact()
    got = Counter(map(tuple, store.read().select(*docs.columns).collect()))
    assert got == Counter({tuple(r): 2 for r in docs.collect()})


def test_later_rounds_merge_merged_shards(spark, tmp_path):
    """Runs of an upper tier hold shards that an earlier compaction made; every size stays within its tier's target."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", base=100, fan=4, target=1600)
    rounds = []
    for part in range(6):
        store.append(spark.createDataFrame([(100 * part + k, "x" * 30) for k in range(8)], "doc_id long, text string"), F.col("doc_id"))
        store.compact()
        rounds.append({(r.shard, r.n_rows) for r in store.manifest().collect()})
    assert any(n > 8 for _, n in rounds[-1]) and store.read().count() == 48
    assert sum(n for _, n in rounds[-1]) == 48


def test_empty_store(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(empty(spark), F.col("doc_id"))
    assert store.compact() == 1 and store.read() is None
