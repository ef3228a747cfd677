"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Fitting. Of the labelled rows, at most ``EXAMPLES`` of each label (by a hash of the id; the bound is a
parameter) are examples. Features are character n-grams, ``GRAMS`` long, of the lower-cased text with every
run of other characters than letters made one space. All that occur clearly more often in examples with label 1
are kept: the vocabulary leaves out what doesn't speak of toxicity, as long texts would else be compared by
their topic. Document frequencies are counted over all documents that may be learnt from. An example is the
TF-IDF vector of these features. The index is inverted: a feature's postings are the examples that have it,
in blocks of ``BLOCK`` neighbouring examples, and each block of postings keeps its greatest weight.

Scoring. One Aho-Corasick pass over the whole text counts its features. The block maxima of their postings
bound the cosine of every example of a block. Blocks are visited by falling bound until the bound is below the
k-th best cosine, and only a visited block's postings are read, so the neighbours are exact. Neighbours vote with weight ``1 / (1.05 - cosine)``; the vote and the cosine of the
nearest one give a raw score, which isotonic regression on the examples (each judged without itself, weighted
to the labels' true rates) turns into a probability. The neighbours are the evidence. A text with no feature
gets the smoothed rate of such examples.

Null and empty texts have no feature. Equal cosines go by the example's id. Labels that are null or of no
document teach nothing; documents labelled twice are toxic if any label is, and an id of several
rows teaches by its least text. Without any labels all scores
are 0. Repeated rows give a row each; ``drop_toxic`` keeps all columns, whatever their names; empty tables
give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lispmill.llm.common import bucket_of, cut, map_rows, table, trim, values

EXAMPLES, GRAMS = 2000, (4, 5, 6, 7, 8)
NEIGHBOURS, BLOCK, CUT = 15, 32, 0.3
#: Blocks that are visited at a time, and n-grams that a task holds before it hands them on.
VISIT, HELD = 4, 1 << 17
#: A feature has at least so many examples of label 1, and its odds of label 1 are e to this power.
LEAST, ODDS = 4, 2.0
#: Every vector has one more component, of this weight, which no two share: scant evidence gives small cosines.
REST = 8.0
FOLDS, HELD_OUT = 4, 2
OTHER = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> str:
    return f" {OTHER.sub(' ', (text or '').lower()).strip()} "


def grams(text: str) -> set[str]:
    """n-grams with at most one space, which is at an end."""
    out: set[str] = set()
    for w in set(text.split()):
        w = f" {w} "
        for n in GRAMS:
            out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return out


def spans(ptr: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ids, place in what ``ptr`` divides) of all that the ids own."""
    n = ptr[ids + 1] - ptr[ids]
    who = np.repeat(np.arange(len(ids)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + ptr[ids][who]


@dataclass
class BlockMaxIndex:
    """Postings (row, weight) by feature, cut in blocks of neighbouring rows, with each block's greatest weight."""

    n_rows: int = 0
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    of_feature: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # blocks of postings by feature
    of_block: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # postings by block of postings
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], features: int) -> BlockMaxIndex:
        """The index of rows given as (features, weights)."""
        if not rows:
            return cls(of_feature=np.zeros(features + 1, np.int64))
        feature = np.concatenate([at for at, _ in rows]).astype(np.int64)
        row = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
        weight = np.concatenate([w for _, w in rows])
        order = np.lexsort((row, feature))
        feature, row, weight = feature[order], row[order], weight[order]
        block = row // BLOCK
        cuts = np.flatnonzero(np.r_[True, (feature[1:] != feature[:-1]) | (block[1:] != block[:-1])])
        return cls(len(rows), row.astype(np.int32), weight.astype(np.float32), np.searchsorted(feature[cuts], np.arange(features + 1)), np.r_[cuts, len(row)], block[cuts].astype(np.int32), np.maximum.reduceat(weight, cuts).astype(np.float32))

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, tie: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k greatest, ties by ``tie``."""
        term, part = spans(self.of_feature, at)
        n_blocks = -(-self.n_rows // BLOCK)
        bound = np.bincount(self.block[part], self.most[part] * w[term], n_blocks)
        order = np.argsort(-bound, kind="stable")
        who, sim, worst = np.zeros(0, np.int64), np.zeros(0), 0.0
        for v in range(0, n_blocks, VISIT):
            if bound[order[v]] <= 0 or (len(who) >= k and bound[order[v]] < worst - 1e-6):
                break
            visited = np.zeros(n_blocks, bool)
            visited[order[v : v + VISIT]] = True
            chosen = visited[self.block[part]]
            own, place = spans(self.of_block, part[chosen])
            score = np.bincount(self.row[place], self.weight[place] * w[term[chosen][own]], self.n_rows)
            rows = np.flatnonzero(score)
            rows = rows[rows != without]
            who, sim = np.r_[who, rows], np.r_[sim, score[rows]]
            best = np.lexsort((tie[who], -sim))[:k]
            who, sim = who[best], sim[best]
            worst = sim[-1] if len(sim) else 0.0
        return who, sim


@dataclass
class Model:
    features: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    y: np.ndarray = field(default_factory=lambda: np.zeros(0))
    index: BlockMaxIndex = field(default_factory=BlockMaxIndex)
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))
    empty_score: float = 0.0

    def ready(self) -> None:
        """The automaton, made once in each Python process."""
        if not hasattr(self, "machine"):
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for k, f in enumerate(self.features):
                self.machine.add_word(f, k)
            if self.features:
                self.machine.make_automaton()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "machine"}

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(features, weights): log-scaled counts by idf; the length has a share for all that isn't a feature."""
        if not self.features:
            return np.zeros(0, int), np.zeros(0)
        n = Counter(k for _, k in self.machine.iter(normal(text)))
        at = np.array(sorted(n), np.int64)
        w = np.array([1 + np.log(n[k]) for k in at.tolist()]) * self.idf[at]
        return at, w / np.sqrt((w * w).sum() + REST * REST)

    def nearest(self, at: np.ndarray, w: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.index.nearest(at, w, NEIGHBOURS, self.ids, without)

    def raw(self, at: np.ndarray, w: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        who, sim = self.nearest(at, w, without)
        if not len(who):
            return 0.0, who, sim
        weight = 1 / (1.05 - np.minimum(sim, 1))
        return float((weight * self.y[who]).sum() / weight.sum() * (0.5 + 0.5 * sim[0])), who, sim

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """(score, ids of the neighbours, cosines)."""
        at, w = self.vector(text)
        if not len(at) or not self.index.n_rows:
            return self.empty_score, [], []
        raw, who, sim = self.raw(at, w)
        return float(np.interp(raw, *self.steps)), self.ids[who].tolist(), sim.tolist()


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted non-decreasing fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([b * c, c, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    knots = [(x, s / n) for s, n, lo, hi in pools for x in ((lo, hi) if hi > lo else (lo,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def may_learn(id_col: str = "doc_id"):
    return bucket_of(id_col, FOLDS) != HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The examples' index. Only rows that ``may_learn`` names teach."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y")).where(may_learn(id_col))
    rates = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not rates:
        model = Model()
        model.ready()
        return model
    # a hash of the id picks about `examples` of each label; its result is that small, so it may be broadcast
    share = F.lit(0.0)
    for y, n in rates.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, examples / n))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64(F.lit("example"), id_col), F.lit(1 << 30)) < share * float(1 << 30))
    # an id of several rows is one example, with its least text
    sample = cut(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col, "y").agg(F.min(text_col).alias(text_col)))

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        n: dict[str, list[int]] = {}
        for text, y in rows:
            for g in grams(normal(text)):
                n.setdefault(g, [0, 0])[y] += 1
            if len(n) > HELD:
                yield from ((g, *ab) for g, ab in n.items())
                n.clear()
        yield from ((g, *ab) for g, ab in n.items())

    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    by = map_rows(sample, [text_col, "y"], count, "gram string, a long, b long", text_as_bytes=False).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("b") + 0.5) / (n1 + 1.0)) - F.log((F.col("a") + 0.5) / (n0 + 1.0))
    # as many as the bounded sample of label 1 has
    model = Model(features=sorted(r["gram"] for r in by.where((F.col("b") >= LEAST) & (odds >= ODDS)).select("gram").collect()))
    # document frequencies over every document that may be learnt from
    probe = Model(features=model.features)

    def frequency(rows: Iterator[tuple]) -> Iterator[tuple]:
        probe.ready()
        n: Counter = Counter()
        for (text,) in rows:
            n[-1] += 1
            if probe.features:
                n.update({k for _, k in probe.machine.iter(normal(text))})
        yield from n.items()

    learnt = docs.where(may_learn(id_col))
    df = {r["k"]: r["n"] for r in map_rows(learnt, [text_col], frequency, "k int, n long", text_as_bytes=False).groupBy("k").agg(F.sum("n").alias("n")).collect()}
    model.idf = np.array([np.log((1 + df.get(-1, 0)) / (1 + df.get(k, 0))) + 1 for k in range(len(model.features))])
    model.ready()

    def vectors(rows: Iterator[tuple]) -> Iterator[tuple]:
        model.ready()
        for doc_id, text, y in rows:
            at, w = model.vector(text)
            yield doc_id, y, at.tolist(), w.tolist()

    got = sorted((tuple(r) for r in map_rows(sample, [id_col, text_col, "y"], vectors, f"{id_col} long, y int, at array<int>, w array<float>", text_as_bytes=False).collect()), key=lambda r: (len(r[2]) == 0, r[2], r[0]))
    weight = {y: n / max(1, totals.get(y, 0)) for y, n in rates.items()}
    bare = [r for r in got if not r[2]]
    got = [r for r in got if r[2]]
    weighed = sum(weight[r[1]] for r in bare)
    model.empty_score = (sum(weight[r[1]] * r[1] for r in bare) + 0.01) / (weighed + 1) if bare else 0.0
    model.ids, model.y = np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], float)
    model.index = BlockMaxIndex.of([(np.array(r[2]), np.array(r[3])) for r in got], len(model.features))
    raws = np.array([model.raw(np.array(r[2]), np.array(r[3]), k)[0] for k, r in enumerate(got)])
    if len(got):
        model.steps = isotonic(raws, model.y, np.array([weight[r[1]] for r in got]))
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, evidence) for each row."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        model.ready()
        for doc_id, held, text in part:
            score, who, sim = model.score(text)
            yield doc_id, held, score, int(score >= CUT), who, sim

    spec = f"{id_col} long, held_out boolean, score double, predicted int, evidence array<long>, cosines array<float>"
    return map_rows(docs.select(id_col, (bucket_of(id_col, FOLDS) == HELD_OUT).alias("_held"), text_col), [id_col, "_held", text_col], rows, spec, text_as_bytes=False)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score below the cut, with all their columns."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.ready()
        for b in batches:
            yield b.filter(pa.array([model.score(t)[0] < CUT for t in values(b.column(at))], pa.bool_()))
        trim()

    return docs.mapInArrow(keep, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted", "evidence")
