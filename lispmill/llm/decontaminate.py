"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Passages are windows of ``2 * width`` words, ``width`` apart, so an item of at most ``width`` words that
occurs in a document lies wholly in one of them. Items of very different lengths get indexes of their own,
with widths in steps of four. A passage's score for an item is the BM25 sum over the distinct words they
share, divided by the item's own sum: 1 if the passage has all its words. All items at or above the
``threshold`` are retrieved. BM25's number of items, document frequencies and mean length are those of all
items, however they are dealt to indexes.

Retrieval is block-max WAND with many passages at once: items of similar words stand in blocks of ``BLOCK``, and
blocks in groups of ``GROUP`` blocks; each word keeps its greatest weight in each block and in each group. A
passage's sum of a group's maxima bounds its score for every item there. Only groups whose bound reaches the
threshold are opened, of their blocks only those whose own bound does, and only these blocks' postings are
read; the rest is skipped, so nothing above the threshold is missed.

A retrieved item is verified on the passage's words. Its question overlaps by the share of its words that the
passage has in their order (longest common subsequence), its answer by the share of its words, repeats included.
It is a leak if the question's overlap reaches ``overlap`` and the answer's does, or if the question alone does and has
``ALONE`` words or more. The answer is the item's last quarter (three words at least) unless the table has
columns for both.

Texts are worked on in blocks of ``BATCH_WORDS`` words, so memory is bounded for texts of any length. The index goes
to every task. It is made from slices of the items of at most ``SLICE_BYTES``; a slice is one more pass over
the documents. Null and empty texts, and items without words, match nothing. Items that are alike are all
reported. Repeated documents give their rows again. Empty tables give an empty result, and ``drop_leaks`` keeps
all columns, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lispmill.llm.common import cut, map_rows, table, trim, values

WORD, NO_WORD = re.compile(r"[^\W_]+"), re.compile(r"[\W_]")
K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, ALONE = 0.6, 0.8, 8
BLOCK, GROUP, LEAST_WIDTH, BATCH_WORDS = 8, 8, 64, 1 << 15
SLICE_BYTES = 8 << 20
#: Bounds that are held and words that are looked up at once, and characters of a long text that are split into words at once.
CELLS, LOOKUPS, SEGMENT = 1 << 21, 1 << 16, 1 << 20


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_blocks(text: str | None, size: int, ahead: int) -> Iterator[tuple[int, list[str], int]]:
    """(first word, words, own words): the text's words in blocks of ``size``, each with up to ``ahead`` words of the next."""
    low, at, first, held = (text or "").lower(), 0, 0, []
    while at < len(low):
        end = at + SEGMENT
        if end < len(low):  # a cut falls between words
            gap = NO_WORD.search(low, end)
            end = gap.start() if gap else len(low)
        held += WORD.findall(low, at, end)
        at = end
        while len(held) >= size + ahead:
            yield first, held[: size + ahead], size
            held, first = held[size:], first + size
    while held:
        yield first, held[: size + ahead], min(size, len(held))
        held, first = held[size:], first + size


def common_in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with a bit for each word of ``a``."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Item:
    def __init__(self, item_id: int, text: str | None, question: str | None = None, answer: str | None = None) -> None:
        self.id = item_id
        if question is not None or answer is not None:
            self.question, reply = words(question), words(answer)
        else:
            ws = words(text)
            n = min(len(ws), max(3, len(ws) // 4))
            self.question, reply = ws[: len(ws) - n], ws[len(ws) - n :]
        self.words = self.question + reply
        self.answer = Counter(reply)
        self.n_answer = len(reply)

    def overlap(self, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's words in order and of the answer's words that the passage has (1 for none to have)."""
        q = common_in_order(self.question, passage) / len(self.question) if self.question else 1.0
        a = sum((self.answer & Counter(passage)).values()) / self.n_answer if self.n_answer else 1.0
        return q, a

    def leaks(self, q: float, a: float, overlap: float) -> bool:
        return q >= overlap and (a >= overlap or len(self.question) >= ALONE)


class Statistics:
    """Of all items: their number, mean length, and how many have a word."""

    def __init__(self, n: int, mean: float, df: dict[str, int]) -> None:
        self.n, self.mean, self.df = n, mean, df

    @classmethod
    def of(cls, items: list[Item]) -> Statistics:
        known = [i for i in items if i.words]
        return cls(len(known), sum(len(i.words) for i in known) / max(1, len(known)), Counter(w for i in known for w in set(i.words)))

    def weights(self, item: Item) -> dict[str, float]:
        """An item's BM25 weights, as shares of their sum."""
        long = K1 * (1 - B + B * len(item.words) / self.mean)
        w = {t: math.log1p((self.n - self.df[t] + 0.5) / (self.df[t] + 0.5)) * n * (K1 + 1) / (n + long) for t, n in Counter(item.words).items()}
        own = sum(w.values())
        return {t: x / own for t, x in w.items()}


class Level:
    """For each word the nodes (groups, blocks or items) that have it, in order, with the greatest weight there."""

    def __init__(self, term: np.ndarray, node: np.ndarray, weight: np.ndarray, n_terms: int) -> None:
        self.n = int(node.max()) + 1
        code = term * self.n + node
        cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        self.code, self.weight = code[cuts], np.maximum.reduceat(weight, cuts)
        self.node = self.code % self.n
        self.ptr = np.searchsorted(self.code, np.arange(n_terms + 1) * self.n)

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in terms, place in the postings) of all postings of the terms."""
        n = self.ptr[terms + 1] - self.ptr[terms]
        who = np.repeat(np.arange(len(terms)), n)
        return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + self.ptr[terms][who]

    def within(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the postings of nodes from low to high (exclusive) only, which are found without reading others."""
        a, b = np.searchsorted(self.code, terms * self.n + np.minimum(low, self.n)), np.searchsorted(self.code, terms * self.n + np.minimum(high, self.n))
        n = b - a
        who = np.repeat(np.arange(len(terms)), n)
        return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + a[who]


class BlockMaxIndex:
    """BM25 weights of items of one range of lengths, and the maxima of their blocks and groups of blocks."""

    def __init__(self, items: list[Item], width: int, statistics: Statistics) -> None:
        df = statistics.df
        self.width = width
        # neighbours share their commonest words, so that blocks have few different words
        self.items = items = sorted(items, key=lambda i: (sorted(set(i.words), key=lambda w: (-df[w], w))[:3], i.id is None, i.id))
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for i in items for w in i.words}))}
        rows = [(self.vocabulary[t], k, x) for k, item in enumerate(items) for t, x in statistics.weights(item).items()]
        term, item, weight = (np.array(x) for x in zip(*sorted(rows), strict=True))
        self.levels = [Level(term, item // size, weight, len(self.vocabulary)) for size in (BLOCK * GROUP, BLOCK, 1)]

    def retrieve(self, texts: list[tuple[list[str], int]], threshold: float) -> Iterator[tuple[int, int, Item, float]]:
        """(text, first word of the passage, item, score) of all passages and items at or above the threshold, for (words, own
        words): passages begin at own words."""
        size = len(self.vocabulary)
        tiles = [-(-len(t) // self.width) for t, _ in texts]
        own_tiles = np.array([-(-n // self.width) for _, n in texts], np.int64)
        first = np.cumsum([0, *tiles])[:-1]
        text = np.repeat(np.arange(len(texts)), tiles)
        ids = np.fromiter(map(self.vocabulary.get, chain.from_iterable(t for t, _ in texts), repeat(-1)), np.int64)
        tile = np.concatenate([np.arange(len(t)) // self.width + f for (t, _), f in zip(texts, first, strict=True)]) if texts else np.empty(0, np.int64)
        ids, tile = ids[ids >= 0], tile[ids >= 0]
        if not len(ids):
            return
        # a passage is a tile and the next one of the text; words that it repeats count once
        again = np.r_[False, text[1:] == text[:-1]][tile]
        code = np.unique(np.r_[tile * size + ids, (tile[again] - 1) * size + ids[again]])
        code = code[(code // size - first[text[code // size]]) < own_tiles[text[code // size]]]
        passage, term = code // size, code % size
        step = max(1, CELLS // self.levels[0].n)
        for low in range(0, len(text), step):
            a, b = np.searchsorted(passage, [low, low + step])
            if a < b:
                for p, k, score in self._match(passage[a:b] - low, term[a:b], min(step, len(text) - low), threshold - 1e-9):
                    p += low
                    yield int(text[p]), int(p - first[text[p]]) * self.width, self.items[k], score

    def _match(self, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> Iterator[tuple[int, int, float]]:
        groups, blocks, items = self.levels
        who, at = groups.of(term)
        bound = np.bincount(passage[who] * groups.n + groups.node[at], groups.weight[at], n * groups.n)
        open_ = np.flatnonzero(bound >= threshold)
        edges = np.searchsorted(passage, np.arange(n + 1))
        count = np.diff(edges)
        part = np.cumsum(count[open_ // groups.n]) // LOOKUPS
        for k in np.unique(part).tolist():
            now = open_[part == k]
            p, node, fan = now // groups.n, now % groups.n, GROUP
            for level in (blocks, items):
                # the words of each open passage, looked up in the open node's children
                own = count[p]
                of = np.repeat(np.arange(len(p)), own)
                terms = term[np.arange(len(of)) - np.repeat(np.cumsum(own) - own, own) + edges[p][of]]
                who, at = level.within(terms, node[of] * fan, (node[of] + 1) * fan)
                child = level.node[at] - node[of[who]] * fan
                score = np.bincount(of[who] * fan + child, level.weight[at], len(p) * fan)
                ok = np.flatnonzero(score >= threshold)
                p, node, fan = p[ok // fan], node[ok // fan] * fan + ok % fan, BLOCK
            yield from zip(p.tolist(), node.tolist(), score[ok].tolist(), strict=True)


def indexes(items: list[Item], statistics: Statistics | None = None) -> list[BlockMaxIndex]:
    statistics = statistics or Statistics.of(items)
    by: dict[int, list[Item]] = {}
    for i in items:
        if i.words:
            width = LEAST_WIDTH
            while width < len(i.words):
                width *= 4
            by.setdefault(width, []).append(i)
    return [BlockMaxIndex(v, w, statistics) for w, v in sorted(by.items())]


def leaks(texts: Iterator[str | None], parts: list[BlockMaxIndex], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Iterator[tuple[int, list[tuple[int | None, float, float, float, int, int]]]]:
    """(text, [(item id, score, question overlap, answer overlap, first word, passages)]) of each text in turn, with the best
    passage of each item. Blocks of several texts are matched at once; a text's result comes when its last block is done."""
    widest = max((i.width for i in parts), default=LEAST_WIDTH)
    size = -(-BATCH_WORDS // widest) * widest
    held: list[tuple[int, int, list[str], int]] = []
    best: dict[int, dict[int, tuple]] = {}

    def match() -> None:
        for index in parts:
            for k, start, item, score in index.retrieve([(ws, n) for _, _, ws, n in held], threshold):
                text, first, ws, _ = held[k]
                q, a = item.overlap(ws[start : start + 2 * index.width])
                if item.leaks(q, a, overlap):
                    own = best.setdefault(text, {})
                    old = own.get(id(item))
                    new = (min(q, a), score, -first - start, q, a, item.id)
                    own[id(item)] = (*max(new, old[:-1] if old else new, key=lambda x: x[:3]), old[-1] + 1 if old else 1)
        held.clear()

    def result(text: int) -> tuple[int, list[tuple]]:
        return text, [(item_id, score, q, a, -start, n) for _, score, start, q, a, item_id, n in best.pop(text, {}).values()]

    done, n_words, k = 0, 0, -1
    for k, t in enumerate(texts):
        for first, ws, n in word_blocks(t, size, widest):
            held.append((k, first, ws, n))
            n_words += len(ws)
            if n_words >= BATCH_WORDS:
                match()
                n_words = 0
        if not held:
            while done <= k:
                yield result(done)
                done += 1
    match()
    while done <= k:
        yield result(done)
        done += 1


def item_slices(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", question_col: str | None = None, answer_col: str | None = None) -> Iterator[list[BlockMaxIndex]]:
    """Indexes of the items, a bounded slice at a time, all with the statistics of all items."""
    cols = [c for c in (text_col if question_col is None else None, question_col, answer_col) if c]
    make = lambda r: Item(r[0], r[1]) if question_col is None else Item(r[0], None, r[1], r[2] if answer_col else None)
    size = benchmark.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in cols), F.lit(0)))).first()[0] or 0
    n = 1 + int(size) // SLICE_BYTES
    slices = [benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64(*[F.col(c) for c in (id_col, *cols)]), F.lit(n)) == k) for k in range(n)]
    counted = None

    def count(part: Iterator[tuple]) -> Iterator[tuple]:
        for r in part:
            if ws := make(r).words:
                yield None, 1, len(ws)
                for w in set(ws):
                    yield w, 1, 0

    if n > 1:
        counted = cut(map_rows(benchmark, [id_col, *cols], count, "word string, n long, long long", text_as_bytes=False).groupBy("word").agg(F.sum("n").alias("n"), F.sum("long").alias("long")))
    for part in slices:
        items = [make(r) for r in part.select(id_col, *cols).collect()]
        if counted is None:
            statistics = Statistics.of(items)
        else:
            total = counted.where("word is null").first()
            own = map_rows(part, [id_col, *cols], count, "word string, n long, long long", text_as_bytes=False).select("word").distinct()
            df = {r["word"]: r["n"] for r in counted.join(own, "word", "left_semi").select("word", "n").collect()}
            statistics = Statistics(total["n"] if total else 0, total["long"] / total["n"] if total else 0.0, df)
        yield indexes(items, statistics)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and item that it holds."""
    spec = f"{id_col} long, {item_col} long, score double, question_overlap double, answer_overlap double, first_word long, passages long"
    out = None
    for parts in item_slices(benchmark, item_col, item_text_col):

        def rows(part: Iterator[tuple], parts: list[BlockMaxIndex] = parts) -> Iterator[tuple]:
            ids: list = []  # of the texts whose results are not out yet
            done = 0

            def texts() -> Iterator[str | None]:
                for doc_id, text in part:
                    ids.append(doc_id)
                    yield text

            for k, found in leaks(texts(), parts, threshold, overlap):
                for row in found:
                    yield (ids[k - done], *row)
                if k - done >= 4096:
                    del ids[: k - done + 1]
                    done = k + 1

        found = map_rows(docs, [id_col, text_col], rows, spec, text_as_bytes=False)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    at = docs.columns.index(text_col)
    for parts in item_slices(benchmark, item_col, item_text_col):

        def keep(batches: Iterator[pa.RecordBatch], parts: list[BlockMaxIndex] = parts) -> Iterator[pa.RecordBatch]:
            for b in batches:
                mask = [not found for _, found in leaks(values(b.column(at)), parts, threshold, overlap)]
                yield b.filter(pa.array(mask, pa.bool_()))
            trim()

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
