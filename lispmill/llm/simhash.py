"""SimHash near-duplicates: 64-bit fingerprints linked at ``distance`` or fewer differing bits, exactly.

A fingerprint's bits are majority votes over the XXH64 hashes of a text's word shingles. Equal fingerprints
are one node. For the rest, the 64 bits are cut into ``distance + AGREE`` blocks: two fingerprints within the distance
agree on at least ``AGREE`` blocks, so each fingerprint goes to one cell for each choice of that many blocks,
keyed by their bits (15 cells of 21 or 22 bits at distance 4). No pair is missed.

In a cell the fingerprints are sorted by Gray rank and put in a hierarchical index: a leaf holds a run of
neighbours, each node above a run of nodes, and each node holds the bits that all below it share (a mask and
a pattern), less those that its parent already holds. A query walks from the top, adds up the differences
on the shared bits, and leaves a group as soon as the sum passes the distance, or when the whole group is
already in the query's component. Links found are merged in a union-find, and a cell hands on one edge per
member, never its pairs. Cells above ``CELL`` members are split: each member gets a part by hash, and each
pair of parts is one task's work, so no cell is gathered in one task.

Components come from the alternating large-star and small-star steps, as joins and aggregates, with a
checkpoint a round. Nothing of the size of the corpus reaches the driver.

Null and empty texts have fingerprint 0 and link like others. Rows with a null id have a fingerprint and, as
component, the smallest id there is in it, or null. Repeated rows give a row each. An empty table gives an
empty result; only the id and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lispmill.llm.common import cut, map_rows, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE, SEED, DISTANCE, AGREE = 4, 42, 4, 2
#: The most members of a cell that one task works on at once.
CELL = 2048
#: The most edges whose components one task finds.
ONE_TASK = 1 << 19
LEAF, FAN, QUERIES = 16, 8, 256
#: The most rows that a join broadcasts (a bound of some 32 MB, whatever the corpus).
BROADCAST = 1 << 20


def majority(hashes: Iterator[np.ndarray]) -> int:
    """Bit b is 1 if it is set in over half the hashes, which come in blocks; without any 0."""
    votes, n = np.zeros(64, np.int64), 0
    for h in hashes:
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The majority of the hashes of the text's shingles, repeats included."""
    words = WORD.findall((text or b"").lower())
    n = max(1, len(words) - shingle + 1) if words else 0
    return majority(np.array([xxhash.xxh64_intdigest(b" ".join(words[j : j + shingle]), SEED) for j in range(i, min(n, i + (1 << 15)))], "<u8") for i in range(0, n, 1 << 15))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in part:
            yield doc_id, signed(fingerprint(text, shingle))

    return map_rows(docs, [id_col, text_col], rows, f"{id_col} long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints in Gray order, with levels of nodes that hold the bits all members below share."""

    def __init__(self, fps: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []  # top first: mask, pattern, members below a node
        ones, zeros, width, step = self.fps, ~self.fps, LEAF, LEAF
        while True:
            cuts = np.arange(0, len(ones), step)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            self.levels.insert(0, (ones | zeros, ones, width))
            if len(cuts) == 1:
                break
            step, width = FAN, width * FAN
        # what a parent's mask holds is factored out of its children's
        shared = [mask for mask, _, _ in self.levels]
        for k in range(1, len(shared)):
            own = shared[k] & ~np.repeat(shared[k - 1], FAN)[: len(shared[k])]
            self.levels[k] = (own, self.levels[k][1] & own, self.levels[k][2])

    def near(self, labels: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) places in Gray order within the distance; of pairs, only those not yet labelled alike."""
        n = len(self.fps)
        for start in range(0, n, QUERIES):
            q = np.arange(start, min(n, start + QUERIES))
            first = np.zeros(len(q), np.int64)
            node, who, sums = first, q, first
            for k, (mask, pattern, width) in enumerate(self.levels):
                if k:
                    children = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    who, sums = np.repeat(who, FAN), np.repeat(sums, FAN)
                    ok = children < len(mask)
                    node, who, sums = children[ok], who[ok], sums[ok]
                sums = sums + np.bitwise_count((self.fps[who] ^ pattern[node]) & mask[node])
                # a pair is looked for from its later member, so groups wholly behind the query are enough
                ok = (sums <= distance) & (node * width < who)
                if n > QUERIES:
                    cuts = np.arange(0, n, width)
                    low, high = np.minimum.reduceat(labels, cuts), np.maximum.reduceat(labels, cuts)
                    ok &= ~((low[node] == high[node]) & (low[node] == labels[who]))
                node, who, sums = node[ok], who[ok], sums[ok]
            member = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            who = np.repeat(who, LEAF)
            ok = member < who
            member, who = member[ok], who[ok]
            ok = np.bitwise_count(self.fps[who] ^ self.fps[member]) <= distance
            yield who[ok], member[ok]


def link(fps: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each fingerprint the least place (by unsigned value) of its component among the given ones."""
    index = GrayIndex(fps)
    n = len(fps)
    labels = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    parent: dict[int, int] = {}
    for who, member in index.near(labels, distance):
        pairs = np.unique(np.stack([labels[who], labels[member]], 1), axis=0) if len(who) else np.empty((0, 2), int)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if not len(pairs):
            continue
        parent.clear()
        for x in np.unique(pairs).tolist():
            parent[x] = x
        for a, b in pairs.tolist():
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        to = np.arange(n)
        for x in list(parent):
            to[x] = find(x)
        labels[:] = to[labels]
    out = np.empty(n, np.int64)
    out[index.order] = labels
    # a component's root: its member with the least value
    best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(best, out, fps)
    return best[out]


def nearest(fps: np.ndarray, distance: int, partners: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, partner): for each one up to ``partners`` of those within the distance that stand before it in Gray
    order, the least different ones first."""
    index = GrayIndex(fps)
    out_a, out_b = [], []
    for who, member in index.near(np.arange(len(fps)), distance):
        differ = np.bitwise_count(index.fps[who] ^ index.fps[member])
        order = np.lexsort((-member, differ, who))
        who, member = who[order], member[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        out_a.append(index.fps[who[place < partners]])
        out_b.append(index.fps[member[place < partners]])
    return np.concatenate(out_a), np.concatenate(out_b)


def _cells(fps: DataFrame, distance: int) -> DataFrame:
    """(cell, fp) for each choice of blocks that two near fingerprints must agree on."""
    blocks = distance + AGREE
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), AGREE)):
        mask = sum(block[i] for i in chosen)
        keys.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(mask)))))
    return fps.select(F.explode(F.array(*keys)).alias("cell"), "fp")


def _link_cells(batches: Iterator[pa.RecordBatch], distance: int, partners: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the cells of a partition, which is sorted by cell; one cell is held at a time. Without ``partners``
    they join each member with its component's root, else with so many of its nearest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def edges(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
        sizes = np.diff(np.r_[starts, len(key)])
        out_a, out_b = [], []
        two = starts[sizes == 2]  # an index of one leaf with two members is one comparison, done for all such cells at once
        if len(two):
            a, b = fp[two], fp[two + 1]
            ok = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
            out_a.append(a[ok]), out_b.append(b[ok])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = fp[s : s + n]
            if partners:
                a, b = nearest(own.view(np.uint64), distance, partners)
            else:
                a, b = own, link(own.view(np.uint64), distance)
            a, b = a.view(np.int64), b.view(np.int64)
            ok = a != b
            if ok.any():
                out_a.append(a[ok]), out_b.append(b[ok])
        if out_a and sum(map(len, out_a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], schema=schema)

    for batch in batches:
        key = np.concatenate([rest_key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))  # the last cell may go on in the next batch
        yield from edges(key[:last], fp[:last])
        rest_key, rest_fp = key[last:], fp[last:]
    yield from edges(rest_key, rest_fp)


def links(fps: DataFrame, distance: int = DISTANCE, partners: int = 0) -> DataFrame:
    """Edges (a, b) among distinct fingerprints that join exactly those within the distance, transitively; with ``partners``
    each one and so many of its nearest in each cell."""
    cells = _cells(fps, distance)
    sizes = cells.groupBy("cell").count().where(F.col("count") > CELL)
    large = cut(sizes.select("cell", F.ceil(F.col("count") / (CELL // 2)).cast("int").alias("parts")))
    part = lambda x: F.pmod(F.xxhash64(F.lit("part"), x), F.col("parts")).cast("int")
    small = cells
    split = None
    if not large.isEmpty():
        # each member of a large cell goes to every pair of parts that has its own
        own = cells.join(large, "cell").withColumn("own", part(F.col("fp")))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        split = own.select(F.col("cell"), "fp", "own", other.alias("other")).select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
        small = cells.join(large.select("cell"), "cell", "left_anti")
    todo = small if split is None else small.unionByName(split)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = todo.repartition(n, "cell").sortWithinPartitions("cell")
    found = dealt.mapInArrow(lambda b: _link_cells(b, distance, partners), "a long, b long")
    if partners:
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # a member's edges from several cells meet, and those that close a circle go
    return found.repartition(n, "a").mapInArrow(_forest, "a long, b long")


def forest_of(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[dict[int, int], Iterator[np.ndarray]]:
    """A union-find over blocks of pairs, and for each block which of its pairs join two trees."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def joins() -> Iterator[np.ndarray]:
        for a_s, b_s in pairs:
            keep = np.zeros(len(a_s), bool)
            for k, (a, b) in enumerate(zip(a_s.tolist(), b_s.tolist(), strict=True)):
                a, b = find(a), find(b)
                if a != b:
                    keep[k] = True
                    parent[max(a, b)] = min(a, b)
            yield keep

    return parent, joins()


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        yield b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges, a spanning forest: at most one edge less than it has nodes."""
    held = []

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            held.append(b)
            yield from _columns(iter([b]))

    _, joins = forest_of(pairs())
    for keep in joins:
        yield held.pop().filter(pa.array(keep))


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes that aren't their component's least."""
    parent, joins = forest_of(_columns(batches))
    for _ in joins:
        pass
    nodes, roots = np.array(sorted(parent), np.int64), []
    for x in nodes.tolist():
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        roots.append(x)
    roots = np.array(roots, np.int64)
    ok = nodes != roots
    if ok.any():
        yield pa.RecordBatch.from_arrays([pa.array(nodes[ok]), pa.array(roots[ok])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes that have an edge and aren't that node.

    Up to ``ONE_TASK`` edges (a bound in bytes, whatever the corpus) are one union-find; beyond it, stars are contracted."""
    edges = cut(edges)
    if edges.count() <= ONE_TASK:
        return cut(edges.coalesce(1).mapInArrow(_rooted, "node long, root long"))
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        # large star: all neighbours above a node go to the least of its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the least ones are cut so that a join's side of many edges of one hub is a plain exchange, which skew handling splits
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        e1 = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: a node and its neighbours below go to the least of these
        least = cut(e1.groupBy("u").agg(F.min("v").alias("m")))
        moved = e1.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(moved.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return cut(e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"))
        seen = now


def _grouped(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, least): the smallest ``key`` that links reach from a fingerprint, for (key, fp) rows."""
    nodes = cut(rows.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(links(nodes.select("fp"), distance))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ends = roots.select("node").unionByName(roots.select(F.col("root").alias("node"))).distinct()
    linked = joined.join(ends, joined["fp"] == ends["node"], "left_semi")
    best = linked.groupBy("root").agg(F.min("least").alias("best"))
    # only fingerprints with an edge need more than their own least key
    return joined.join(best, "root", "left").select("fp", F.coalesce("best", "least").alias("least"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): the smallest id that links reach, for each row."""
    rows = cut(fingerprints(docs, shingle, id_col, text_col))
    of = _grouped(rows.select(F.col(id_col).alias("key"), "fp"), distance).withColumnRenamed("least", "component_id")
    return rows.join(of, "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest id (null last), then of the smallest
    hash of its text; of rows alike in both, one."""
    keyed, key = with_key(docs, text_col)

    def prints(part: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, k, text in part:
            yield doc_id, k, signed(fingerprint(text, shingle))

    rows = cut(map_rows(keyed, [id_col, key, text_col], prints, "id long, k long, fp long"))
    return keep_least(keyed, key, rows, _grouped(rows.select(own_key().alias("key"), "fp"), distance).select("least").distinct(), id_col).select(*docs.columns)


def with_key(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """The rows with a hash of their text, and that column's name, which no other has."""
    key = "_key_" + "_".join(docs.columns)
    return docs.withColumn(key, F.xxhash64(F.lit("row"), text_col)), key


def own_key():
    """Of (id, k): what orders the rows of a group."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("k").alias("k"))


def keep_least(keyed: DataFrame, key: str, rows: DataFrame, least: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``keyed`` that ``least`` names, one each; ``rows`` has all (id, k)."""
    kept = least.select(F.col("least.id").alias("_kept_id"), F.col("least.k").alias("_kept_key"))
    # the rows that go are fewer than those that stay, so texts are dealt only if even they are too many to broadcast
    gone = cut(rows.join(kept, rows["id"].eqNullSafe(kept["_kept_id"]) & (rows["k"] == kept["_kept_key"]), "left_anti").select(F.col("id").alias("_gone_id"), F.col("k").alias("_gone_key")))
    few = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    stay = keyed.join(few, keyed[id_col].eqNullSafe(few["_gone_id"]) & (keyed[key] == few["_gone_key"]), "left_anti")
    if rows.groupBy("id", "k").count().where("count > 1").isEmpty():
        return stay
    return stay.dropDuplicates([id_col, key])


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
