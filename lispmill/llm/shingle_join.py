"""Near-duplicates by Jaccard similarity of word shingles: SimHash candidates, verified, and an exact join for the rest.

A text's set holds the hashes of its word shingles (a shorter text is one shingle). Equal sets are one node, known by
the hash of the set. The method is ``simhash``'s: a set's fingerprint is the majority of its hashes, the Gray-order
index names each fingerprint's nearest partners within the distance, and a link is what the whole sets confirm.

64 bits cannot tell 0.79 from 0.81, so an exact prefix-filter self-join finds the links that are left, between nodes
that stand in different components so far. Shingles are ordered by how often a count sketch of fixed size has seen their
bucket, rarest first, with ties by the hash. Of two sets of similarity ``least`` or more, the first shared shingle under
any such order is among the first ``n - ceil(least * n) + 1`` of both, so each set goes to the cells of these shingles
only. A pair of a cell is a candidate if its sizes allow the similarity and if enough shingles are left behind the two
places. In rounds each member of a cell is tried with its neighbours by size, first few, then more; a round reads the cells
where they lie, and no pair is verified twice. Cells so small that a round has tried all their pairs are done with. Of the
rest the last two rounds take those of several components and hold what differs from its cell's commonest component against
the whole cell, block by block inside tasks. A set's sketch has the parity of its hashes in some buckets, and two sets differ
in no fewer hashes than their sketches in buckets, so what a sketch rules out is not similar and never becomes a row. The
first of these rounds names each member's closest ones only, which joins most of them; the second names all that are left
between different components, so no pair at or above ``least`` stays unlinked.

Nothing of the size of the corpus reaches the driver. Null and empty texts have the empty set and are alike. Rows of a
null id are told apart by their texts. Repeated rows are one. Empty tables give empty results; columns of any name are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lispmill.llm.common import cut, map_rows, trim
from lispmill.llm.simhash import BROADCAST, DISTANCE, SEED, WORD, components, keep_least, links, majority, own_key, signed, with_key

#: Buckets of the sketch, and of a row of it.
BUCKETS, ROW = 1 << 18, 1 << 12
#: Partners that the fingerprint index names for each of a cell, and neighbours by size in the rounds of the exact join.
PARTNERS, NEIGHBOURS = 2, (3, 24)
#: Neighbours by size with which a member of a cell is compared before it counts as one that fits another.
TRIED = 64
#: Of the last rounds: closest ones of a block that a member is tried with before all, the rows of a block, and the bits of a sketch.
CLOSEST, BLOCK, WIDTHS = 3, 256, (512, 1 << 16)
#: Words whose hashes a task remembers, and sets that it remembers having seen.
KNOWN = 1 << 16

_hashes: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles: the words' XXH64 hashes, mixed in their order."""
    words = WORD.findall((text or b"").lower())
    if not words:
        return np.empty(0, np.uint64)
    if len(_hashes) > KNOWN:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = _mixed(out + h[j : j + n])
    return np.unique(out)


def _done() -> None:
    """A task's words are forgotten with it."""
    _hashes.clear()
    trim()


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _first_pass(keyed: DataFrame, columns: list[str], shingle: int) -> tuple[DataFrame, np.ndarray]:
    """(id, k, sig, fp) of the rows, and how many of their sets have a shingle of each bucket (a result of fixed size)."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        seen = np.zeros(BUCKETS, np.int64)
        for doc_id, k, text in part:
            h = shingle_set(text, shingle)
            seen += np.bincount(bucket(h), minlength=BUCKETS) if len(h) > ROW else 0
            if len(h) <= ROW:
                np.add.at(seen, bucket(h), 1)
            yield doc_id, k, signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)), signed(majority(iter([h]))), None, None
        for r in range(0, BUCKETS, ROW):
            if seen[r : r + ROW].any():
                yield None, None, None, None, r // ROW, seen[r : r + ROW].tobytes()
        _done()

    def total(part: Iterator[tuple]) -> Iterator[tuple]:
        sums: dict[int, np.ndarray] = {}
        for r, n in part:
            sums[r] = sums.get(r, 0) + np.frombuffer(n, np.int64)
        for r, n in sums.items():
            yield r, n.tobytes()

    made = cut(map_rows(keyed, columns, rows, "id long, k long, sig long, fp long, r int, n binary"))
    counts = np.zeros(BUCKETS, np.int64)
    by_row = made.where("r is not null").select("r", "n").repartition(BUCKETS // ROW, "r")
    for x in map_rows(by_row, ["r", "n"], total, "r int, n binary").collect():
        counts[x["r"] * ROW : (x["r"] + 1) * ROW] = np.frombuffer(x["n"], np.int64)
    return made.where("r is null").select("id", "k", "sig", "fp"), counts


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


def _shared(keyed: DataFrame, text_col: str, shingle: int, least: float, counts: np.ndarray) -> DataFrame:
    """(cell, sig, n, at, m): the prefixes of all sets, without most members that fit no other one of their cell. A cell's rows
    lie together in one partition, by size and set; m is how many they are, and above ``TRIED`` says that they are more."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # most copies go before the shuffle, so a cell gets a set about once from each task
        for b in batches:
            for s in range(0, b.num_rows, 256):
                cols: list[list[np.ndarray]] = [[], [], [], []]
                for text in b.column(0)[s : s + 256]:
                    text = text.as_py()
                    x = shingle_set(text.encode() if isinstance(text, str) else text, shingle)
                    sig = signed(xxhash.xxh64_intdigest(x.tobytes(), SEED))
                    if sig in seen:
                        continue
                    if len(seen) >= KNOWN:
                        seen.clear()
                    seen.add(sig)
                    keep = len(x) - math.ceil(least * len(x) - 1e-6) + 1 if len(x) else 0
                    first = x[np.lexsort((x, counts[bucket(x)]))[:keep]]
                    for c, v in zip(cols, (first.view(np.int64), np.full(keep, sig), np.full(keep, len(x)), np.arange(keep)), strict=True):
                        c.append(v.astype(np.int64))
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["cell", "sig", "n", "at"])
        _done()

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition sorted by cell, size and set: the rows that fit another one of their cell, and all of cells above
        ``TRIED``, with how many these are. The rows of a batch's last cell wait for the next batch, ``TRIED`` of them at most."""
        rest, large = [np.empty(0, np.int64)] * 4, False

        def part(cols: list[np.ndarray], ends: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, large
            fresh = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
            cell, sig, n, at = cols = [c[fresh] for c in cols]
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            big = sizes > TRIED
            big[0] |= large
            keep = np.repeat(big, sizes)
            for d in range(1, min(TRIED, int(sizes[~big].max(initial=1)) - 1) + 1):
                j = np.flatnonzero(cell[d:] == cell[:-d]) + d
                j = j[~(keep[j] & keep[j - d])]
                j = j[fits(n, at, j - d, j, least)]
                keep[j] = keep[j - d] = True
            out = len(cell) if ends else max(starts[-1], len(cell) - TRIED)
            large = bool(big[-1]) and not ends
            ok = keep[:out]
            ok[starts[-1] :] = big[-1] if not ends else ok[starts[-1] :]
            if ok.any():
                m = np.repeat(np.where(big, TRIED + 1, np.add.reduceat(keep.astype(np.int64), starts)), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(c[:out][ok]) for c in (*cols, m)], names=["cell", "sig", "n", "at", "m"])
            rest = [c[out:] for c in cols]

        for b in batches:
            if b.num_rows:
                yield from part([np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, b.columns, strict=True)], False)
        if len(rest[0]):
            yield from part(rest, True)

    spec = "cell long, sig long, n long, at long"
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = keyed.select(text_col).mapInArrow(postings, spec)
    return cut(made.repartition(n, "cell").sortWithinPartitions("cell", "n", "sig").mapInArrow(several, f"{spec}, m long"))


def fits(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n shingles that share those at the places ``at`` can be as similar as ``least``."""
    need = (n[i] + n[j]) * (least / (1 + least)) - 1e-6
    return (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-6) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need)


def _labelled(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``shared`` with the label of each set's component so far; cells stay where they lie, or are dealt again if the labels are too
    many to broadcast."""
    n = roots.count()
    out = shared.join(_small(roots, n), shared["sig"] == roots["node"], "left").select("cell", "sig", "n", "at", "m", F.coalesce("root", "sig").alias("label"))
    if n <= BROADCAST:
        return out
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, "cell").sortWithinPartitions("cell", "n", "sig")


def _untried(labelled: DataFrame, most: int) -> DataFrame:
    """The rows of cells that have more pairs than those of a member with the next ``most``."""
    return labelled.where((F.col("m") > most + 1) | (F.col("m") > TRIED))


def _neighbours(labelled: DataFrame, past: int, most: int, least: float) -> DataFrame:
    """Candidates (a, b) of (cell, sig, n, at, label), whose cells lie together: each member with those of its cell that come
    behind the next ``past`` and among the next ``most`` by size, if of another label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None  # the last rows of the batch before
        for b in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            old = 0 if rest is None else len(rest[0])
            cols = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            cell, sig, n, at, label = cols
            for d in range(past + 1, min(most, len(cell) - 1) + 1):
                j = np.arange(max(d, old), len(cell))
                i = j - d
                ok = (cell[i] == cell[j]) & (label[i] != label[j])
                i, j = i[ok], j[ok]
                ok = fits(n, at, i, j, least)
                if ok.any():
                    x, y = sig[i[ok]], sig[j[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            rest = [c[-most:] for c in cols]

    return labelled.select("cell", "sig", "n", "at", "label").mapInArrow(run, "a long, b long").distinct()


def sketch(hashes: np.ndarray) -> bytes:
    """Which of some buckets hold an odd number of the hashes: 4 to 8 bits for each of them, within ``WIDTHS``."""
    bits = min(max(1 << (4 * len(hashes) - 1).bit_length(), WIDTHS[0]), WIDTHS[1])
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of one length as words, folded to ``width`` bytes: what they would be with fewer buckets."""
    m = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    return m if m.shape[1] * 8 == width else m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]


def _mixed_cells(labelled: DataFrame) -> DataFrame:
    """The rows of cells with several labels, cut, with ``odd`` (not of the cell's commonest label), and how many rows it has (``rows``)
    and how many odd ones (``odds``)."""
    mixed = labelled.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("cell")
    live = cut(labelled.join(mixed, "cell", "left_semi"))
    by = live.groupBy("cell", "label").count().groupBy("cell")
    by = by.agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("rows"), F.max("count").alias("of_main"))
    told = live.join(by, "cell")
    return cut(told.select("cell", "sig", "n", "at", "label", (F.col("label") != F.col("main")).alias("odd"), "rows", (F.col("rows") - F.col("of_main")).alias("odds")))


def _all_left(told: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) of different labels: each odd row of ``_mixed_cells`` with all of its cell that sketches (``bits``) don't rule
    out, or the ``most`` closest of each block. Rows of a cell are dealt in blocks, and each pair of blocks is one task's work."""

    def blocks(rows: str, salt: str) -> tuple[Column, Column]:
        n = F.ceil(F.col(rows) / BLOCK).cast("int")
        return n, F.pmod(F.xxhash64(F.lit(salt), "sig"), n).cast("int")

    (n_odd, own_odd), (n_all, own_all) = blocks("odds", "odd"), blocks("rows", "all")
    kept = ["sig", "n", "at", "label", "odd", "most", "bits"]
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    partner = told.select("cell", every(n_odd).alias("x"), own_all.alias("y"), F.lit(True).alias("partner"), *kept)
    asks = told.where("odd").select("cell", own_odd.alias("x"), every(n_all).alias("y"), F.lit(False).alias("partner"), *kept)

    def close(unit: pa.RecordBatch) -> pa.RecordBatch | None:
        cell, _, _, partner, sig, n, at, label, odd, most = (c.to_numpy(zero_copy_only=False) for c in unit.columns[:-1])
        bits = unit.column(10).to_pylist()
        width = np.array([len(b) for b in bits])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for w in np.unique(width[~partner]).tolist():
            i = np.flatnonzero(~partner & (width == w))
            of_i = [bits[k] for k in i.tolist()]
            for v in (w // 2, w, 2 * w):  # sizes that differ more are not similar
                j = np.flatnonzero(partner & (width == v))
                if not len(j):
                    continue
                x, y = _folded(of_i, min(v, w)), _folded([bits[k] for k in j.tolist()], min(v, w))
                step = max(1, (1 << 19) // y.size)
                for s in range(0, len(i), step):
                    k, m = i[s : s + step, None], j[None]
                    ok = (label[k] != label[m]) & fits(n, at, k, m, least) & (~odd[m] | (sig[k] < sig[m]))
                    if not ok.any():
                        continue
                    differ = np.bitwise_count(x[s : s + step, None] ^ y[None]).sum(axis=2, dtype=np.int64)
                    # sets differ in no fewer hashes than their sketches in buckets
                    ok &= differ <= (n[k] + n[m]) * ((1 - least) / (1 + least)) + 4e-6
                    r, c = np.nonzero(ok)
                    found.append((i[s + r], j[c], differ[r, c] / (n[i[s + r]] + n[j[c]])))
        if not found or not sum(len(f[0]) for f in found):
            return None
        i, j, far = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((sig[j], far, i))
        i, j = i[order], j[order]
        ok = np.arange(len(i)) - np.searchsorted(i, i) < most[i]
        x, y = sig[i[ok]], sig[j[ok]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the last unit, which may go on in the next batch

        def units(b: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            nonlocal rest
            if b is not None:
                rest.append(b)
            if not rest:
                return
            b = pa.Table.from_batches(rest).combine_chunks().to_batches()[0] if len(rest) > 1 else rest[0]
            cell, x, y = (c.to_numpy(zero_copy_only=False) for c in b.columns[:3])
            starts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(cell)]
            rest = [b.slice(starts[-2])]
            for s, e in zip(starts[:-2], starts[1:-1], strict=True):
                yield b.slice(s, e - s)

        for b in batches:
            if b.num_rows:
                yield from filter(None, map(close, units(b)))
        for b in rest:
            if (out := close(b)) is not None:
                yield out
        trim()

    n = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = partner.unionByName(asks).repartition(n, "cell", "x", "y").sortWithinPartitions("cell", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar(docs: DataFrame, shingle: int, least: float, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, DataFrame, DataFrame]:
    """(rows with a key, the key's name, (id, k, sig) of the rows, (sig, own, root) of the sets): the links' components.

    ``own`` is a set's row of the smallest id, and ``root`` stands for its component."""
    keyed, key = with_key(docs, text_col)
    rows, counts = _first_pass(keyed, [id_col, key, text_col], shingle)
    nodes = cut(rows.groupBy("sig").agg(F.min(own_key()).alias("own"), F.first("fp").alias("fp")))

    # candidates of the fingerprints: sets of one are tried with its least, and the least ones of two near ones with each other
    of = nodes.groupBy("fp").agg(F.min("sig").alias("least"), F.count("*").alias("n"))
    own = nodes.join(of.where("n > 1"), "fp").where("sig > least").select(F.col("least").alias("a"), F.col("sig").alias("b"))
    near = links(of.select("fp"), distance, PARTNERS)
    first = of.select("fp", "least")
    near = near.join(first.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def batch() -> pa.RecordBatch:
            sigs = pa.array([signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)) for h in held], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held).view(np.int64)))
            held.clear()
            return pa.RecordBatch.from_arrays([sigs, lists], names=["sig", "hashes"])

        for b in batches:
            for text in b.column(0):
                text = text.as_py()
                held.append(shingle_set(text.encode() if isinstance(text, str) else text, shingle))
                if sum(map(len, held[-8:])) > 1 << 17 or len(held) >= 256:
                    yield batch()
        if held:
            yield batch()
        _done()

    def sketches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sets_of(batches):
            values, ends = b.column(1).values.to_numpy().view(np.uint64), b.column(1).offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(values[s:e]) for s, e in pairwise(ends)], pa.binary())], names=["sig", "bits"])

    def texts_of(sigs: DataFrame) -> DataFrame:
        """A text of each of the sets."""
        named = cut(sigs.distinct())
        of_named = cut(nodes.join(_small(named, named.count()), "sig", "left_semi").select(F.col("own.id").alias("_id"), F.col("own.k").alias("_k")))
        few = keyed.join(_small(of_named, of_named.count()), keyed[id_col].eqNullSafe(F.col("_id")) & (keyed[key] == F.col("_k")), "left_semi")
        return few.select(text_col)

    tried: list[DataFrame] = []

    def verified(pairs: DataFrame) -> DataFrame | None:
        """The pairs (a, b) whose sets are as similar as ``least``; only the sets that they name are made again and shuffled. Pairs
        that were here before are left out; without any other, None."""
        if tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        pairs = cut(pairs)
        if pairs.isEmpty():
            return None
        tried.append(pairs)
        sets = texts_of(pairs.select("a").union(pairs.select("b")).withColumnRenamed("a", "sig")).mapInArrow(sets_of, "sig long, hashes array<long>").dropDuplicates(["sig"])
        both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("hashes").alias("y")), "b")
        return both.where(F.size(F.array_intersect("x", "y")) * (1 + least) >= (F.size("x") + F.size("y")) * least - 2e-6).select("a", "b")

    found = verified(own.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))))
    roots = components(nodes.limit(0).select(F.col("sig").alias("a"), F.col("sig").alias("b")) if found is None else found)
    shared, past = _shared(keyed, text_col, shingle, least, counts), 0

    def linked(found: DataFrame | None) -> DataFrame:
        return roots if found is None else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))

    for most in NEIGHBOURS:
        shared = _untried(shared, past)
        if shared.isEmpty():
            break
        roots, past = linked(verified(_neighbours(_labelled(shared, roots), past, most, least))), most
    shared, sketches = _untried(shared, past), None
    for most in (CLOSEST, (1 << 31) - 1):
        told = _mixed_cells(_labelled(shared, roots))
        if told.isEmpty():
            break
        if sketches is None:  # later rounds have no other sets
            sketches = cut(texts_of(told.select("sig")).mapInArrow(sketches_of, "sig long, bits binary").dropDuplicates(["sig"]))
            size = sketches.agg(F.sum(F.length("bits"))).first()[0]
        drawn = told.join(_small(sketches, size // 32), "sig").withColumn("most", F.lit(most))
        roots = linked(verified(_all_left(drawn, least)))
    joined = nodes.join(roots, nodes["sig"] == roots["node"], "left").select("sig", "own", F.coalesce("root", "sig").alias("root"))
    return keyed, key, rows, joined


def drop_similar(docs: DataFrame, shingle: int, least: float, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of texts linked at a similarity of ``least`` or more, with all its columns: the one of the
    smallest id (null last), then of the smallest hash of its text; of rows alike in both, one."""
    keyed, key, rows, joined = similar(docs, shingle, least, distance, id_col, text_col)
    best = joined.groupBy("root").agg(F.min("own").alias("least"))
    return keep_least(keyed, key, rows, best, id_col).select(*docs.columns)
