"""Best-fit packing of token sequences under several capacities at once.

A document's ids are cut into pieces of at most ``capacity`` tokens. A piece takes of a sequence tokens (its
length), one document place, and attention cost (its length squared). All three follow from the length, so
the plan is made on the histogram of lengths, which has at most ``capacity`` rows however large the corpus
is. Lengths are placed from the longest down. Sequences with equal contents form a class of consecutive
numbers; for each length the class is chosen, among those with room in every dimension, by the smallest
weighted norm of the capacities left after placing (``select="norm"``), or by the largest weighted
dot-product of what the piece takes and what is left (``"dot"``). A class takes as many pieces as it has
sequences, all at one offset, so the plan is a short list of runs: the pieces of a length with ranks
``r .. r + n`` go to sequences ``s .. s + n``.

Ranks within a length are dealt in hash buckets with a prefix sum over the buckets' counts, so a length that
a third of all pieces have is not gathered in one task.

A null or empty text is the end id alone. Repeated rows and null ids are pieces of their own. An empty table
gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lispmill.llm.common import cut, map_rows, table

CAPACITY, END_ID = 4096, 1
#: Different parts that a worker keeps the ids of (about 200 bytes each); beyond them a text's rare words are encoded anew.
CACHED = 300_000
#: Runs that are broadcast at most (about 50 bytes each); a longer plan is joined by a shuffle.
BROADCAST_RUNS = 100_000
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of a white-space-blind, lower-casing word tokenizer, encoded once for each different word.

    The vocabulary's tokens never cross white space, so a text's ids are those of its parts between ASCII
    white space, one after the other. Texts of Latin-1 characters, which are composed already, may be
    lower-cased first, and a part of letters and closing punctuation is its word's ids and the punctuation's,
    as the tokenizer parts them too. New words are encoded together; each word's last id ends a word.
    """

    WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
    CLOSING = ".,;:!?|"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        try:
            text.encode("latin-1")
            text = text if "<|" in text else text.lower()
        except UnicodeEncodeError:
            pass
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        out = list(map(self.known.get, parts))
        if None in out:
            new = self.fill({p for p, x in zip(parts, out, strict=True) if x is None})
            out = [new[p] if x is None else x for p, x in zip(parts, out, strict=True)]
        return b"".join(out)

    def fill(self, parts: set[str]) -> dict[str, bytes]:
        """The ids of parts that are not known; words and punctuation are known from now on if there is room."""
        known, word, new, whole, ended = self.known, self.WORD.fullmatch, {}, [], []
        for p in parts:
            w = p.rstrip(self.CLOSING)
            if not word(w):
                new[p] = self.encode(p).tobytes()
                continue
            if w not in known and w not in new:
                new[w] = b""
                whole.append(w)
            if w != p:
                tail = p[len(w) :]
                if tail not in known:
                    known[tail] = self.encode(tail).tobytes()
                ended.append((p, w, tail))
        if whole:
            ids = self.encode(" ".join(whole))
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(whole):
                raise ValueError("the tokenizer does not end each word with one end-of-word token")
            blob, start = ids.tobytes(), 0
            for w, end in zip(whole, cuts, strict=True):
                new[w] = blob[4 * start : 4 * end]
                start = end
        if len(known) < CACHED:
            known.update(new)
        for p, w, tail in ended:
            new[p] = (new.get(w) or known[w]) + known[tail]
        return new


def encoder(path: str | None) -> WordEncoder:
    """One encoder in each Python process; no path means the public word vocabulary of this machine."""
    key = path or ""
    if key not in _encoders:
        if not path:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        _encoders[key] = WordEncoder(path)
    return _encoders[key]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int | None = END_ID, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, n): n counts a partition's pieces and only spreads equal rows."""
    last = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        own, n = encoder(tokenizer), 0
        for doc_id, text in part:
            ids = own.ids(text or "") + last
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                one = ids[at : at + 4 * capacity]
                n += 1
                yield doc_id, k, at // 4, len(one) // 4, zlib.crc32(one), n

    return map_rows(docs, [id_col, text_col], rows, f"{id_col} long, piece int, start long, length long, ids_crc32 long, n long", text_as_bytes=False)


@dataclass
class Limits:
    """Capacities of a sequence and the weights of its dimensions (tokens, documents, attention cost)."""

    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


def plan(histogram: dict[int, int], limits: Limits | None = None, select: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) that place every piece of the histogram."""
    limits = limits or Limits()
    cap = np.array([limits.tokens, limits.documents, limits.attention], float)
    weights = np.array(limits.weights)
    if limits.documents < 1 or select not in ("norm", "dot"):
        raise ValueError("limits allow no piece, or unknown selection")
    size, made, runs = 0, 0, []
    left, many, first = np.zeros((1024, 3)), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def add(row: np.ndarray, n: int, at: int) -> None:
        nonlocal size, left, many, first
        if size == len(many):
            live = np.flatnonzero((many[:size] > 0) & (left[:size] > 0).all(axis=1))
            if len(live) > size // 2:
                left, many, first = np.vstack([left, np.zeros_like(left)]), np.r_[many, np.zeros_like(many)], np.r_[first, np.zeros_like(first)]
            else:  # full classes are never looked at again
                left[: len(live)], many[: len(live)], first[: len(live)] = left[live], many[live], first[live]
                size = len(live)
        left[size], many[size], first[size] = row, n, at
        size += 1

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        takes = np.array([length, 1, length * length], float)
        if (takes > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while count:
            fits = np.flatnonzero((many[:size] > 0) & (left[:size] >= takes).all(axis=1))
            if len(fits):
                after = (left[fits] - takes) / cap
                score = (weights * after * after).sum(axis=1) if select == "norm" else -(weights * (takes / cap) * (left[fits] / cap)).sum(axis=1)
                best = int(fits[np.argmin(score)])
                n = int(min(count, many[best]))
                runs.append((length, rank, n, int(first[best]), int(limits.tokens - left[best, 0])))
                row, at = left[best] - takes, int(first[best])
                if n == many[best]:
                    left[best] = row
                else:
                    many[best] -= n
                    first[best] += n
                    add(row, n, at)
            else:
                each = max(1, min(int(limits.tokens // length), int(limits.documents), int(limits.attention // (length * length))))
                n = -(-count // each)  # so many new sequences; they take more of this length in the next turns
                n = min(count, n)
                runs.append((length, rank, n, made, 0))
                add(cap - takes, n, made)
                made += n
            count, rank = count - n, rank + n
    return runs


def pack(parts: DataFrame, limits: Limits | None = None, select: str = "norm", id_col: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; the input should be cheap to read again (see ``cut``)."""
    spark = parts.sparkSession
    sizes = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan(sizes, limits, select)
    buckets = max(64, sum(sizes.values()) // 4096)
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32", "n"), F.lit(buckets)))
    own = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32", "n")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ranked = dealt.withColumn("k", F.row_number().over(own) - 1).join(counts, ["length", "bucket"])
    table_ = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "l long, rank long, pieces long, first long, offset long")
    table_ = F.broadcast(table_) if len(runs) <= BROADCAST_RUNS else table_
    at = F.col("ahead") + F.col("k")
    placed = ranked.join(table_, (F.col("length") == F.col("l")) & (at >= F.col("rank")) & (at < F.col("rank") + F.col("pieces")))
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("first") + at - F.col("rank")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, limits: Limits | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with the sequence and the offset of each."""
    limits = limits or Limits()
    return pack(cut(pieces(docs, limits.tokens, END_ID, tokenizer, id_col, text_col)), limits, id_col=id_col)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
