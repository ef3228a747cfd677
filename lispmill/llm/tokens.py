"""Token counts by section: whole documents are encoded once and tokens attributed by their places.

A byte-level vocabulary loses nothing, so the running sum of the tokens' byte lengths gives each token's
byte span, and counting the characters' first bytes gives its character span (a token that holds only part
of a character spans that character). The spans are interval-joined to the sections' character spans.

The rule for a token that crosses a boundary: it goes to the section that holds most of its characters, and
of several to the first. A token that meets no section counts as outside. So every token is counted once,
and a document's sections and outside tokens add up to its tokens.

Sections are a document's lines, each with its line end, unless the caller names spans. Null and empty texts
have one empty section (0 tokens). Empty sections get no tokens. Overlapping sections are refused. Repeated
rows give their rows again; only the id and the text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lispmill.llm.common import map_rows, table

_encodings: dict[str, tuple] = {}


def encoding(path: str | None) -> tuple:
    """(tiktoken encoding, byte length of each token), once in each Python process."""
    key = path or ""
    if key not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        _encodings[key] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[key]


def token_spans(text: str, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of a text's tokens in characters, from one encoding of the whole text."""
    enc, sizes = encoding(path)
    ids = np.array(enc.encode_ordinary(text), np.int64)
    end = np.cumsum(sizes[ids])
    start = end - sizes[ids]
    data = text.encode()
    if len(data) != len(text):
        # characters that began up to and with each byte
        begun = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        start, end = begun[start] - 1, begun[end - 1]
    return start, end


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of a text's lines, line ends included."""
    cuts = [0]
    at = text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] < len(text) or len(cuts) == 1:
        cuts.append(len(text))
    edges = np.array(cuts, np.int64)
    return edges[:-1], edges[1:]


def attribute(start: np.ndarray, end: np.ndarray, s_start: np.ndarray, s_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, crossing tokens) of each section, and tokens outside. Sections are ordered and do not overlap."""
    n = len(s_start)
    if n and ((s_start > s_end).any() or (s_start[1:] < s_end[:-1]).any()):
        raise ValueError("sections overlap or are out of order")
    filled = np.flatnonzero(s_end > s_start)
    a, b = s_start[filled], s_end[filled]
    lo = np.searchsorted(b, start, "right")  # first section that ends behind the token's start
    hi = np.searchsorted(a, end, "left") - 1  # last that starts before its end
    owner = np.where(lo <= hi, lo, -1)
    inside = (lo <= hi) & (start >= a[np.minimum(lo, len(a) - 1)]) & (end <= b[np.minimum(lo, len(a) - 1)]) if len(a) else np.zeros(len(start), bool)
    crossing = np.zeros(n, np.int64)
    for t in np.flatnonzero((lo <= hi) & ~inside):
        k = np.arange(lo[t], hi[t] + 1)
        share = np.minimum(b[k], end[t]) - np.maximum(a[k], start[t])
        owner[t] = k[np.argmax(share)]
        crossing[filled[owner[t]]] += 1
    kept = owner[owner >= 0]
    tokens = np.zeros(n, np.int64)
    tokens[filled] = np.bincount(kept, minlength=len(filled))
    return tokens, crossing, int(len(start) - len(kept))


def count_tokens(docs: DataFrame, spans_col: str | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per section: its place, characters, tokens and how many of them cross its boundaries.

    ``spans_col`` may name an array<array<int>> column of [start, end) characters, ordered; -1 is the section
    number of the tokens that none of them holds. Without it the sections are the lines.
    """

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, *given in part:
            text = text or ""
            if spans_col:
                pairs = np.array(given[0] or [], np.int64).reshape(-1, 2)
                s_start, s_end = pairs[:, 0], pairs[:, 1]
            else:
                s_start, s_end = line_spans(text)
            tokens, crossing, outside = attribute(*token_spans(text, path), s_start, s_end)
            for k, row in enumerate(zip(s_start.tolist(), s_end.tolist(), tokens.tolist(), crossing.tolist(), strict=True)):
                yield doc_id, k, *row
            if outside:
                yield doc_id, -1, None, None, outside, 0

    return map_rows(docs, [id_col, text_col, *([spans_col] if spans_col else [])], rows, f"{id_col} long, section int, start long, end long, n_tokens long, n_crossing long", text_as_bytes=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
