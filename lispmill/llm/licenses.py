"""License scans by an exact set-similarity (containment) join.

Templates may be of any length. A template's ``width`` is ``TILE`` words, or the least such width times a power of four that
has room for it. A text block of a width is a run of two neighbouring tiles of so many words of the whole text, so a
notice lies in one wherever it is wrapped. At the least width each line is a block of its own too, and of lines longer
than two tiles each run of two; ``n_blocks`` counts the lines' blocks only. A template matches a block of its width if at
least ``threshold`` of its distinct words occur in the block. Template words are ordered by how many documents of the
corpus have them, rarest first, with ties by the word. Then

* prefix filter: with ``need`` words asked for, one of a template's first ``size - need + 1`` words must occur;
* length filter: the block must have ``need`` template words;
* positional filter: from the place of the first shared word, both sides must still have enough words left.

What is left is verified, so the join is exact. Of templates that a block meets, one whose words all occur in
another of them gives no label: the longer notice names the license. The words of templates are the only ones that can match,
so the order is kept for these alone; the templates are a parameter, and few.

Null and empty texts give no words, no labels and score 0. Repeated rows and ids give a row each. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lispmill.llm.common import map_rows, table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a tile of short templates; blocks are two tiles long and overlap by one.
TILE = 32
THRESHOLD = 0.9
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences that name a license, and the notices that licenses ask to be put in files.
TEMPLATES = {
    "mit": [
        "Released under the MIT License", "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License, version 2",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl": ["licensed under the GNU Lesser General Public License"],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0"],
    "mpl": [
        "subject to the terms of the Mozilla Public License",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "proprietary": ["All rights reserved. Unauthorized copying is strictly prohibited"],
}


def words(text: bytes | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased; every other character stays as it is."""
    return WORD.findall((text or b"").lower())


def blocks(text: bytes, vocabulary: frozenset[bytes]) -> Iterator[set[bytes]]:
    """For each block of a line that has any, its words that some template has."""
    for line in text.split(b"\n"):
        found = WORD.findall(line)
        if len(found) <= 2 * TILE:
            if kept := vocabulary.intersection(found):
                yield kept
        else:
            yield from runs(found, vocabulary, TILE)


def runs(found: list[bytes], vocabulary: frozenset[bytes], width: int) -> Iterator[set[bytes]]:
    """The like for each two neighbouring tiles of the words, or for all words where they fill one."""
    tiles = [vocabulary.intersection(found[i : i + width]) for i in range(0, len(found), width)]
    for a, b in zip(tiles, tiles[1:] or [frozenset()], strict=False):
        if a or b:
            yield a | b


def template_sets(templates: dict[str, list[str]]) -> list[tuple[str, frozenset[bytes]]]:
    out = [(label, frozenset(words(t.encode()))) for label, texts in templates.items() for t in texts]
    return [(label, t) for label, t in out if t]


def width_of(template: str | bytes) -> int:
    """Words of a tile that holds the whole notice."""
    n, width = len(words(template.encode() if isinstance(template, str) else template)), TILE
    while width < n:
        width *= 4
    return width


def by_width(templates: dict[str, list[str]]) -> dict[int, dict[str, list[str]]]:
    """The templates by the width of their blocks, ascending."""
    out: dict[int, dict[str, list[str]]] = {}
    for label, texts in templates.items():
        for t in texts:
            out.setdefault(width_of(t), {}).setdefault(label, []).append(t)
    return dict(sorted(out.items()))


class TemplateJoin:
    """The prefix index of the templates, under a global order of their words."""

    def __init__(self, templates: list[tuple[str, frozenset[bytes]]], frequency: dict[bytes, int], threshold: float) -> None:
        self.templates = templates
        ordered = sorted({w for _, t in templates for w in t}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(ordered)}
        self.need = [max(1, math.ceil(threshold * len(t) - 1e-9)) for _, t in templates]
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(templates):
            for at, w in enumerate(sorted(t, key=self.rank.__getitem__)[: len(t) - self.need[k] + 1]):
                self.index.setdefault(w, []).append((k, at))

    def matches(self, block: set[bytes]) -> Iterator[tuple[int, float]]:
        """(template, containment) of all templates that the block meets."""
        if self.index.keys().isdisjoint(block):
            return
        seen: set[int] = set()
        for j, w in enumerate(sorted(block, key=self.rank.__getitem__)):
            for k, at in self.index.get(w, ()):
                size = len(self.templates[k][1])
                if k in seen or len(block) < self.need[k]:
                    continue
                if 1 + min(size - at - 1, len(block) - j - 1) < self.need[k]:
                    continue
                seen.add(k)
                shared = len(self.templates[k][1] & block)
                if shared >= self.need[k]:
                    yield k, shared / size


def word_frequency(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many documents of the whole corpus have each word of the vocabulary (a bounded result)."""

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        n: Counter = Counter()
        for (text,) in rows:
            n.update(vocabulary.intersection(words(text)))
        yield from n.items()

    out = map_rows(docs, [text_col], count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in out.collect()}


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, word count, phrase hits and the labels of phrases and matching templates."""
    grouped = {w: template_sets(t) for w, t in by_width(TEMPLATES if templates is None else templates).items()}
    every = frozenset(w for sets in grouped.values() for _, t in sets for w in t)
    frequency = word_frequency(docs, every, text_col) if every else {}
    joins = [(width, frozenset(w for _, t in sets for w in t), TemplateJoin(sets, frequency, threshold)) for width, sets in grouped.items()]
    spelled = [(p.encode(), p.encode().split(), label) for p, label in (PHRASES if phrases is None else phrases).items()]

    def found_blocks(low: bytes, found: list[bytes], width: int, vocabulary: frozenset[bytes]) -> Iterator[tuple[int, set[bytes]]]:
        if width == TILE:
            yield from ((1, b) for b in blocks(low, vocabulary))
        if width > TILE or b"\n" in low:
            yield from ((0, b) for b in runs(found, vocabulary, width))

    def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            low = (text or b"").lower()
            found = WORD.findall(low)
            places: list[int] = []
            base: set[str] = set()
            for _, phrase, label in spelled:
                if phrase[0] not in low or phrase[-1] not in low:
                    continue
                at = -1
                while True:
                    try:
                        at = found.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if found[at : at + len(phrase)] == phrase:
                        places.append(at)
                        base.add(label)
            labels, score, n_blocks = set(base), 1.0 if base else 0.0, 0
            distinct = set(found)
            for width, vocabulary, join in joins:
                if len(vocabulary & distinct) < min(join.need):
                    continue
                for is_line, b in found_blocks(low, found, width, vocabulary):
                    met = list(join.matches(b))
                    for k, share in met:
                        if not any(join.templates[k][1] < join.templates[o][1] for o, _ in met):
                            labels.add(join.templates[k][0])
                            score = max(score, share)
                    n_blocks += is_line if met else 0
            yield (doc_id, len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, n_blocks)

    spec = f"{id_col} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"
    return map_rows(docs, [id_col, text_col], scan, spec)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same rows in DuckDB: every template is counted in every block, without an index."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda ws: "[" + ", ".join(quote(w) for w in ws) + "]"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    sets = [(width, label, t) for width, templates in by_width(TEMPLATES).items() for label, t in template_sets(templates)]
    templates = ", ".join(f"({k}, {width}, {quote(label)}, {listed(sorted(w.decode() for w in t))}, {max(1, math.ceil(THRESHOLD * len(t) - 1e-9))})" for k, (width, label, t) in enumerate(sets))
    within = " OR ".join(f"(a.k = {i} AND b.k = {j})" for i, (_, _, s) in enumerate(sets) for j, (_, _, t) in enumerate(sets) if s < t) or "false"
    run = lambda width, of, where: f"SELECT rid, {width} AS width, {of == 'l'} AS line, ws[i + 1:i + {2 * width}] AS ws FROM (SELECT *, unnest(range(0, greatest(len(ws) - {width}, 1), {width})) AS i FROM {of} WHERE {where})"
    tiles = " UNION ALL ".join(["SELECT rid, " + str(TILE) + " AS width, true AS line, ws FROM l WHERE len(ws) BETWEEN 1 AND " + str(2 * TILE), run(TILE, "l", f"len(ws) > {2 * TILE}"), run(TILE, "w", "len(ws) > 0 AND contains(t, chr(10))"), *(run(w, "w", "len(ws) > 0") for w in sorted({w for w, _, _ in sets} - {TILE}))])
    phrases = ", ".join(f"({listed(p.split())}, {quote(label)})" for p, label in PHRASES.items())
    return f"""
      WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
      w AS (SELECT *, regexp_extract_all(t, '{word}') AS ws FROM d),
      base AS (SELECT rid, label, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + len(p)] = p)) AS place FROM w, (VALUES {phrases}) AS p(p, label)),
      l AS (SELECT rid, regexp_extract_all(unnest(string_split(t, chr(10))), '{word}') AS ws FROM d),
      b AS (SELECT row_number() OVER () AS bid, * FROM ({tiles})),
      h AS (SELECT rid, bid, line, k, label, len(list_intersect(words, list_distinct(ws))) / len(words) AS share FROM b JOIN (VALUES {templates}) AS t(k, width, label, words, need) USING (width) WHERE len(list_intersect(words, list_distinct(ws))) >= need),
      kept AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.bid = b.bid AND ({within}))),
      found AS (SELECT rid, label, share, NULL::BIGINT AS place FROM kept UNION ALL SELECT rid, label, 1.0, place FROM base),
      g AS (SELECT rid, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place IS NOT NULL) AS base_labels,
              string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY rid),
      n AS (SELECT rid, count(DISTINCT bid) AS n_blocks FROM h WHERE line GROUP BY rid)
      SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        coalesce(score, 0)::DOUBLE AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
      FROM w LEFT JOIN g USING (rid) LEFT JOIN n USING (rid)"""
