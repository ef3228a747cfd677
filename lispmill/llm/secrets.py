"""Secret scans in DataFrame functions only.

Three base kinds are regular expressions: ``assign`` (a named credential and a value of 6 or more
characters), ``access`` (an access key id) and ``hex`` (24 or more hexadecimal digits). The method adds
``entropy-hex`` and ``entropy-b64``: a window of ``WINDOW`` characters slides over each candidate string of
a character class, with the counts of its characters updated for the one that enters and the one that
leaves (twelve counts of five bits to a long). The sum of ``c * log2(c)`` over the counts is kept as an integer
scaled by ``SCALE``, so a window's Shannon entropy ``log2(w) - sum / w`` is compared exactly.

The allow-list suppresses windows, not candidates: a window of characters of one ``PLAIN`` set only (words,
paths, numbers, the other class's strings), one that touches a placeholder word, and one that holds a run of
``RUN`` equal characters. The span runs from the first to the last window that reaches the class's threshold and
isn't suppressed. Base kinds are never suppressed.

Work is linear in the text: places come from a prefix scan in blocks, long candidates are judged in overlapping
pieces, and texts are cut in chunks before spans are taken out of them.

Places are code points, ends exclusive. Null and empty texts have no spans; ties of a start go by the order
of ``KINDS``; repeated rows give a row each. Columns other than the id and the text are kept by ``redact``
and not read by ``scan_secrets``. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lispmill.llm.common import table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
WINDOW, SCALE = 20, 1 << 32
#: class: alphabet of its candidates, their pattern, the least entropy of a window in bits
CLASSES = {
    "entropy-hex": ("0123456789abcdefABCDEF", "[0-9a-fA-F]", 3.0),
    "entropy-b64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "[A-Za-z0-9+/_=-]", 3.85),
}
#: A window of characters of one of these two sets only is no secret.
PLAIN = {
    "entropy-hex": ("0123456789", "abcdefABCDEF"),
    "entropy-b64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-/", "0123456789abcdefABCDEF"),
}
PLACEHOLDERS = ("example", "placeholder", "changeme", "dummy")
#: What a placeholder's characters become, and so many equal characters that no secret holds.
MASK, RUN = "!", 8
#: Elements of a block of a scan; characters of a piece of a candidate, and of a chunk of a text.
SCAN, PIECE, CHUNK = 256, 2048, 4096
KINDS = ("assign", "access", "hex", *CLASSES)
REDACTED = "[SECRET]"
SPAN = "array<struct<start:int,rank:int,end:int>>"


def scaled_terms(window: int = WINDOW) -> list[int]:
    """round(c * log2(c) * SCALE) for counts 0 .. window + 1."""
    return [0, *(round(c * math.log2(c) * SCALE) for c in range(1, window + 2))]


def most_sum(threshold: float, window: int = WINDOW) -> int:
    """The largest scaled sum whose window still reaches the threshold."""
    return math.floor(window * (math.log2(window) - threshold) * SCALE)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is worked out once, however often and in whatever lambdas the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(xs: Column, kind: str, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """All states of a fold over the array but the first, in blocks, so that growing arrays are copied in small only."""
    last = lambda a: F.element_at(a, -1)

    def block(s: Column, own: Column) -> Column:
        grown = F.aggregate(own, F.array(last(last(s))), lambda t, x: F.concat(t, F.array(step(last(t), x).cast(kind))))
        return F.concat(s, F.array(F.slice(grown, F.lit(2), F.lit(SCAN))))

    def scanned(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / SCAN).cast("int")), lambda k: F.slice(a, k * SCAN + 1, F.lit(SCAN)))
        return F.aggregate(blocks, F.array(F.array(zero.cast(kind))), block, lambda s: F.slice(F.flatten(s), F.lit(2), F.size(a)))

    return _let(xs, lambda a: F.when(F.size(a) > 0, scanned(a)).otherwise(F.array().cast(f"array<{kind}>")))


def _places(text: Column, pattern: str) -> Column:
    """(match, start) of all matches: the gaps between them are what split() leaves."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gap"))

    def placed(a: Column) -> Column:
        ends = _scan(a, "int", F.lit(0), lambda at, p: at + F.length(p["gap"]) + F.coalesce(F.length(p["found"]), F.lit(0)))
        # the last gap has no match behind it
        both = F.filter(F.arrays_zip(F.transform(a, lambda p: p["found"]).alias("text"), ends.alias("end")), lambda p: p["text"].isNotNull())
        return F.transform(both, lambda p: F.struct(p["text"].alias("text"), (p["end"] - F.length(p["text"])).cast("int").alias("start")))

    return _let(pairs, placed)


def _whole(places: Column, rank: int) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), (p["start"] + F.length(p["text"])).cast("int").alias("end")))


def _windows(text: Column, kind: str) -> Column:
    """(first, last) index, from 0, of the windows of a short string that reach the threshold and aren't suppressed; -1 if none.

    A step judges the window that ended before it, so that nothing of a step is worked out twice."""
    alphabet, _, threshold = CLASSES[kind]
    terms, most, w = scaled_terms(), most_sum(threshold), WINDOW
    longs = lambda xs: F.expr(f"array({', '.join(f'{x}L' for x in xs)})")
    # what a count's next unit adds to the sum, and what its last one takes away
    up, down = longs([b - a for a, b in zip(terms, terms[1:], strict=False)]), longs([0, *(a - b for a, b in zip(terms, terms[1:], strict=False))])
    # of a code: the long that counts it, the place and unit there, and its marks: not of the first plain set, not of the second,
    # and of no set at all, eight bits each
    outside = [1 << 16, *((c not in PLAIN[kind][0]) + ((c not in PLAIN[kind][1]) << 8) for c in alphabet)]
    told = lambda code, word, shift, unit, mark: f"named_struct('code', {code}, 'word', {word}, 'shift', {shift}, 'unit', {unit}L, 'mark', {mark})"
    table = F.expr(f"array({', '.join(told(c, c // 12, c % 12 * 5, 1 << c % 12 * 5, m) for c, m in enumerate(outside))})")
    nothing = F.expr(told(-1, -1, 0, 0, 0))
    codes = F.transform(F.slice(F.split(text, "", -1), F.lit(1), F.length(text)), lambda c: F.get(table, F.instr(F.lit(alphabet), c)))
    count = lambda n, c: F.call_function("shiftright", F.get(n, c["word"]), c["shift"]).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def judged(state: Column, i: Column) -> tuple[Column, Column, Column]:
        """(dull, first, last) with the window that ends before ``i``."""
        at = i - w
        dull = F.when(state["run"] >= RUN, i - RUN).otherwise(state["dull"])  # start of the last run
        ok = (state["sum"] <= F.lit(most)) & (at >= 0) & (state["marks"] < 1 << 16) & (state["marks"] % 256 > 0) & (state["marks"] > 255) & (dull < at)
        return dull, F.when((state["first"] < 0) & ok, at).otherwise(state["first"]), F.when(ok, at).otherwise(state["last"])

    def step(state: Column, x: Column) -> Column:
        came, left = x["came"], x["left"]
        dull, first, last = judged(state, state["i"])
        total = F.when(came["code"] == left["code"], state["sum"]).otherwise(state["sum"] + F.get(up, count(state["n"], came)) + F.when(left["code"] < 0, F.lit(0).cast("long")).otherwise(F.get(down, count(state["n"], left))))
        counts = F.transform(state["n"], lambda v, k: v + F.when(k == came["word"], came["unit"]).otherwise(F.lit(0).cast("long")) - F.when(k == left["word"], left["unit"]).otherwise(F.lit(0).cast("long")))
        run = F.when(came["code"] == state["code"], state["run"] + 1).otherwise(F.lit(1))
        return F.struct(
            (state["i"] + 1).alias("i"), came["code"].alias("code"), counts.alias("n"), total.alias("sum"), (state["marks"] + came["mark"] - left["mark"]).alias("marks"), run.alias("run"),
            dull.alias("dull"), first.alias("first"), last.alias("last"),
        )

    def judge(own: Column) -> Column:
        pairs = F.slice(F.arrays_zip(own.alias("came"), F.concat(F.array_repeat(nothing, w), own).alias("left")), F.lit(1), F.size(own))
        none = F.array_repeat(F.lit(0).cast("long"), len(alphabet) // 12 + 1)
        zero = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("code"), none.alias("n"), F.lit(0).cast("long").alias("sum"), *[F.lit(v).alias(k) for k, v in {"marks": 0, "run": 0, "dull": -1, "first": -1, "last": -1}.items()])

        def finish(state: Column) -> Column:
            _, first, last = judged(state, state["i"])
            return F.struct(first.alias("first"), last.alias("last"))

        return F.aggregate(pairs, zero, step, finish)

    return _let(codes, judge)


def _masked(text: Column) -> Column:
    for p in PLACEHOLDERS:
        text = F.regexp_replace(text, f"(?i){p}", MASK * len(p))
    return text


def _judged(text: Column, kind: str) -> Column:
    """(first, last) over the pieces of a candidate; a piece begins with the last window of the one before it, less a character."""

    def of(pieces: Column) -> Column:
        before = F.concat(F.array(F.lit("")), pieces)
        own = F.transform(F.slice(F.arrays_zip(pieces.alias("piece"), before.alias("before")), F.lit(1), F.size(pieces)), lambda p: F.concat(F.right(p["before"], F.lit(WINDOW - 1)), p["piece"]))
        shift = lambda w, k: F.when(w >= 0, (w + k * PIECE - F.when(k > 0, WINDOW - 1).otherwise(F.lit(0))).cast("int"))
        places = F.transform(F.transform(own, lambda t: _windows(t, kind)), lambda w, k: F.struct(shift(w["first"], k).alias("first"), shift(w["last"], k).alias("last")))
        return _let(places, lambda a: F.struct(F.array_min(F.transform(a, lambda w: w["first"])).alias("first"), F.array_max(F.transform(a, lambda w: w["last"])).alias("last")))

    return _let(F.regexp_extract_all(_masked(text), F.lit(f".{{1,{PIECE}}}"), F.lit(0)), of)


def _entropy(text: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    plain = "|".join(f"[{re.escape(p)}]+" for p in PLAIN[kind])
    candidates = F.filter(_places(text, f"{CLASSES[kind][1]}{{{WINDOW},}}"), lambda p: ~p["text"].rlike(f"^(?:{plain})$"))
    judged = F.transform(candidates, lambda p: F.struct(p["start"].alias("at"), _judged(p["text"], kind).alias("w")))
    spans = F.transform(judged, lambda p: F.when(p["w"]["first"].isNotNull(), F.struct((p["at"] + p["w"]["first"]).cast("int").alias("start"), F.lit(rank).alias("rank"), (p["at"] + p["w"]["last"] + WINDOW).cast("int").alias("end"))))
    return F.filter(spans, lambda s: s.isNotNull())


_built: dict[tuple, Column] = {}


def _all_spans(text_col: str, spark: SparkSession) -> Column:
    """All spans of a text, ordered; the expression is made once for each JVM and column name."""
    key = (id(spark.sparkContext._gateway), text_col, SCAN, PIECE)
    if key not in _built:
        text = F.coalesce(F.col(text_col), F.lit(""))
        low = F.lower(text)
        named = low.contains(NAMES[0])
        for n in NAMES[1:]:
            named |= low.contains(n)
        empty = F.array().cast(SPAN)
        assigned = F.filter(F.arrays_zip(_places(text, ASSIGN).alias("p"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)).alias("v")), lambda x: F.length(x["v"]) >= 6)
        parts = [
            F.when(named, _whole(F.transform(assigned, lambda x: x["p"]), 0)).otherwise(empty),
            F.when(text.contains("AKIA"), _whole(_places(text, ACCESS), 1)).otherwise(empty),
            F.when(text.rlike(HEX), _whole(_places(text, HEX), 2)).otherwise(empty),
            *[F.when(text.rlike(f"{CLASSES[k][1]}{{{WINDOW},}}"), _entropy(text, k)).otherwise(empty) for k in CLASSES],
        ]
        _built[key] = F.array_sort(F.concat(*[p.cast(SPAN) for p in parts]))
    return _built[key]


def with_spans(docs: DataFrame, text_col: str = "text", to: str = "_spans") -> DataFrame:
    """Adds all spans as an array of (start, rank of the kind, end), ordered."""
    return docs.withColumn(to, _all_spans(text_col, docs.sparkSession))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: counts of the base kinds, a digest of their spans, and all spans."""
    found = with_spans(docs.select(id_col, text_col), text_col)
    count = lambda rank: F.size(F.filter("_spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("_spans", lambda s: s["rank"] < 3)
    return found.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans")
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = REDACTED) -> DataFrame:
    """The same rows and columns, with every run of overlapping spans in the text replaced by ``mark``."""
    name = "_spans_" + "_".join(docs.columns)
    found = with_spans(docs, text_col, name)
    text, end = F.col(text_col), 1 << 30

    def runs(spans: Column) -> Column:
        """Starts and ends of the runs of spans that meet: a run's end is the greatest so far, where the next span begins behind it."""
        reach = _scan(spans, "int", F.lit(-1), lambda at, s: F.greatest(at, s["end"]))
        before = F.concat(F.array(F.lit(-1)), reach)
        zipped = F.slice(F.arrays_zip(F.transform(spans, lambda s: s["start"]).alias("start"), before.alias("before")), F.lit(1), F.size(spans))
        fresh = F.filter(zipped, lambda s: s["start"] > s["before"])
        # a gap goes from the end of a run (0 at first) to the start of the next (the text's end at last)
        return F.concat(F.transform(fresh, lambda s: F.struct(F.greatest(s["before"], F.lit(0)).alias("a"), s["start"].alias("b"))), F.array(F.struct(F.array_max(reach).alias("a"), F.lit(end).alias("b"))))

    def cut(chunks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        own = F.coalesce(F.get(chunks, i), F.lit(""))
        within = F.substring(own, a % CHUNK + 1, b - a)
        over = F.concat(F.substring(own, a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(chunks, j), F.lit(1), b % CHUNK), F.lit("")))
        return F.when(i == j, within).otherwise(over)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    gaps = _let(chunks, lambda c: F.transform(_let(F.col(name), runs), lambda g: cut(c, g["a"], g["b"])))
    return found.withColumn(text_col, F.when(F.size(name) > 0, F.array_join(gaps, mark)).otherwise(text)).select(*docs.columns)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same rows in DuckDB: every window of every candidate is counted afresh."""
    terms = "[" + ", ".join(f"{x}::BIGINT" for x in scaled_terms()[1:]) + "]"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, **{k: f"{CLASSES[k][1]}{{{WINDOW},}}" for k in CLASSES}}
    parts = []
    for rank, (kind, p) in enumerate(pattern.items()):
        keep = "length(v[i]) >= 6" if kind == "assign" else "true"
        values = f"regexp_extract_all(text, {quote(p)}, {2 if kind == 'assign' else 0})"
        parts.append(f"""
          SELECT doc_id, row_id, {rank} AS rank, '{kind}' AS kind, m[i] AS found,
            (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS start
          FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, row_id, regexp_extract_all(text, {quote(p)}, 0) AS m, {values} AS v, string_split_regex(text, {quote(p)}) AS gaps FROM d))
          WHERE {keep}""")
    masked = "found"
    for word in PLACEHOLDERS:
        masked = f"regexp_replace({masked}, '(?i){word}', '{MASK * len(word)}', 'g')"
    some_of = lambda chars: "[" + "".join("\\" + c if c in "+-/" else c for c in chars) + "]"
    suppressed = {k: " OR ".join([f"contains(w, '{MASK}')", *(f"regexp_matches(w, '^{some_of(p)}+$')" for p in PLAIN[k]), *(f"contains(w, '{c * RUN}')" for c in CLASSES[k][0])]) for k in CLASSES}
    judged = " UNION ALL ".join(
        f"""SELECT row_id, rank, kind, start + min(j) AS start, start + max(j) + {WINDOW} AS end_ FROM (
              SELECT *, substr(masked, (j + 1)::BIGINT, {WINDOW}) AS w FROM (SELECT *, {masked} AS masked, unnest(range(0, length(found) - {WINDOW} + 1)) AS j FROM s WHERE kind = '{k}'))
            WHERE NOT ({suppressed[k]}) AND list_sum(list_transform(map_values(list_histogram(string_split(w, ''))), lambda c: ({terms})[c::BIGINT])) <= {most_sum(CLASSES[k][2])}
            GROUP BY row_id, rank, kind, start, found"""
        for k in CLASSES
    )
    return f"""
      WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents),
      s AS ({" UNION ALL ".join(parts)}),
      a AS (SELECT row_id, rank, kind, start, start + length(found) AS end_ FROM s WHERE rank < 3 UNION ALL {judged}),
      g AS (SELECT row_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
              coalesce(string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, rank, end_) FILTER (rank < 3), '') AS base,
              string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, rank, end_) AS spans FROM a GROUP BY row_id)
      SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row_id)"""

