"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

LETTERS = "the of and mar ton sel ven qui dor bel".split()


def prose(seed: int, n: int, stems=LETTERS) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 3))) + r.choice(["", "", ",", ".", ".\n"]) for _ in range(n))


def awkward(spark, texts=(), columns="doc_id long, text string, lang string, source string, n_chars long"):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids; then the given texts from id 100."""
    rows = [
        (1, None, "en", "s", 0), (2, "", None, None, 0), (3, "  \n\t ", "en", "s", None), (None, "lost id here", "en", "s", 3), (4, "same text", "en", "s", 1), (4, "same text", "en", "s", 1),
        (5, "same text", "en", "s", 1), (5, "other text of a repeated id", "en", "s", 1), (6, prose(1, 30_000), "en", "s", 1), (7, "ÀÉ ß İ \u0000 　 😀 ＡＢ", "fr", "s", 1), (8, "x" * 50_000, "en", "s", 1),
    ]
    rows += [(100 + k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, columns)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df, *names):
    """The table with further columns of names that operators use for their own."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
