"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of 1 to ``ORDERS`` characters of the lower-cased text (white space made one space),
hashed to ``DIM`` columns. Document frequencies count every document that may be learnt from. Weights are
log-scaled counts by idf, with vectors of length 1. Training is follow-the-regularised-leader with an L1 and an L2
penalty on a sample of at most about ``ROWS`` rows of each language, chosen by a hash of the id (an id
of several rows of a language gives one); the ``LANGUAGES`` commonest values of the column are learnt. A fifth of
the sample is kept back to fit the temperature that divides the scores before the softmax.

Only rows with text and language whose id's crc32 modulo ``FOLDS`` is not 0 teach. A text that is null or has
no letter is ``und`` with score 0. Equal scores go to the language first in order. Without any rows to learn
from all texts are ``und``. Repeated rows give a row each; only the id, the text and (to learn) the language
are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lispmill.llm.common import bucket_of, map_rows, table

ORDERS, DIM, ROWS, FOLDS = 3, 1 << 15, 1000, 5
#: The most languages that are learnt.
LANGUAGES = 256
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-3, 2
UND = "und"
SPACE = re.compile(r"\s+")
LETTER = re.compile(r"[^\W\d_]")
#: Characters that are hashed at once; a longer text's counts are added up.
CHUNK = 1 << 20


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text."""
    x = np.frombuffer(SPACE.sub(" ", text.lower()).encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(DIM, np.int64)
    for start in range(0, len(x), CHUNK):
        part = x[start : start + CHUNK + ORDERS - 1]
        code = part
        for n in range(1, ORDERS + 1):
            m = min(CHUNK, len(part) - n + 1)  # n-grams that start in this chunk
            if m < 1:
                break
            code = part[:m] if n == 1 else code[:m] * np.uint32(0x01000193) ^ part[n - 1 : n - 1 + m]
            mixed = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x7F4A7C15 & 0xFFFFFFFF)) >> np.uint32(17)
            out += np.bincount(mixed, minlength=DIM)
    return out


class LanguageModel:
    """Weights of each language, the idf, and the temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray) -> None:
        self.languages, self.idf = languages, idf
        self.weights, self.bias, self.temperature = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages)), 1.0

    def vector(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(tf)
        w = (1 + np.log(tf[at])) * self.idf[at]
        return at, w / (np.sqrt(w @ w) or 1)

    def logits(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        return w @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UND, 0.0
        z = self.logits(*self.vector(counts(text))) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.languages[k], float(p[k] / p.sum())

    def train(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """FTRL-proximal with elastic net: weights are zero where the gradients' sum stays within L1."""
        k = len(self.languages)
        z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

        def weights(at: np.ndarray) -> np.ndarray:
            own = z[at]
            return np.where(np.abs(own) <= L1, 0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

        order = np.random.default_rng(7)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                at, w, y = rows[i]
                at, w = np.r_[at, DIM], np.r_[w, 1.0]
                own = weights(at)
                s = w @ own
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y] -= 1
                g = w[:, None] * p
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - sigma * own
                n[at] += g * g
        final = weights(np.arange(DIM + 1))
        self.weights, self.bias = final[:DIM].astype(np.float32), final[DIM]

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """The temperature of least log loss on rows kept back."""
        if not rows:
            return
        z, y = np.array([self.logits(at, w) for at, w, _ in rows]), np.array([r[2] for r in rows])

        def loss(t: float) -> float:
            s = z / t
            top = s.max(axis=1)
            return float((np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(y)), y]).mean())

        self.temperature = min(np.geomspace(0.05, 20, 61).tolist(), key=loss)


def fit(docs: DataFrame, rows_each: int = ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (bucket_of(id_col, FOLDS) != 0))
    # values beyond the LANGUAGES commonest are not learnt, so a column of dirty values stays bounded
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(F.col("count").desc(), lang_col).limit(LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(DIM))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, rows_each / n))).otherwise(share)
    chosen = F.pmod(F.xxhash64(F.lit("train"), id_col), F.lit(1 << 30)) < share * float(1 << 30)

    def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
        df, total = np.zeros(DIM, np.int64), 0
        for doc_id, lang, text, take in rows:
            tf = counts(text)
            df += tf > 0
            total += 1
            if take:
                at = np.flatnonzero(tf)
                yield doc_id, lang, np.stack([at, tf[at]]).astype("<i4").tobytes(), 0
        for k in np.flatnonzero(df).tolist():
            yield k, None, None, int(df[k])
        yield -1, None, None, total

    out = map_rows(known.select(id_col, F.col(lang_col).alias("_lang"), text_col, chosen.alias("_take")), [id_col, "_lang", text_col, "_take"], scan, "k long, lang string, tf binary, df long", text_as_bytes=False)
    # one row for each column of the features, and one for each row of the sample: both are bounded
    merged = out.groupBy("lang", "k").agg(F.min("tf").alias("tf"), F.sum("df").alias("df")).toArrow()
    sample, df, total = [], np.zeros(DIM), 0
    for r in (r for b in merged.to_batches() for r in b.to_pylist()):
        if r["lang"] is not None:
            sample.append((r["lang"], r["k"], r["tf"]))
        elif r["k"] < 0:
            total = r["df"]
        else:
            df[r["k"]] = r["df"]
    model = LanguageModel(languages, np.log((1 + total) / (1 + df)) + 1)
    sample.sort()
    ready = []
    for lang, _, blob in sample:
        at, n = np.frombuffer(blob, "<i4").reshape(2, -1)
        tf = np.zeros(DIM, np.int64)
        tf[at] = n
        ready.append((*model.vector(tf), languages.index(lang)))
    model.train([r for k, r in enumerate(ready) if k % 5])
    model.calibrate(ready[::5])
    return model


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, held, text in part:
            yield doc_id, held, *model.predict(text)

    spec = f"{id_col} long, held_out boolean, lang_pred string, score double"
    return map_rows(docs.select(id_col, (bucket_of(id_col, FOLDS) == 0).alias("_held"), text_col), [id_col, "_held", text_col], rows, spec, text_as_bytes=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
