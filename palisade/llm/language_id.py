"""Language identification by nearest centroid.

Character n-grams of a text become a normalised TF-IDF vector; each language has several
centroids, found by spherical k-means over a bounded sample of its labelled texts
(about `PER_LANG` each and at most `MAX_ROWS` in all: the ids whose hash is below a
language's share, one row each). A text gets the language of
the centroid with the largest cosine; `rejected` tells that it is farther from it than
nearly all of that centroid's own training texts.

`und` with score 0 goes to null texts and texts without a letter, and to all texts where
nothing was learned. Ties go to the language first in order. Repeated rows score alike. Texts of any length
are read whole. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import Staged, held_out, read, small_batches
from palisade.llm.toxicity import ngrams

BITS, SIZES, PER_LANG, MAX_ROWS, CENTROIDS, REJECT = 14, (1, 2, 3), 600, 12_000, 3, 0.01
NOT_LETTERS = re.compile(r"[\W\d_]+")


def term_weights(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text's words, one blank between them and other characters left out, and their damped counts."""
    n = np.zeros(1 << BITS, np.int64)
    for part in ngrams(NOT_LETTERS.sub(" ", f" {text} "), SIZES, BITS):
        n += np.bincount(part, minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, 1 + np.log(n[at])


@dataclass
class Model:
    langs: list[str]  # by centroid
    centroids: np.ndarray  # n-grams by centroids
    idf: np.ndarray
    least: np.ndarray  # cosine below which a centroid rejects

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        at, tf = term_weights(text)
        x = tf * self.idf[at]
        cos = (x @ self.centroids[at]) / (np.sqrt(x @ x) or 1.0)
        best = int(np.argmax(cos))
        return self.langs[best], float(np.clip(cos[best], 0, 1)), bool(cos[best] < self.least[best])


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest points; rows of x have length 1."""
    first = [int(np.argmax(x @ x.mean(0)))]
    while len(first) < min(k, len(x)):
        first.append(int(np.argmin((x @ x[first].T).max(1))))
    c = x[first]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        c = np.stack([m / (np.linalg.norm(m) or 1) for m in (x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c)))])
    return c, np.argmax(x @ c.T, 1)


def train(docs: DataFrame, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS, centroids: int = CENTROIDS) -> Model:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # a language's rows below a hash threshold: no language passes through one task
    share = known.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("share")).orderBy("share", "lang").limit(max_rows)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) / (1 << 30)
    picked = known.select("doc_id", "lang", "text", place.alias("place")).join(F.broadcast(share), "lang").where("place < share")
    one = picked.groupBy("doc_id", "place").agg(F.min(F.struct("lang", "text")).alias("row"))
    one = Staged(one.select("doc_id", "place", "row.*"), "language-sample").df
    ids = one.select("doc_id", "place").orderBy("place", "doc_id").limit(max_rows).select("doc_id")
    sample = one.join(F.broadcast(ids), "doc_id")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = (c.to_pylist() for c in batch.columns)
            found = [(lang, *term_weights(t)) for lang, t in zip(langs, texts) if any(map(str.isalpha, t))]
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.float64()))], ["lang", "at", "tf"])

    small_batches(docs.sparkSession)
    rows = sample.select("lang", "text").mapInArrow(weighed, "lang string, at array<long>, tf array<double>").toPandas()  # max_rows rows, 2^BITS numbers each at most
    rows = rows.sort_values("lang", kind="stable")
    if not len(rows):
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(1 << BITS), np.zeros(0))
    terms = [(np.asarray(at), np.asarray(tf)) for at, tf in zip(rows['at'], rows['tf'])]
    seen = np.bincount(np.concatenate([at for at, _ in terms]), minlength=1 << BITS)
    idf = np.where(seen > 0, np.log((1 + len(terms)) / (1 + seen)) + 1e-3, 0.0)
    langs, cents, least = [], [], []
    for lang in sorted(rows.lang.unique()):
        own = [t for t, keep in zip(terms, (rows.lang == lang).to_numpy()) if keep]
        x = np.zeros((len(own), 1 << BITS), np.float32)
        for row, (at, tf) in zip(x, own):
            row[at] = tf * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        c, of = _clusters(x, centroids)
        near = (x * c[of]).sum(1)
        for i in range(len(c)):
            langs.append(lang)
            cents.append(c[i])
            least.append(float(np.quantile(near[of == i], REJECT)) if (of == i).any() else 0.0)
    return Model(langs, np.stack(cents, 1), idf, np.array(least))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score and rejected, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("rejected", T.BooleanType())

    @F.pandas_udf(kind)
    def found(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score", "rejected"])

    small_batches(docs.sparkSession)
    return docs.withColumn("__found", found("text")).select(*(c for c in docs.columns if c not in kind.names), "__found.lang_pred", "__found.score", "__found.rejected")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
