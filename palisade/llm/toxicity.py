"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training reads a bounded sample of labelled rows (`MAX_ROWS`, in the order of a hash of
the id). Counts of texts with an n-gram, by label, give each hashed n-gram its log-count
ratio; the `FEATURES` with the largest likelihood-ratio statistics stay, and a logistic
regression with an L2 penalty is fitted on presence times ratio. Scoring reads whole
texts and depends on the text alone.

Null texts score as empty ones, which have no n-grams and get the intercept's score. Texts
of any length are read whole, some places at a time. Rows that repeat score alike; in
training, rows of one doc_id are one row, with the least of their texts and the largest of
their labels. Of n-grams with equal statistics the least hash stays. An empty table gives
an empty table. Without labels of both kinds every score is the base rate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import Staged, held_out, read, small_batches

BITS, SIZES, MAX_ROWS, FEATURES = 20, (3, 4, 5, 6), 20_000, 3_000
THRESHOLD = 0.3
BLOCK, PLACES = 1 << 18, 1 << 16


def ngrams(text: str | None, sizes=SIZES, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text's code points, one for each place and size, for `PLACES` places at a time."""
    low = (text or "").lower()
    for lo in range(0, len(low), PLACES):
        c = np.frombuffer(low[lo : lo + PLACES + max(sizes) - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for k in range(1, max(sizes) + 1):
            if len(c) < k:
                break
            h = h[: len(c) - k + 1] * np.uint64(0x100000001B3) + c[k - 1 :] + np.uint64(k)
            if k in sizes:
                yield ((h[:PLACES] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def present(text: str | None, chosen: np.ndarray | None = None) -> np.ndarray:
    """The distinct n-grams of a text, or those of them that `chosen` marks."""
    found = [np.unique(at if chosen is None else at[chosen[at]]) for at in ngrams(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    weight: np.ndarray  # by hashed n-gram; 0 for those left out
    bias: float
    chosen: np.ndarray | None = None  # where the weight isn't 0

    def score(self, text: str | None) -> float:
        at = present(text, self.weight != 0 if self.chosen is None else self.chosen)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[at].sum(), -30, 30))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    rows = [0, 0]
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows[label] += 1
            counts[label][present(text)] += 1
    at = np.flatnonzero(counts[0] + counts[1])  # rare ones too: other tasks may have them
    whole = [pa.array([-1]), pa.array(rows[:1]), pa.array(rows[1:])]
    yield pa.RecordBatch.from_arrays(whole, ["feature", "neg", "pos"])
    for i in range(0, len(at), BLOCK):
        part = at[i : i + BLOCK]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0][part]), pa.array(counts[1][part])], ["feature", "neg", "pos"])


def totals(rows: DataFrame) -> DataFrame:
    """(feature, neg, pos) over all `rows` (text, toxic), whatever their partitions; feature -1 counts the rows."""
    return rows.mapInArrow(_counts, "feature long, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


def _fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps on presence * ratio, over blocks of entries."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    n, w, b = len(y), np.zeros(len(ratio)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))

    def added(to: np.ndarray, values: np.ndarray, by: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for i in range(0, len(to), BLOCK):
            out += np.bincount(to[i : i + BLOCK], values[by[i : i + BLOCK]], minlength=size)
        return out

    lip = 0.25 * max(1.0, float(added(row, ratio**2, at, n).mean()) * 4) + penalty
    v, vb, w0, b0 = w.copy(), b, w.copy(), b
    for t in range(steps):
        z = vb + added(row, ratio * v, at, n)
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        w = v - (ratio * added(at, g, row, len(ratio)) / n + penalty * v) / lip
        b = vb - g.mean() / 0.25 / 4
        k = t / (t + 3)
        v, vb, w0, b0 = w + k * (w - w0), b + k * (b - b0), w, b
    return w * ratio, b


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, features: int = FEATURES, penalty: float = 1e-4) -> Model:
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = Staged(rows.select("text", "toxic"), "toxicity-sample").df
    counts = Staged(totals(rows).where("feature = -1 or neg + pos >= 4"), "toxicity-counts").df
    whole = counts.where("feature = -1").first()
    neg, pos = (float(whole[k]) if whole else 0.0 for k in ("neg", "pos"))
    weight = np.zeros(1 << BITS)
    if not neg or not pos:
        return Model(weight, 5.0 if pos else -5.0)
    p, q, both = (F.col("pos") + 1) / (pos + 2), (F.col("neg") + 1) / (neg + 2), (F.col("pos") + F.col("neg") + 2) / (pos + neg + 4)
    gain = pos * (p * F.log(p / both) + (1 - p) * F.log((1 - p) / (1 - both))) + neg * (q * F.log(q / both) + (1 - q) * F.log((1 - q) / (1 - both)))
    best = counts.where("feature >= 0").select("feature", F.log(p / q).alias("ratio"), gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(features).toPandas()
    at, ratio = best.feature.to_numpy(np.int64), best.ratio.to_numpy(float)
    place = np.full(1 << BITS, -1, np.int32)
    place[at] = np.arange(len(at), dtype=np.int32)

    taken = place >= 0

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                found.append(np.unique(place[present(t, taken)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1).cast(pa.int64())], ["f", "y"])

    small_batches(spark)
    fit = rows.mapInArrow(chosen, "f array<int>, y long").toPandas()  # max_rows rows, `features` numbers each at most
    w, b = _fit([np.asarray(f, np.int32) for f in fit.f], fit.y.to_numpy(float), ratio, penalty)
    weight[at] = w
    return Model(weight, b, weight != 0)


def scorer(spark: SparkSession, model: Model) -> Callable[[Column | str], Column]:
    """A function from a text column to its scores."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype="float64")

    small_batches(spark)
    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score`, which replaces a column of that name."""
    return docs.withColumn("score", scorer(docs.sparkSession, model)("text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
