"""Word sequences of reference texts found again in documents, by broadcast suffix automata.

The reference is dealt into shards of about `shard_words` words. Each shard's automaton is
built in a Spark task, is broadcast by itself (its size is bounded by the shard's), and all
documents stream past it: the walk keeps the longest match that ends at each word, cut to
`width` words, so it stands for every maximal span of that length or more. The shards'
counts are added up per window.

One pass over the documents per shard: right for a reference of bounded size, such as a
benchmark. A corpus held against itself has shards in proportion to its size, so the work
grows with its square; `substring_dedup` is for that.

Null and empty texts have no words: they are in no shard, match nothing and stay as they are.
A text longer than a shard is a shard of its own, together with what hash dealing puts there.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Staged, small_batches

SHARD_WORDS = 100_000


class Automaton:
    """Suffix automaton over words, with the number of places where each state's sequences end.
    A text with a weight counts that many times."""

    def __init__(self, texts: list[list[bytes]], weights: list[int] | None = None):
        self.ids: dict[bytes, int] = {}
        steps, link, length, count = [{}], [-1], [0], [0]
        for words, weight in zip(texts, weights or [1] * len(texts)):
            last = 0  # each text starts at the root: no sequence crosses from one text to another
            for w in words:
                c = self.ids.setdefault(w, len(self.ids))
                have = steps[last].get(c)
                if have is not None and length[have] == length[last] + 1:
                    last = have
                    count[last] += weight
                    continue
                split_only = have is not None
                cur = -1
                if not split_only:
                    cur = len(steps)
                    steps.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    count.append(weight)
                p = last
                while p >= 0 and c not in steps[p]:
                    steps[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = steps[p][c]
                    if length[q] != length[p] + 1:
                        copy = len(steps)
                        steps.append(dict(steps[q]))
                        link.append(link[q])
                        length.append(length[p] + 1)
                        count.append(0)
                        while p >= 0 and steps[p].get(c) == q:
                            steps[p][c] = copy
                            p = link[p]
                        link[q] = q = copy
                    if split_only:
                        count[q] += weight
                        cur = q
                    else:
                        link[cur] = q
                last = cur
        for v in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
            count[link[v]] += count[v]
        self.steps, self.link, self.length, self.count = steps, link, length, count

    def windows(self, words: list[bytes], width: int) -> tuple[list[int], list[int]]:
        """Starts of the windows found in the reference, and how often each is there."""
        at, often, state, have = [], [], 0, 0
        steps, link, length = self.steps, self.link, self.length
        for i, w in enumerate(words):
            c = self.ids.get(w)
            if c is None:
                state = have = 0
                continue
            to = steps[state].get(c)
            while to is None and state:
                state = link[state]
                have = length[state]
                to = steps[state].get(c)
            if to is None:
                continue
            state, have = to, have + 1
            if have >= width:
                have = width
                while length[link[state]] >= width:
                    state = link[state]
                at.append(i - width + 1)
                often.append(self.count[state])
        return at, often


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def windows(docs: DataFrame, reference: DataFrame, width: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, at, times): the places of `docs` (doc_id, text) where `width` words stand that
    the texts of `reference` hold `times` times. Only places with times > 0 have a row. Rows
    that share a doc_id add up, so ids should be unique."""
    spark = docs.sparkSession
    small_batches(spark)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    texts = reference.select("text").where(words >= width)
    total = texts.agg(F.sum(words)).first()[0] or 0
    n = math.ceil(total / shard_words)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "automaton": [pickle.dumps(Automaton([_words(t) for t in rows["text"]]), protocol=5)]})

    spread = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(max(n, 1))).cast("int")
    built = Staged(texts.withColumn("shard", spread).groupBy("shard").applyInPandas(build, "shard int, automaton binary"), "automata").df
    parts = []
    for shard in range(n):
        row = built.where(F.col("shard") == shard).first()
        if row is None:
            continue
        sent = spark.sparkContext.broadcast(bytes(row.automaton))

        def match(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            known = pickle.loads(sent.value)
            for batch in batches:
                found = [known.windows(_words(t), width) for t in batch["text"]]
                yield pd.DataFrame({"doc_id": batch["doc_id"], "at": [np.array(a, np.int64) for a, _ in found], "times": [np.array(b, np.int64) for _, b in found]})

        hits = docs.select("doc_id", "text").mapInPandas(match, "doc_id long, at array<long>, times array<long>")
        parts.append(Staged(hits.where(F.size("at") > 0), f"matches-{shard}").df)
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], "doc_id long, at long, times long")
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    places = every.select("doc_id", F.explode(F.arrays_zip("at", "times")).alias("x"))
    return places.groupBy("doc_id", F.col("x.at").alias("at")).agg(F.sum("x.times").alias("times"))


def remove_known(docs: DataFrame, reference: DataFrame, width: int = 35, least: int = 1, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`docs` (doc_id, text) with columns n_removed and left: each text without the words of its
    spans of `width` or more words that `reference` holds `least` times or more. With the
    documents as their own reference and least=2 that removes what repeats among them."""
    found = windows(docs, reference, width, shard_words).where(F.col("times") >= least).groupBy("doc_id").agg(F.collect_list("at").alias("__at"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_removed, left = [], []
            for text, at in zip(batch["text"], batch["__at"]):
                words = _words(text)
                step = np.zeros(len(words) + 1, np.int64)
                if at is not None:
                    np.add.at(step, at, 1)
                    np.add.at(step, at + width, -1)
                gone = np.cumsum(step[:-1]) > 0
                n_removed.append(int(gone.sum()))
                left.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode() if gone.any() else text)
            yield batch.drop(columns="__at").assign(n_removed=n_removed, left=left)

    schema = docs.select("doc_id", "text").schema.add("n_removed", "long").add("left", "string")
    return docs.select("doc_id", "text").join(found, "doc_id", "left").mapInPandas(cut, schema)
