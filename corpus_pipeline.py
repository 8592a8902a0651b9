"""A training corpus from raw documents: each stage works on all that the one before kept.

Toxic documents go, one document of each group of near copies stays, passages that repeat
across what is left are removed, personal data gets surrogates, and the texts are packed.

Null and empty texts are no toxic ones, link with nothing, hold no passage and no data, and are packed as one end id
each. Rows that repeat an id and its text are one row after the second stage; other texts under one id are documents of
their own, and rows with a null id come behind those with one. Among linked documents the least id stays. A text may have any length.
All but the last stage return the columns of the documents, whatever their names. An empty table gives no sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import jaccard_join, packing, pii_surrogates, substring_dedup, toxicity
from palisade.llm.common import Staged, read, scratch

PASSAGE = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)("text") < toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, k=5, num=4, den=5, null_ids=True)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(docs, width=PASSAGE, keep_text=True)
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.when(F.col("row.text").isNotNull(), F.col("left"))}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("n_removed") > 0, F.length("left").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*(v.alias(c) for c, v in cols.items()))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = docs.select("text", F.struct(*docs.columns).alias("row"))
    out = pii_surrogates.replace(kept, pii_surrogates.QUERY_KEY)
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(cols["n_chars"])
    return out.select(*(v.alias(c) for c, v in cols.items()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: Trained scores, near copies, tokenizers: not for SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as own:
            done = Staged(stage(spark, docs, sf_dir), f"stage-{name}")
            own.remove(done)
        if last:
            last.drop()
        docs, last = done.df, done
    return STAGES[-1][1](spark, docs, sf_dir)
