"""Queries over lexicons, lasting indexes and states that live on between batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palisade.operators import lexicon, store
from palisade.sources.carriers import shared_folder, table
from palisade.streaming import ingest, state


def _terms(spark, d):
    """All words of benchmark items that have letters or digits, all neighbouring pairs of them, and all items' ends of three."""
    w = table(spark, d, "benchmark").select(F.explode(F.array(F.split("text", " "))).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))
    last = F.array(F.array_join(F.slice("w", F.size("w") - 2, 3), " "))
    return w.where(F.size("w") > 2).select(F.explode(F.concat("w", pairs, last)).alias("term")).where(F.col("term").rlike("[A-Za-z0-9]"))


def q117_large_lexicon(spark, d):
    allow = table(spark, d, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("term"))
    out = lexicon.hits(table(spark, d, "documents").select("doc_id", "text"), _terms(spark, d), allow)
    return out.select("doc_id", F.size("hits").cast("long").alias("n"), F.size(F.array_distinct("hits.value")).cast("long").alias("terms"), F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["start"]).alias("starts"))


def _changed_index(spark, d):
    """An index of all documents; then some get other texts, some go, and some of these come back; then one snapshot and more changes."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    path = store.built(docs, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    store.change(spark, path, docs.where("key % 5 = 0").withColumn("text", F.concat("text", F.lit(" permit licence"))), docs.where("key % 7 = 0 and key % 5 <> 0"))
    store.change(spark, path, docs.where("key % 21 = 0"), docs.where("key % 11 = 0 and key % 21 <> 0"))
    return path


def q118_index_after_changes(spark, d):
    words = F.slice(F.split("text", " "), 1, 12)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text"))
    return store.search(spark, _changed_index(spark, d), q).withColumnRenamed("key", "doc_id")


def q119_index_sums(spark, d):
    path = _changed_index(spark, d)
    before = store.totals(spark, path)
    store.compact(spark, path)
    assert store.totals(spark, path) == before
    rows = store.live(spark, path)
    return rows.agg(F.count("*").alias("units"), F.sum("length").alias("length"), F.sum(F.size("terms")).cast("long").alias("postings"))


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


def _place(spark):
    return f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"


def q120_stream_approvals(spark, d):
    """Every other event parks a call of its user; claims follow within an hour, some by others, some a second time, some not at all."""
    i, at = F.col("event_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    after = lambda s: F.timestamp_seconds(F.unix_timestamp(at) + s)
    row = lambda kind, who, when: F.struct(F.col("user_id").cast("string").alias("scope"), F.lit(kind).alias("kind"), i.cast("string").alias("token"), who.cast("string").alias("who"), when.alias("at"))
    other = F.col("user_id") + (i % 14 == 0).cast("int")
    rows = F.array(row("park", F.col("user_id"), at), row("claim", other, after(i * 37 % 1800 * 2 + 1)), row("claim", F.col("user_id"), after(i * 53 % 2700 * 2 + 2)))
    keep = F.filter(rows, lambda r: (r["kind"] == "park") | (i % 6 != 0))
    events = _event_stream(spark, d).where(i % 2 == 0).select(F.explode(keep).alias("r")).select("r.*")
    return state.collected(state.approvals(events), _place(spark)).groupBy("scope", "outcome").agg(F.count("*").alias("n"))


def q121_stream_budgets(spark, d):
    """The daily ceiling as it is reached: q39 over a stream."""
    tokens = F.floor(F.abs("value") * 10).cast("long") + F.col("event_id") % 977
    usage = _event_stream(spark, d).select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("at"), tokens.alias("tokens"))
    out = state.collected(state.budgets(usage, {"daily": 1500, "monthly": 40_000}), _place(spark))
    return out.select(F.col("user").cast("long").alias("user_id"), "window", "period", "used")


def q122_ingest_outputs(spark, d):
    """All documents taken in by a stream: where each went, and that it is there and nowhere else."""
    schema, path = table(spark, d, "documents").schema, _place(spark)
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parquet*")
    ingest.run(docs.select("doc_id", F.lit("").alias("title"), "text"), path)
    out = ingest.outcome(spark, path)
    kept = spark.read.parquet(f"{path}/quarantine").select("doc_id").distinct().withColumn("kept", F.lit(True))
    noted = spark.read.parquet(f"{path}/audit/records").select("doc_id").distinct().withColumn("noted", F.lit(True))
    cut = spark.read.parquet(f"{path}/chunks").select("doc_id").distinct().withColumn("cut", F.lit(True))
    out = out.join(kept, "doc_id", "left").join(noted, "doc_id", "left").join(cut, "doc_id", "left")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "status", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("cut", F.lit(False)).alias("indexed"), F.coalesce("kept", F.lit(False)).alias("quarantined"), F.coalesce("noted", F.lit(False)).alias("audited"))
