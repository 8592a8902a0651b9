"""Documents taken in from a stream, with two outputs: chunks of masked text in a lasting index, and a quarantine for review.

Each micro-batch is normalised, passes the rails as whole documents, is masked, and only then cut into chunks, so nothing
that isn't masked is ever written. What is too long, blocked or empty goes to the quarantine and to no index; a document
that was indexed before and is quarantined now loses its chunks, one that comes again has its new chunks alone. Every
document leaves a record in the audit trail.

Every output of a batch has folders of its own, which a batch that runs again overwrites, and the index knows its
number, so restarts change nothing. Documents without an id go to the quarantine as such (`no id`); of rows that share an
id within a batch the one with the greatest text counts. An empty batch makes empty folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import retrieval, store
from palisade.plans.evaluate import MAX_CHARS
from palisade.plans.evaluate import ingest as scan
from palisade.streaming import audit

CHUNKS = "doc_id string, n int, chunk string"
DONE = "doc_id string, status string, reason string, verdict string, masked int, chunks int"


def _body():
    return F.concat_ws("|", "doc_id", "status", F.coalesce("reason", F.lit("")), "verdict", F.col("masked").cast("string"))


def ingester(path: str, max_chars: int = MAX_CHARS, size: int = retrieval.CHUNK, overlap: int = retrieval.OVERLAP) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that takes in batches (doc_id, title, text) below `path`, a shared folder with one checkpoint."""
    record = audit.appender(f"{path}/audit", "status", "doc_id", _body())

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            store.create(spark, f"{path}/index")
        rows = batch.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "text")
        named = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("text", "title")).alias("x")).select("doc_id", "x.title", "x.text")
        seen = scan(named.unionByName(rows.where("doc_id is null")), max_chars)
        no_id = F.col("doc_id").isNull()
        seen = seen.withColumn("reason", F.when(no_id, "no id").otherwise(F.col("reason"))).withColumn("status", F.when(no_id, "quarantined").otherwise(F.col("status")))
        masked = (F.size("terms") + F.size("found")).alias("masked")
        place = f"batch={number}"
        seen.select("doc_id", "title", "status", "reason", "verdict", masked, "text_out").write.mode("overwrite").parquet(f"{path}/scanned/{place}")
        seen = spark.read.parquet(f"{path}/scanned/{place}")
        good = seen.where("status = 'indexed'")
        cut = retrieval.cut(good.select("doc_id", "title", "text_out"), "text_out", size, overlap)
        cut.write.mode("overwrite").parquet(f"{path}/chunks/{place}")
        cut = spark.read.parquet(f"{path}/chunks/{place}")
        seen.where("status = 'quarantined'").select("doc_id", "title", "reason", "verdict", "text_out").write.mode("overwrite").parquet(f"{path}/quarantine/{place}")
        key = F.concat_ws("#", "doc_id", F.col("n").cast("string"))
        upserts = cut.select(key.alias("key"), F.concat_ws(" ", "title", "chunk").alias("text"))
        before = spark.read.parquet(f"{path}/chunks").where(F.col("batch") < number).join(seen.select("doc_id").distinct(), "doc_id", "left_semi").select(key.alias("key"))
        store.change(spark, f"{path}/index", upserts, before.join(upserts.select("key"), "key", "left_anti"), number)
        record(seen.where("doc_id is not null").select("doc_id", "status", "reason", "verdict", "masked"), number)

    return write


def run(docs: DataFrame, path: str, **limits: int) -> None:
    """Takes in all that the stream `docs` (doc_id, title, text) holds."""
    docs.writeStream.foreachBatch(ingester(path, **limits)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def outcome(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, status, reason, verdict, masked, chunks, batch) of each document as it came last; chunks are those in the index."""
    every = spark.read.parquet(f"{path}/scanned").drop("text_out", "title").where("doc_id is not null")
    newest = every.groupBy("doc_id").agg(F.max_by(F.struct("status", "reason", "verdict", "masked", "batch"), "batch").alias("x")).select("doc_id", "x.*")
    chunks = store.live(spark, f"{path}/index").select(F.substring_index("key", "#", 1).alias("doc_id")).groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"))
    return newest.join(chunks, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
