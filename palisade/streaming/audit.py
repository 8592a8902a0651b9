"""An audit trail that a stream appends to, batch by batch, and its verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.operators.records import BLOCK, chain, hashed, start

#: Blocks of one group in one batch; a batch number is a multiple of it.
SHARES = 1 << 24


def _grouped(rows: DataFrame, group: str) -> DataFrame:
    return rows.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("")))


def _ends(chained: DataFrame, group: str, order: str) -> DataFrame:
    """Per group and batch: records, and a digest of each block's count and last hash."""
    blocks = chained.groupBy(group, "batch", "block").agg(F.count("*").alias("c"), F.max_by("hash", order).alias("last"))
    digest = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("block", "c", "last")))), 256)
    return blocks.groupBy(group, "batch").agg(F.sum("c").alias("n"), digest.alias("ends"))


def _seal(prev: Column) -> Column:
    return hashed(prev, F.concat_ws("|", F.col("batch").cast("string"), F.col("n").cast("string"), "ends"))


def _first(group: str) -> Column:
    return F.sha2(F.col(group), 256)


def appender(path: str, group: str, order: str, body: Column, block: int = BLOCK) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that adds each batch to the trail in `path`, a shared folder with one checkpoint.

    A group's records of a batch are dealt by hash of `order` (unique in the group) to blocks of about `block`
    records, each a chain of its own; one seal per group and batch covers its blocks and the group's seal before.
    A batch that runs again overwrites its own folders, so each record is there once. Of earlier batches only
    the last seals are read, one row a group. A null group is the group ''."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, _grouped(batch, group)
        shares = rows.groupBy(group).agg(F.ceil(F.count("*") / block).alias("__shares"))
        share = F.pmod(F.xxhash64(order), F.col("__shares"))
        dealt = rows.join(shares, group).withColumn("__block", F.lit(batch_id).cast("long") * SHARES + share).drop("__shares")
        chain(dealt, group, order, body, F.col("__block")).drop("__block").write.mode("overwrite").parquet(f"{path}/records/batch={batch_id}")
        kept = spark.read.parquet(f"{path}/records/batch={batch_id}").withColumn("batch", F.lit(batch_id).cast("long"))
        ends = _ends(kept, group, order)
        if batch_id:
            before = spark.read.parquet(f"{path}/heads/at={batch_id - 1}")
            prev = before.select(group, F.col("hash").alias("prev"))
            new = ends.join(prev, group, "left").withColumn("prev", F.coalesce("prev", _first(group)))
            old = before.join(ends, group, "left_anti")
        else:
            new, old = ends.withColumn("prev", _first(group)), None
        new = new.withColumn("hash", _seal(F.col("prev")))
        (new.unionByName(old) if old else new).write.mode("overwrite").parquet(f"{path}/heads/at={batch_id}")
        heads = spark.read.parquet(f"{path}/heads/at={batch_id}")
        heads.where(F.col("batch") == batch_id).write.mode("overwrite").parquet(f"{path}/seals/at={batch_id}")

    return write


def trail(spark: SparkSession, path: str, last: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, seals and the newest seals of all groups after the batch numbered `last`."""
    records = spark.read.parquet(f"{path}/records").withColumn("batch", F.col("batch").cast("long"))
    return records, spark.read.parquet(f"{path}/seals").drop("at"), spark.read.parquet(f"{path}/heads/at={last}")


def verify(records: DataFrame, seals: DataFrame, heads: DataFrame, group: str, order: str, body: Column) -> DataFrame:
    """Per group: records, those whose content or link is broken, and seals that are broken, missing or too many."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(group, "block").orderBy(order)), start(group))
    checked = records.withColumn("bad", ~(hashed(F.col("prev"), body).eqNullSafe(F.col("hash")) & F.col("prev").eqNullSafe(before)))
    counts = checked.groupBy(group).agg(F.count("*").alias("records"), F.count_if("bad").alias("broken"))
    found = _ends(records, group, order).withColumnsRenamed({"n": "found_n", "ends": "found_ends"})
    link = F.coalesce(F.lag("hash").over(Window.partitionBy(group).orderBy("batch")), _first(group))
    whole = (F.col("prev") == link) & (_seal(F.col("prev")) == F.col("hash")) & F.col("found_n").eqNullSafe(F.col("n")) & F.col("found_ends").eqNullSafe(F.col("ends"))
    sealed = seals.withColumn("known", F.lit(True)).join(found, [group, "batch"], "full").withColumn("good", F.coalesce(whole & F.col("known"), F.lit(False)))
    tops = sealed.groupBy(group).agg(F.count_if(~F.col("good")).alias("bad_seals"), F.max_by("hash", "batch").alias("top"))
    ends = tops.join(heads.select(group, F.col("hash").alias("head")), group, "full")
    ended = F.col("top").eqNullSafe(F.col("head")).cast("int")
    out = ends.select(group, (F.coalesce("bad_seals", F.lit(0)) + 1 - ended).alias("broken_seals")).join(counts, group, "full")
    return out.select(group, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("records", "broken", "broken_seals")))
