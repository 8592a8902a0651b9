"""Windowed counts over event streams; every function takes a stream or a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def timed(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events with a zoned timestamp and a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    out = timed(events).groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.abs("value"))).alias("used"))
    return out.select(F.col("window.start").alias("start"), "user_id", "n", "used")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    out = timed(events).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select(F.col("window.start").alias("start"), "n", "errors")


def by_session(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    out = timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), "user_id", "n")


def newest(counts: DataFrame, place: str, *keys: str) -> DataFrame:
    """Run a stream of windowed counts over all that its source holds, in update mode, and give the newest row of each key.

    Groups behind the watermark leave the state, and rows later than that are not counted. `place` is a shared
    folder; a batch that runs again overwrites its own part. Session windows have no update mode in Spark."""

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={n}")

    spark = counts.sparkSession
    spark.createDataFrame([], counts.schema).write.mode("overwrite").parquet(f"{place}/out/batch=-1")  # a source without rows has no batch
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*counts.schema, T.StructField("batch", T.LongType())])).parquet(f"{place}/out")
    rest = F.struct(*(c for c in counts.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.max_by(rest, "batch").alias("x")).select(*keys, "x.*")
