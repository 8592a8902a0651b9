"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII blanks.
BLANKS = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or else the context's checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


_scopes: list[list[Staged]] = []


class Staged:
    """A written table in the shared folder: it cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.schema = df.sparkSession, df.schema  # known: no job to read it from files
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        if _scopes:
            _scopes[-1].append(self)
        df.write.option("compression", "zstd").parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[list[Staged]]:
    """Deletes at its end the tables staged within it, but for those taken out of the list that it
    gives: whatever depends on them must be written by then."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for staged in _scopes.pop():
            staged.drop()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds; texts are whole and may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def held_out(doc_id: Column) -> Column:
    """Rows that no training may read: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def once(column: Column) -> Column:
    """To be selected by itself: it generates the one row that there is, so that what follows refers to the result
    and no optimiser puts the expression into a loop over the elements of its own result."""
    return F.explode(F.array(column))


class IdFilter:
    """A bitmap of fixed size over hashed keys: it may let other keys through, never drops one of its own.

    It is broadcast as a table of at most BITS / 64 rows, whatever the data. Where it fills
    up, more rows take the exact join that follows it, and results stay the same.
    """

    BITS = 1 << 23

    def __init__(self, keys: DataFrame, col: str):
        words = keys.select(self._bit(col).alias("b")).groupBy(F.shiftright("b", 6).alias("__word"))
        words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("__bits"))
        self.words = F.broadcast(Staged(words, "bitmap").df)

    def _bit(self, col: str) -> Column:
        return F.pmod(F.xxhash64(F.col(col)), F.lit(self.BITS))

    def mark(self, rows: DataFrame, col: str, name: str) -> DataFrame:
        """`rows` with a boolean column: the key may be among those of the bitmap."""
        found = rows.join(self.words, F.shiftright(self._bit(col), 6) == F.col("__word"), "left")
        hit = F.getbit(F.col("__bits"), F.pmod(self._bit(col), F.lit(64)).cast("int")) == 1
        return found.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__word", "__bits")

    def keep(self, rows: DataFrame, col: str) -> DataFrame:
        return self.mark(rows, col, "__hit").where("__hit").drop("__hit")
