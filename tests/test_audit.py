"""The streamed trail: batches link to those before, a repeated batch changes nothing, forgeries show."""

import pytest
from pyspark.sql import functions as F

from palisade.operators.records import hashed
from palisade.streaming import audit

def body():
    return F.concat_ws("|", F.col("id").cast("string"), "text")


def batch(spark, lo, hi):
    return spark.range(lo, hi, 1, 3).select("id", F.when(F.col("id") % 3 != 0, F.when(F.col("id") % 10 != 0, "hot").otherwise("cold")).alias("who"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trail"))
    write = audit.appender(path, "who", "id", body(), block=16)
    write(batch(spark, 0, 200), 0)
    write(batch(spark, 200, 201), 1)  # one record of one group
    write(batch(spark, 0, 0), 2)
    write(batch(spark, 201, 500), 3)
    return path


def result(spark, place, change=lambda records, seals, heads: (records, seals, heads)):
    found = audit.verify(*change(*audit.trail(spark, place, 3)), "who", "id", body())
    return {r.who: (r.records, r.broken, r.broken_seals) for r in found.collect()}


def test_whole(spark, place):
    n = {r.who: r.n for r in batch(spark, 0, 500).fillna("", ["who"]).groupBy("who").agg(F.count("*").alias("n")).collect()}
    assert result(spark, place) == {who: (c, 0, 0) for who, c in n.items()}


def test_repeated_batch(spark, place):
    before = {r.id: r.hash for r in audit.trail(spark, place, 3)[0].collect()}
    audit.appender(place, "who", "id", body(), block=16)(batch(spark, 201, 500), 3)
    assert before == {r.id: r.hash for r in audit.trail(spark, place, 3)[0].collect()}
    assert all(v[1:] == (0, 0) for v in result(spark, place).values())


def test_forgeries(spark, place):
    hot = lambda change: result(spark, place, change)["hot"]
    text = F.when(F.col("id") == 7, "forged").otherwise(F.col("text"))
    assert hot(lambda r, s, h: (r.withColumn("text", text), s, h))[1:] == (1, 0)
    # with a new hash of its own: the next record's link, or its block's seal, no longer fits
    renewed = lambda r: r.withColumn("text", text).withColumn("hash", F.when(F.col("id") == 7, hashed(F.col("prev"), body())).otherwise(F.col("hash")))
    got = hot(lambda r, s, h: (renewed(r), s, h))
    assert got[1] + got[2] >= 1
    got = hot(lambda r, s, h: (r.where("id != 499 and id != 7"), s, h))
    assert got[1] + got[2] >= 1
    assert hot(lambda r, s, h: (r.where("block != 0"), s, h))[2] == 1
    # the last batch goes with its seals; a middle one too; a seal alone
    assert hot(lambda r, s, h: (r.where("batch < 3"), s.where("batch < 3"), h))[2] == 1
    assert result(spark, place, lambda r, s, h: (r.where("batch != 1"), s.where("batch != 1"), h))["cold"][2] == 1
    assert hot(lambda r, s, h: (r, s.where("batch != 0"), h))[2] >= 1
    assert hot(lambda r, s, h: (r.where("who != 'hot'"), s.where("who != 'hot'"), h)) == (0, 0, 1)


def test_missing_batch(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        audit.appender(str(tmp_path), "who", "id", body())(batch(spark, 0, 5), 4)
