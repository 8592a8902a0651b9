"""A lasting inverted index in a shared folder: segments of postings, tombstones, running sums, and whole snapshots.

Every change is a segment with a generation, in folders of its own: `forward` (a unit's terms), `postings` (by buckets
of terms), `gone` (keys that the change replaces or deletes), `df` and `totals` (what it adds to document frequencies,
units and lengths). A row of an older generation whose key is gone later is dead; nothing is rewritten. The newest
manifest names the segments that make up the index, so a reader sees a whole state, a change that broke off is
not seen, and one that runs again overwrites its own folders. `compact` writes the live rows as one new segment
and swaps it in. One writer at a time; readers need no lock.

A null text has no terms but its key is there, so it replaces what it had; rows with a null key are left out. Of rows
that repeat a key within a change the greatest text counts. Units without terms are not found and don't count in
the averages. An empty change makes an empty segment.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.operators import retrieval

BUCKETS = 64
#: Terms of queries that a broadcast may have; beyond it both sides are shuffled.
BROADCAST = 200_000
MANIFEST = "generation long, folder string"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _write_manifest(spark: SparkSession, path: str, version: int, segments: list[tuple[int, str]]) -> None:
    rows = spark.createDataFrame([(version, g, f) for g, f in segments] or [(version, None, None)], f"version long, {MANIFEST}")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/at={version}")


def create(spark: SparkSession, path: str) -> None:
    """An empty index in a folder that has none."""
    _write_manifest(spark, path, 0, [])
    _none(spark, "key string").write.mode("overwrite").parquet(f"{path}/installed/at=-1")


def segments(spark: SparkSession, path: str) -> tuple[int, list[tuple[int, str]]]:
    """Version of the newest manifest and its segments, by generation; few, as `compact` makes them one."""
    rows = spark.read.schema(f"version long, {MANIFEST}").parquet(f"{path}/manifest")
    newest = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).collect()
    return newest[0].version, sorted((r.generation, r.folder) for r in newest if r.folder is not None)


def _read(spark: SparkSession, path: str, parts: list[tuple[int, str]], name: str, schema: str) -> DataFrame:
    """One table of all segments, with the generation of each."""
    each = [spark.read.schema(schema).parquet(f"{path}/{folder}/{name}").withColumn("generation", F.lit(g).cast("long")) for g, folder in parts]
    return reduce(DataFrame.unionByName, each) if each else _none(spark, f"{schema}, generation long")


#: A unit's terms and how often it has each are strings with blanks between, as nested values take longer to write and to read.
FORWARD = "key {kind}, length long, terms string, tfs string"
POSTINGS = "term string, n long, keys array<{kind}>, tfs array<long>, lengths array<long>, bucket int"


def _kind(spark: SparkSession, path: str, parts: list[tuple[int, str]]) -> str:
    return spark.read.parquet(f"{path}/{parts[0][1]}/forward").schema["key"].dataType.simpleString() if parts else "string"


def _alive(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """`rows` (key, generation) without those whose key goes in a later generation."""
    last = gone.groupBy("key").agg(F.max("generation").alias("gone_at"))
    return rows.join(last, "key", "left").where(F.col("gone_at").isNull() | (F.col("gone_at") <= F.col("generation"))).drop("gone_at")


def live(spark: SparkSession, path: str) -> DataFrame:
    """(key, length, terms) of the units that the index holds now; `terms` are pairs (term, tf)."""
    terms = F.arrays_zip(F.split("terms", " ").alias("term"), F.split("tfs", " ").cast("array<bigint>").alias("tf"))
    return _live(spark, path).select("key", "length", terms.alias("terms"))


def _live(spark: SparkSession, path: str) -> DataFrame:
    """The same rows as they are kept."""
    _, parts = segments(spark, path)
    kind = _kind(spark, path, parts)
    rows = _read(spark, path, parts, "forward", FORWARD.format(kind=kind)).where("length > 0")
    return (_alive(rows, _read(spark, path, parts[1:], "gone", f"key {kind}")) if len(parts) > 1 else rows).drop("generation")


def _write_forward(place: str, forward: DataFrame) -> DataFrame:
    forward.write.mode("overwrite").parquet(f"{place}/forward")
    return forward.sparkSession.read.schema(forward.schema).parquet(f"{place}/forward")


def _write_postings(place: str, forward: DataFrame) -> DataFrame:
    """Writes the blocks of `forward` by buckets; gives back (term, df) of each, to be added up."""
    rows = retrieval.postings(forward).withColumn("bucket", _bucket(F.col("term")))
    # a bucket with much is split by the tasks that made its blocks, whatever its terms; searches read a bucket whole, so its rows aren't sorted by term
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{place}/postings")
    return forward.sparkSession.read.schema("term string, n long, bucket int").parquet(f"{place}/postings").select("term", F.col("n").alias("df"))


def change(spark: SparkSession, path: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, generation: int | None = None) -> int:
    """Put the units `upserts` (key, text) in place of what their keys had, and take out `deletes` (key); the generation.

    With a `generation` of the caller's (a batch number, say) a change that is in the index already does nothing."""
    version, parts = segments(spark, path)
    last = parts[-1][0] if parts else -1
    if generation is not None and generation <= last:
        return generation
    g = last + 1 if generation is None else generation
    folder = f"segment-{g}"
    place = f"{path}/{folder}"
    given = upserts if upserts is not None else deletes.select("key", F.lit(None).cast("string").alias("text")).limit(0)
    given = given.where(F.col("key").isNotNull())
    forward = _write_forward(place, retrieval.bags(given, "key", "text", empty=True, joined=True))
    if not forward.groupBy("key").count().where("count > 1").isEmpty():
        forward = _write_forward(place, retrieval.bags(given.groupBy("key").agg(F.max("text").alias("text")), "key", "text", empty=True, joined=True))
    added = _write_postings(place, forward)
    gone = forward.select("key")
    if deletes is not None:
        gone = gone.unionByName(deletes.select("key").where(F.col("key").isNotNull())).distinct()
    gone.write.mode("overwrite").parquet(f"{place}/gone")
    gone = spark.read.schema(gone.schema).parquet(f"{place}/gone")
    kind = forward.schema["key"].dataType.simpleString()
    # of what the index holds only the rows whose keys go now are looked at further
    before = _read(spark, path, parts, "forward", FORWARD.format(kind=kind)).where("length > 0").join(gone, "key", "left_semi")
    killed = _alive(before, _read(spark, path, parts, "gone", f"key {kind}").join(gone, "key", "left_semi"))
    signed = added.unionByName(killed.select(F.explode(F.split("terms", " ")).alias("term"), F.lit(-1).cast("long").alias("df")))
    signed.groupBy("term").agg(F.sum("df").alias("df")).where("df != 0").withColumn("bucket", _bucket(F.col("term"))).write.mode("overwrite").parquet(f"{place}/df")
    sums = forward.where("length > 0").select("length", F.lit(1).cast("long").alias("units")).unionByName(killed.select((-F.col("length")).alias("length"), F.lit(-1).cast("long").alias("units")))
    sums.agg(F.coalesce(F.sum("units"), F.lit(0).cast("long")).alias("units"), F.coalesce(F.sum("length"), F.lit(0).cast("long")).alias("length")).write.mode("overwrite").parquet(f"{place}/totals")
    _write_manifest(spark, path, version + 1, [*parts, (g, folder)])
    return g


def compact(spark: SparkSession, path: str) -> None:
    """One segment of the live rows in place of all; the swap is the new manifest, and older folders stay for readers that began before."""
    version, parts = segments(spark, path)
    if not parts:
        return
    g, folder = parts[-1][0], f"snapshot-{parts[-1][0]}-{uuid.uuid4().hex}"
    place = f"{path}/{folder}"
    forward = _write_forward(place, _live(spark, path))
    rows = _write_postings(place, forward)
    forward.select("key").limit(0).write.parquet(f"{place}/gone")
    rows.groupBy("term").agg(F.sum("df").alias("df")).withColumn("bucket", _bucket(F.col("term"))).write.parquet(f"{place}/df")
    forward.agg(F.count("*").alias("units"), F.coalesce(F.sum("length"), F.lit(0).cast("long")).alias("length")).write.parquet(f"{place}/totals")
    _write_manifest(spark, path, version + 1, [(g, folder)])


def install(spark: SparkSession, path: str, builtins: DataFrame) -> None:
    """Add the units `builtins` (key, text) that this index was never given: one that somebody deleted stays deleted,
    and one whose key is in use is only noted."""
    version, parts = segments(spark, path)
    given = spark.read.schema("key string").parquet(f"{path}/installed")
    fresh = builtins.withColumn("__name", F.col("key").cast("string")).join(given.select(F.col("key").alias("__name")).distinct(), "__name", "left_anti")
    place = f"{path}/installed/at={version}"
    fresh.select(F.col("__name").alias("key")).write.mode("overwrite").parquet(f"{path}/noted-{version}")
    held = live(spark, path).select("key") if parts else fresh.select("key").limit(0)
    change(spark, path, fresh.drop("__name").join(held, "key", "left_anti"))
    # noted after the change is seen: if it breaks off between, the units are in use and the next call only notes them
    spark.read.schema("key string").parquet(f"{path}/noted-{version}").write.mode("overwrite").parquet(place)


def totals(spark: SparkSession, path: str) -> tuple[int, int]:
    """Units with terms and their summed length; one row a segment."""
    _, parts = segments(spark, path)
    row = _read(spark, path, parts, "totals", "units long, length long").agg(F.sum("units"), F.sum("length")).first()
    return row[0] or 0, row[1] or 0


def _asked(queries: DataFrame) -> tuple[DataFrame, bool]:
    """(query_id, n_terms, term, bucket), and whether they are few enough to broadcast."""
    q = queries.select("query_id", F.array_distinct(retrieval.terms(F.col("text"))).alias("q")).where(F.size("q") > 0)
    q = q.select("query_id", F.size("q").alias("n_terms"), F.explode("q").alias("term")).withColumn("bucket", _bucket(F.col("term")))
    return q, q.limit(BROADCAST + 1).count() <= BROADCAST


def _hits(spark: SparkSession, path: str, wanted: DataFrame, few: bool) -> DataFrame:
    """`wanted` (term, bucket, ...) with (key, tf, length) of the live postings of each term, and no others: the terms are joined
    first, and buckets that hold none of them are not read."""
    _, parts = segments(spark, path)
    kind = _kind(spark, path, parts)
    asked = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # BUCKETS numbers at most: other folders are not read
    rows = _read(spark, path, parts, "postings", POSTINGS.format(kind=kind)).where(F.col("bucket").isin(asked))
    rows = rows.join(F.broadcast(wanted) if few else wanted, ["bucket", "term"])
    units = F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("tfs").alias("tf"), F.col("lengths").alias("length")))
    hits = rows.select(*(c for c in wanted.columns if c != "bucket"), "generation", units)
    if len(parts) > 1:
        hits = _alive(hits.repartition("key"), _read(spark, path, parts[1:], "gone", f"key {kind}"))
    return hits.drop("generation")


def matches(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, n_terms, term, key, tf, length): live postings of the terms of `queries` (query_id, text), and no others."""
    q, few = _asked(queries)
    if not few:
        return _hits(spark, path, q, few)
    # a unit's places come together once, before they are multiplied by queries
    hits = _hits(spark, path, q.select("term", "bucket").distinct(), few)
    return hits.repartition("key").join(F.broadcast(q.drop("bucket")), "term")


def frequencies(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(term, df) of the terms of `queries`, summed over segments; marked for a broadcast if these are few, so that postings stay where they are."""
    _, parts = segments(spark, path)
    q, few = _asked(queries)
    wanted = q.select("term").distinct()
    rows = _read(spark, path, parts, "df", "term string, df long, bucket int").join(F.broadcast(wanted) if few else wanted, "term")
    found = rows.groupBy("term").agg(F.sum("df").alias("df"))
    return F.broadcast(found) if few else found


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 4, min_coverage: float = retrieval.MIN_COVERAGE) -> DataFrame:
    """(query_id, key, score, coverage, rank): the best k units for each of `queries` (query_id, text) by BM25."""
    n, length = totals(spark, path)
    hits = matches(spark, path, queries).join(frequencies(spark, path, queries), "term")
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (retrieval.K1 + 1) / (F.col("tf") + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("length") / (length / n if n else 1.0)))
    found = hits.groupBy("query_id", "key", "n_terms").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))
    found = found.withColumn("coverage", F.col("matched") / F.col("n_terms"))
    found = found.where((F.col("coverage") >= min_coverage) & ((F.col("n_terms") <= 3) | (F.col("matched") >= 2)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("coverage"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "key", "score", F.round("coverage", 6).alias("coverage"), F.col("rank").cast("long").alias("rank"))


def gate(spark: SparkSession, path: str, queries: DataFrame, min_coverage: float = retrieval.MIN_COVERAGE) -> DataFrame:
    """Per query with a hit: units that share a term, and those that hold enough of its terms."""
    hits = matches(spark, path, queries).groupBy("query_id", "key", "n_terms").agg(F.count("*").alias("matched"))
    passes = (F.col("matched") / F.col("n_terms") >= min_coverage) & ((F.col("n_terms") <= 3) | (F.col("matched") >= 2))
    return hits.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(passes).alias("passed"))


def built(units: DataFrame, path: str) -> str:
    """A new index of `units` (key, text) in `path`, which is given back."""
    create(units.sparkSession, path)
    change(units.sparkSession, path, units)
    return path
