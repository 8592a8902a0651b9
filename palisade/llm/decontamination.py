"""Benchmark passages in documents: an exact prefix-filtered join on word shingles.

A window is `width` consecutive words of an item, or the whole item where it is shorter. A window
occurs in a document where all its shingles stand in a row, so its rarest shingle must be there:
1. shingles of the documents that windows have too are kept with their places (a bitmap of fixed
   size, broadcast, spares the others the shuffle) and counted over all documents;
2. the shingles of each window are ordered by rarity. At full containment the necessary prefix is
   one shingle, the rarest; a window with a shingle that no document has goes at once;
3. places join prefix shingles. A shingle's place and its offset in the window give the window's
   first word, which must not lie before the text nor the last one behind it (positional and
   length bounds);
4. candidates are verified word by word against the text, over windows of the item's size.
Everything is DataFrame functions. Equal texts are worked on once; documents that hold the same
windows look up their items once, so that copies of a passage don't multiply items.

Null or empty texts have no words, on either side. An item with a null id marks words but is
no item of the list; items of equal id count as one. Repeated rows give repeated results, null
ids of documents are ids like others, of equally rare shingles the least hash is taken, a text
may have any length (its candidates are one array), and empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import IdFilter, Staged, once, read

WIDTH, SHINGLE = 10, 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: ASCII other than digits and letters. Capitals are lower-cased before.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(low, _GAPS), "")


def _shingles(words: Column, k: int) -> Column:
    """Hash of the k words from each place on."""
    at = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(F.lit(k), *(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) >= k, at)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, window, n): the distinct windows of `items` (item_id, text), words joined by spaces."""
    split = items.select("item_id", once(_words(F.col("text"))).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return split.select("item_id", n.alias("n"), F.explode(each).alias("window")).distinct()


def occurrences(docs: DataFrame, known: DataFrame) -> DataFrame | None:
    """(text_key, spans, windows, n_hit) for each distinct text of `docs` in which windows of `known`
    (window, n) occur: their places (start, end in words), the distinct windows, the words covered.
    None where `known` is empty."""
    known = known.select("window", "n").distinct().withColumn("k", F.least("n", F.lit(SHINGLE)))
    known = Staged(known, "windows").df
    lengths = sorted(r.k for r in known.select("k").distinct().collect())  # SHINGLE numbers at most
    if not lengths:
        return None
    parts = known.select("window", "n", "k", once(F.split("window", " ")).alias("w"))
    of = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for k in lengths:
        of = of.when(F.col("k") == k, _shingles(F.col("w"), k))
    parts = Staged(parts.select("window", "n", F.size("w").alias("words"), "k", F.posexplode(of).alias("offset", "token")), "window-shingles").df
    likely = IdFilter(parts.select("token").distinct(), "token")
    split = docs.where("text is not null").select(_key(F.col("text")).alias("text_key"), once(_words(F.col("text"))).alias("w"))
    places = split.select("text_key", F.size("w").alias("n_words"), F.posexplode(_shingles(F.col("w"), lengths[0])).alias("pos", "token"))
    for k in lengths[1:]:
        places = places.unionByName(split.select("text_key", F.size("w").alias("n_words"), F.posexplode(_shingles(F.col("w"), k)).alias("pos", "token")))
    places = likely.keep(places, "token").groupBy("text_key", "n_words", "pos", "token").agg(F.count("*").alias("copies"))
    places = Staged(places, "places").df

    counts = places.groupBy("token").agg(F.sum("copies").alias("count"))
    order = F.struct("count", "token", "offset")
    rarest = parts.join(counts, "token").groupBy("window", "n", "k", "words").agg(F.count("*").alias("there"), F.min_by(F.struct("token", "offset"), order).alias("prefix"))
    prefix = Staged(rarest.where(F.col("there") == F.col("words") - F.col("k") + 1).select("window", "n", "prefix.*"), "prefixes").df
    start = F.col("pos") - F.col("offset")
    near = places.join(prefix, "token").where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    near = Staged(near.groupBy("text_key").agg(F.collect_list(F.struct(start.alias("start"), "n", "window")).alias("near")), "candidates").df

    named = IdFilter(near, "text_key")
    texts = named.keep(docs.where("text is not null").select(_key(F.col("text")).alias("text_key"), "text"), "text_key")
    texts = texts.join(near.select("text_key"), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    checked = near.join(texts, "text_key").select("text_key", "near", once(_words(F.col("text"))).alias("w"))
    found = F.filter("near", lambda c: F.array_join(F.slice("w", c["start"] + 1, c["n"]), " ") == c["window"])
    checked = checked.select("text_key", once(found).alias("found")).where(F.size("found") > 0)
    spans = F.array_sort(F.array_distinct(F.transform("found", lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["n"]).alias("end")))))
    checked = checked.select("text_key", F.array_sort(F.array_distinct("found.window")).alias("windows"), once(spans).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    cover = F.aggregate("spans", zero, lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("hit")), lambda a: a["hit"])
    return checked.select("text_key", "spans", "windows", cover.alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_hit (words inside occurrences of windows of
    `items`), `spans` of these and `items`, the ids of the items they come from, sorted as strings."""
    own = Staged(windows(items.select("item_id", "text"), width), "item-windows").df
    rows = docs.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long").alias("n_words"), _key(F.col("text")).alias("text_key"))
    none = [F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items")]
    found = occurrences(docs.select("text"), own)
    if found is None:
        return rows.select("doc_id", "n_words", *none)
    found = Staged(found.withColumn("same", F.md5(F.array_join("windows", ","))), "occurrences").df
    sets = found.groupBy("same").agg(F.first("windows").alias("windows")).select("same", F.explode("windows").alias("window"))
    of = sets.join(own.where("item_id is not null").select("window", F.col("item_id").cast("string").alias("item_id")), "window")
    of = of.groupBy("same").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = found.join(of, "same", "left").select("text_key", "n_hit", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    found = Staged(found, "contaminated").df
    marked = IdFilter(found, "text_key").mark(rows, "text_key", "maybe")
    hit = marked.where("maybe").drop("maybe").join(found, "text_key", "left")
    hit = hit.select("doc_id", "n_words", F.coalesce("n_hit", none[0]).alias("n_hit"), F.coalesce("spans", none[1]).alias("spans"), F.coalesce("items", none[2]).alias("items"))
    return hit.unionByName(marked.where("not maybe").select("doc_id", "n_words", *none))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
