"""Exact Jaccard self-join on word shingles: rare-first prefix filtering with length,
positional and suffix filters, joined on prefix n-grams and verified once per pair.

Texts with equal shingle sets form one class, and only its least doc_id takes part. A
pair above the threshold shares an n-gram of both prefixes, so candidates come from
joins on prefix n-grams. Where an n-gram is in many documents (a family of near copies)
emitting all pairs would grow with the square, so the join has two rounds:
1. each n-gram's least document against the others; verified links are contracted;
2. all pairs of an n-gram whose documents lie in different components, in two parts (the
   n-gram's largest component against the others, and these among themselves).
Pairs within a component can't change any component, so no link between different texts
is lost. The second round leaves out the pairs that the first compared, so each pair's texts
are compared once at most. The order of n-grams comes from counts over all documents in a table of fixed
size; ties are ordered by hash. Any total order gives the same result.

Documents of one n-gram that lie just under the limit are in components of their own; they
are compared, since nothing short of it tells them from links, in shares of GROUP documents
a task. An empty table gives an empty table. Null or empty texts have no shingles and link with nothing; a null doc_id takes no part
and gets a null component. Rows that share a doc_id count as one document, except in `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import wordhash as wh
from palisade.llm.common import BLANKS, IdFilter, Staged, read, small_batches
from palisade.llm.components import components

RANKS = 1 << 18
PARTS = 16
GROUP = 2_000


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Distinct shingle hashes of each text, by lower-cased words; fewer words than k: the sequence as one."""
    coeff = wh.table(11, True)
    for lo, hi, raw, offsets in wh.chunks(column):
        starts, ends, first = wh.bounds(raw, offsets)
        h = wh.word_hashes(raw, starts, ends, coeff)
        g = wh.runs(h, k)
        out = []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                s = np.sort(g[a : b - k + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            else:
                out.append(wh.runs(h[a:b], b - a) if b > a else h[:0])
        yield lo, hi, out


def _scan(k: int):
    """Per document n and a 128-bit fingerprint of its set; at the end, n-gram counts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RANKS, np.int64)
        names = ["doc_id", "n", "s1", "s2", "bucket"]
        for batch in batches:
            for lo, hi, sets in _sets(batch.column(1), k):
                counts += np.bincount((np.concatenate(sets) & wh.U(RANKS - 1)).astype(np.int64), minlength=RANKS)
                n = [len(s) for s in sets]
                s1 = [int(s.sum(dtype=wh.U).astype(np.int64)) for s in sets]
                s2 = [int(wh.mix(s ^ wh.U(0x5DEECE66D)).sum(dtype=wh.U).astype(np.int64)) for s in sets]
                cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in (n, s1, s2)), pa.nulls(hi - lo, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names)
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(counts[at]), none, none, pa.array(at)], names)

    return run


def _need(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n with any set that it links with."""
    return -(-num * n // den)


def _prefixes(k: int, num: int, den: int, ranks):
    """Per document: n, its rarest n-grams in global order and sizes of PARTS ranges of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            for lo, hi, sets in _sets(batch.column(1), k):
                n, tokens, parts = [], [], []
                for s in sets:
                    order = np.sort((rank[(s & wh.U(RANKS - 1)).astype(np.int64)] << wh.U(48)) | (s >> wh.U(16)))
                    size = len(s)
                    n.append(size)
                    tokens.append(order[: size - _need(size, num, den) + 1 if size else 0].astype(np.int64))
                    parts.append(np.bincount((s >> wh.U(60)).astype(np.int64), minlength=PARTS))
                at = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
                at2 = np.arange(len(sets) + 1, dtype=np.int32) * PARTS
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(n, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(tokens))),
                        pa.ListArray.from_arrays(pa.array(at2), pa.array(np.concatenate(parts).astype(np.int32))),
                    ],
                    ["doc_id", "n", "tokens", "parts"],
                )

    return run


def _verify(k: int, num: int, den: int):
    """Exact Jaccard of each pair's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = (s for _, _, x in _sets(batch.column(2), k) for s in x)
            right = (s for _, _, x in _sets(batch.column(3), k) for s in x)
            good = []
            for s, t in zip(left, right):
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(den * both >= num * (len(s) + len(t) - both) and both > 0)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _may_link(na: Column, pa_: Column, nb: Column, pb: Column, num: int, den: int) -> Column:
    """Length filter, and the positional filter for two sets whose first common n-gram stands there."""
    rest = F.least(na - pa_, nb - pb)
    return (den * F.least(na, nb) >= num * F.greatest(na, nb)) & ((num + den) * rest >= num * (na + nb))


class _Join:
    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.checked: list[DataFrame] = []  # tables of the pairs whose texts were compared
        self.docs = docs.select("doc_id", "text")
        small_batches(docs.sparkSession)
        scanned = Staged(self.docs.mapInArrow(_scan(k), "doc_id long, n long, s1 long, s2 long, bucket long"), "shingles").df
        self.sets = scanned.where("bucket is null")
        counts = scanned.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("c")).toPandas()  # at most RANKS rows
        rank = np.zeros(RANKS, wh.U)
        rank[counts["bucket"].to_numpy(np.int64)] = np.minimum(np.log2(counts["c"].to_numpy(float)) * 1024, 65535).astype(wh.U)
        ranks = docs.sparkSession.sparkContext.broadcast(rank)
        usable = self.sets.where("n > 0 and doc_id is not null")
        self.classes = Staged(usable.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "classes").df
        prefixes = self.docs.mapInArrow(_prefixes(k, num, den, ranks), "doc_id long, n int, tokens array<long>, parts array<int>")
        reps = self.classes.select(F.col("rep").alias("doc_id")).distinct()
        self.prefixes = Staged(prefixes.join(reps, "doc_id", "left_semi"), "prefixes").df

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, of those not verified before. Suffix filter: sizes of the ranges bound the difference."""
        num, den = self.num, self.den
        size = self.prefixes.select("doc_id", "n", "parts")
        one = size.select(F.col("doc_id").alias("a"), F.col("n").alias("n1"), F.col("parts").alias("p1"))
        two = size.select(F.col("doc_id").alias("b"), F.col("n").alias("n2"), F.col("parts").alias("p2"))
        differ = F.expr("aggregate(zip_with(p1, p2, (x, y) -> abs(x - y)), 0, (s, x) -> s + x)")
        # overlap <= (n1 + n2 - differ) / 2
        pairs = pairs.distinct()
        for before in self.checked:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = pairs.join(one, "a").join(two, "b").where((num + den) * (F.col("n1") + F.col("n2") - differ) >= 2 * num * (F.col("n1") + F.col("n2")))
        pairs = Staged(pairs.select("a", "b"), "pairs").df
        self.checked.append(pairs)
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        known = IdFilter(ids, "doc_id")
        texts = known.keep(self.docs, "doc_id").dropDuplicates(["doc_id"])
        texts = Staged(texts.join(ids, "doc_id", "left_semi"), "pair-texts").df
        joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        return joined.select("a", "b", "ta", "tb").mapInArrow(_verify(self.k, num, den), "a long, b long")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links that make the components of all links, and the components (node, component)."""
        num, den = self.num, self.den
        posts = self.prefixes.select("doc_id", "n", F.posexplode("tokens").alias("pos", "token"))
        firsts = posts.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "n", "pos")).alias("first")).where("c > 1").select("token", "first")
        firsts = Staged(firsts, "first-documents").df
        likely = IdFilter(firsts, "token")
        shared = Staged(likely.keep(posts, "token").join(firsts, "token"), "shared-tokens").df
        near = shared.where("doc_id != first.doc_id").where(_may_link(F.col("first.n"), F.col("first.pos"), F.col("n"), F.col("pos"), num, den))
        edges = Staged(self.verified(near.select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b"))), "links").df
        comp = components(edges)

        held = shared.select("token", "doc_id", "n", "pos").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        held = Staged(held.withColumn("component", F.coalesce("component", "doc_id")), "held").df
        sizes = held.groupBy("token", "component").count()
        main = sizes.groupBy("token").agg(F.count("*").alias("k"), F.sum("count").alias("c"), F.max_by("component", F.struct("count", "component")).alias("main")).where("k > 1")
        # tokens of many documents are dealt to several tasks by one side's ids; the other side goes to each of them
        main = main.select("token", "main", F.ceil(F.col("c") / GROUP).cast("int").alias("shares"))
        open_ = Staged(held.join(main, "token"), "open-tokens").df
        x, y = (open_.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "pos", "component")), "main", "shares") for s in ("x", "y"))
        x = x.withColumn("share", F.pmod(F.xxhash64("doc_id_x"), F.col("shares")).cast("int")).drop("shares")
        y = y.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        fits = _may_link(F.col("n_x"), F.col("pos_x"), F.col("n_y"), F.col("pos_y"), num, den)
        others = y.where("component_y != main").drop("main")
        mixed = x.where("component_x = main").join(others, ["token", "share"]).where(fits)
        rest = x.where("component_x != main").join(others, ["token", "share"]).where("component_x < component_y").where(fits)
        pairs = mixed.unionByName(rest).select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b"))
        more = Staged(self.verified(pairs), "links").df
        if more.limit(1).count():
            edges = edges.unionByName(more)
            comp = components(edges)
        return edges, comp


def link(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text): documents link
    when den * intersection >= num * union of their k-word shingles."""
    join = _Join(docs, k, num, den)
    _, comp = join.links()
    heads = join.classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    # rows of one doc_id in several classes can't differ in component unless texts clash; empty ones stay alone
    full = join.sets.where("n > 0").join(heads, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    empty = join.sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def _repeats(docs: DataFrame, null_ids: bool) -> bool:
    """Some doc_id is in several rows, or null ids are to be joined and there are some."""
    if null_ids and docs.where("doc_id is null").limit(1).count():
        return True
    return docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def _keyed(docs: DataFrame) -> DataFrame:
    """(__key, text, row): one row for each doc_id and text, that of least fingerprint among repeats.
    Keys are in the order of doc_id, null ones last, then of the text's hash."""
    rows = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"), F.sha2(F.to_json(F.struct(*docs.columns)), 256).alias("print"), F.struct(*docs.columns).alias("row"))
    one = rows.groupBy("id", "h").agg(F.min_by("row", "print").alias("row"))
    order = [F.asc_nulls_last("id"), F.asc_nulls_first("h")]
    one = one.repartitionByRange(*order).sortWithinPartitions(*order)
    return Staged(one.select(F.monotonically_increasing_id().alias("__key"), F.col("row.text").alias("text"), "row"), "keyed").df


def _first_of_linked(docs: DataFrame, key: str, k: int, num: int, den: int) -> DataFrame:
    """`docs` without the rows whose key is not the least of its component."""
    out = Staged(link(docs.select(F.col(key).alias("doc_id"), "text"), k, num, den), "components").df
    gone = out.where("component_id != doc_id").select(F.col("doc_id").alias(key)).distinct()
    named = IdFilter(gone, key)
    marked = named.mark(docs, key, "__near")
    kept = marked.where("not __near").unionByName(marked.where("__near").join(gone, key, "left_anti"))
    return kept.select(*docs.columns)


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, null_ids: bool = False) -> DataFrame:
    """`docs` without all but the document of least doc_id in each group of linked ones.

    Rows that repeat a doc_id and its text are one row; other texts under the same doc_id are
    documents of their own, so no text goes that has no copy among those kept. Rows with a null
    doc_id are all kept, or, with `null_ids`, join the groups behind all rows that have an id;
    those without words link with nothing and stay."""
    if not _repeats(docs, null_ids):
        return _first_of_linked(docs, "doc_id", k, num, den)
    joins = F.col("doc_id").isNotNull()
    if null_ids:
        joins = joins | F.coalesce(F.col("text").rlike(f"[^{BLANKS}]"), F.lit(False))
    kept = _first_of_linked(_keyed(docs.where(joins)), "__key", k, num, den)
    return kept.select(*(F.col(f"row.`{c}`") for c in docs.columns)).unionByName(docs.where(~joins))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"), k=4, num=85, den=100)
