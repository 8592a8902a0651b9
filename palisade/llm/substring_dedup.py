"""Removal of word sequences that occur more than once in a corpus.

A window is `width` consecutive words of one document; every word covered by a window
whose word sequence also starts anywhere else is removed.

Method. A suffix automaton over the whole corpus would be as large as the corpus, and one
automaton for each shard, broadcast to all documents, makes work grow with its square. So
shards are dealt such that all places of a window lie in one of them:
1. each window names its least hashed `anchor` words (equal windows name equal anchors);
2. anchors are counted over distinct texts; only windows with a repeated anchor go on, as
   stretches: consecutive windows of one text that name one anchor;
3. equal stretches are one with a weight. The stretches of an anchor form a shard, small ones
   together in one automaton of about `SHARD` words; each task builds the suffix automata of
   its shards and streams the stretches past them for matching statistics: the places where
   `width` words match, and how often those words stand in the shard. Windows found once come
   back as (document, position), all other candidates are repeated;
4. an anchor with more than `SHARD` words of stretches is dealt anew by longer anchors, in the
   end by the windows themselves, so no automaton outgrows its bound, however common a passage.
Equal texts are one text with a weight. Every step is a keyed aggregation or a join whose
groups are pre-aggregated; bitmaps of fixed size only spare rows the exact joins behind them.

Null or empty texts have no words and stay as they are. Rows that repeat as a whole are
documents of their own, so each makes the other's windows repeated. Null ids are ids like
others. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import wordhash as wh
from palisade.llm.common import IdFilter, Staged, read, small_batches
from palisade.llm.suffix_automata import Automaton

WIDTH, ANCHOR, SHARD = 35, 12, 20_000


def _anchors(h: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes at each selected anchor position, and the anchor that each window names."""
    reach = width - anchor + 1
    g = wh.runs(h, anchor)
    named = wh.slide(g, reach)
    edge = np.zeros(reach - 1, wh.U)
    most = wh.slide(np.concatenate([edge, named, edge]), reach, np.maximum)
    return g[g == most], named


def _scan(width: int, anchor: int):
    """Per document: word count, 128-bit fingerprint of its words, its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coeff, other = wh.table(11, False), wh.table(12, False)
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, raw, offsets in wh.chunks(batch.column(1)):
                starts, ends, first = wh.bounds(raw, offsets)
                h, h2 = wh.word_hashes(raw, starts, ends, coeff), wh.word_hashes(raw, starts, ends, other)
                c1, c2, found = [], [], []
                for a, b in zip(first[:-1], first[1:]):
                    own = h[a:b]
                    c1.append(int(wh.runs(own, b - a)[0].astype(np.int64)) if b > a else 0)
                    c2.append(int(wh.runs(h2[a:b], b - a)[0].astype(np.int64)) if b > a else 0)
                    found.append(_anchors(own, width, anchor)[0].astype(np.int64) if b - a >= width else np.zeros(0, np.int64))
                ends_at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(lo, hi - lo),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(c1, pa.int64()),
                        pa.array(c2, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends_at), pa.array(np.concatenate(found))),
                    ],
                    ["key", "n_words", "c1", "c2", "anchors"],
                )

    return run


def _stretches(width: int, anchor: int, all_: bool = False):
    """Stretches of windows whose anchor is in the list of their text, or of all its windows: the anchor, a
    128-bit fingerprint, the number of windows, the text's key, the first window's position, the weight, the words."""
    most = width - anchor + 1

    def cut(named: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First windows and lengths."""
        at = np.flatnonzero(hit)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (named[at[1:]] != named[at[:-1]])
        first = np.flatnonzero(fresh)
        run = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        first = np.flatnonzero(run % most == 0)
        return at[first], np.diff(np.append(first, len(at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coeff, other = wh.table(11, False), wh.table(12, False)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            lists, weights, begins = batch.column(2), batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False)
            for lo, hi, raw, offsets in wh.chunks(batch.column(1)):
                starts, ends, first = wh.bounds(raw, offsets)
                h, h2 = wh.word_hashes(raw, starts, ends, coeff), wh.word_hashes(raw, starts, ends, other)
                data, numbers, of, words = raw.tobytes(), [], [], []
                for i, (a, b) in enumerate(zip(first[:-1], first[1:]), lo):
                    if b - a < width:
                        continue
                    named = _anchors(h[a:b], width, anchor)[1]
                    hit = np.ones(len(named), bool) if all_ else np.isin(named, lists[i].values.to_numpy(zero_copy_only=False).astype(wh.U))
                    at, n = cut(named, hit)
                    long = n + width - 1
                    cols = (named[at], wh.ranges(h[a:b], at, long), wh.ranges(h2[a:b], at, long), n, at + begins[i], np.full(len(at), weights[i]))
                    numbers.append(np.stack([c.astype(np.int64) for c in cols]))
                    of += [keys[i]] * len(at)
                    words += [data[x:y] for x, y in zip(starts[a:b][at].tolist(), ends[a:b][at + long - 1].tolist())]
                if of:
                    cols = np.concatenate(numbers, 1)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(of, pa.binary()), pa.array(words, pa.string())], ["anchor", "f1", "f2", "n", "pos", "weight", "key", "words"])

    return run


STRETCH = "anchor long, f1 long, f2 long, n long, pos long, weight long, key binary, words string"


def _once(width: int):
    """Windows (key, at) that stand once in their shard, from rows in the order of anchors."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[0].encode().split() for r in rows]
        known = Automaton(texts, [r[1] for r in rows])
        keys, at = [], []
        for words, (_, weight, key, pos) in zip(texts, rows):
            if weight == 1:
                starts, often = known.windows(words, width)
                single = [pos + i for i, n in zip(starts, often) if n == 1]
                if single:
                    keys.append(key)
                    at.append(single)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(at, pa.list_(pa.int64()))], ["key", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for anchor, n, words, weight, key, pos in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD and anchor != last:
                    yield found(rows)
                    rows, size = [], 0
                rows.append((words, weight, key, pos))
                size, last = size + n + width - 1, anchor
        if rows:
            yield found(rows)

    return run


def single_windows(texts: DataFrame, width: int, anchor: int, shard: int = SHARD) -> DataFrame:
    """(key, once): positions of the windows that stand once among those of `texts` (key, text, anchors, copies) with an anchor of their list."""
    rows = texts.select("key", "text", "anchors", "copies", F.lit(0).cast("long").alias("pos")).mapInArrow(_stretches(width, anchor), STRETCH)
    parts = []
    while True:
        equal = rows.groupBy("anchor", "f1", "f2").agg(F.sum("weight").alias("weight"), F.min(F.struct("key", "pos")).alias("at"), F.first("n").alias("n"), F.first("words").alias("words"))
        equal = Staged(equal, "stretches").df
        large = equal.groupBy("anchor").agg(F.sum(F.col("n") + width - 1).alias("size")).where(F.col("size") > shard).select("anchor")
        large = Staged(large, "large-shards").df
        deeper = anchor < width and large.limit(1).count() > 0
        small = equal.join(large, "anchor", "left_anti") if deeper else equal
        dealt = small.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "n", "words", "weight", "at.key", "at.pos")
        parts.append(Staged(dealt.mapInArrow(_once(width), "key binary, at array<long>"), "single-windows").df)
        if not deeper:
            break
        anchor = min(2 * anchor, width)
        again = equal.join(large, "anchor", "left_semi").select("at.key", "words", F.lit(None).cast("array<long>").alias("anchors"), "weight", "at.pos")
        rows = again.mapInArrow(_stretches(width, anchor, all_=True), STRETCH)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("key").agg(F.flatten(F.collect_list("at")).alias("once"))


def _kept(width: int, anchor: int, keep_text: bool):
    """Per document: the words left. `whole`: all windows are repeated; `once`: candidates found once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coeff = wh.table(11, False)
        for batch in batches:
            n = batch.num_rows
            ids, texts = batch.column(0), batch.column(1).fill_null("").to_pylist()
            whole, lists, once = (batch.column(i) for i in (2, 3, 4))
            n_words, n_removed, digest, left = [], [], [], []
            for i in range(n):
                raw = texts[i].encode()
                words = raw.split()
                total = len(words)
                drop = None
                if total >= width and whole[i].as_py():
                    drop, words = total, []
                elif total >= width and lists[i].is_valid:
                    buf = np.frombuffer(raw, np.uint8)
                    starts, ends, _ = wh.bounds(buf, np.array([0, len(raw)]))
                    named = _anchors(wh.word_hashes(buf, starts, ends, coeff), width, anchor)[1]
                    hit = np.isin(named, lists[i].values.to_numpy(zero_copy_only=False).astype(wh.U))
                    if once[i].is_valid:
                        hit[once[i].values.to_numpy(zero_copy_only=False)] = False
                    step = np.zeros(total + 1, np.int64)
                    at = np.flatnonzero(hit)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + width, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    drop = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                n_words.append(total)
                n_removed.append(drop or 0)
                digest.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    left.append(kept.decode() if drop else texts[i])
            cols = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["row", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols.append(pa.array(left, pa.string()))
                names.append("left")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): `row` (a struct of all its columns), n_words,
    n_removed, kept_sha256 and, with keep_text, `left`: the text, joined anew by single
    spaces where words were removed."""
    spark = docs.sparkSession
    small_batches(spark)
    # 128 bits, so that no two rows that differ share a key
    key = F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text")))
    keyed = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"), "text")
    scanned = Staged(
        keyed.select("key", "text").mapInArrow(_scan(width, anchor), "key binary, n_words long, c1 long, c2 long, anchors array<long>"),
        "substrings",
    )
    long_enough = scanned.df.where(F.col("n_words") >= width)
    classes = long_enough.groupBy("c1", "c2", "n_words").agg(F.count("*").alias("copies"), F.min("key").alias("rep"))
    classes = Staged(classes, "substring-classes").df
    copied = long_enough.select("key", "c1", "c2", "n_words").join(classes.where("copies > 1"), ["c1", "c2", "n_words"], "left_semi").select("key").distinct()

    own = long_enough.select("key", "anchors").join(classes.select(F.col("rep").alias("key"), "copies"), "key")
    own = Staged(own, "substring-anchors").df
    repeated = Staged(own.select(F.explode("anchors").alias("anchor")).groupBy("anchor").count().where("count > 1").select("anchor"), "repeated-anchors").df
    likely = IdFilter(repeated, "anchor")
    found = (
        likely.keep(own.select("key", "copies", F.explode("anchors").alias("anchor")), "anchor")
        .join(repeated, "anchor", "left_semi")
        .groupBy("key")
        .agg(F.collect_set("anchor").alias("anchors"), F.max("copies").alias("copies"))
    )
    found = Staged(found, "candidates").df
    near = IdFilter(found, "key")

    texts = near.keep(keyed.select("key", "text"), "key").join(found, "key").select("key", "text", "anchors", "copies")
    once = single_windows(texts, width, anchor)
    marks = (
        found.where("copies = 1").select("key", "anchors").join(once, "key", "left").select("key", F.lit(False).alias("whole"), "anchors", "once")
        .unionByName(copied.select("key", F.lit(True).alias("whole")), allowMissingColumns=True)
    )
    marks = Staged(marks, "marks").df
    touched = IdFilter(marks, "key")
    with_hit = touched.mark(keyed, "key", "hit")
    none = [F.lit(False).alias("whole"), F.lit(None).cast("array<long>").alias("anchors"), F.lit(None).cast("array<long>").alias("once")]
    rows = (
        with_hit.where("hit").join(marks, "key", "left").select("row", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "anchors", "once")
        .unionByName(with_hit.where("not hit").select("row", "text", *none))
    )
    schema = f"row {docs.select(F.struct(*docs.columns).alias('row')).schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    return rows.mapInArrow(_kept(width, anchor, keep_text), schema + (", left string" if keep_text else ""))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")
