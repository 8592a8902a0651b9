"""Collocations: phrases of two to five words that stand together more often than their parts would.

Method. Counts of word sequences are first bounded from above by a sketch: a sequence's hash names
one of 2^CELLS cells, and a cell's count is at least that of each of its sequences. Tasks send the
cells that they touch, counted, so the sketch grows with the corpus and is added up by cell ranges
on many tasks. It has two levels: pairs first, then sequences of three to five words all of whose
pairs reach the threshold, and the words of such pairs. The cells that reach it are broadcast as a
bitmap of fixed size (where it fills up, more candidates are counted, with the same results).

Candidates are the sequences whose bounds, and those of all their parts, reach the threshold. From
each place on, the longest of them is that place's window; the others are its beginnings. A task sends
each window once, with its count, to a bucket of its first two words, and each word to one of its own;
so a bucket's windows hold every occurrence of the candidates that begin with these words. There the
candidates of a language are compiled into pyahocorasick automata of at most `shard` characters, with
a guard before each phrase and a delimiter after each word, so that matches begin with windows and end
with words. A bucket's windows pass its automata, and no text passes those of others: work grows with
the input, not with its product with the number of automata. Matches are added up with their windows'
counts, and only then thresholds, scores and ranks are applied, to exact counts.

Phrases, counts and ranks are kept apart by language; a null language is `und`. Null and empty
texts have no words, repeated rows count each, doc_id is not used, other columns are not read, a
long text is worked on by itself, ties are ordered as stated at `collocations`, and an empty
table gives none. The driver holds the bitmaps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm import wordhash as wh
from palisade.llm.common import Staged, read, small_batches

LEAST, LONGEST, TOP = 100, 5, 2_000
CELLS, BLOCKS, BITS = 34, 12, 27
HELD = 1 << 22
SHARD = 4_000_000
BUCKETS = 1_024
SCAN = 1 << 20
#: Capitals are lower-cased, what ends a piece turns into a line's end and other blanks into a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9] = 32
_FOLD[list(b".,;:!?\n\x0b\x0c\r")] = 10


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little")


class _Chunk:
    """Words, pieces and languages of some texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.raw = _FOLD[raw]
        self.starts, self.ends, first = wh.bounds(self.raw, offsets)
        step = np.zeros(len(raw) + 1, np.int64)
        np.add.at(step, offsets, 1)
        step[:-1] += self.raw == 10
        self.piece = np.cumsum(step)[self.starts]
        self.langs = langs
        self.n = np.diff(first)
        self.salt = np.repeat(np.array([_lang_hash(x) for x in langs], wh.U), self.n)
        self.text = np.repeat(np.arange(len(langs)), self.n)
        self.words = wh.word_hashes(self.raw, self.starts, self.ends, wh.table(11, False))
        self._good = None

    def cells(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell of the k words from each place on, and whether they are of one piece."""
        if len(self.words) < k:
            return np.zeros(0, wh.U), np.zeros(0, bool)
        m = len(self.words) - k + 1
        return wh.mix(wh.runs(self.words, k) ^ self.salt[:m]) >> wh.U(64 - CELLS), self.piece[:m] == self.piece[k - 1 :]

    def good(self, pairs: np.ndarray) -> np.ndarray:
        """Pairs of one piece that reach the threshold by the bitmap, by their first words."""
        if self._good is None:
            cells, inside = self.cells(2)
            self._good = inside & _among(cells, pairs)
        return self._good

    def paired(self, pairs: np.ndarray) -> np.ndarray:
        """Words of such pairs."""
        out = np.zeros(len(self.words), bool)
        if len(good := self.good(pairs)):
            out[:-1] |= good
            out[1:] |= good
        return out

    def likely(self, k: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places from which on all pairs among k words reach the threshold, and the cells of these words."""
        good = self.good(pairs)
        at = np.flatnonzero(wh.slide(good, k - 1, np.logical_and)) if len(good) > k - 2 else np.zeros(0, np.int64)
        return at, wh.mix(wh.ranges(self.words, at, np.full(len(at), k)) ^ self.salt[at]) >> wh.U(64 - CELLS)

    def reach(self, longest: int, pairs: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that may reach the threshold, and of how many words the longest sequence from each place on is that may
        with all of its parts, 0 where none is."""
        single, reach = _among(self.cells(1)[0], more), np.zeros(len(self.words), np.int8)
        last = self.good(pairs)
        reach[: len(last)][last] = 2
        for k in range(3, longest + 1):
            at, cells = self.likely(k, pairs)
            at = at[_among(cells, more) & last[at] & last[at + 1]]  # both parts that are one word shorter
            if not len(at):
                break
            reach[at] = k
            last = reach >= k
        return single, reach


def _among(cells: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = cells & wh.U((1 << BITS) - 1)
    return (bitmap[(bit >> wh.U(3)).astype(np.int64)] >> (bit & wh.U(7)).astype(np.uint8)) & 1 == 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, raw, offsets in wh.chunks(batch.column(1), SCAN):
            yield _Chunk(raw, offsets, langs[lo:hi])


SKETCH = "block int, cells binary, counts binary, lang string, n long"


def _sketch(least: int, longest: int, pairs=None):
    """Counted cells by block, of pairs and words by language, or, with the pairs' bitmap, of longer sequences and of words in likely pairs."""
    kind = np.uint8 if least < 256 else np.uint32
    names = ["block", "cells", "counts", "lang", "n"]

    def blocks(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(held))
        at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        counts = np.minimum(np.diff(np.append(at, len(cells))), least).astype(kind)  # a part that reaches the threshold is enough
        cells = cells[at]
        block = (cells >> wh.U(CELLS - BLOCKS)).astype(np.int32)
        own = (cells & wh.U((1 << CELLS - BLOCKS) - 1)).astype(np.uint32)
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        to = np.append(cut[1:], len(block))
        rows = [own[a:b].tobytes() for a, b in zip(cut, to)], [counts[a:b].tobytes() for a, b in zip(cut, to)]
        return pa.RecordBatch.from_arrays([pa.array(block[cut]), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary()), pa.nulls(len(cut), pa.string()), pa.nulls(len(cut), pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, {}
        for chunk in _chunks(batches):
            if pairs is None:
                cells, inside = chunk.cells(2)
                found = [cells[inside]]
                for lang, words in zip(chunk.langs, chunk.n.tolist()):
                    n[lang] = n.get(lang, 0) + words
            else:
                found = [chunk.likely(k, pairs.value)[1] for k in range(3, longest + 1)]
                found.append(chunk.cells(1)[0][chunk.paired(pairs.value)])
            for cells in found:
                held.append(cells)
                size += len(cells)
            if size > HELD:
                yield blocks(held)
                held, size = [], 0
        if size:
            yield blocks(held)
        if n:
            none = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int32()), none, none, pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names)

    return run


def _reached(least: int):
    """Bits of the cells that reach the threshold, from rows in the order of blocks."""
    kind = np.uint8 if least < 256 else np.uint32

    def added(block: int, rows: list[tuple[bytes, bytes]]) -> np.ndarray:
        cells = np.concatenate([np.frombuffer(a, np.uint32) for a, _ in rows])
        counts = np.concatenate([np.frombuffer(b, kind) for _, b in rows]).astype(np.int64)
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        good = cells[at[np.add.reduceat(counts, at) >= least]].astype(np.int64)
        return (good + (block << CELLS - BLOCKS)) & ((1 << BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for block, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if block != last and rows:
                    yield pa.RecordBatch.from_arrays([pa.array(added(last, rows), pa.int64())], ["bit"])
                    rows = []
                last = block
                rows.append((cells, counts))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(added(last, rows), pa.int64())], ["bit"])

    return run


def _bitmap(sketch: DataFrame, least: int) -> np.ndarray:
    dealt = sketch.where("block is not null").select("block", "cells", "counts").repartition("block").sortWithinPartitions("block")
    bits = dealt.mapInArrow(_reached(least), "bit long")
    words = bits.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).toArrow()  # at most 2^(BITS - 5) rows
    out = np.zeros(1 << BITS - 5, "<u4")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


class _Seen:
    """Windows of some chunks: which words they use, and how far each place reaches."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.places: list[tuple[np.ndarray, ...]] = []  # used, single, reach
        self.words: list[tuple[np.ndarray, ...]] = []  # bytes, lengths, languages of those used
        self.size = 0

    def add(self, chunk: _Chunk, longest: int, pairs: np.ndarray, more: np.ndarray) -> None:
        single, reach = chunk.reach(longest, pairs, more)
        used = single | chunk.paired(pairs)
        if not used.any():
            return
        starts, ends = chunk.starts[used], chunk.ends[used]
        mark = np.zeros(len(chunk.raw) + 1, np.int8)
        mark[starts] += 1
        mark[ends] -= 1
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in chunk.langs])
        self.places.append((used, single, reach))
        self.words.append((chunk.raw[np.cumsum(mark[:-1], dtype=np.int8) == 1], ends - starts, lang[chunk.text[used]]))
        self.size += len(used)

    def sent(self, longest: int) -> pa.RecordBatch:
        used, single, reach = map(np.concatenate, zip(*self.places))
        data, lengths, lang = map(np.concatenate, zip(*self.words))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        # a word has one number in each language
        numbers, distinct = pd.factorize(coded.indices.to_numpy().astype(np.int64) * len(self.langs) + lang)
        words, lang, v = coded.dictionary.take(pa.array(distinct // len(self.langs))).to_pylist(), distinct % len(self.langs), len(distinct)
        hashes = np.array([zlib.crc32(w) for w in words])
        ids = np.full(len(used), -1)
        ids[used] = numbers
        n = np.bincount(ids[single], minlength=v)
        at = np.flatnonzero(n)
        texts, counts, firsts, buckets = [words[i] for i in at.tolist()], [n[at]], [at], [hashes[at] % BUCKETS]
        at = np.flatnonzero(reach > 1)
        key = ids[at]
        for k in range(2, longest + 1):
            # exact: numbers of what the k - 1 words before are, and of the next word
            key = pd.factorize(key * v + ids[at + k - 1])[0]
            own = reach[at] == k
            n = np.bincount(key[own])
            place = np.zeros(len(n), np.int64)
            place[key[own]] = at[own]
            found = np.flatnonzero(n)
            rows = ids[place[found][:, None] + np.arange(k)]
            texts += [b" ".join([words[i] for i in row]) for row in rows.tolist()]
            counts.append(n[found])
            firsts.append(rows[:, 0])
            buckets.append((hashes[rows[:, 0]] * 31 + hashes[rows[:, 1]]) % BUCKETS + BUCKETS)  # apart from words, which begin windows too
            at, key = at[~own], key[~own]
            if not len(at):
                break
        n, group = np.concatenate(counts).astype(np.uint32), lang[np.concatenate(firsts)] * 2 * BUCKETS + np.concatenate(buckets)
        order = np.argsort(group, kind="stable")
        n, group, texts = n[order], group[order], [texts[i] for i in order.tolist()]
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        to, of = np.append(cut[1:], len(group)), list(self.langs)
        cols = [pa.array((group[cut] % (2 * BUCKETS)).astype(np.int32)), pa.array([of[i] for i in (group[cut] // (2 * BUCKETS)).tolist()], pa.string())]
        cols += [pa.array([b"\n".join(texts[i:j]) for i, j in zip(cut, to)], pa.binary()), pa.array([n[i:j].tobytes() for i, j in zip(cut, to)], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["bucket", "lang", "windows", "counts"])


WINDOWS = "bucket int, lang string, windows binary, counts binary"


def _windows(longest: int, pairs, more):
    """Windows, one a line, by buckets of their first two words, and words by their own, each once for what a task remembers, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for chunk in _chunks(batches):
            seen.add(chunk, longest, pairs.value, more.value)
            if seen.size > HELD:
                yield seen.sent(longest)
                seen = _Seen()
        if seen.size:
            yield seen.sent(longest)

    return run


def _parts(window: bytes) -> list[bytes]:
    """What a window counts for: itself and its beginnings of two words or more."""
    words = window.split(b" ")
    return [b" ".join(words[:k]) for k in range(2, len(words))] + [window]


def _added(windows: list[tuple[bytes, int]], phrases: list[bytes], total: dict[bytes, int]) -> None:
    """Matches of an automaton of the phrases, a line's end before each, so that a place counts once, and a blank behind each word."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        automaton.add_word(f"\n{phrase.decode('latin-1')} ", i)
    automaton.make_automaton()
    ends = np.cumsum([len(w) + 2 for w, _ in windows])
    text = "".join([f"\n{w.decode('latin-1')} " for w, _ in windows])
    matches = np.fromiter(chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2)  # (last place, phrase)
    found = np.zeros(len(phrases), np.int64)
    np.add.at(found, matches[:, 1], np.array([n for _, n in windows])[np.searchsorted(ends, matches[:, 0], side="right")])
    for phrase, n in zip(phrases, found.tolist()):
        total[phrase] = total.get(phrase, 0) + n


def _matched(least: int, shard: int):
    """(lang, phrase, f): counts that reach the threshold, from windows in the order of buckets and languages. Windows go in
    their order through one automaton of at most `shard` characters after the other, each of the phrases that its windows hold."""

    def counts(lang: str, held: dict[bytes, int]) -> pa.RecordBatch:
        total: dict[bytes, int] = {}
        windows, phrases, size = [], {}, 0
        for window in sorted(held):
            new = [p for p in _parts(window) if p not in phrases]
            more = sum(len(p) + 2 for p in new)
            if windows and size + more > shard:
                _added(windows, list(phrases), total)
                windows, phrases, size, new = [], {}, 0, _parts(window)
                more = sum(len(p) + 2 for p in new)
            windows.append((window, held[window]))
            phrases.update(dict.fromkeys(new))
            size += more
        _added(windows, list(phrases), total)
        good = [(p.decode(), n) for p, n in total.items() if n >= least]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(good), pa.string()), pa.array([p for p, _ in good], pa.string()), pa.array([n for _, n in good], pa.int64())], ["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in batches:
            for bucket, lang, windows, n in zip(*(c.to_pylist() for c in batch.columns)):
                if last != (bucket, lang):
                    if held:
                        yield counts(last[1], held)
                    last, held = (bucket, lang), {}
                for window, m in zip(windows.split(b"\n"), np.frombuffer(n, np.uint32).tolist()):
                    held[window] = held.get(window, 0) + m
        if held:
            yield counts(last[1], held)

    return run


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f): exact counts of phrases of two to `longest` words that occur at least `least` times in their
    language, of their parts and of words; and (lang, n): the words of each language."""
    spark = docs.sparkSession
    small_batches(spark)
    send = spark.sparkContext.broadcast
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    pairs_sketch = Staged(texts.mapInArrow(_sketch(least, longest), SKETCH), "pair-sketch").df
    n = pairs_sketch.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
    pairs = send(_bitmap(pairs_sketch, least))
    more_sketch = Staged(texts.mapInArrow(_sketch(least, longest, pairs), SKETCH), "sketch").df
    more = send(_bitmap(more_sketch, least))
    found = texts.mapInArrow(_windows(longest, pairs, more), WINDOWS).repartition("bucket", "lang").sortWithinPartitions("bucket", "lang")
    return Staged(found.mapInArrow(_matched(least, shard), "lang string, phrase string, f long"), "phrase-counts").df, n


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language of `docs` (lang, text) its `top` phrases with at
    least `least` occurrences a, by score (then a, descending, then phrase, ascending in bytes). A phrase is cut in
    two parts with l and r occurrences such that floor(1000 a n / (l r)) is least, ties at the smallest
    first part; n is the number of words of the language. Phrases that lie in a longer one with as many
    occurrences are left out."""
    counts, n = counted(docs, least, longest, shard)
    words = F.split("phrase", " ")
    phrases = counts.withColumn("w", words).where((F.size("w") > 1) & (F.col("f") >= least)).select("lang", "phrase", F.col("f").alias("a"), "w")
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(n, "lang")
    wide = lambda c: f"cast({c} as decimal(18, 0))"  # noqa: E731  products have up to 38 digits
    score = F.expr(f"cast(1000 * ({wide('a')} * {wide('n')}) as decimal(38, 0)) div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r", "n")).alias("best"))

    sizes = F.filter(F.sequence(F.lit(2), F.greatest(F.size("w") - 1, F.lit(2))), lambda k: k < F.size("w"))
    inner = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    within = phrases.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "best.n", "best.score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
