"""Lexicons as tables: terms of any number found in texts by joins, in one plan whatever their number.

A text is cut into tokens: words and single other characters (mode `word`), characters (`substring`), or the text as a
whole (`exact`). A term is a sequence of tokens, so it occurs where its first tokens do: up to HEAD tokens from each
place are looked up among the terms' beginnings, and what is found is compared as a whole. Terms that were counted and
are few are broadcast and looked up where the texts are: neither texts nor places are shuffled, and a row leaves its task
once. Else hashes of the beginnings join, both sides shuffled, and a text is worked on once however many rows hold it.

Terms are lower-cased; null, empty and longer ones than
LONGEST characters are ignored, repeated ones count once, and null and empty texts have no hits. An empty lexicon
and an empty table of texts give no hits. Columns of any name pass through; an input column `hits` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import spans

LONGEST = 256
HEAD = {"word": 3, "substring": 4, "exact": 1}
#: Terms that a broadcast may have: about 20 MB, as each has 256 characters at most and mostly few.
BROADCAST = 200_000
_WORD = "[A-Za-z0-9_]"
_CUT, _LETTERS = re.compile(f"{_WORD}+|[^A-Za-z0-9_]"), frozenset(map(chr, [*range(48, 58), *range(65, 91), 95, *range(97, 123)]))
_SPANS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("start", T.IntegerType()), ("stop", T.IntegerType()), ("kind", T.StringType()), ("value", T.StringType()), ("ord", T.IntegerType()))]))
#: Hits that a task hands on at a time.
HANDED = 100_000


def _tokens(text: Column, mode: str) -> Column:
    if mode == "exact":
        return F.array(text)
    if mode == "substring":
        return F.filter(F.split(text, ""), lambda c: c != "")
    return F.regexp_extract_all(text, F.lit(f"{_WORD}+|(?s:[^A-Za-z0-9_])"), F.lit(0))


def _head(tokens: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(tokens, at + i) for i in range(k)))


def _once(column: Column) -> Column:
    """Generates its one row, so that no optimiser puts the expression into a loop over its own elements."""
    return F.explode(F.array(column))


def _usable(terms: DataFrame, mode: str) -> DataFrame:
    if mode not in HEAD:
        raise ValueError(f"unknown mode: {mode}")
    return terms.select(F.lower("term").alias("term")).where(F.length("term").between(1, LONGEST)).distinct()


def prepared(terms: DataFrame, mode: str = "word") -> DataFrame:
    """(term, n, k, head): the usable terms (column `term`), their tokens and the hash of the first k of them."""
    cut = _usable(terms, mode).select("term", _once(_tokens(F.col("term"), mode)).alias("w"))
    head = F.when(F.lit(False), F.lit(0).cast("long"))
    for k in range(1, HEAD[mode] + 1):
        head = head.when(F.least(F.size("w"), F.lit(HEAD[mode])) == k, _head(F.col("w"), F.lit(0), k))
    return cut.select("term", F.size("w").alias("n"), F.least(F.size("w"), F.lit(HEAD[mode])).alias("k"), head.alias("head"))


def _cut(text: str, mode: str) -> list[str]:
    return [text] if mode == "exact" else list(text) if mode == "substring" else _CUT.findall(text)


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """One number of the tokens' numbers; it may wrap around, as what it finds is compared as text."""
    key = columns[0].astype(np.uint64)
    for c in columns[1:]:
        key = key * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64)
    return key


class _Lexicon:
    """Terms by their first tokens: what a task needs to find them in a text."""

    def __init__(self, terms: list[str], mode: str):
        self.bounded, self.vocabulary = mode == "word", {}
        cut = [(i, t, _cut(t, mode)) for i, t in enumerate(terms)]
        number = lambda t: self.vocabulary.setdefault(t, len(self.vocabulary))
        heads = [(i, t, [number(x) for x in w[: HEAD[mode]]], len(w)) for i, t, w in cut]
        size = max(1, len(self.vocabulary))
        self.first, self.single = np.zeros(size, bool), np.full(size, -1, np.int64)
        self.longer: list[tuple[int, np.ndarray, list[list[int]], dict[str, int]]] = []
        for i, t, head, n in heads:
            self.first[head[0]] = True
            if n == 1 and (not self.bounded or t[0] in _LETTERS):
                self.single[head[0]] = i
        for k in range(1, HEAD[mode] + 1):
            some = [(i, t, head) for i, t, head, _ in heads if len(head) == k and (k > 1 or self.single[head[0]] != i)]
            if some:
                keys, which = np.unique(_key([np.array([h[x] for _, _, h in some]) for x in range(k)]), return_inverse=True)
                lengths: list[set[int]] = [set() for _ in keys]
                for at, (_, t, _) in zip(which, some):
                    lengths[at].add(len(t))
                self.longer.append((k, keys, [sorted(x) for x in lengths], {t: i for i, t, _ in some}))

    def places(self, low: str, w: list[str], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, stops and numbers of terms, by place and length."""
        numbers = np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w))
        known = np.flatnonzero(numbers >= 0)
        known = known[self.first[numbers[known]]]
        # a word by itself is bounded by what no word has
        single = self.single[numbers[known]]
        alone = known[single >= 0]
        out: list[tuple[int, int, int]] = []
        end = len(low)
        for k, keys, lengths, ids in self.longer:
            at = known[known + k <= len(w)]
            key = _key([numbers[at + x] for x in range(k)])
            near = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            good = keys[near] == key
            for start, which in zip(begin[at[good]].tolist(), near[good].tolist()):
                if self.bounded and start and low[start - 1] in _LETTERS and low[start] not in _LETTERS:
                    continue
                for n in lengths[which]:
                    stop = start + n
                    if stop <= end and (i := ids.get(low[start:stop])) is not None and not (self.bounded and stop < end and low[stop] in _LETTERS):
                        out.append((start, stop, i))
        found = np.array(out, np.int64).reshape(-1, 3)
        starts, stops, which = (np.concatenate(x) for x in ((begin[alone], found[:, 0]), (begin[alone + 1], found[:, 1]), (single[single >= 0], found[:, 2])))
        order = np.lexsort((stops, starts))
        return starts[order], stops[order], which[order]


def _finder(terms: list[str], allow: list[str], mode: str):
    """For mapInArrow: rows (row, hits) whose `hits` is the lower-cased text, with its hits in its place."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, free = _Lexicon(terms, mode), _Lexicon(allow, mode)
        values = pa.array(terms, pa.string())

        def one(low: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w = _cut(low, mode) if low else []
            begin = np.fromiter(accumulate(map(len, w), initial=0), np.int64, len(w) + 1)
            starts, stops, which = lex.places(low, w, begin)
            opens, ends, _ = free.places(low, w, begin) if allow and len(starts) else ((), (), ())
            if len(opens):
                # how far the allowed hits reach that begin no later
                before = np.searchsorted(opens, starts, "right")
                kept = (before == 0) | (np.maximum.accumulate(ends)[np.maximum(before, 1) - 1] < stops)
                starts, stops, which = starts[kept], stops[kept], which[kept]
            return starts, stops, which

        def handed(rows: pa.Array, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            starts, stops, which = (np.concatenate([np.zeros(0, np.int64), *(f[x] for f in found)]).astype(np.int32) for x in range(3))
            kind = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(starts), np.int8)), pa.array(["blocked_term"])).cast(pa.string())
            fields = [pa.array(starts), pa.array(stops), kind, values.take(pa.array(which)), pa.array(np.zeros(len(starts), np.int32))]
            offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32))
            hits = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "stop", "kind", "value", "ord"]))
            return pa.RecordBatch.from_arrays([rows, hits], ["row", "hits"])

        for batch in batches:
            first, held, found = 0, 0, []
            for i, low in enumerate(batch.column(1)):
                found.append(one(low.as_py() or ""))
                held += len(found[-1][0])
                if held >= HANDED or i + 1 == batch.num_rows:
                    yield handed(batch.column(0).slice(first, len(found)), found)
                    first, held, found = i + 1, 0, []

    return find


def _found(texts: DataFrame, terms: DataFrame, mode: str, few: bool) -> DataFrame:
    """(text_key, hits) for the distinct `texts` (text_key, low) with hits of `terms`, sorted spans."""
    lex = prepared(terms, mode)
    lex = F.broadcast(lex) if few else lex
    cut = texts.select("text_key", _once(_tokens(F.col("low"), mode)).alias("w"))

    def places(k: int) -> DataFrame:
        heads = F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: _head(F.col("w"), i, k)))
        return cut.select("text_key", F.lit(k).alias("k"), F.posexplode(heads).alias("at", "head"))

    every = places(1)
    for k in range(2, HEAD[mode] + 1):
        every = every.unionByName(places(k))
    near = every.join(lex, ["k", "head"]).groupBy("text_key").agg(F.collect_list(F.struct("at", "n", "term")).alias("near"))
    word = lambda c: c.rlike(f"^{_WORD}")
    # a term that begins or ends with another character than a word's mustn't touch a word there
    touches = lambda c: (~word(c["term"]) & F.coalesce(word(F.get("w", c["at"] - 1)), F.lit(False))) | (~c["term"].rlike(f"{_WORD}$") & F.coalesce(word(F.get("w", c["at"] + c["n"])), F.lit(False)))
    same = lambda c: F.array_join(F.slice("w", c["at"] + 1, c["n"]), "") == c["term"]
    good = (lambda c: same(c) & ~touches(c)) if mode == "word" else same
    held = near.join(texts, "text_key").select("text_key", "near", _once(_tokens(F.col("low"), mode)).alias("w"))
    held = held.select("text_key", F.filter("near", good).alias("good"), _once(spans.sums_before(F.transform("w", F.length))).alias("begin"))
    span = lambda c: F.struct(F.get("begin", c["at"]).alias("start"), (F.get("begin", c["at"]) + F.length(c["term"])).alias("stop"), F.lit("blocked_term").alias("kind"), c["term"].alias("value"), F.lit(0).alias("ord"))
    return held.where(F.size("good") > 0).select("text_key", F.array_sort(F.transform("good", span)).alias("hits"))


def hits(docs: DataFrame, terms: DataFrame, allow: DataFrame | None = None, mode: str = "word", broadcast: int = BROADCAST) -> DataFrame:
    """`docs` (text and others) with `hits`: spans of `terms` (term) in the lower-cased text, overlapping ones included,
    without those that lie wholly inside a hit of `allow` (term). Sorted by place and term."""
    kept = [c for c in docs.columns if c != "hits"]
    few = [None if x is None else [r.term for r in _usable(x, mode).limit(broadcast + 1).collect()] for x in (terms, allow)]
    small = [len(x or ()) <= broadcast for x in few]
    if all(small):
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.lower("text").alias("hits"))
        schema = T.StructType([rows.schema["row"], T.StructField("hits", _SPANS)])
        return rows.mapInArrow(_finder(few[0], few[1] or [], mode), schema).select(*(F.col(f"row.`{c}`") for c in kept), "hits")
    keyed = docs.select(F.md5("text").alias("text_key"), F.lower("text").alias("low")).where(F.col("low") != "")
    texts = keyed.groupBy("text_key").agg(F.first("low").alias("low"))
    found = _found(texts, terms, mode, small[0])
    if allow is not None:
        free = _found(texts, allow, mode, small[1]).withColumnRenamed("hits", "free")
        inside = lambda h: F.exists(F.coalesce("free", F.array()), lambda a: (a["start"] <= h["start"]) & (h["stop"] <= a["stop"]))
        found = found.join(free, "text_key", "left").select("text_key", F.filter("hits", lambda h: ~inside(h)).alias("hits"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.md5("text").alias("text_key"))
    out = rows.join(found, "text_key", "left")
    return out.select(*(F.col(f"row.`{c}`") for c in kept), F.coalesce("hits", F.expr(spans.NONE)).alias("hits"))
