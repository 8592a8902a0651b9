"""Periodic runs of words: every maximal repetition of a text, found in linear time.

A run is a stretch of consecutive words with smallest period q, at least `shortest` words and
two periods long, that no neighbouring word extends.

Method (Kolpakov and Kucherov). A suffix automaton of the words gives the factorisation into
factors that occur earlier, as long as possible. Main's algorithm finds the runs that cross or
touch the beginning of a factor u: they reach less than 2|t| + |u| words to its left, where t is
the factor before, so longest common extensions by the Z algorithm over that stretch find them
all. Runs that lie strictly inside a factor are copied from where the factor occurs earlier.

A run of length n and period q holds n - q >= shortest / 2 places whose next shortest / 2 words
stand again q words on, and these windows cover it. So only stretches covered by windows that
their text holds twice are factorised; hashes find them, and no run is lost. Texts are worked
on one by one, in memory proportional to the longest text (about 1 kB a word that repeats), and
no row leaves its task: there is no shuffle.

Null and empty texts have no words and no runs. Repeated rows give repeated results, ties go to
the least start and then the least period, columns of any name pass through in `row`, and an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palisade.llm import wordhash as wh
from palisade.llm.common import BLANKS, once, read, small_batches

SHORTEST = 12
SCHEMA = "n_runs long, start long, length long, period long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_sha256 string"


class _Automaton:
    """Suffix automaton with the first place where each state's sequences end."""

    def __init__(self, w: list[int]):
        steps: list[dict[int, int]] = [{}]
        link, length, first = [-1], [0], [-1]
        last = 0
        for i, c in enumerate(w):
            cur = len(steps)
            steps.append({})
            link.append(0)
            length.append(i + 1)
            first.append(i)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = cur
                p = link[p]
            if p >= 0:
                q = steps[p][c]
                if length[q] != length[p] + 1:
                    copy = len(steps)
                    steps.append(dict(steps[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    first.append(first[q])
                    while p >= 0 and steps[p].get(c) == q:
                        steps[p][c] = copy
                        p = link[p]
                    link[q] = q = copy
                link[cur] = q
            last = cur
        self.steps, self.first = steps, first


def factorise(w: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, distance): factors, each the longest that starts earlier too, `distance` words
    before; a word that is new is a factor with distance 0."""
    known, out, i, n = _Automaton(w), [], 0, len(w)
    steps, first = known.steps, known.first
    while i < n:
        state, j = 0, i
        while j < n:
            to = steps[state][w[j]]
            if first[to] >= j:
                break
            state, j = to, j + 1
        if j == i:
            out.append((i, i + 1, 0))
            i += 1
        else:
            out.append((i, j, j - 1 - first[state]))
            i = j
    return out


def _z(a: list[int], upto: int) -> list[int]:
    """Length of the longest common prefix of a and a[i:], for i < upto."""
    z, left, right, n = [0] * upto, 0, 0, len(a)
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and a[k] == a[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _touching(w: list[int], lo: int, b: int, hi: int, shortest: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions within lo..hi that cross or touch b."""
    x, y = w[lo:b], w[b:hi]
    nx, ny = len(x), len(y)
    back = x[::-1]
    zx = _z([*back, -1, *y[::-1], *back], nx + 1 + ny)
    zy = _z([*y, -1, *x, *y], ny + 1 + nx)
    for p in range(1, ny + 1):  # a whole period lies on the right
        before, behind = zx[nx + 1 + ny - p], zy[p] if p < ny else 0
        if before + behind >= p and p + before + behind >= shortest:
            yield b - before, b + p + behind, p
    for p in range(1, nx + 1):  # or on the left
        before, behind = zx[p] if p < nx else 0, zy[ny + 1 + nx - p]
        if before + behind >= p and p + before + behind >= shortest:
            yield b - p - before, b + behind, p


def find_runs(words: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of `words` (numbers from 0 on), by start, then period."""
    n = len(words)
    w = [*words, max(words, default=0) + 1]  # one more, new word: every run ends before the last factor
    at: list[dict[int, int]] = [{} for _ in range(n + 1)]  # by start: end to period
    before = 0
    for b, e, distance in factorise(w):
        lo = max(0, b - 2 * before - (e - b))
        if b and e - lo >= shortest:
            for start, end, p in _touching(w, lo, b, e, shortest):
                if (start == 0 or w[start - 1] != w[start - 1 + p]) and (end > n or w[end] != w[end - p]):
                    have = at[start].get(end)
                    if have is None or p < have:  # the same stretch has multiples of its period too
                        at[start][end] = p
        if distance and e - b > shortest:
            last = e - distance
            for start in range(b - distance + 1, last - shortest):
                for end, p in at[start].items():
                    if end < last:
                        at[start + distance][end + distance] = p
        before = e - b
    return [(s, e - s, p) for s, ends in enumerate(at) for e, p in sorted(ends.items(), key=lambda x: x[1])]


def _stretches(h: np.ndarray, first: np.ndarray, width: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first and last word of the stretches covered by windows that their text holds twice."""
    none = np.zeros(0, np.int64)
    if len(h) < shortest:
        return none, none, none
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(text[: len(h) - width + 1] == text[width - 1 :])
    g = wh.mix(wh.runs(h, width)[inside] + text[inside].astype(wh.U) * wh.U(0x9E3779B97F4A7C15))
    order = np.argsort(g)
    same = g[order[1:]] == g[order[:-1]]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int64)
    step[inside[twice]] += 1
    step[inside[twice] + width] -= 1
    covered = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    if not len(covered):
        return none, none, none
    fresh = np.flatnonzero((np.diff(covered) != 1) | (np.diff(text[covered]) != 0)) + 1
    begin, end = covered[np.append(0, fresh)], covered[np.append(fresh - 1, len(covered) - 1)] + 1
    keep = end - begin >= shortest
    return text[begin[keep]], begin[keep], end[keep]


def _scan(shortest: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coeff, width = wh.table(11, False), -(-shortest // 2)
        no_runs = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for lo, hi, raw, offsets in wh.chunks(batch.column(1)):
                starts, ends, first = wh.bounds(raw, offsets)
                found: dict[int, list[tuple[int, int, int]]] = {}
                for i, b, e in zip(*(x.tolist() for x in _stretches(wh.word_hashes(raw, starts, ends, coeff), first, width, shortest))):
                    ids: dict[bytes, int] = {}
                    data = raw[starts[b] : ends[e - 1]].tobytes()
                    runs = find_runs([ids.setdefault(x, len(ids)) for x in data.split()], shortest)
                    if runs:
                        found.setdefault(i, []).extend((b - int(first[i]) + s, n, q) for s, n, q in runs)
                n_runs, longest, every, digest, collapsed, left = [], [], [], [], [], []
                for i in range(hi - lo):
                    words, runs = raw[offsets[i] : offsets[i + 1]].tobytes().split(), found.get(i)
                    if runs:
                        step = np.zeros(len(words) + 1, np.int64)
                        s, n, q = np.array(runs).T
                        np.add.at(step, s + q, 1)
                        np.add.at(step, s + n, -1)
                        gone = np.cumsum(step[:-1]) > 0
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                        digest.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
                        longest.append(min(runs, key=lambda r: (-r[1], r[0], r[2])))
                    else:
                        digest.append(no_runs)
                        longest.append((None, None, None))
                    n_runs.append(len(runs or ()))
                    every.append([{"start": s, "length": n, "period": q} for s, n, q in runs or ()])
                    text = b" ".join(words)
                    collapsed.append(hashlib.sha256(text).hexdigest())
                    if keep_text:
                        left.append(text.decode())
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(n_runs, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*longest)), pa.array(every, RUNS), pa.array(digest), pa.array(collapsed)]
                names = ["row", "n_runs", "start", "length", "period", "runs", "runs_sha256", "collapsed_sha256"]
                if keep_text:
                    cols.append(pa.array(left, pa.string()))
                    names.append("collapsed")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, keep_text: bool = False) -> DataFrame:
    """One row per row of `docs` (text and any others): `row` (a struct of all its columns but text), n_runs, the
    start, length and period of the longest run, `runs` (all, by start, then period), the SHA-256 of
    their `start,length,period` lines and of the words left, joined by single spaces, when each run
    keeps its first period alone; with keep_text also `collapsed`, that text."""
    small_batches(docs.sparkSession)
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"] or [F.lit(None).alias("none")]
    rows = docs.select(F.struct(*others).alias("row"), "text")
    schema = StructType([rows.schema["row"], *StructType.fromDDL(SCHEMA + ", collapsed string" * keep_text)])
    return rows.mapInArrow(_scan(shortest, keep_text), schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts that the query searches. One id in ten has a periodic end, its length and period drawn
    from the id's checksum. A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when((F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(f"[^{BLANKS}]"), F.regexp_extract_all("text", F.lit(f"[^{BLANKS}]+"), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), once(words).alias("w"))
    n = F.size("w").cast("long")
    rows = rows.withColumn("a", F.pmod("g", n)).withColumn("p", 1 + F.expr("(size(w) - a) div (3 + g % 8)"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), n - F.col("a") - 1), lambda i: F.get("w", (F.col("a") + F.pmod(i, F.col("p"))).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("w").isNull(), F.col("text")).otherwise(planted).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(read(spark, sf_dir, "documents"))
    return periodic_runs(docs).select("row.doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
