"""Spans against plain loops, and on texts with very many matches."""

import random
import re
import time

from pyspark.sql import functions as F

from palisade.functions import pii, spans


def test_sums_before(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 4_095, 4_097, 20_000)]
    got = [list(r.s) for r in spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>").orderBy("i").select(spans.sums_before(F.col("x")).alias("s")).collect()]
    assert got == [[sum(x[:i]) for i in range(len(x))] if len(x) < 100 else _sums(x) for x in lists]


def _sums(x):
    out, at = [], 0
    for n in x:
        out.append(at)
        at += n
    return out


def _kept(found):
    out, stop = [], 0
    for s in sorted(found, key=lambda s: (s[0], s[0] - s[1], s[4])):
        if s[0] >= stop:
            out.append(s)
            stop = s[1]
    return out


def test_resolve_and_splice_in_many_stretches(spark):
    rng = random.Random(4)
    rows = []
    for n in (0, 1, 5, 64, 65, 200, 9_000):
        text = "".join(rng.choice("abcé😀") for _ in range(3 * n + 5))
        found = []
        for i in range(n):
            a = rng.randrange(len(text) - 4)
            b = a + rng.randrange(1, 5)
            found.append((a, b, rng.choice("XY"), text[a:b], i))
        rows.append((n, text, found))
    df = spark.createDataFrame(rows, f"n int, text string, found array<{spans.SPAN}>")
    out = {r.n: r for r in df.select("n", spans.resolve(F.col("found")).alias("kept"), spans.splice(F.col("text"), spans.resolve(F.col("found")), lambda s: F.concat(F.lit("<"), s["kind"], s["value"], F.lit(">"))).alias("new")).collect()}
    for n, text, found in rows:
        kept = _kept(found)
        assert [tuple(s) for s in out[n].kept] == kept
        at, new = 0, ""
        for s in kept:
            new += text[at : s[0]] + f"<{s[2]}{s[3]}>"
            at = s[1]
        assert out[n].new == new + text[at:]


def test_offsets_of_matches(spark):
    rng = random.Random(5)
    texts = ["", "no", "é1 😀22", "7" * 300, " ".join(rng.choice(["a", "é😀", "12", "345"]) for _ in range(9_000)), None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select("text", spans.find(F.col("text"), "[0-9]+", "N", 3).alias("f")).collect()
    for r in got:
        assert [tuple(s) for s in r.f] == [(m.start(), m.end(), "N", m[0], 3) for m in re.finditer("[0-9]+", r.text or "")]


def test_hundred_thousand_matches(spark):
    n = 100_000
    df = spark.createDataFrame([(" ".join(f"10.0.{i % 250}.7" for i in range(n)),)], "text string")
    began = time.time()
    out = df.select(pii.mask(F.col("text"), pii.detect(F.col("text"))).alias("x")).first().x
    assert out == " ".join(["<IP_ADDRESS>"] * n) and time.time() - began < 60
