"""Quality rules: an ordered decision list learned from labelled text statistics.

Sequential covering: a rule against low quality grows by the threshold condition with the
best information gain on two thirds of the labelled rows, is pruned from its end while
that does not lower its worth on the last third, and is taken when its precision there
holds; rows it covers go, and the next rule follows. Counts of a step come from one
aggregation of the labelled rows by (feature, bin), so the driver sees FEATURES x BINS
numbers whatever the corpus has. The list becomes one `when` expression.

Null and empty texts have no words; all their statistics are 0. Repeated rows count each.
A document with several labels has the lowest. Without labels of both kinds there are no rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import BLANKS, Staged, read

BINS, MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVER = 32, 6, 3, 0.9, 5
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules are made of, for each row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(
        "doc_id",
        F.array_remove(F.split("text", f"[{BLANKS}]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANKS}]")).alias("lines"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    windows = F.expr("transform(sequence(0, size(words) - 5), i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]))")
    d = d.select(
        "doc_id", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 6, windows).alias("windows"),
    )
    d = d.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.expr("array_sort(transform(windows, (w, i) -> struct(w as w, i as i)))")))
    again = F.expr("array_sort(transform(filter(placed, (p, i) -> p.w = get(placed, i - 1).w or p.w = get(placed, i + 1).w), p -> p.i))")
    d = d.withColumn("again", again).drop("windows", "placed")
    covered = F.expr("aggregate(transform(again, (p, i) -> least(5, coalesce(get(again, i + 1) - p, 5))), 0L, (s, x) -> s + x)")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_distinct", "n_lines")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.expr(FEATURES[self.feature]).cast("double")
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _counts(rows: DataFrame, limits: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """By feature and bin: rows of low and of high quality."""
    table = rows.select("low", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("low").alias("p"), F.sum(1 - F.col("low")).alias("n"))
    names = list(limits)
    out: dict[str, dict[int, tuple[int, int]]] = {}
    for r in table.collect():  # FEATURES x BINS rows
        out.setdefault(names[r.f], {})[r.b] = (r.p, r.n)
    return out


def _best(rows: DataFrame, limits: dict[str, list[float]]) -> tuple[Condition, int, int] | None:
    counts = _counts(rows, limits)
    best = None
    for f, ts in limits.items():
        by = counts.get(f, {})
        p0, n0 = sum(p for p, _ in by.values()), sum(n for _, n in by.values())
        if not p0 or not n0:
            continue
        base, p, n = math.log2(p0 / (p0 + n0)), 0, 0
        for i, t in enumerate(ts):
            p, n = p + by.get(i, (0, 0))[0], n + by.get(i, (0, 0))[1]
            for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = a * (math.log2(a / (a + b)) - base) if a else 0.0
                if a >= MIN_COVER and (best is None or gain > best[0] + 1e-9):
                    best = (gain, Condition(f, above, t), a, b)
    return best[1:] if best and best[0] > 1e-9 else None


def _centred(covered: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The rule with each threshold half way to the nearest value that it covers."""
    near = covered.agg(*((F.min if c.above else F.max)(F.expr(FEATURES[c.feature]).cast("double")).alias(f"v{i}") for i, c in enumerate(rule))).first()
    return [Condition(c.feature, c.above, (c.threshold + near[i]) / 2) for i, c in enumerate(rule)]


def _bin(feature: str, limits: list[float]) -> Column:
    """How many limits a feature's value exceeds."""
    return F.size(F.filter(F.array(*map(F.lit, limits)), lambda t: t < F.expr(feature).cast("double")))


def learn(stats: DataFrame, labels: DataFrame, min_precision: float = MIN_PRECISION) -> list[list[Condition]]:
    """Rules against low quality, in order."""
    y = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.join(y, "doc_id").withColumn("low", (F.col("quality") == 0).cast("long")).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    rows = Staged(rows, "labelled").df
    marks = [(i + 1) / BINS for i in range(BINS - 1)]
    found = rows.groupBy("low").agg(*(F.percentile_approx(F.expr(e).cast("double"), marks, 2000).alias(f) for f, e in FEATURES.items())).collect()
    if len(found) < 2:
        return []
    limits = {f: sorted({t for r in found for t in r[f]}) for f in FEATURES}
    above = [_bin(FEATURES[f], ts) for f, ts in limits.items()]
    rows = Staged(rows.withColumn("bins", F.array(*above)), "binned").df
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        left = rows
        for r in rules:
            left = left.where(~_all(r))
        grow, prune = left.where("fold > 0"), left.where("fold = 0")
        conditions: list[Condition] = []
        while len(conditions) < MAX_CONDITIONS and (b := _best(grow.where(_all(conditions)), limits)):
            conditions.append(b[0])
            if not b[2]:
                break
        if not conditions:
            break
        cover = prune.agg(*(F.sum(F.when(_all(conditions[: i + 1]), F.col("low")).otherwise(0)).alias(f"p{i}") for i in range(len(conditions))), *(F.sum(F.when(_all(conditions[: i + 1]), 1 - F.col("low")).otherwise(0)).alias(f"n{i}") for i in range(len(conditions)))).first()
        worth = [((cover[f"p{i}"] or 0) - (cover[f"n{i}"] or 0)) / max(1, (cover[f"p{i}"] or 0) + (cover[f"n{i}"] or 0)) for i in range(len(conditions))]
        keep = len(conditions)
        while keep > 1 and worth[keep - 2] >= worth[keep - 1]:
            keep -= 1
        p, n = cover[f"p{keep - 1}"] or 0, cover[f"n{keep - 1}"] or 0
        if p < MIN_COVER or p < min_precision * (p + n):
            break
        rules.append(_centred(left.where(_all(conditions[:keep])), conditions[:keep]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list: false for the first rule that holds, true after the last."""
    out = F.when(F.lit(False), False)
    for r in rules:
        out = out.when(_all(r), False)
    return out.otherwise(True)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Staged(statistics(read(spark, sf_dir, "documents")), "statistics").df
    rules = learn(stats, read(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
