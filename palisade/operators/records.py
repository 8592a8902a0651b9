"""History, spending, budgets, audit chains, evaluation metrics and agent folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.rails import rank, verdict_of
from palisade.sources.carriers import RATES

BLOCK = 1024


def sessions(turns: DataFrame) -> DataFrame:
    asks = F.when(F.col("role") == "user", F.struct("ordinal", "text"))
    return turns.groupBy("user", "session_id").agg(
        F.count("*").alias("turns"), F.min(asks)["text"].alias("first_question"), F.max("ordinal").alias("last_ordinal"),
        F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"),
    )


def keep_last(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def rate(model: Column, side: int) -> Column:
    """Rate of the longest prefix that a model's name starts with; 0 without one."""
    out = F.when(F.lit(False), 0)
    for prefix, *rates in sorted(RATES, key=lambda r: -len(r[0])):
        out = out.when(model.startswith(prefix), rates[side])
    return out.otherwise(0)


def cost(usage: DataFrame) -> DataFrame:
    return usage.withColumn("micros", F.bround(F.col("tokens_in") * rate(F.col("model"), 0) + F.col("tokens_out") * rate(F.col("model"), 1)).cast("long"))


def budget_breaches(usage: DataFrame, daily: int) -> DataFrame:
    """Each user's first use on a day that brings the day's sum to the limit."""
    day = usage.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    w = Window.partitionBy("user_id", "day").orderBy("ts", "tokens_in", "tokens_out").rowsBetween(Window.unboundedPreceding, 0)
    run = day.withColumn("used", F.sum(F.col("tokens_in") + F.col("tokens_out")).over(w))
    return run.where(F.col("used") >= daily).groupBy("user_id", "day").agg(F.min("used").alias("used_at_breach"), F.count("*").alias("uses_after"))


def start(group: str) -> Column:
    """What the first record of a block links to."""
    return F.sha2(F.concat_ws("|", F.col(group).cast("string"), F.col("block").cast("string")), 256)


def hashed(prev: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, body), 256)


def chain(rows: DataFrame, group: str, seq: str, body: Column, block: int | Column = BLOCK) -> DataFrame:
    """`rows` with block, prev and hash: a record's hash covers its body and the hash before, in the order of seq.

    A group's chain is cut into blocks of consecutive seq numbers, each a fold over at most `block`
    records, or into the blocks that a column names; `seals` links the blocks, so no group passes through one task."""
    kept = F.struct(*rows.columns)
    at = block if isinstance(block, Column) else F.floor(F.col(seq) / block)
    keyed = rows.select(F.col(group).alias("g"), at.alias("block"), F.struct(F.col(seq).alias("s"), body.alias("body"), kept.alias("row")).alias("r"))
    # sorted by numbers and places alone: a comparison by a lambda takes longer than the hashes
    order = F.array_sort(F.transform("r", lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"))))
    folded = keyed.groupBy("g", "block").agg(F.collect_list("r").alias("r")).select("g", "block", "r", F.explode(F.array(order)).alias("order"))
    folded = folded.select("g", "block", F.explode(F.array(F.transform("order", lambda o: F.get("r", o["i"])))).alias("r"))
    # each hash once; the one before is the last of the list
    hashes = F.aggregate(F.transform("r", lambda x: x["body"]), F.array(start("g")), lambda out, x: F.array_append(out, hashed(F.element_at(out, -1), x)))
    linked = folded.select("block", F.col("r.row").alias("row"), F.explode(F.array(hashes)).alias("at"))
    out = linked.select("block", F.explode(F.arrays_zip("row", F.slice("at", 1, F.size("row")).alias("prev"), F.slice("at", 2, F.size("row")).alias("hash"))).alias("x"))
    return out.select("x.row.*", "block", "x.prev", "x.hash")


def seals(chained: DataFrame, group: str, seq: str) -> DataFrame:
    """One row a block: how many records it has and its last hash, chained over the blocks of a group."""
    ends = chained.groupBy(group, "block").agg(F.count("*").alias("n"), F.max_by("hash", seq).alias("last"))
    return chain(ends.withColumnRenamed("block", "at"), group, "at", F.concat_ws("|", F.col("at").cast("string"), F.col("n").cast("string"), "last")).drop("block").withColumnRenamed("at", "block")


def verify_chain(rows: DataFrame, sealed: DataFrame, group: str, seq: str, body: Column) -> DataFrame:
    """Per group: records, those whose content or link is broken, the first of them, and blocks that differ from their seals."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(group, "block").orderBy(seq)), start(group))
    checked = rows.withColumn("broken", (hashed(F.col("prev"), body) != F.col("hash")) | (F.col("prev") != before))
    blocks = checked.groupBy(group, "block").agg(
        F.count("*").alias("records"), F.count_if("broken").alias("broken"), F.min(F.when(F.col("broken"), F.col(seq))).alias("first_broken"), F.max_by("hash", seq).alias("end"),
    )
    both = blocks.join(sealed.select(group, "block", "n", "last"), [group, "block"], "full")
    whole = F.col("records").eqNullSafe(F.col("n")) & F.col("end").eqNullSafe(F.col("last"))
    return both.groupBy(group).agg(F.sum(F.coalesce("records", F.lit(0))).alias("records"), F.sum(F.coalesce("broken", F.lit(0))).alias("broken"), F.min("first_broken").alias("first_broken"), F.count_if(~whole).alias("broken_blocks"))


def last_hash(chained: DataFrame, group: str, seq: str) -> DataFrame:
    """Where an append to a group's chain goes on."""
    return chained.groupBy(group).agg(F.max_by("hash", seq).alias("hash"))


def confusion(rows: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """Counts, precision and recall of two booleans."""
    n = rows.select(expected.alias("e"), actual.alias("a")).agg(*(F.count_if((F.col("e") == e) & (F.col("a") == a)).alias(k) for k, e, a in (("tp", True, True), ("fp", False, True), ("fn", True, False), ("tn", False, False))))
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    return n.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))


def quantiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median, and the 95th percentile as the element at floor(0.95 n). Values are counted first,
    so the window orders distinct values, not rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(value))
    n = counts.groupBy(key).agg(F.sum("c").alias("n"))
    ranked = counts.withColumn("upto", upto).join(n, key)
    holds = lambda at: (F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)
    pick = lambda at: F.max(F.when(holds(at), F.col(value)))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return ranked.groupBy(key).agg(F.round((pick(low) + pick(high)) / 2, 6).alias("p50"), F.round(pick(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))), 6).alias("p95"))


def arm_changes(outcomes: DataFrame) -> DataFrame:
    """Cases by how their verdict changed from arm a to arm b; a case that one arm lacks is `only`."""
    a, b = (outcomes.where(F.col("arm") == x).select("case_id", F.col("actual").alias(f"actual_{x}")) for x in ("a", "b"))
    ra, rb = rank(F.col("actual_a")), rank(F.col("actual_b"))
    change = F.when(ra.isNull() | rb.isNull(), "only").when(rb < ra, "looser").when(rb > ra, "stricter").otherwise("same")
    return a.join(b, "case_id", "full").groupBy(change.alias("change")).agg(F.count("*").alias("cases"))


def strictest(outcomes: DataFrame, key: str) -> DataFrame:
    """The strictest verdict of a key's outcomes; escalations don't count, none left is a pass."""
    best = F.max(F.when(F.col("actual") != "escalate", rank(F.col("actual"))))
    return outcomes.groupBy(key).agg(verdict_of(F.coalesce(best, F.lit(0))).alias("verdict"))
