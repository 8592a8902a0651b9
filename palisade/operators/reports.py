"""Roll-ups of traces, evaluation outcomes, people, limits and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.rails import rank, verdict_of


def traces(stages: DataFrame) -> DataFrame:
    """Per request of `stages` (request, kind, verdict, ms): all time, the guardrails' time (rails and retries), their share, the strictest verdict."""
    own = F.sum(F.when(F.col("kind").isin("rail", "retry"), F.col("ms")).otherwise(0))
    out = stages.groupBy("request").agg(F.sum("ms").alias("total_ms"), own.alias("guardrail_ms"), verdict_of(F.max(rank(F.col("verdict")))).alias("verdict"))
    return out.withColumn("share", F.round(F.when(F.col("total_ms") > 0, 100 * F.col("guardrail_ms") / F.col("total_ms")).otherwise(0.0), 1))


def layer_counts(outcomes: DataFrame) -> DataFrame:
    """(rail, judge, local): how often each layer decided, from `layers`, a map of rails to layers."""
    each = outcomes.select(F.explode("layers").alias("rail", "layer"))
    return each.groupBy("rail").agg(F.count_if(F.col("layer") == "judge").alias("judge"), F.count_if(F.col("layer") == "local").alias("local"))


def rates(outcomes: DataFrame) -> DataFrame:
    """Share of requests that reached a judge, share blocked, judge calls a request."""
    calls = F.size(F.map_filter("layers", lambda k, v: v == "judge"))
    return outcomes.agg(
        F.round(F.avg((calls > 0).cast("double")), 3).alias("fallback_rate"), F.round(F.avg((F.col("actual") == "block").cast("double")), 3).alias("block_rate"),
        F.round(F.avg(calls.cast("double")), 3).alias("calls_per_request"),
    )


def rail_metrics(cases: DataFrame) -> DataFrame:
    """False positive rate over cases that should pass, false negative rate (passed outright) over those that should fire,
    exact matches over all cases, and cases caught less strictly than labelled."""
    clean, fired = F.col("expected") == "pass", F.col("actual") != "pass"
    weaker = fired & (rank(F.col("actual")) < rank(F.col("expected")))
    return cases.agg(
        F.round(F.avg(F.when(clean, fired.cast("double"))), 3).alias("fpr"), F.round(F.avg(F.when(~clean, (~fired).cast("double"))), 3).alias("fnr"),
        F.round(F.avg((F.col("expected") == F.col("actual")).cast("double")), 3).alias("exact"), F.count_if(weaker).alias("under_caught"), F.count("*").alias("cases"),
    )


def regressions(outcomes: DataFrame) -> DataFrame:
    """(case_id, change) that arm b brings: newly_missed cases fired in a alone, newly_blocked are blocked in b alone."""
    of = lambda arm, cond: outcomes.where((F.col("arm") == arm) & cond).select("case_id")
    fired, blocked = F.col("actual") != "pass", F.col("actual") == "block"
    missed = of("a", fired).join(of("b", ~fired), "case_id", "left_semi").withColumn("change", F.lit("newly_missed"))
    return missed.unionByName(of("b", blocked).join(of("a", blocked), "case_id", "left_anti").withColumn("change", F.lit("newly_blocked")))


def suite(runs: DataFrame) -> DataFrame:
    """Per category: cases, share routed to exactly the expected set, decisions right where one is expected, escalations, mean latency."""
    same = F.array_sort(F.array_distinct("routed")) == F.array_sort(F.array_distinct("expected_route"))
    right = F.when(F.col("expected").isNotNull(), (F.col("expected") == F.col("actual")).cast("double"))
    return runs.groupBy("category").agg(
        F.count("*").alias("cases"), F.round(F.avg(same.cast("double")), 6).alias("routing"), F.round(F.avg(right), 6).alias("decisions"),
        F.round(F.avg((F.col("actual") == "escalate").cast("double")), 6).alias("escalated"), F.round(F.avg("ms"), 3).alias("ms"),
    )


def people(users: DataFrame, usage: DataFrame) -> DataFrame:
    """Per role of `users` (user_id, role, cap; 0: none): people, those with a cap, those over it, tokens."""
    used = usage.groupBy("user_id").agg(F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("used"))
    each = users.join(used, "user_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    capped = F.col("cap") > 0
    return each.groupBy("role").agg(F.count("*").alias("people"), F.count_if(capped).alias("capped"), F.count_if(capped & (F.col("used") >= F.col("cap"))).alias("over"), F.sum("used").alias("tokens"))


def windows_used(usage: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Per user: use of the newest day and month and of all time, and the first window at its limit, in the order daily, monthly, total."""
    tokens, day, month = F.col("tokens_in") + F.col("tokens_out"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM")
    by = usage.groupBy("user_id", month.alias("month"), day.alias("day")).agg(F.sum(tokens).alias("used"))
    last = Window.partitionBy("user_id")
    by = by.withColumn("last_day", F.max("day").over(last)).withColumn("last_month", F.max("month").over(last))
    out = by.groupBy("user_id").agg(
        F.sum(F.when(F.col("day") == F.col("last_day"), F.col("used"))).alias("daily"), F.sum(F.when(F.col("month") == F.col("last_month"), F.col("used"))).alias("monthly"), F.sum("used").alias("total"),
    )
    breach = F.when(F.lit(False), "")
    for name in ("daily", "monthly", "total"):
        breach = breach.when((F.lit(limits.get(name, 0)) > 0) & (F.col(name) >= limits.get(name, 0)), name)
    return out.withColumn("breach", breach.otherwise("none"))


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key; keys whose newest change is a deletion go."""
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), order).alias("r")).select("r.*")
    return newest.where("not deleted").drop("deleted")


def overrides(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(key, value): what differs from the baseline (key, value); keys that it doesn't know are an error row of their own."""
    both = current.join(baseline.withColumnRenamed("value", "base"), "key", "left")
    return both.where(F.col("base").isNull() | (F.col("value") != F.col("base"))).select("key", "value", F.col("base").isNull().alias("unknown"))


def live(sessions: DataFrame, now: Column, ttl_s: int) -> DataFrame:
    """Sessions (user_id, at) still alive, per user."""
    return sessions.where(F.unix_timestamp(now) - F.unix_timestamp("at") < ttl_s).groupBy("user_id").agg(F.count("*").alias("live"))


def context(turns: DataFrame, n: int = 12) -> DataFrame:
    """`turns` (owner, session_id, ordinal, text, blocked) with `before`: the texts of up to n messages before it that weren't blocked."""
    w = Window.partitionBy("owner", "session_id").orderBy("ordinal").rowsBetween(-n, -1)
    return turns.withColumn("before", F.collect_list(F.when(~F.col("blocked"), F.col("text"))).over(w))
