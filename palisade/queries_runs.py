"""Queries over runs of agents: tool calls replayed."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import rails, vault
from palisade.functions.spans import find
from palisade.operators import supervisor, toolruns
from palisade.sources.carriers import prompts, table

SECRET, TTL = "fedcba9876543210", 3_600  # of the query's own test vault
TOOLS = {"lookup": (False, ("reference",)), "search": (False, ()), "file": (True, ("reference",))}
DONE = ("pass", "flag", "mask", "block", "escalate")
RULES = (*rails.SECURITY_RULES, *rails.USE_CASE_RULES)


def _asks(spark, d):
    """Every event asks for a call, three a step and 24 a run, with its tokenised text as an argument twice; its result is the next event's
    text. Every thirteenth step is an answer."""
    i, n = F.col("request_id"), F.floor(F.col("request_id") / 3)
    p = prompts(spark, d).select("request_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "text")
    marked = vault.tokenized(p, "request_id", "user_id", find(F.col("text"), r"CLM-\d{8}|user\d+@mail1\.example\.com", "CLAIM"))
    back = p.select((i - 1).alias("request_id"), F.col("text").alias("result"))
    tool = F.when(n % 13 == 12, None).when(i % 17 == 5, "erase").when(i % 7 == 3, "file").when(i % 2 == 0, "lookup").otherwise("search")
    rows = marked.join(back, "request_id", "left").where((n % 13 != 12) | (i % 3 == 0))
    asks = rows.select(
        F.floor(i / 24).alias("run"), (F.col("user_id") + (i % 5 == 0).cast("int")).alias("principal"), F.timestamp_seconds(F.unix_timestamp("ts") + F.when(i % 10 == 1, 7_200).otherwise(60)).alias("at"),
        (1 + F.floor(i % 24 / 3)).cast("int").alias("step"), (i % 3).cast("int").alias("place"), tool.alias("tool"),
        F.create_map(F.lit("reference"), F.col("masked"), F.lit("note"), F.col("masked")).alias("args"), "result",
        F.when(i % 31 == 0, "timeout").when(i % 31 == 7, "failed").alias("error"), F.when(i % 4 == 0, None).otherwise(i % 4 != 1).alias("decided"),
    )
    return asks, vault.sealed(marked, "user_id", "ts", SECRET)


def _calls(spark, d):
    asks, held = _asks(spark, d)
    results = lambda t: rails.fold(rails.rule_verdict(t, RULES), F.when(rails.injection_score(t) >= rails.INJECTION_THRESHOLD, "block").otherwise("pass"))
    return toolruns.replayed(toolruns.screened(asks, TOOLS, lambda t: rails.rule_verdict(t, RULES), results), TOOLS), held


def q123_tool_runs(spark, d):
    """What became of every call."""
    return _calls(spark, d)[0].select("run", "step", "place", "status", "outcome", F.coalesce("verdict", F.lit("")).alias("verdict"))


def q124_tool_arguments(spark, d):
    """What the tools that ran saw: the reference unmasked where tool and principal are entitled to it, the note never."""
    calls, held = _calls(spark, d)
    out = toolruns.resolved(calls, held, TOOLS, SECRET, TTL)
    return out.select("run", "step", "place", "unmasked", F.col("seen")["reference"].alias("reference"), F.col("seen")["note"].alias("note"))


def q125_tool_run_sums(spark, d):
    return toolruns.summed(_calls(spark, d)[0])


def q126_supervisor_rounds(spark, d):
    """Every event is a plan, three a request, and what two agents did; the first of a request is also what was said of all results."""
    e = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 3).alias("request"))
    i = F.col("event_id")
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), n.cast("int"))
    names = F.array(*(pick(supervisor.AGENTS, F.floor(i / k) % 6) for k in (1, 2, 5, 7)))
    plans = e.select("request", (i % 3 + 1).alias("round"), F.slice(names, 1, F.floor(i / 3) % 7 % 5).alias("agents"), (i % 7 < 4).alias("more"), (i % 53).cast("double").alias("at_s")).where(F.col("request") % 19 != 7)
    acts = e.select("request", F.explode(F.array(*map(F.lit, supervisor.AGENTS))).alias("agent"), "event_id").where("event_id % 3 = 0")
    code = F.floor(F.col("request") / 2) + F.length("agent") * 3
    results = acts.select("request", "agent", pick(DONE, code % len(DONE)).alias("action"))
    said = e.where("event_id % 3 = 0").select("request", pick((*DONE, "unheard"), i % 6).alias("action"), (i % 12 / 10).alias("confidence"), (i % 47).cast("double").alias("at_s"))
    out = supervisor.decided(plans, results, said)
    return out.select("request", F.col("made").cast("long").alias("made"), F.size("ran").cast("long").alias("ran"), "status", "action", "overridden")
