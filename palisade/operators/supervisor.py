"""A supervisor's rounds replayed: plans pick agents, agents act, and one action comes of it, never milder than what an agent enforced.

`plans` has a row per round of a request: (request, round from 1, agents, more, at_s, the seconds since its start, when the plan was there).
`results` has (request, agent, action) of every agent that was asked; `said` has (request, action, confidence, at_s), how several
agents' results were reconciled. Actions are pass, flag, mask, block and escalate.

An empty plan passes the request, whatever came before. A plan's agents run once each, in order, while MAX_CALLS lasts; a budget that ends
within or before a plan, a plan that is late or missing, and MAX_ROUNDS plans that all ask for more escalate. One agent's action carries;
those of several need what was said, in time, with a known action and a confidence of 0 to 1, or the request escalates. An agent that
isn't registered is an error of the program and ends the request as `unregistered`, with no action.

(request, round), (request, agent) and `said`'s request are unique; rows with a null there are left out, as are rounds below 1. A null plan or
`more` is an empty one or no. An agent without a result escalated. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import rails
from palisade.operators import decisions
from palisade.operators.controls import TOOLS

MAX_ROUNDS, MAX_CALLS, TIMEOUT_S = 3, 6, 45.0
AGENTS = tuple(TOOLS)


def _round(s: Column, x: Column, most: int, rounds: int, timeout_s: float, agents: tuple[str, ...]) -> Column:
    """The state (made, ran, status) after one more plan."""
    plan = F.array_distinct(F.coalesce(x["agents"], F.expr("cast(array() as array<string>)")))
    taken = F.slice(plan, 1, F.greatest(F.lit(most) - s["made"], F.lit(0)))
    strange = F.exists(taken, lambda a: ~F.coalesce(a.isin(*agents), F.lit(False)))
    status = (
        F.when(x["round"].isNull(), "no_plan").when(x["at_s"] > timeout_s, "late").when(F.size(plan) == 0, "none").when(s["made"] >= most, "budget").when(strange, "unregistered")
        .when(F.size(plan) > F.size(taken), "budget").when(~F.coalesce(x["more"], F.lit(False)), "decided").when(x["round"] >= rounds, "rounds")
    )
    new = F.struct((s["made"] + F.size(taken)).alias("made"), F.array_union(s["ran"], taken).alias("ran"), status.alias("status"))
    stays = F.struct(s["made"].alias("made"), s["ran"].alias("ran"), status.alias("status"))
    return F.when(s["status"].isNotNull(), s).when(status.isin("no_plan", "late", "none"), stays).otherwise(new)


def routed(plans: DataFrame, max_rounds: int = MAX_ROUNDS, max_calls: int = MAX_CALLS, timeout_s: float = TIMEOUT_S, agents: tuple[str, ...] = AGENTS) -> DataFrame:
    """(request, made, ran, status) of every request: calls made, agents that ran, and decided, none or why it escalates.

    Rounds past the last that may count are left out before the shuffle, so a request is at most `max_rounds` rows."""
    row = F.struct(F.col("round").cast("int").alias("round"), F.col("agents").alias("agents"), F.col("more").alias("more"), F.col("at_s").cast("double").alias("at_s"))
    asked = plans.where("request is not null and round >= 1")
    by = asked.groupBy("request").agg(F.collect_list(F.when(F.col("round") <= max_rounds, row)).alias("plans"))
    start = F.struct(F.lit(0).alias("made"), F.expr("cast(array() as array<string>)").alias("ran"), F.lit(None).cast("string").alias("status"))
    at = lambda i: F.get(F.filter("plans", lambda p: p["round"] == i), F.lit(0))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(max_rounds)), start, lambda s, i: _round(s, at(i), max_calls, max_rounds, timeout_s, agents))
    return by.select("request", state.alias("s")).select("request", "s.made", "s.ran", "s.status")


def decided(plans: DataFrame, results: DataFrame, said: DataFrame, max_rounds: int = MAX_ROUNDS, max_calls: int = MAX_CALLS, timeout_s: float = TIMEOUT_S, agents: tuple[str, ...] = AGENTS) -> DataFrame:
    """`routed` with `floor`, `action` and `overridden`: an escalation gives way only to a floor above pass, an escalated end to nothing."""
    route = routed(plans, max_rounds, max_calls, timeout_s, agents)
    # what an agent did counts if it ran; all tables meet by request
    own = F.map_from_entries(F.collect_list(F.struct("agent", "action")))
    did = results.where(F.col("agent").isin(*agents) & F.col("request").isNotNull()).groupBy("request").agg(own.alias("did"))
    spoken = said.select("request", F.struct("action", "confidence", F.col("at_s").alias("at_s")).alias("said"))
    out = route.join(did, "request", "left").join(spoken, "request", "left")
    known = lambda a: F.coalesce(a.isin(*rails.LEVELS, "escalate"), F.lit(False))
    acts = F.transform("ran", lambda a: F.coalesce(F.col("did")[a], F.lit("escalate")))
    out = out.withColumn("acts", acts)
    floor = rails.verdict_of(F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(F.filter("acts", lambda a: a != "escalate"), lambda a: F.when(known(a), rails.rank(a)).otherwise(rails.rank(F.lit("block"))))), F.lit(0))))
    sound = known(F.col("said.action")) & F.coalesce(F.col("said.confidence").between(0, 1), F.lit(False))
    # time is asked for before results are weighed, so a late word escalates one agent's action too
    status = F.when(F.col("status") != "decided", F.col("status")).when(F.coalesce(F.col("said.at_s") > timeout_s, F.lit(False)), "late").when((F.size("ran") > 1) & ~sound, "malformed").otherwise("decided")
    out = out.withColumn("floor", floor).withColumn("status", status)
    wanted = F.when(F.size("ran") == 1, F.get("acts", F.lit(0))).otherwise(F.col("said.action"))
    final = decisions.policy_floor(wanted, F.size("ran"), F.col("floor"))
    ended = F.when(F.col("status") == "none", F.struct(F.lit("pass").alias("verdict"), F.lit(False).alias("overridden")))
    ended = ended.when(F.col("status") == "unregistered", F.struct(F.lit(None).cast("string").alias("verdict"), F.lit(False).alias("overridden")))
    ended = ended.when(F.col("status") == "decided", final).otherwise(F.struct(F.lit("escalate").alias("verdict"), F.lit(False).alias("overridden")))
    out = out.withColumn("end", ended)
    return out.select("request", "made", "ran", "status", "floor", F.col("end.verdict").alias("action"), F.coalesce("end.overridden", F.lit(False)).alias("overridden"))
