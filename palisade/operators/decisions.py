"""Decisions on scored and looked-up rows: content breaches, second opinions, policy floors, permissions, prices, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.rails import LEVELS, rank, verdict_of


def content_breach(scores: dict[str, Column], thresholds: dict[str, float]) -> Column:
    """Struct of the verdict, the categories at or above their thresholds (sorted) and the largest score by its threshold."""
    of = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) for c, s in scores.items()}
    over = F.array_compact(F.array(*(F.when(of[c] >= thresholds[c], c) for c in sorted(of))))
    worst = F.array_max(F.array(*(of[c] / thresholds[c] for c in sorted(of))))
    return F.struct(F.when(F.size(over) > 0, "block").otherwise("pass").alias("verdict"), F.array_join(over, ",").alias("breached"), F.round(worst, 6).alias("worst"))


def adjudicate(verdict: Column, score: Column, threshold: float, margin: float, second: Column, confidence: Column, least: float) -> Column:
    """A verdict after a second opinion on marginal scores: raised freely, lowered only with confidence and not below flag.
    An unknown second verdict changes nothing."""
    near = (F.lit(threshold) > 0) & (F.round(F.abs(score - threshold), 9) <= margin)
    old, new = rank(verdict), rank(second)
    lowered = F.least(old, F.greatest(new, F.lit(1)))
    return F.when(~near | (new < 0) | new.isNull(), verdict).when(new > old, second).when(confidence >= least, verdict_of(lowered)).otherwise(verdict)


def policy_floor(verdict: Column, findings: Column, action: Column) -> Column:
    """Struct of the verdict under a policy's floor and whether the floor overrode it. No findings or no action: no floor;
    an unknown action is a block; an escalating policy stands above all, a verdict that escalates above a floor of pass alone."""
    floor = F.when(action.isin(*LEVELS, "escalate"), action).otherwise("block")
    asked = (findings > 0) & action.isNotNull()
    out = F.when(~asked | ((verdict == "escalate") & (floor == "pass")), verdict).when(floor == "escalate", floor).when(rank(floor) > rank(verdict), floor).otherwise(verdict)
    return F.struct(out.alias("verdict"), (out != verdict).alias("overridden"))


def allowed(users: DataFrame, grants: DataFrame, permission: str) -> DataFrame:
    """The `users` (role, ...) whose role `grants` (role, permission) list for a permission."""
    return users.join(grants.where(F.col("permission") == permission), "role", "left_semi")


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """`usage` with the rates of the longest prefix in `prices` (prefix, rate_in, rate_out) that its model starts with; 0 without one.

    Only distinct models meet the prices, and prices are one row a prefix."""
    models = usage.select("model").distinct()
    best = models.join(prices, F.col("model").startswith(F.col("prefix")), "left")
    best = best.groupBy("model").agg(F.max_by(F.struct("prefix", "rate_in", "rate_out"), F.length("prefix")).alias("p"))
    best = best.select("model", *(F.coalesce(f"p.{c}", F.lit(0)).alias(c) for c in ("rate_in", "rate_out")), F.coalesce("p.prefix", F.lit("")).alias("prefix"))
    return usage.join(best, "model", "left")


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def claims(text: Column) -> Column:
    """Sentences of an answer."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda c: c != "")


def supported(claims_: Column, source: Column, share: float = 0.5) -> Column:
    """How many claims have at least `share` of their distinct words in the source."""
    known = words(source)
    inside = lambda c: F.size(F.array_intersect(words(c), known)) >= share * F.size(words(c))
    return F.size(F.filter(claims_, lambda c: (F.size(words(c)) > 0) & inside(c)))
