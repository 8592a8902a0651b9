"""Controls around rails: judges of scope, gates on masks, failing rails, checked settings, tools, limits and notes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import rails
from palisade.functions.vault import TOKEN

#: Types of settings that are lists.
LISTS = ("string[]", "regex[]", "enum[]", "set", "ruleset")
#: The tools that each agent may call.
TOOLS = {
    "pii": ("detect_pii_regex", "detect_pii_presidio", "classify_pii_type", "get_pii_policy"),
    "injection": ("detect_injection_patterns", "classify_injection", "inspect_instruction_hierarchy", "get_injection_policy"),
    "content": ("score_content_categories", "get_content_policy"),
    "scope": ("check_domain_vocabulary", "get_scope_policy"),
    "authorization": ("get_user_role", "get_user_permissions", "get_resource_classification", "check_permission", "check_ownership"),
    "grounding": ("extract_claims", "check_local_entailment", "get_grounding_policy"),
}


def scope(text: Column, terms, judge: Column, threshold: float, action: str = "flag") -> Column:
    """Struct of layer, score and verdict: a scope word passes; else a judge's score, if any, is held against the threshold."""
    hit, s = F.size(rails.in_scope(text, terms)) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), judge))
    layer = F.when(hit, "vocabulary").when(judge.isNotNull(), "judge").otherwise("none")
    out = (layer == "judge") & (s < threshold)
    return F.struct(layer.alias("layer"), F.when(layer == "judge", s).otherwise(1.0).alias("score"), F.when(out, action).otherwise("pass").alias("verdict"))


def gated(action: Column, masked: Column, allow: Column, preserve: Column) -> Column:
    """Struct of the action and text of an agent's reply: a mask that policy refuses goes to a person, without a text;
    tokens that it doesn't keep are redacted."""
    refused = (action == "MASK") & ~allow
    text = F.when(refused, F.lit(None).cast("string")).when((action == "MASK") & ~preserve, F.regexp_replace(masked, TOKEN, "[REDACTED]")).otherwise(masked)
    return F.struct(F.when(refused, "ESCALATE").otherwise(action).alias("action"), text.alias("text"))


def failed(verdict: Column, error: Column, late: Column, mode: Column) -> Column:
    """A rail's verdict: late ones block in either mode, failing ones block unless the mode is fail_open."""
    return F.when(late, "block").when(error.isNotNull(), F.when(mode == "fail_open", "pass").otherwise("block")).otherwise(verdict)


def _compiles(pattern: str | None) -> bool:
    try:
        re.compile(pattern or "")
    except (re.error, OverflowError, RecursionError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def _all_compile(lists: pd.Series) -> pd.Series:
    return lists.map(lambda patterns: patterns is None or all(map(_compiles, patterns)))


def checked(changes: DataFrame, registry: DataFrame) -> DataFrame:
    """`changes` (key, raw, ...) with `value`, as text, or `error`. `registry`: key, type, least, most, options, locked;
    a row a parameter, so it is broadcast where Spark finds it small. Lists (types in LISTS) are read and given as JSON,
    their items as strings; a null one is empty, and each item of a regex[] must compile."""
    j = changes.join(registry, "key", "left")
    t, raw = F.col("type"), F.trim("raw")
    whole, real = raw.rlike(r"^[+-]?\d+$"), raw.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")
    n = F.when(real, F.expr("try_cast(trim(raw) as double)"))
    number = t.isin("int", "float")
    readable = F.when(t == "int", whole).when(t == "float", real).otherwise(F.lit(True))
    items = F.when(t.isin(*LISTS), F.when(F.col("raw").isNull(), F.expr("cast(array() as array<string>)")).when(raw.startswith("["), F.from_json("raw", "array<string>")))
    error = (
        F.when(t.isNull(), "unknown").when(F.col("locked"), "locked").when(number & ~F.coalesce(readable, F.lit(False)), "unreadable")
        .when(number & (n < F.col("least")), "below").when(number & (n > F.col("most")), "above").when((t == "enum") & ~F.array_contains("options", F.col("raw")), "no option")
        .when(t.isin(*LISTS) & items.isNull(), "no list").when((t == "regex[]") & ~_all_compile(items), "no pattern")
    )
    value = F.when(t == "bool", F.lower(raw).isin("1", "true", "yes", "on").cast("string")).when(number, n.cast("string")).when(t.isin(*LISTS), F.to_json(items)).otherwise(F.col("raw"))
    return j.select(*changes.columns, F.when(error.isNull(), value).alias("value"), error.alias("error"))


def evidence_text(results: Column, margin: float) -> Column:
    """A line per result (rail, unit, score, threshold, verdict, error), marked where its score is within `margin` of its
    threshold; results that failed, count or have no threshold are never marginal."""
    near = lambda r: r["error"].isNull() & (r["unit"] != "count") & (r["threshold"] > 0) & (F.round(F.abs(r["score"] - r["threshold"]), 9) <= margin)
    body = lambda r: F.when(r["error"].isNotNull(), F.concat(F.lit("error "), r["error"])).when(r["unit"] == "count", F.format_string("%.0f found", r["score"])).otherwise(F.format_string("%.3f of %.3f", r["score"], r["threshold"]))
    away = lambda r: F.when(near(r), F.format_string(" [marginal, %.3f away]", F.abs(r["score"] - r["threshold"]))).otherwise("")
    return F.array_join(F.transform(results, lambda r: F.concat(r["rail"], F.lit(": "), body(r), F.lit(", "), r["verdict"], away(r))), "\n")


def dispatched(agent: Column, tool: Column, error: Column) -> Column:
    """A call's status: not_allowed, by the agent's list, without a look at what the call did; else error or ok."""
    mine = F.create_map(*[x for a, ts in TOOLS.items() for x in (F.lit(a), F.array(*map(F.lit, ts)))])[agent]
    return F.when(~F.coalesce(F.array_contains(mine, tool), F.lit(False)), "not_allowed").when(error.isNotNull(), "error").otherwise("ok")


def first_per_document(hits: DataFrame, query: str, doc: str, rank: str) -> DataFrame:
    """A query's documents by their first hit, ranked anew from 1."""
    best = hits.groupBy(query, doc).agg(F.min(rank).alias("first"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("first", doc)))


def rejoined(texts: Column, glue: str, judge) -> Column:
    """Retrieved `texts` evaluated as one and split again: none if blocked. `judge` makes (verdict, text) of one text."""
    verdict, text = judge(F.array_join(texts, glue))
    return F.when(verdict == "block", F.expr("cast(array() as array<string>)")).otherwise(F.split(text, glue))


def document_id(title: Column, *parts: Column) -> Column:
    """A readable part of up to 40 characters and six hex digits from what is unique to the document."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return F.concat_ws("-", F.coalesce(F.nullif(slug, F.lit("")), F.lit("document")), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 6))


def forget(turns: DataFrame, users: DataFrame) -> DataFrame:
    """The turns of all but some users."""
    return turns.join(users, "user", "left_anti")


def limits(changes: DataFrame, key: str, at: str, names: tuple[str, ...]) -> DataFrame:
    """Each key's limits, set one by one: the newest that isn't null; never set is 0, without a limit."""
    return changes.groupBy(key).agg(*(F.coalesce(F.max_by(F.when(F.col(n).isNotNull(), F.col(n)), F.when(F.col(n).isNotNull(), F.col(at))), F.lit(0)).alias(n) for n in names))


def model_calls(traces: DataFrame, stages: str = "stages") -> DataFrame:
    """Rails of all stages that used a model: one row a rail with tokens in or out."""
    each = traces.withColumn("rail", F.explode(F.flatten(F.transform(stages, lambda s: s["rails"])))).drop(stages)
    return each.where((F.col("rail.tokens_in") > 0) | (F.col("rail.tokens_out") > 0))


def noted(stages: DataFrame, notes: DataFrame) -> DataFrame:
    """`notes` (request, at, note) with the stage (request, at, stage) that was open or had closed last: the last begun.
    A request's stages are few, and both sides meet in one window. Notes before any stage are dropped."""
    both = stages.select("request", "at", "stage", F.lit(None).cast("string").alias("note")).unionByName(notes.select("request", "at", F.lit(None).cast("string").alias("stage"), "note"))
    w = Window.partitionBy("request").orderBy("at", F.col("note").isNotNull())
    return both.withColumn("stage", F.last("stage", ignorenulls=True).over(w)).where(F.col("note").isNotNull() & F.col("stage").isNotNull())


def scenarios(checks: DataFrame) -> DataFrame:
    """Per scenario its steps, those that failed, and whether all checks held without an error."""
    good = F.coalesce(F.col("held"), F.lit(False)) & F.col("error").isNull()
    return checks.groupBy("scenario").agg(F.count("*").alias("steps"), F.count_if(~good).alias("failed"), F.every(good).alias("passed"))


def refusal(summary: Column, request: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.concat(F.lit("Your request was stopped. Reference "), request.cast("string"), F.lit(".")))
