"""Grounding of answers, explanations to readers, tool calls, approvals and evidence, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import rails, spans
from palisade.operators.decisions import claims, words

#: Questions about the service, admissions of a gap, labels of kinds, classes of resources, capabilities.
META_QUESTION = (
    r"(?i)\b(?:why\s+(?:was|were|is|did|am|do)\b.{0,40}?\b(?:block|blocked|refus|reject|stopp|flag|denied|filter)"
    r"|(?:explain|appeal|challenge|understand)\s+(?:the\s+)?(?:refusal|rejection|block|decision)\b|what\s+(?:can|do)\s+you\s+(?:do|help|answer|access|have|know)"
    r"|which\s+(?:documents?|sources?|records?)\s+(?:do|can)?\s*you|how\s+(?:does|do)\s+(?:this|the)\s+(?:service|system|assistant)\s+work)"
)
GAP = (
    r"(?i)\b(?:does not|doesn't|do not|don't|no |not )\b.{0,40}\b(?:contain|include|cover|say|specify|state|have|mention|find)\b"
    r"|\b(?:i (?:would )?(?:need|can't|cannot)|not in the (?:context|source|material))\b"
)
RESOURCES = {"own_record": "owner_only", "case_file": "restricted", "published_contact": "public", "claim_status": "owner_only", "audit_log": "admin_only", "policy_config": "admin_only"}
CAPABILITIES = {"MASK": "mask", "REDACT": "mask", "BLOCK": "block_request", "ALLOW": "pass_through", "FLAG": "pass_through", "ESCALATE": "human_review"}
TOXIC_HEADS = {"identity_hate": "hate", "threat": "violence", "insult": "insults"}


def chosen(table: dict[str, str], key: Column, otherwise: str | None = None) -> Column:
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return F.coalesce(found, F.lit(otherwise)) if otherwise is not None else found


def grounded(answers: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """(key, claims, supported, consistency) of `answers` (key, text) against their own `chunks` (key, text): a claim
    stands if some chunk holds at least `least` of its distinct words. Claims meet only the chunks of their answer."""
    each = answers.select("key", F.posexplode(claims(F.col("text"))).alias("i", "claim")).withColumn("w", words(F.col("claim")))
    held = chunks.select("key", words(F.col("text")).alias("c"))
    share = F.when(F.size("w") > 0, F.size(F.array_intersect("w", "c")) / F.size("w")).otherwise(0.0)
    best = each.join(held, "key", "left").groupBy("key", "i").agg(F.max(F.coalesce(share, F.lit(0.0))).alias("best"))
    by = best.groupBy("key").agg(F.count("*").alias("claims"), F.count_if(F.col("best") >= least).alias("supported"))
    out = answers.select("key").join(by, "key", "left").fillna(0, ["claims", "supported"])
    return out.withColumn("consistency", F.round(F.when(F.col("claims") == 0, 1.0).otherwise(F.col("supported") / F.col("claims")), 6))


def grounding_verdict(n_chunks: Column, consistency: Column, relevance: Column, cited: Column, must_cite: Column, least: float = 0.5, related: float = 0.35) -> Column:
    """Struct of verdict and reason: nothing retrieved passes; then consistency, relevance and citations, in this order."""
    reason = F.when(n_chunks == 0, "no_context").when(consistency < least, "consistency").when(relevance < related, "relevance").when(must_cite & (F.size(cited) == 0), "citations").otherwise("grounded")
    return F.struct(F.when(reason.isin("no_context", "grounded"), "pass").otherwise("block").alias("verdict"), reason.alias("reason"))


def citations(text: Column, n_chunks: Column) -> Column:
    """Numbers in brackets that name a chunk, once each, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n_chunks))))


def numbered(claims_: Column) -> Column:
    return F.array_join(F.transform(claims_, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n")


def cascade(pattern: Column, local: Column, judge: Column, text: Column, bar: float = 0.9, threshold: float = rails.INJECTION_THRESHOLD) -> Column:
    """Struct of verdict, layer and score: a pattern decides first; a local score may only block, never a question about
    the service; else a judge, if there is one; null scores are layers that don't answer."""
    by_local = (local >= max(bar, threshold)) & ~text.rlike(META_QUESTION)
    judged = F.greatest(pattern, F.least(F.lit(1.0), F.greatest(F.lit(0.0), judge)))
    layer = F.when(pattern >= threshold, "pattern").when(F.coalesce(by_local, F.lit(False)), "local").when(judge.isNotNull(), "judge").otherwise("none")
    score = F.when(layer == "local", local).when(layer == "judge", judged).otherwise(pattern)
    return F.struct(F.when((layer != "none") & (score >= threshold), "block").otherwise("pass").alias("verdict"), layer.alias("layer"), score.alias("score"))


def category_scores(heads: Column) -> Column:
    """A map of a model's heads to scores as a map of our categories; heads that stand for none are left out."""
    of = {}
    for head, category in TOXIC_HEADS.items():
        of.setdefault(category, []).append(heads[head])
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), (F.greatest(*v) if len(v) > 1 else v[0]).alias("value")) for c, v in of.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def explained(results: Column, level: str, origin: Column, request: Column) -> Column:
    """The message to the reader from `results`, an array of (rail, verdict, detail): strictest first, without a pass;
    `level` none says nothing, minimal and category don't name details; injections never get more than their category."""
    at = ("none", "minimal", "category", "detailed").index(level)
    where = F.when(origin == "prompt", "your message").when(origin == "response", "the reply").when(origin == "document", "a document").otherwise("a tool's result")
    did = F.create_map(*map(F.lit, ("block", "was stopped", "mask", "was masked", "flag", "was marked")))

    def line(r: Column) -> Column:
        plain = F.concat(F.lit("Something in "), where, F.lit(" "), did[r["verdict"]], F.lit("."))
        named = F.concat(F.initcap(r["rail"]), F.lit(" in "), where, F.lit(" "), did[r["verdict"]])
        more = F.when((F.lit(at) >= 3) & (r["rail"] != "injection") & (F.coalesce(r["detail"], F.lit("")) != ""), F.concat(named, F.lit(" ("), r["detail"], F.lit(")."))).otherwise(F.concat(named, F.lit(".")))
        return plain if at < 2 else more

    fired = F.filter(results, lambda r: r["verdict"] != "pass")
    ordered = F.array_sort(F.transform(fired, lambda r, i: F.struct((-rails.rank(r["verdict"])).alias("k"), i.alias("i"), r.alias("r"))))
    body = F.array_join(F.transform(ordered, lambda x: line(x["r"])), " ")
    blocked = F.exists(results, lambda r: r["verdict"] == "block")
    if at == 0:
        return F.lit("")
    return F.when(F.size(fired) == 0, "").when(blocked, F.concat(body, F.lit(" Reference "), request, F.lit("."))).otherwise(body)


def reason(results: Column) -> Column:
    """Which rail blocked first, and its technique or category."""
    first = F.get(F.filter(results, lambda r: r["verdict"] == "block"), F.lit(0))
    return F.when(first.isNull(), "").when(F.coalesce(first["detail"], F.lit("")) == "", first["rail"]).otherwise(F.concat(first["rail"], F.lit(" ("), first["detail"], F.lit(")")))


def evidence(found: Column) -> Column:
    """Per detection: its kind, the value with all but its ends starred, and that its checks held."""
    hide = lambda v: F.concat(F.substr(v, F.lit(1), F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.length(v) - 2, F.lit(0))), F.when(F.length(v) > 1, F.substr(v, F.length(v), F.lit(1))).otherwise(""))
    return F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), hide(s["value"]).alias("shown")))


def injections(text: Column, techniques: set[str] | None = None) -> Column:
    """Every match of every injection pattern: (technique, score, start)."""
    parts = [F.transform(spans.find(text, f"(?i){p}", t), lambda s, n=n: F.struct(s["kind"].alias("technique"), F.lit(n).cast("double").alias("score"), s["start"].alias("start"))) for t, n, p in rails.INJECTION if techniques is None or t in techniques]
    return F.concat(*parts)


def approvals(pending: DataFrame, decisions: DataFrame, ttl_s: int) -> DataFrame:
    """`pending` (token, owner, at) with `state`: the first decision (token, principal, at, approve) of the owner in time counts, once."""
    both = pending.join(decisions.select("token", "principal", F.col("at").alias("said"), "approve"), "token", "left")
    age = F.unix_timestamp("said") - F.unix_timestamp("at")
    counts = (F.col("principal") == F.col("owner")) & (age >= 0) & (age <= ttl_s)
    by = both.groupBy(*pending.columns).agg(F.min_by(F.when(counts, F.col("approve")), F.when(counts, F.struct("said", "approve"))).alias("answer"), F.count("principal").alias("said"))
    return by.withColumn("state", F.when(F.col("answer").isNull(), F.when(F.col("said") == 0, "pending").otherwise("refused")).when(F.col("answer"), "approved").otherwise("declined")).drop("answer", "said")


def cited_calls(cited: Column, recorded: Column) -> Column:
    """All evidence names calls on record."""
    return F.size(F.array_except(cited, recorded)) == 0
