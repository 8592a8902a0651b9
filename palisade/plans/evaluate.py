"""Evaluate a table (or stream) of texts: normalise, run the rails that the surface asks for, mask, fold the verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import pii, rails
from palisade.functions.normalize import compose, normalize
from palisade.operators.retrieval import WHITE

MAX_CHARS = 200_000
RUNS_ALWAYS, RUNS_BY_MATRIX = ("ingest.document", "agent.data"), ("user.prompt", "user.feedback")
INJECTION_SURFACES = RUNS_BY_MATRIX + RUNS_ALWAYS


def evaluate(rows: DataFrame) -> DataFrame:
    """`rows` (text, surface) with each rail's verdict, the rewritten text and the verdict of all.

    Works alike on a stream: no step needs another row.
    """
    t = rows.withColumn("clean", normalize(compose(F.coalesce("text", F.lit("")))))
    t = t.withColumn("terms", rails.blocked_terms(F.col("clean"))).withColumn("found", pii.detect(F.col("clean")))
    t = t.withColumn("words_verdict", F.when(F.size("terms") > 0, "mask").otherwise("pass"))
    t = t.withColumn("pii_verdict", F.when(F.size("found") > 0, "mask").otherwise("pass"))
    t = t.withColumn("rules_verdict", rails.rule_verdict(F.col("clean"), (*rails.SECURITY_RULES, *rails.USE_CASE_RULES)))
    score = F.when(F.col("surface").isin(*INJECTION_SURFACES), rails.injection_score(F.col("clean"))).otherwise(0.0)
    t = t.withColumn("injection_score", score).withColumn("injection_verdict", F.when(F.col("injection_score") >= rails.INJECTION_THRESHOLD, "block").otherwise("pass"))
    # stars keep every length, so spans found before still fit
    starred = rails.star_out(F.col("clean"), F.col("terms"))
    t = t.withColumn("starred", starred).withColumn("text_out", pii.mask(F.col("starred"), F.col("found")))
    return t.withColumn("verdict", rails.fold(*(F.col(f"{k}_verdict") for k in ("words", "pii", "rules", "injection")))).drop("starred")


def ingest(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Status of each document: quarantined if too long, blocked or empty, in this order; else indexed.

    A document is empty if nothing is left of it after normalising and masking, as when no chunk would come of it."""
    out = evaluate(docs.withColumn("surface", F.lit("ingest.document")))
    left = F.col("text_out").rlike(f"[^{WHITE[1:]}")
    reason = F.when(F.length("text") > max_chars, "oversized").when(F.col("verdict") == "block", "blocked").when(~left, "empty")
    return out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "indexed").otherwise("quarantined"))


def composed(rows: DataFrame, rules: tuple[str, ...], entities: set[str] | None = None) -> DataFrame:
    """`rows` with text_out: each rail that masks rewrites what the one before left, in the order words, identifiers, rules.

    A rail takes part by what it finds in the given text, and finds its places anew in the text at hand."""
    text = F.col("text")
    masks = {
        "words": (F.size(rails.blocked_terms(text)) > 0, lambda t: rails.star_out(t, rails.blocked_terms(t))),
        "pii": (F.size(pii.detect(text, entities=entities)) > 0, lambda t: pii.mask(t, pii.detect(t, entities=entities))),
        "rules": (rails.rule_verdict(text, rules) == "mask", lambda t: rails.star_out(t, rails.rule_spans(t, rules))),
    }
    out = rows.select("*", *(asked.alias(f"__{k}") for k, (asked, _) in masks.items())).withColumn("text_out", text)
    for k, (_, rewrite) in masks.items():
        out = out.withColumn("text_out", F.when(F.col(f"__{k}"), rewrite(F.col("text_out"))).otherwise(F.col("text_out")))
    return out.drop(*(f"__{k}" for k in masks))
