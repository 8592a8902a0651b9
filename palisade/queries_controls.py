"""Queries over named entities, controls and settings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palisade.functions import rails, spans
from palisade.operators import controls, entities
from palisade.operators.records import keep_last
from palisade.sources.carriers import prompts, shared_folder, table
from palisade.streaming import audit

TAILS = (" Meet Arjun Nair at 14 Anna Salai", ". Thanks", "\nRegards", " <PERSON:0123456789ab> called", "! Ask Birth and Death Records")
TERMS = ("permit", "claim", "weather")
SETTINGS = (
    ("content.threshold", "float", 0.0, 1.0, None, False), ("ingest.max_chars", "int", 100.0, 20000.0, None, False), ("policy.fail_mode", "enum", None, None, ["fail_open", "fail_closed"], False),
    ("pii.reversible", "bool", None, None, None, False), ("audit.raw", "bool", None, None, None, True),
)
KEYS = (*(s[0] for s in SETTINGS), "pii.typo")
RAW = ("0.5", "250", "fail_open", "YES", "1.5", "-3", "many", "70000")
LIST_SETTINGS = (("words.allow", "string[]", None, None, None, False), ("scope.rules", "regex[]", None, None, None, False), ("agents.on", "set", None, None, None, True))
LIST_RAW = ('["a", "b c"]', "[1, 2.5]", "[]", "plain", '["CLM-[0-9]+", "x|y"]', '["(open"]', '{"a": 1}')
KINDS = ("PERSON", "ADDRESS", "ORGANISATION")
AGENT_OF = tuple(controls.TOOLS)
TOOL_NAMES = tuple(ts[0] for ts in controls.TOOLS.values()) + ("delete_records",)

#: Files of a batch of the streamed audit: what reads and writes them at a time.
AUDIT_FILES = 12


def _pick(words, i):
    return F.get(F.array(*map(F.lit, words)), i.cast("int"))


def _at(m):
    return F.col("event_id") % m


def q95_entity_gate(spark, d):
    t = F.concat("text", _pick(TAILS, F.col("request_id") % len(TAILS)))
    return prompts(spark, d).select("request_id", entities.candidate(t).alias("candidate"))


def entity_rows(spark, d):
    """One text an event with what a recogniser and a judge say of it; every seventh has no judge."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("Please send Arjun Nair to no. "), _at(90).cast("string"), F.lit(" Anna Salai, says Birth Office. Mail a"), _at(7).cast("string"), F.lit("@x.org now.")).alias("text"))
    n = F.length(_at(90).cast("string"))
    spot = lambda a, b, kind, score: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(kind).alias("kind"), score.alias("score"))
    found = F.array(
        spot(F.lit(12), F.lit(22), "PERSON", F.lit(0.9)), spot(31 + n, 41 + n, "LOCATION", _at(10) / 10), spot(18 + F.lit(0), F.lit(24), "NRP", _at(3) / 2), spot(48 + n, 60 + n, "PERSON", F.lit(0.85)), spot(48 + n, 53 + n, "DATE", F.lit(1.0)),
    )
    said = F.array(
        F.struct(F.lit(" Arjun Nair ").alias("value"), F.lit("person").alias("kind"), F.lit(0.8).alias("confidence")),
        F.struct(_pick(("Anna Salai", "Anna Road", "Birth"), _at(3)).alias("value"), F.lit("ADDRESS").alias("kind"), (_at(4) / 2).alias("confidence")),
        F.struct(F.lit("Birth Office").alias("value"), _pick(("ORGANISATION", "OTHER"), _at(2)).alias("kind"), F.lit(0.95).alias("confidence")),
    )
    return e.withColumn("found", found).withColumn("judged", F.when(_at(7) != 0, said)).withColumn("taken", F.when(_at(5) == 0, F.array(F.struct(F.lit(15).alias("start"), F.lit(16).alias("stop")))).otherwise(F.expr("cast(array() as array<struct<start:int,stop:int>>)")))


def q96_entity_merge(spark, d):
    held = entity_rows(spark, d).withColumn("held", entities.named(F.col("text"), F.col("found"), F.col("taken"), KINDS, 0.6))
    # generated, so that the fields of `m` don't each work it out
    out = held.withColumn("m", F.explode(F.array(entities.merged(F.col("text"), F.col("held"), F.col("judged"), KINDS, 0.6, r"Birth Office"))))
    return out.select("event_id", F.array_join(F.transform("m.kept", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("kept"), "m.corroborated", "m.rejected", "m.unverifiable", "m.allowlisted", spans.splice(F.col("text"), F.col("m.kept"), entities.starred).alias("masked"))


def q97_scope_judge(spark, d):
    i = F.col("request_id")
    o = controls.scope(F.col("text"), TERMS, F.when(i % 3 != 0, (i % 7) / 5 - 0.1), 0.5)
    return prompts(spark, d).select("request_id", o.alias("o")).select("request_id", "o.layer", F.round("o.score", 6).alias("score"), "o.verdict")


def q98_mask_gate(spark, d):
    text = F.concat(F.lit("to <PERSON:0123456789ab> and <CLAIM:"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 12), F.lit("> from "), F.col("event_type"))
    o = controls.gated(_pick(("MASK", "BLOCK", "ALLOW"), _at(3)), text, _at(5) != 0, _at(2) == 0)
    return table(spark, d, "events").select("event_id", o.alias("o")).select("event_id", "o.action", "o.text")


def q99_fail_mode(spark, d):
    i = F.col("event_id")
    v = controls.failed(_pick(rails.LEVELS, i % 3), F.when(i % 6 == 0, "boom"), i % 50 == 0, _pick(("fail_open", "fail_closed"), F.floor(i / 4) % 2))
    return table(spark, d, "events").groupBy(F.floor(i / 4).alias("request")).agg(rails.verdict_of(F.max(rails.rank(v))).alias("verdict"))


def q100_settings(spark, d):
    registry = spark.createDataFrame(SETTINGS, "key string, type string, least double, most double, options array<string>, locked boolean")
    changes = table(spark, d, "events").select(_pick(KEYS, _at(len(KEYS))).alias("key"), _pick(RAW, F.floor(F.col("event_id") / 6) % len(RAW)).alias("raw"))
    return controls.checked(changes, registry).groupBy("key", "raw", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("value", F.lit("")).alias("value")).agg(F.count("*").alias("n"))


def q101_evidence_text(spark, d):
    one = lambda rail, unit, score, bar, error: F.struct(F.lit(rail).alias("rail"), F.lit(unit).alias("unit"), score.cast("double").alias("score"), F.lit(bar).alias("threshold"), _pick(rails.LEVELS, _at(4)).alias("verdict"), error.alias("error"))
    none = F.lit(None).cast("string")
    r = F.array(one("content", "score", _at(1000) / 1000, 0.7, none), one("pii", "count", _at(5), 1.0, none), one("attack", "score", _at(100) / 100, 0.85, F.when(_at(9) == 0, "timeout")))
    return table(spark, d, "events").select("event_id", controls.evidence_text(r, 0.1).alias("evidence"))


def q102_document_rank(spark, d):
    hits = table(spark, d, "events").select("user_id", _at(13).alias("doc"), F.col("event_id").alias("at"))
    return controls.first_per_document(hits, "user_id", "doc", "at").select("user_id", "doc", F.col("rank").cast("long").alias("rank"))


def q103_retrieval_rails(spark, d):
    """The four texts of a request, evaluated as one."""
    ordered = F.array_sort(F.collect_list(F.struct("request_id", "text")))["text"]
    r = prompts(spark, d).groupBy(F.floor(F.col("request_id") / 4).alias("request")).agg(ordered.alias("texts"))
    judge = lambda t: (rails.fold(rails.rule_verdict(t, (*rails.SECURITY_RULES, *rails.USE_CASE_RULES)), F.when(rails.injection_score(t) >= rails.INJECTION_THRESHOLD, "block").otherwise("pass")), F.regexp_replace(t, r"CLM-\d{8}", "<CLAIM>"))
    out = controls.rejoined(F.col("texts"), "\n\n", judge)
    return r.select("request", F.size(out).alias("n"), F.md5(F.array_join(out, "|")).alias("shown"))


def q104_document_ids(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", controls.document_id(F.concat_ws(" / ", "p_name", "p_brand", "p_type"), F.col("p_partkey").cast("string")).alias("id"))


def q105_forget_users(spark, d):
    turns = table(spark, d, "events").withColumnRenamed("user_id", "user")
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user"))
    return controls.forget(turns, gone).groupBy("user").agg(F.count("*").alias("turns"))


def q106_limits(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", *(F.when(_at(m) == 0, F.floor(F.col("event_id") / m)).alias(n) for n, m in (("total", 17), ("daily", 5), ("monthly", 29))))
    return controls.limits(e, "user_id", "event_id", ("total", "daily", "monthly"))


def q107_model_calls(spark, d):
    rail = lambda name, i, o: F.struct(F.lit(name).alias("rail"), i.alias("tokens_in"), o.alias("tokens_out"))
    stage = lambda *r: F.struct(F.array(*r).alias("rails"))
    t = table(spark, d, "events").select("event_type", F.array(stage(rail("content", _at(4), _at(2)), rail("attack", _at(3), F.lit(0).cast("long"))), stage(rail("grounding", _at(5), _at(5)))).alias("stages"))
    return controls.model_calls(t).groupBy("event_type", F.col("rail.rail").alias("rail")).agg(F.count("*").alias("calls"), F.sum(F.col("rail.tokens_in") + F.col("rail.tokens_out")).alias("tokens"))


def q108_refusals(spark, d):
    return table(spark, d, "events").select("event_id", controls.refusal(_pick(("", "  ", "Words were stopped."), _at(3)), F.col("event_id")).alias("shown"))


def q109_stage_notes(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("at"), "event_type")
    out = controls.noted(e.where("at % 3 <> 0").select("request", "at", F.concat_ws("-", "event_type", F.col("at").cast("string")).alias("stage")), e.where("at % 3 = 0").select("request", "at", F.concat(F.lit("n"), F.col("at").cast("string")).alias("note")))
    return out.select("request", "at", "stage", "note")


def q110_denials_since(spark, d):
    """Denials after a reader's mark, at most the newest eight of an owner."""
    denied = table(spark, d, "events").where(_at(4) == 0).select("user_id", "event_id")
    return keep_last(denied.where("event_id > 100"), "user_id", "event_id", 8)


def q111_scenarios(spark, d):
    return controls.scenarios(table(spark, d, "events").select(F.col("user_id").alias("scenario"), F.when(_at(41) != 0, _at(23) != 0).alias("held"), F.when(_at(37) == 0, "late").alias("error")))


def q112_tool_dispatch(spark, d):
    s = controls.dispatched(_pick(AGENT_OF, _at(len(AGENT_OF))), _pick(TOOL_NAMES, F.floor(F.col("event_id") / 3) % len(TOOL_NAMES)), F.when(_at(5) == 0, "ValueError"))
    return table(spark, d, "events").groupBy(_pick(AGENT_OF, _at(len(AGENT_OF))).alias("agent"), s.alias("status")).agg(F.count("*").alias("n"))


def q113_streamed_audit(spark, d):
    """Three batches of events become a trail by event type; then the values of some records are changed."""
    place = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    source = table(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    source.repartition(3 * AUDIT_FILES, "event_id").write.parquet(f"{place}/in")
    body = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("value").cast("string"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", AUDIT_FILES).parquet(f"{place}/in")
    run = stream.writeStream.foreachBatch(audit.appender(place, "event_type", "event_id", body)).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    kept, seals, heads = audit.trail(spark, place, run.lastProgress["batchId"])
    forged = kept.withColumn("value", F.when(F.col("event_id") % 97 == 0, F.coalesce("value", F.lit(0)) + 1).otherwise(F.col("value")))
    return audit.verify(forged, seals, heads, "event_type", "event_id", body)


def q115_list_settings(spark, d):
    registry = spark.createDataFrame(LIST_SETTINGS, "key string, type string, least double, most double, options array<string>, locked boolean")
    changes = table(spark, d, "events").select(_pick([s[0] for s in LIST_SETTINGS], _at(3)).alias("key"), _pick(LIST_RAW, F.floor(F.col("event_id") / 3) % (len(LIST_RAW) + 1)).alias("raw"))
    # few distinct values: each is checked once
    return controls.checked(changes.groupBy("key", "raw").agg(F.count("*").alias("n")), registry)
