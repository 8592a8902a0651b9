"""Queries over vaults, agents, evaluations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import pii, rails, vault
from palisade.functions.spans import find
from palisade.operators import agents, reports
from palisade.plans.evaluate import RUNS_BY_MATRIX, RUNS_ALWAYS, composed
from palisade.sources.carriers import prompts, table, turns, usage

SECRET = "0123456789abcdef"  # of the query's own test vault
TTL = 3_600
ASKS = ("why was my request blocked", "explain the decision please", "what can you do", "which documents do you use", "renew my permit")
MATRIX = (("content", "user.prompt", "high"), ("content", "llm.response", "high"), ("content", "agent.tool", "off"), ("words", "retrieval", "off"), ("words", "user.prompt", "low"), ("pii", "agent.data", "high"))
REGISTRY = (("pii", "mask_strategy", "enum", False), ("pii", "reversible", "bool", False), ("pii", "raw_logging", "bool", True), ("content", "threshold", "float", False), ("content", "scope", "list", True), ("words", "mode", "enum", False), ("ingest", "max_chars", "int", False), ("ingest", "injection_scan", "bool", True))
CONTROLS = {"bool": "switch", "float": "slider", "int": "number", "enum": "select", "list": "tags"}


def _at(m):
    return F.col("event_id") % m


def _level(c):
    return F.get(F.array(*map(F.lit, rails.LEVELS)), c.cast("int"))


def q18_meta_question(spark, d):
    ask = F.get(F.array(*map(F.lit, ASKS)), (F.col("request_id") % 5).cast("int"))
    t = F.concat_ws(" ", F.col("text"), ask)
    return prompts(spark, d).select("request_id", t.rlike(agents.META_QUESTION).alias("meta"))


def q24_mask_composition(spark, d):
    rules = (r"CLM-\d{8} => mask", r"permit \d+ => mask")
    out = composed(prompts(spark, d), rules, {"EMAIL_ADDRESS"})
    return out.select("request_id", "text_out")


def _stored(spark, d):
    found = find(F.col("text"), r"CLM-\d{8}|user\d+@mail1\.example\.com", "CLAIM")
    rows = prompts(spark, d).select("request_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "text")
    marked = vault.tokenized(rows, "request_id", "user_id", found)
    held = vault.sealed(marked.where("request_id % 11 != 0"), "user_id", "ts", SECRET)
    late = F.when(F.col("request_id") % 3 == 0, 7_200).otherwise(60)
    reads = marked.select(F.col("request_id").alias("read_id"), (F.col("user_id") + (F.col("request_id") % 5 == 0).cast("int")).alias("principal"), F.timestamp_seconds(F.unix_timestamp("ts") + late).alias("at"), "masked")
    return reads, held


def _vault(spark, d):
    reads, held = _stored(spark, d)
    return reads, vault.asked(reads, held, SECRET, TTL)


def q52_vault_egress(spark, d):
    reads, answers = _vault(spark, d)
    return vault.revealed(reads, answers).select(F.col("read_id").alias("request_id"), "shown")


def q53_unmask_denials(spark, d):
    return _vault(spark, d)[1].groupBy(F.coalesce("denied", F.lit("revealed")).alias("outcome")).agg(F.count("*").alias("n"))


def q114_vault_resolution(spark, d):
    """Every fourth read is under a policy by which nothing resolves."""
    reads, held = _stored(spark, d)
    out = vault.resolved(reads, held, SECRET, TTL, F.when(F.col("read_id") % 4 == 0, "never").otherwise("owner_only"))
    return out.select(F.col("read_id").alias("request_id"), "shown", "n_revealed")


def q55_tool_call_verdict(spark, d):
    """A call's arguments and its result, the text of the next event; injection counts on results alone."""
    p = prompts(spark, d).select("request_id", "text")
    result = p.select((F.col("request_id") - 1).alias("request_id"), F.col("text").alias("result"))
    rules = (*rails.SECURITY_RULES, *rails.USE_CASE_RULES)
    args, back = rails.rule_verdict(F.col("text"), rules), rails.rule_verdict(F.col("result"), rules)
    data = F.when(rails.injection_score(F.col("result")) >= rails.INJECTION_THRESHOLD, "block").otherwise("pass")
    return p.join(result, "request_id").select("request_id", args.alias("args"), rails.fold(back, data).alias("result"), rails.fold(args, back, data).alias("verdict"))


def _results(text):
    rules = rails.rule_verdict(text, (*rails.SECURITY_RULES, *rails.USE_CASE_RULES))
    hurt = F.when(rails.injection_score(text) >= rails.INJECTION_THRESHOLD, "block").otherwise("pass")
    claim = F.when(text.rlike(r"CLM-\d{8}"), "mask").otherwise("pass")
    one = lambda rail, verdict, detail: F.struct(F.lit(rail).alias("rail"), verdict.alias("verdict"), detail.alias("detail"))
    return F.array(one("pii", claim, F.lit("claim number")), one("rules", rules, F.lit("policy")), one("injection", hurt, F.coalesce(rails.injection_technique(text), F.lit(""))))


def q57_explain(spark, d):
    # generated, so that four columns don't each look for every pattern
    rows = prompts(spark, d).select("request_id", F.explode(F.array(_results(F.col("text")))).alias("r"))
    r = F.col("r")
    say = lambda level: agents.explained(r, level, F.lit("prompt"), F.col("request_id").cast("string"))
    return rows.select("request_id", say("minimal").alias("minimal"), say("category").alias("category"), say("detailed").alias("detailed"), agents.reason(r).alias("reason"))


def q64_agent_suite(spark, d):
    names = F.array(*map(F.lit, ("pii", "injection", "scope")))
    some = lambda x: F.filter(names, lambda n, i: F.get(F.array(*(F.lit(b) for b in (1, 2, 4))), i).bitwiseAND(x.cast("int")) > 0)
    e = table(spark, d, "events")
    wanted = F.when(_at(3) != 0, _level(_at(4)))
    got = F.when(_at(29) == 0, "escalate").otherwise(_level(F.when(_at(10) == 0, 0).otherwise(_at(4))))
    runs = e.select(F.col("event_type").alias("category"), some(_at(8)).alias("expected_route"), F.reverse(some(F.when(_at(6) == 0, _at(7)).otherwise(_at(8)))).alias("routed"), wanted.alias("expected"), got.alias("actual"), _at(1000).cast("double").alias("ms"))
    return reports.suite(runs)


def q66_tool_evidence(spark, d):
    found = pii.detect(F.col("text"), entities={"EMAIL_ADDRESS", "CUSTOM_1"})
    e = prompts(spark, d).select("request_id", F.explode(agents.evidence(found)).alias("e"))
    known = agents.chosen({"EMAIL_ADDRESS": "built-in", "CUSTOM_1": "custom"}, F.col("e.kind"), "unknown")
    return e.select("request_id", F.col("e.kind").alias("kind"), F.col("e.shown").alias("shown"), known.alias("origin"))


def q68_registry_rollup(spark, d):
    keys = spark.createDataFrame(REGISTRY, "family string, key string, type string, locked boolean")
    control = agents.chosen(CONTROLS, F.col("type"))
    return keys.groupBy("family").agg(F.count_if(~F.col("locked")).alias("adjustable"), F.count_if("locked").alias("locked"), F.array_join(F.array_sort(F.collect_set(control)), ",").alias("controls"))


def q70_severity_matrix(spark, d):
    cells = spark.createDataFrame(MATRIX, "family string, surface string, level string")
    p = prompts(spark, d).select("request_id", "surface", F.explode(F.array(*map(F.lit, ("content", "words", "pii")))).alias("family"))
    p = p.join(F.broadcast(cells), ["family", "surface"], "left").withColumn("level", F.coalesce("level", F.lit("medium")))  # the matrix is a few constants
    scan = F.col("surface").isin(*RUNS_ALWAYS) | (F.col("surface").isin(*RUNS_BY_MATRIX) & (F.col("family") == "content") & (F.col("level") != "off"))
    return p.groupBy("surface", "family", "level").agg(F.count("*").alias("n"), F.round(F.max(rails.scaled(F.lit(0.7), F.col("level"))), 6).alias("threshold"), F.count_if(scan & (F.col("family") == "content")).alias("injection_scans"))


def q71_trace_rollup(spark, d):
    kind = F.get(F.array(*map(F.lit, ("rail", "model", "retry", "tool"))), _at(4).cast("int"))
    stages = table(spark, d, "events").select(F.floor(F.col("event_id") / 4).alias("request"), kind.alias("kind"), _level(F.floor(F.col("event_id") / 3) % 4).alias("verdict"), (_at(97) + 1).alias("ms"))
    return reports.traces(stages)


def _layered(spark, d):
    layer = lambda i: F.get(F.array(*map(F.lit, ("judge", "local", "pattern"))), ((F.col("event_id") + i) % 3).cast("int"))
    layers = F.map_filter(F.create_map(F.lit("content"), layer(0), F.lit("attack"), layer(1), F.lit("scope"), layer(2)), lambda k, v: (_at(5) != 0) | (k == "content"))
    return table(spark, d, "events").select(layers.alias("layers"), _level(_at(4)).alias("actual"))


def q72_layer_counts(spark, d):
    return reports.layer_counts(_layered(spark, d))


def q73_rates(spark, d):
    return reports.rates(_layered(spark, d))


def q74_rail_metrics(spark, d):
    return reports.rail_metrics(table(spark, d, "events").select(_level(_at(4)).alias("expected"), _level(F.when(_at(7) == 0, F.floor(F.col("event_id") / 7) % 4).otherwise(_at(4))).alias("actual")))


def q75_answer_facts(spark, d):
    """Required facts: the three longest words of the question; whether the reply admits a gap."""
    c = table(spark, d, "conversations")
    longest = F.slice(F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 3)["w"]
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), longest.alias("need"))
    a = c.where("role = 'assistant'").select("conv_id", "turn", "text")
    got = F.size(F.filter("need", lambda w: F.contains(F.lower("text"), w)))
    return a.join(u, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.when(F.size("need") > 0, got / F.size("need")).otherwise(1.0), 6).alias("coverage"), F.col("text").rlike(agents.GAP).alias("gap"))


def q76_regressions(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("case_id"), _level(_at(4)).alias("a"), _level(F.floor(F.col("event_id") / 5) % 4).alias("b"))
    both = e.select("case_id", F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))).alias("arm", "actual"))
    return reports.regressions(both)


def _answers(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("key"), "text")
    u = c.where("role = 'user'").select("conv_id", "turn", F.explode(agents.claims(F.col("text"))).alias("text"))
    return a, u.select(F.struct("conv_id", (F.col("turn") + 1).alias("turn")).alias("key"), "text")


def q77_grounding(spark, d):
    a, chunks = _answers(spark, d)
    return agents.grounded(a, chunks, 0.2).select("key.conv_id", "key.turn", "claims", "supported", "consistency")


def q78_attack_cascade(spark, d):
    p = prompts(spark, d)
    i = F.col("request_id")
    ask = F.concat_ws(" ", "text", F.get(F.array(*map(F.lit, ASKS)), (i % 5).cast("int")))
    local, judge = F.when(i % 2 == 0, (i % 101) / 100), F.when(i % 3 != 0, (i % 89) / 88)
    return p.select("request_id", agents.cascade(rails.injection_score(F.col("text")), local, judge, ask).alias("o")).groupBy("o.verdict", "o.layer").agg(F.count("*").alias("n"))


def q79_toxic_heads(spark, d):
    heads = F.create_map(*[F.lit(x) if isinstance(x, str) else x for kv in (("toxic", _at(7) / 7), ("threat", _at(11) / 11), ("insult", _at(13) / 13)) for x in kv])
    s = agents.category_scores(heads)
    return table(spark, d, "events").select("event_id", F.round(s["violence"], 6).alias("violence"), F.round(s["insults"], 6).alias("insults"), F.size(s).alias("categories"))


def q80_grounding_verdict(spark, d):
    i = F.col("event_id")
    cites = agents.citations(F.concat(F.lit("see ["), (i % 4).cast("string"), F.lit("] and ["), (i % 6).cast("string"), F.lit("]")), (i % 5).cast("int"))
    out = agents.grounding_verdict(i % 5, (i % 10) / 10, (i % 9) / 9, cites, i % 2 == 0)
    return table(spark, d, "events").select(out.alias("o"), F.size(cites).alias("cited")).groupBy("o.verdict", "o.reason").agg(F.count("*").alias("n"), F.sum("cited").alias("cited"))


def q82_context_window(spark, d):
    t = turns(spark, d).select(F.col("user").alias("owner"), "session_id", "ordinal", "text", (F.col("ordinal") % 5 == 3).alias("blocked"))
    return reports.context(t, 3).select("session_id", "ordinal", F.size("before").alias("n"), F.md5(F.array_join("before", "|")).alias("before"))


def q83_people(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"), F.when(F.col("c_custkey") % 3 == 0, 500).otherwise(0).alias("cap"))
    return reports.people(users, usage(spark, d))


def q84_live_sessions(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    last = e.agg(F.max("at").alias("now"))
    return e.crossJoin(F.broadcast(last)).transform(lambda s: reports.live(s, F.col("now"), 5 * 86_400))  # `last` is one row


def q85_budget_windows(spark, d):
    return reports.windows_used(usage(spark, d), {"daily": 1500, "monthly": 5_000, "total": 20_000})


def q86_transcript_access(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("principal"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("traces"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("principal"))
    own = F.col("owner") == F.col("principal")
    out = F.when(F.col("traces").isNull(), "missing").when(own, "own").when(F.col("traces"), "allowed").otherwise("refused")
    return o.join(c, "principal", "left").groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


def q88_latest_documents(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("doc"), F.col("event_id").alias("version"), (_at(9) == 0).alias("deleted"))
    return reports.latest(e, "doc", "version")


def q89_overrides(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_retailprice").cast("string").alias("value"))
    k = F.col("key").cast("long")
    now = p.where(k % 7 == 0).select(F.when(k % 5 == 0, F.concat(F.lit("x"), "key")).otherwise(F.col("key")).alias("key"), F.when(k % 2 == 0, "new").otherwise(F.col("value")).alias("value"))
    return reports.overrides(p, now).groupBy("unknown").agg(F.count("*").alias("n"))


def q90_approvals(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    i = F.col("event_id")
    asked = e.select(i.alias("token"), F.col("user_id").alias("owner"), "at")
    said = e.where(i % 4 != 0).select(i.alias("token"), (F.col("user_id") + (i % 7 == 0).cast("int")).alias("principal"), F.timestamp_seconds(F.unix_timestamp("at") + i % 900).alias("at"), (i % 3 == 0).alias("approve"))
    return agents.approvals(asked, said, 600).groupBy("state").agg(F.count("*").alias("n"))


def q91_capabilities(spark, d):
    action = F.get(F.array(*map(F.lit, ("MASK", "REDACT", "BLOCK", "ALLOW", "FLAG", "ESCALATE", "DELETE"))), _at(7).cast("int"))
    return table(spark, d, "events").select(action.alias("action"), agents.chosen(agents.CAPABILITIES, action, "denied").alias("capability")).groupBy("action", "capability").agg(F.count("*").alias("n"))


def q92_resource_class(spark, d):
    kinds = (*agents.RESOURCES, "other")
    kind = F.get(F.array(*map(F.lit, kinds)), _at(7).cast("int"))
    return table(spark, d, "events").groupBy(kind.alias("kind"), agents.chosen(agents.RESOURCES, kind, "unclassified").alias("class")).agg(F.count("*").alias("n"))


def q93_cited_calls(spark, d):
    made = F.array(_at(3), _at(5), _at(7))
    cited = F.array(_at(5), _at(4))
    return table(spark, d, "events").groupBy(agents.cited_calls(cited, made).alias("on_record")).agg(F.count("*").alias("n"))


def q94_all_injections(spark, d):
    x = prompts(spark, d).select("request_id", F.explode(agents.injections(F.col("text"))).alias("x"))
    return x.groupBy("x.technique").agg(F.count("*").alias("n"), F.sum(F.col("x.start").cast("long")).alias("starts"))
