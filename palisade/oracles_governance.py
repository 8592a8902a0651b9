"""DuckDB SQL for the queries of `queries_governance`."""

from __future__ import annotations

from palisade.functions import rails
from palisade.operators import agents
from palisade.queries_governance import ASKS, CONTROLS, MATRIX, REGISTRY
from palisade.sources.carriers import PROMPTS, USAGE


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _level(x: str) -> str:
    return f"{_list(rails.LEVELS)}[1 + ({x}) % 4]"


def _rank(x: str) -> str:
    return f"(list_position({_list(rails.LEVELS)}, {x}) - 1)"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)


def _case(table: dict[str, str], key: str, otherwise: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else '{otherwise}' end"


_P = f"with prompts as ({PROMPTS}) "
_RULES = " or ".join(f"regexp_matches(TEXT, '(?i){rails.parse_rule(r)[0]}')" for r in (*rails.SECURITY_RULES, *rails.USE_CASE_RULES))
_SCORE = "greatest(" + ", ".join(f"case when regexp_matches(TEXT, '(?i){p}') then {s} else 0.0 end" for _, s, p in rails.INJECTION) + ")"
_TECHNIQUE = "case " + " ".join(f"when {_SCORE} = {s} and regexp_matches(TEXT, '(?i){p}') then '{t}'" for t, s, p in rails.INJECTION) + " end"
_ASK = f"text || ' ' || {_list(ASKS)}[1 + request_id % 5]"
_CLAIM = r"CLM-\d{8}|user\d+@mail1\.example\.com"


def _on(sql: str, text: str) -> str:
    return sql.replace("TEXT", text)


_VAULT = f"""{_P}, r as (select request_id, user_id, text, regexp_extract(text, '{_CLAIM}') as v from prompts),
o as (select *, '<CLAIM:' || substr(sha256(request_id || '|' || user_id || '|' || (strpos(text, v) - 1) || '|' || v), 1, 12) || '>' as token,
  case when request_id % 11 = 0 then 'unknown' when request_id % 3 = 0 then 'expired' when request_id % 5 = 0 then 'owner_mismatch' else 'revealed' end as outcome from r) """

_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda c: trim(c)), lambda c: c <> '')"
_WORDS = "list_distinct(regexp_extract_all(lower(X), '[a-z0-9]+'))"
_LAYERS = """with l as (select event_id, event_id % 4 as a, unnest([{'rail': 'content', 'i': 0}, {'rail': 'attack', 'i': 1}, {'rail': 'scope', 'i': 2}]) as x from events),
k as (select event_id, a, x.rail as rail, ['judge', 'local', 'pattern'][1 + (event_id + x.i) % 3] as layer from l where event_id % 5 <> 0 or x.rail = 'content') """


def oracle_sql() -> dict[str, str]:
    claim, hurt, rule = r"regexp_matches(text, 'CLM-\d{8}')", f"{_on(_SCORE, 'text')} >= 0.85", f"({_on(_RULES, 'text')})"
    named = "concat_ws(' ', case when rule then 'Rules in your message was stopped{r}.' end, case when hurt then 'Injection in your message was stopped.' end, case when claim then 'Pii in your message was masked{p}.' end)"
    ref = "case when rule or hurt then ' Reference ' || request_id || '.' else '' end"
    hits = " union all ".join(
        f"select '{t}' as technique, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as start from (select g, m, unnest(range(1, len(m) + 1)) as i from (select regexp_extract_all(text, '(?i){p}') as m, regexp_split_to_array(text, '(?i){p}') as g from prompts))"
        for t, _, p in rails.INJECTION
    )
    mail = r"[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+[\p{L}\p{N}_]"
    wide = _WORDS.replace("X", "text")
    return {
        "q18_meta_question": f"{_P} select request_id, regexp_matches({_ASK}, '{agents.META_QUESTION}') as meta from prompts",
        "q24_mask_composition": rf"{_P} select request_id, regexp_replace(regexp_replace(regexp_replace(replace(text, 'idiot', '*****'), '{mail}', '<EMAIL_ADDRESS>', 'g'), 'CLM-\d{{8}}', repeat('*', 12), 'g'), '(?i)permit \d+', repeat('*', 15), 'g') as text_out from prompts",
        "q52_vault_egress": _VAULT + "select request_id, case when v = '' or outcome = 'revealed' then text else replace(text, v, token) end as shown from o",
        "q114_vault_resolution": _VAULT + "select request_id, case when v = '' then text when outcome = 'revealed' and request_id % 4 <> 0 then text else replace(text, v, token) end as shown, cast(v <> '' and outcome = 'revealed' and request_id % 4 <> 0 as bigint) as n_revealed from o",
        "q53_unmask_denials": _VAULT + "select outcome, count(*) as n from o where v <> '' group by 1",
        "q55_tool_call_verdict": f"{_P}, v as (select request_id, text, lead(text) over (order by request_id) as result, lead(request_id) over (order by request_id) as next from prompts), o as (select request_id, {_on(_RULES, 'text')} as a, {_on(_RULES, 'result')} or {_on(_SCORE, 'result')} >= 0.85 as b from v where next = request_id + 1) select request_id, case when a then 'block' else 'pass' end as args, case when b then 'block' else 'pass' end as result, case when a or b then 'block' else 'pass' end as verdict from o",
        "q57_explain": f"""{_P}, v as (select request_id, {claim} as claim, {hurt} as hurt, {rule} as rule, {_on(_TECHNIQUE, 'text')} as technique from prompts)
            select request_id, concat_ws(' ', case when rule then 'Something in your message was stopped.' end, case when hurt then 'Something in your message was stopped.' end, case when claim then 'Something in your message was masked.' end) || {ref} as minimal,
            {named.format(r='', p='')} || {ref} as category, {named.format(r=' (policy)', p=' (claim number)')} || {ref} as detailed,
            case when rule then 'rules (policy)' when hurt then 'injection (' || technique || ')' else '' end as reason from v""",
        "q64_agent_suite": f"""with r as (select event_type as category, event_id % 8 as want, case when event_id % 6 = 0 then event_id % 7 else event_id % 8 end as got, case when event_id % 3 <> 0 then {_level('event_id')} end as expected,
            case when event_id % 29 = 0 then 'escalate' when event_id % 10 = 0 then 'pass' else {_level('event_id')} end as actual, event_id % 1000 as ms from events)
            select category, count(*) as cases, round(avg(case when want = got then 1.0 else 0.0 end), 6) as routing, round(avg(case when expected is not null then case when expected = actual then 1.0 else 0.0 end end), 6) as decisions,
            round(avg(case when actual = 'escalate' then 1.0 else 0.0 end), 6) as escalated, round(avg(ms), 3) as ms from r group by 1""",
        "q66_tool_evidence": rf"{_P}, h as (select request_id, 'EMAIL_ADDRESS' as kind, unnest(regexp_extract_all(text, '{mail}')) as v from prompts union all select request_id, 'CUSTOM_1', unnest(regexp_extract_all(text, 'CLM-\d{{8}}')) from prompts) select request_id, kind, substr(v, 1, 1) || repeat('*', length(v) - 2) || substr(v, length(v), 1) as shown, case kind when 'CUSTOM_1' then 'custom' else 'built-in' end as origin from h",
        "q68_registry_rollup": f"select family, count(*) filter (where not locked) as adjustable, count(*) filter (where locked) as locked, array_to_string(list_sort(list(distinct {_case(CONTROLS, 'type', '')})), ',') as controls from (values {_values(REGISTRY)}) v(family, key, type, locked) group by 1",
        "q70_severity_matrix": f"""{_P}, f as (select surface, unnest(['content', 'words', 'pii']) as family from prompts), m as (select * from (values {_values(MATRIX)}) v(family, surface, level)), j as (select surface, family, coalesce(level, 'medium') as level from f left join m using (family, surface))
            select surface, family, level, count(*) as n, round(max(case level when 'off' then 2.0 when 'high' then 0.49 when 'low' then 0.91 else 0.7 end), 6)::double as threshold,
            count(*) filter (where family = 'content' and (surface in ('ingest.document', 'agent.data') or (surface in ('user.prompt', 'user.feedback') and level <> 'off'))) as injection_scans from j group by all""",
        "q71_trace_rollup": f"with s as (select event_id // 4 as request, event_id % 4 in (0, 2) as own, (event_id // 3) % 4 as r, event_id % 97 + 1 as ms from events) select request, cast(sum(ms) as bigint) as total_ms, cast(sum(case when own then ms else 0 end) as bigint) as guardrail_ms, {_list(rails.LEVELS)}[1 + max(r)] as verdict, round(100.0 * sum(case when own then ms else 0 end) / sum(ms), 1)::double as share from s group by 1",
        "q72_layer_counts": _LAYERS + "select rail, count(*) filter (where layer = 'judge') as judge, count(*) filter (where layer = 'local') as local from k group by 1",
        "q73_rates": _LAYERS + ", e as (select event_id, any_value(a) as a, count(*) filter (where layer = 'judge') as calls from k group by 1) select round(avg(case when calls > 0 then 1.0 else 0.0 end), 3) as fallback_rate, round(avg(case when a = 3 then 1.0 else 0.0 end), 3) as block_rate, round(avg(calls), 3) as calls_per_request from e",
        "q74_rail_metrics": "with c as (select event_id % 4 as e, case when event_id % 7 = 0 then (event_id // 7) % 4 else event_id % 4 end as a from events) select round(avg(case when e = 0 then case when a > 0 then 1.0 else 0.0 end end), 3) as fpr, round(avg(case when e > 0 then case when a = 0 then 1.0 else 0.0 end end), 3) as fnr, round(avg(case when a = e then 1.0 else 0.0 end), 3) as exact, count(*) filter (where a > 0 and a < e) as under_caught, count(*) as cases from c",
        "q75_answer_facts": f"""with u as (select conv_id, turn + 1 as turn, list_transform(list_sort(list_transform({wide}, lambda w: {{'n': -length(w), 'w': w}}))[1:3], lambda s: s.w) as need from conversations where role = 'user')
            select conv_id, turn, round(case when len(need) > 0 then len(list_filter(need, lambda w: contains(lower(text), w))) / len(need) else 1.0 end, 6) as coverage, regexp_matches(text, '{agents.GAP.replace("'", "''")}') as gap from conversations join u using (conv_id, turn) where role = 'assistant'""",
        "q76_regressions": "with c as (select event_id as case_id, event_id % 4 as a, (event_id // 5) % 4 as b from events) select case_id, 'newly_missed' as change from c where a > 0 and b = 0 union all select case_id, 'newly_blocked' from c where b = 3 and a <> 3",
        "q77_grounding": f"""with a as (select conv_id, turn, {_SENTENCES} as cl from conversations where role = 'assistant'), u as (select conv_id, turn + 1 as turn, {_SENTENCES} as ch from conversations where role = 'user'),
            n as (select a.conv_id, a.turn, len(cl) as claims, len(list_filter(cl, lambda c: len({_WORDS.replace('X', 'c')}) > 0 and len(list_filter(coalesce(ch, []), lambda h: len(list_intersect({_WORDS.replace('X', 'c')}, {_WORDS.replace('X', 'h')})) >= 0.2 * len({_WORDS.replace('X', 'c')}))) > 0)) as supported from a left join u using (conv_id, turn))
            select conv_id, turn, claims, supported, round(case when claims = 0 then 1.0 else supported / claims end, 6) as consistency from n""",
        "q78_attack_cascade": f"""{_P}, s as (select {_on(_SCORE, 'text')} as p, case when request_id % 2 = 0 then (request_id % 101) / 100 end as l, case when request_id % 3 <> 0 then (request_id % 89) / 88 end as j, regexp_matches({_ASK}, '{agents.META_QUESTION}') as meta from prompts),
            k as (select *, case when p >= 0.85 then 'pattern' when l >= 0.9 and not meta then 'local' when j is not null then 'judge' else 'none' end as layer from s)
            select case when layer = 'pattern' or layer = 'local' or (layer = 'judge' and greatest(p, j) >= 0.85) then 'block' else 'pass' end as verdict, layer, count(*) as n from k group by all""",
        "q79_toxic_heads": "select event_id, round(event_id % 11 / 11, 6) as violence, round(event_id % 13 / 13, 6) as insults, cast(2 as int) as categories from events",
        "q80_grounding_verdict": """with c as (select event_id as i, list_distinct(list_filter([event_id % 4, event_id % 6], lambda x: x between 1 and event_id % 5)) as cited from events),
            r as (select len(cited) as n, case when i % 5 = 0 then 'no_context' when (i % 10) / 10 < 0.5 then 'consistency' when (i % 9) / 9 < 0.35 then 'relevance' when i % 2 = 0 and len(cited) = 0 then 'citations' else 'grounded' end as reason from c)
            select case when reason in ('no_context', 'grounded') then 'pass' else 'block' end as verdict, reason, count(*) as n, cast(sum(n) as bigint) as cited from r group by reason""",
        "q82_context_window": "with t as (select conv_id, turn, coalesce(list(text) filter (where turn % 5 <> 3) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding), []) as b from conversations) select conv_id as session_id, turn as ordinal, cast(len(b) as int) as n, md5(coalesce(array_to_string(b, '|'), '')) as before from t",
        "q83_people": f"with u as (select user_id, sum(tokens_in + tokens_out) as used from ({USAGE}) group by 1), p as (select c_mktsegment as role, case when c_custkey % 3 = 0 then 500 else 0 end as cap, coalesce(used, 0) as used from customer left join u on user_id = c_custkey) select role, count(*) as people, count(*) filter (where cap > 0) as capped, count(*) filter (where cap > 0 and used >= cap) as over, cast(sum(used) as bigint) as tokens from p group by 1",
        "q84_live_sessions": "select user_id, count(*) as live from events where epoch(date_trunc('second', (select max(ts) from events))) - epoch(date_trunc('second', ts)) < 5 * 86400 group by 1",
        "q85_budget_windows": f"""with u as (select user_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m') as month, tokens_in + tokens_out as t from ({USAGE})), m as (select *, max(day) over (partition by user_id) as ld, max(month) over (partition by user_id) as lm from u),
            s as (select user_id, cast(sum(t) filter (where day = ld) as bigint) as daily, cast(sum(t) filter (where month = lm) as bigint) as monthly, cast(sum(t) as bigint) as total from m group by 1)
            select *, case when daily >= 1500 then 'daily' when monthly >= 5000 then 'monthly' when total >= 20000 then 'total' else 'none' end as breach from s""",
        "q86_transcript_access": "select case when c_custkey is null then 'missing' when o_custkey = p then 'own' when c_mktsegment in ('BUILDING', 'MACHINERY') then 'allowed' else 'refused' end as outcome, count(*) as n from (select o_custkey, o_custkey + o_orderkey % 3 as p from orders) left join customer on c_custkey = p group by 1",
        "q88_latest_documents": "select user_id % 50 as doc, max(event_id) as version from events group by 1 having max(event_id) % 9 <> 0",
        "q89_overrides": "select p_partkey % 5 = 0 as unknown, count(*) as n from part where p_partkey % 7 = 0 and (p_partkey % 5 = 0 or p_partkey % 2 = 0) group by 1",
        "q90_approvals": "select case when event_id % 4 = 0 then 'pending' when event_id % 7 = 0 or event_id % 900 > 600 then 'refused' when event_id % 3 = 0 then 'approved' else 'declined' end as state, count(*) as n from events group by 1",
        "q91_capabilities": f"with a as (select ['MASK', 'REDACT', 'BLOCK', 'ALLOW', 'FLAG', 'ESCALATE', 'DELETE'][1 + event_id % 7] as action from events) select action, {_case(agents.CAPABILITIES, 'action', 'denied')} as capability, count(*) as n from a group by all",
        "q92_resource_class": f"with a as (select {_list((*agents.RESOURCES, 'other'))}[1 + event_id % 7] as kind from events) select kind, {_case(agents.RESOURCES, 'kind', 'unclassified')} as class, count(*) as n from a group by all",
        "q93_cited_calls": "select event_id % 4 in (event_id % 3, event_id % 5, event_id % 7) as on_record, count(*) as n from events group by 1",
        "q94_all_injections": f"{_P} select technique, count(*) as n, cast(sum(start) as bigint) as starts from ({hits}) group by 1",
    }
