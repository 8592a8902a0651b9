"""DuckDB SQL for the queries of `queries_controls`."""

from __future__ import annotations

from palisade.functions import rails
from palisade.operators import controls
from palisade.oracles_governance import _RULES, _SCORE, _list, _on
from palisade.queries_controls import AGENT_OF, KEYS, LIST_RAW, LIST_SETTINGS, RAW, TAILS, TERMS, TOOL_NAMES
from palisade.sources.carriers import PROMPTS

_P = f"with prompts as ({PROMPTS}) "
_TOKEN = r"<[A-Z_0-9]+:[0-9a-f]{12}(?:\s[^>]*)?>"
_NAME = r"(?:[^\w\s]|(?:\A|[^.!?])[ \t\v\f\r])[A-Z][a-z]{2,}\b"


def _text(words) -> str:
    return "[" + ", ".join("'" + w.replace("\n", "' || chr(10) || '") + "'" for w in words) + "]"


def oracle_sql() -> dict[str, str]:
    level = f"{_list(rails.LEVELS)}[1 + event_id % 4]"
    near = lambda s, t: f"case when round(abs({s} - {t}), 9) <= 0.1 then ' [marginal, ' || printf('%.3f', abs({s} - {t})) || ' away]' else '' end"
    tools = " or ".join(f"(agent = '{a}' and tool in ({', '.join(repr(t) for t in ts)}))" for a, ts in controls.TOOLS.items())
    newest = lambda m: f"coalesce(max(case when event_id % {m} = 0 then event_id end) // {m}, 0)"
    terms = " or ".join(f"contains(lower(text), '{t}')" for t in TERMS)
    return {
        "q95_entity_gate": f"{_P} select request_id, regexp_matches(regexp_replace(text || {_text(TAILS)}[1 + request_id % {len(TAILS)}], '{_TOKEN}', ' ', 'g'), '{_NAME}') as candidate from prompts",
        "q97_scope_judge": f"""{_P}, s as (select request_id, {terms} as hit, case when request_id % 3 <> 0 then least(1.0, greatest(0.0, (request_id % 7) / 5 - 0.1)) end as j from prompts)
            select request_id, case when hit then 'vocabulary' when j is null then 'none' else 'judge' end as layer, round(case when hit or j is null then 1.0 else j end, 6)::double as score, case when not hit and j < 0.5 then 'flag' else 'pass' end as verdict from s""",
        "q98_mask_gate": """with s as (select event_id, ['MASK', 'BLOCK', 'ALLOW'][1 + event_id % 3] as a, 'to <PERSON:0123456789ab> and <CLAIM:' || substr(md5(cast(event_id as varchar)), 1, 12) || '> from ' || event_type as t, event_type from events)
            select event_id, case when a = 'MASK' and event_id % 5 = 0 then 'ESCALATE' else a end as action, case when a <> 'MASK' then t when event_id % 5 = 0 then null when event_id % 2 = 0 then t else 'to [REDACTED] and [REDACTED] from ' || event_type end as text from s""",
        "q99_fail_mode": f"""with s as (select event_id // 4 as request, case when event_id % 50 = 0 then 3 when event_id % 6 = 0 then case when (event_id // 4) % 2 = 0 then 0 else 3 end else event_id % 3 end as r from events)
            select request, {_list(rails.LEVELS)}[1 + max(r)] as verdict from s group by 1""",
        "q100_settings": f"""with c as (select {_list(KEYS)}[1 + event_id % {len(KEYS)}] as key, {_list(RAW)}[1 + (event_id // 6) % {len(RAW)}] as raw from events),
            n as (select *, try_cast(raw as double) as x from c),
            e as (select key, raw, x, case when key = 'pii.typo' then 'unknown' when key = 'audit.raw' then 'locked' when key in ('content.threshold', 'ingest.max_chars') and (x is null or (key = 'ingest.max_chars' and contains(raw, '.'))) then 'unreadable'
              when (key = 'content.threshold' and x < 0) or (key = 'ingest.max_chars' and x < 100) then 'below' when (key = 'content.threshold' and x > 1) or (key = 'ingest.max_chars' and x > 20000) then 'above'
              when key = 'policy.fail_mode' and raw not in ('fail_open', 'fail_closed') then 'no option' else '' end as error from n)
            select key, raw, error, case when error <> '' then '' when key = 'pii.reversible' then cast(lower(raw) in ('1', 'true', 'yes', 'on') as varchar) when key in ('content.threshold', 'ingest.max_chars') then cast(x as varchar) else raw end as value, count(*) as n from e group by all""",
        "q101_evidence_text": f"""with s as (select event_id, (event_id % 1000) / 1000 as c, (event_id % 100) / 100 as a, {level} as v from events)
            select event_id, 'content: ' || printf('%.3f', c) || ' of 0.700, ' || v || {near('c', '0.7')} || chr(10) || 'pii: ' || (event_id % 5) || ' found, ' || v || chr(10) || 'attack: ' || case when event_id % 9 = 0 then 'error timeout, ' || v else printf('%.3f', a) || ' of 0.850, ' || v || {near('a', '0.85')} end as evidence from s""",
        "q102_document_rank": "with b as (select user_id, event_id % 13 as doc, min(event_id) as f from events group by all) select user_id, doc, row_number() over (partition by user_id order by f) as rank from b",
        "q103_retrieval_rails": rf"""{_P}, r as (select request_id // 4 as request, string_agg(text, chr(10) || chr(10) order by request_id) as t, string_agg(regexp_replace(text, 'CLM-\d{{8}}', '<CLAIM>', 'g'), '|' order by request_id) as shown, count(*) as n from prompts group by 1),
            v as (select *, ({_on(_RULES, 't')}) or {_on(_SCORE, 't')} >= 0.85 as bad from r) select request, cast(case when bad then 0 else n end as int) as n, md5(case when bad then '' else shown end) as shown from v""",
        "q104_document_ids": "select p_partkey, substr(trim(regexp_replace(lower(concat_ws(' / ', p_name, p_brand, p_type)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40) || '-' || substr(sha256(cast(p_partkey as varchar)), 1, 6) as id from part",
        "q105_forget_users": "select user_id as user, count(*) as turns from events where user_id not in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by 1",
        "q106_limits": f"select user_id, {newest(17)} as total, {newest(5)} as daily, {newest(29)} as monthly from events group by 1",
        "q107_model_calls": """with r as (select event_type, unnest([{'rail': 'content', 't': event_id % 4 + event_id % 2}, {'rail': 'attack', 't': event_id % 3}, {'rail': 'grounding', 't': 2 * (event_id % 5)}]) as x from events)
            select event_type, x.rail as rail, count(*) as calls, cast(sum(x.t) as bigint) as tokens from r where x.t > 0 group by all""",
        "q108_refusals": "select event_id, case when event_id % 3 = 2 then 'Words were stopped.' else 'Your request was stopped. Reference ' || event_id || '.' end as shown from events",
        "q109_stage_notes": """with s as (select user_id, event_id, event_type from events where event_id % 3 <> 0), n as (select user_id, event_id from events where event_id % 3 = 0)
            select n.user_id as request, n.event_id as at, s.event_type || '-' || s.event_id as stage, 'n' || n.event_id as note from n asof join s on n.user_id = s.user_id and n.event_id >= s.event_id""",
        "q110_denials_since": "select user_id, event_id from events where event_id % 4 = 0 and event_id > 100 qualify row_number() over (partition by user_id order by event_id desc) <= 8",
        "q111_scenarios": "with c as (select user_id as scenario, event_id % 41 <> 0 and event_id % 23 <> 0 and event_id % 37 <> 0 as good from events) select scenario, count(*) as steps, count(*) filter (where not good) as failed, bool_and(good) as passed from c group by 1",
        "q113_streamed_audit": "select event_type, count(*) as records, count(*) filter (where event_id % 97 = 0) as broken, 0 as broken_seals from events group by 1",
        "q115_list_settings": f"""with c as (select {_list([x[0] for x in LIST_SETTINGS])}[1 + event_id % 3] as key, {_list(LIST_RAW)}[1 + (event_id // 3) % {len(LIST_RAW) + 1}] as raw from events),
            e as (select *, case when key = 'agents.on' then 'locked' when raw is not null and not (json_valid(raw) and left(raw, 1) = '[') then 'no list' when key = 'scope.rules' and raw = '["(open"]' then 'no pattern' end as error from c)
            select key, raw, count(*) as n, case when error is null then cast(to_json(coalesce(cast(cast(case when left(raw, 1) = '[' then raw end as json) as varchar[]), [])) as varchar) end as value, error from e group by all""",
        "q112_tool_dispatch": f"""with c as (select event_id, {_list(AGENT_OF)}[1 + event_id % {len(AGENT_OF)}] as agent, {_list(TOOL_NAMES)}[1 + (event_id // 3) % {len(TOOL_NAMES)}] as tool from events)
            select agent, case when not ({tools}) then 'not_allowed' when event_id % 5 = 0 then 'error' else 'ok' end as status, count(*) as n from c group by all""",
    }
