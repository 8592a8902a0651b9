"""DuckDB SQL for the queries over runs of agents: each run is walked call by call."""

from __future__ import annotations

from palisade.operators.controls import TOOLS
from palisade.oracles_governance import _P, _RULES, _SCORE, _on

AGENTS = tuple(TOOLS)
_FOUND = r"regexp_extract(text, 'CLM-\d{8}|user\d+@mail1\.example\.com')"
_WALK = f"""{_P.replace("with ", "with recursive ", 1)}, e as (select request_id as i, request_id // 3 as n, user_id, text, {_FOUND} as v from prompts),
m as (select *, case when v = '' then text else replace(text, v, '<CLAIM:' || substr(sha256(i || '|' || user_id || '|' || (strpos(text, v) - 1) || '|' || v), 1, 12) || '>') end as masked from e),
a as materialized (select m.i, m.i // 24 as run, 1 + m.i % 24 // 3 as step, m.i % 3 as place, m.text, m.masked, row_number() over (partition by m.i // 24 order by m.i) as k,
    case when m.n % 13 = 12 then null when m.i % 17 = 5 then 'erase' when m.i % 7 = 3 then 'file' when m.i % 2 = 0 then 'lookup' else 'search' end as tool,
    case when m.i % 31 = 0 then 'timed_out' when m.i % 31 = 7 then 'failed' end as error, case when m.i % 4 <> 0 then m.i % 4 <> 1 end as decided,
    {_on(_RULES, 'm.masked')} as bad, coalesce(b.text is not null and m.i % 31 not in (0, 7) and ({_on(_RULES, 'b.text')} or {_on(_SCORE, 'b.text')} >= 0.85), false) as tainted
  from m left join e b on b.i = m.i + 1 where m.n % 13 <> 12 or m.i % 3 = 0),
ext as (select *, coalesce(tool = 'file', false) and not bad as gate from a),
w as (
  select run, 0 as k, 0 as used, 0 as gated, '' as status, '' as outcome from (select distinct run from a)
  union all
  select s.run, s.k + 1,
    case when o.outcome in ('unreached', 'answer', 'skipped', 'budget') then s.used else s.used + 1 end,
    case when x.gate and o.outcome not in ('unreached', 'skipped', 'budget') then x.step else s.gated end,
    case when s.status <> '' then s.status when x.step > 6 then 'out_of_steps' when o.outcome = 'answer' then 'answered' when o.outcome = 'awaiting' then 'awaiting' else '' end, o.outcome
  from w s join ext x on x.run = s.run and x.k = s.k + 1, lateral (select case
    when s.status <> '' or x.step > 6 then 'unreached' when x.tool is null then 'answer' when x.step = s.gated then 'skipped' when s.used >= 10 then 'budget'
    when x.tool = 'erase' then 'unknown' when x.bad then 'refused' when x.gate and x.decided is null then 'awaiting' when x.gate and not x.decided then 'declined'
    when x.error is not null then x.error when x.tainted then 'withheld' else 'done' end as outcome) o),
fin as (select run, case when max(status) = '' then 'open' else max(status) end as status from w group by run),
r as materialized (select x.*, f.status, w.outcome, case when w.outcome in ('unknown', 'refused', 'declined', 'withheld') then 'block' when w.outcome in ('done', 'timed_out', 'failed') then 'pass' else '' end as verdict
  from ext x join w on w.run = x.run and w.k = x.k join fin f on f.run = x.run) """
_MAY = "tool in ('lookup', 'file') and masked <> text and i % 5 <> 0 and i % 10 <> 1"

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_DONE = ("pass", "flag", "mask", "block", "escalate")
_RANK = lambda x: f"(list_position({_LIST(_DONE[:4])}, {x}) - 1)"
_ROUNDS = f"""with recursive picked as (select event_id as i, event_id // 3 as request, event_id % 3 + 1 as n, event_id % 7 < 4 as more, event_id % 53 as at_s,
    [{', '.join(f"{_LIST(AGENTS)}[1 + event_id // {k} % 6]" for k in (1, 2, 5, 7))}][1 : event_id // 3 % 7 % 5] as named from events where event_id // 3 % 19 <> 7),
p as (select *, list_filter(named, lambda a, k: list_position(named, a) = k) as plan from picked),
w as (
  select distinct request, 0 as n, 0::bigint as made, []::varchar[] as ran, '' as status from p
  union all
  select w.request, w.n + 1, case when o.status in ('no_plan', 'late', 'none') then w.made else least(6, w.made + len(p.plan)) end, case when o.status in ('no_plan', 'late', 'none') then w.ran else list_distinct(w.ran || p.plan[1 : 6 - w.made]) end, o.status
  from w left join p on p.request = w.request and p.n = w.n + 1, lateral (select case when p.n is null then 'no_plan' when p.at_s > 45 then 'late' when len(p.plan) = 0 then 'none' when w.made >= 6 or w.made + len(p.plan) > 6 then 'budget'
    when not p.more then 'decided' when p.n = 3 then 'rounds' else '' end as status) o
  where w.status = '' and w.n < 3),
f as (select * from w where status <> ''),
acted as (select request, a, {_LIST(_DONE)}[1 + (request // 2 + length(a) * 3) % 5] as action from (select request, unnest(ran) as a from f)),
own as (select request, count(*) as k, coalesce(max({_RANK('action')}) filter (where action <> 'escalate'), 0) as floor, min(action) as one from acted group by request),
s as (select event_id // 3 as request, {_LIST((*_DONE, 'unheard'))}[1 + event_id % 6] as action, event_id % 12 / 10 as confidence, event_id % 47 as at_s from events where event_id % 3 = 0),
j as (select f.request, made, coalesce(k, 0) as k, floor, case when k = 1 then one else s.action end as wanted,
    case when status <> 'decided' then status when s.at_s > 45 then 'late' when k > 1 and (s.request is null or s.action = 'unheard' or s.confidence > 1) then 'malformed' else 'decided' end as status
  from f left join own using (request) left join s using (request)),
z as (select *, case when status = 'none' then 'pass' when status <> 'decided' then 'escalate' when wanted = 'escalate' then case when floor = 0 then wanted else {_LIST(_DONE)}[1 + floor] end
    when floor > {_RANK('wanted')} then {_LIST(_DONE)}[1 + floor] else wanted end as action from j) """


def oracle_sql() -> dict[str, str]:
    return {
        "q123_tool_runs": _WALK + "select run, step, place, status, outcome, verdict from r",
        "q124_tool_arguments": _WALK + f"""select run, step, place, cast({_MAY} as bigint) as unmasked, case when {_MAY} then text else masked end as reference, masked as note
            from r where outcome in ('done', 'withheld', 'timed_out', 'failed')""",
        "q126_supervisor_rounds": _ROUNDS + "select request, made, len_ran as ran, status, action, status = 'decided' and action <> wanted as overridden from (select z.*, len(f.ran) as len_ran from z join f using (request))",
        "q125_tool_run_sums": _WALK + """select run, status, count(*) filter (where outcome not in ('unreached', 'skipped', 'budget', 'answer')) as calls, count(*) filter (where outcome in ('done', 'withheld', 'timed_out', 'failed')) as ran,
            case when bool_or(verdict = 'block') then 'block' else 'pass' end as verdict from r group by run, status""",
    }
