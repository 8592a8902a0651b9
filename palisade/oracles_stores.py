"""DuckDB SQL for the queries over lexicons, lasting indexes and lasting states."""

from __future__ import annotations

from palisade.sources.carriers import USAGE

_CUT = "'[A-Za-z0-9_]+|[^A-Za-z0-9_]'"
_WORDS = "string_split(text, ' ')"
_TERMS = f"""select distinct lower(term) as term from (
    select unnest({_WORDS}) as term from benchmark where len({_WORDS}) > 2
    union all select {_WORDS}[i] || ' ' || {_WORDS}[i + 1] from (select text, unnest(range(1, len({_WORDS}))) as i from benchmark where len({_WORDS}) > 2)
    union all select array_to_string({_WORDS}[len({_WORDS}) - 2 :], ' ') from benchmark where len({_WORDS}) > 2
  ) where regexp_matches(term, '[A-Za-z0-9]') and length(term) between 1 and 256"""
_ALLOW = f"select distinct lower(array_to_string({_WORDS}[1:4], ' ')) as term from benchmark where text <> ''"

#: The texts that the index holds after the changes of q118.
CHANGED = """changed as (select doc_id, case when doc_id % 21 <> 0 and doc_id % 5 = 0 then text || ' permit licence' else text end as text
  from documents where doc_id % 21 = 0 or (doc_id % 11 <> 0 and (doc_id % 5 = 0 or doc_id % 7 <> 0)))"""


def _lexicon() -> str:
    cut = lambda name, terms: f"""{name}_cut as (select term, len(t) as n, least(len(t), 3) as k, array_to_string(t[1 : least(len(t), 3)], '') as head
    from (select term, regexp_extract_all(term, {_CUT}) as t from ({terms})))"""  # noqa: E731
    found = lambda name: f"""{name} as (select r, start, start + length(term) as stop, term from heads join {name}_cut using (k, head) join d using (r)
      where substr(low, start + 1, length(term)) = term and not regexp_matches(before, '^[A-Za-z0-9_]')
        and not regexp_matches(substr(low, start + length(term) + 1, 1), '^[A-Za-z0-9_]'))"""  # noqa: E731
    return f"""with d as materialized (select row_number() over () as r, doc_id, lower(coalesce(text, '')) as low from documents),
  tok as (select r, unnest(w) as t, generate_subscripts(w, 1) as p from (select r, regexp_extract_all(low, {_CUT}) as w from d)),
  cum as materialized (select r, t, cast(sum(length(t)) over s - length(t) as bigint) as start, coalesce(lag(t) over s, '') as before, lead(t) over s as t2, lead(t, 2) over s as t3 from tok window s as (partition by r order by p)),
  heads as (select r, start, before, 1 as k, t as head from cum union all select r, start, before, 2, t || t2 from cum where t2 is not null union all select r, start, before, 3, t || t2 || t3 from cum where t3 is not null),
  {cut('hit', _TERMS)}, {cut('free', _ALLOW)}, {found('hit')}, {found('free')},
  inside as (select distinct h.r, h.start, h.term from hit h join free f on f.r = h.r where f.start <= h.start and h.stop <= f.stop),
  kept as (select hit.* from hit left join inside i on i.r = hit.r and i.start = hit.start and i.term = hit.term where i.r is null)
  select doc_id, count(term) as n, count(distinct term) as terms, cast(coalesce(sum(start), 0) as bigint) as starts from d left join kept using (r) group by r, doc_id"""


def oracle_sql(bm25: str, ingest: str) -> dict[str, str]:
    """`bm25`: the common tables of a search over `documents`; `ingest`: those with the reason why a document is not indexed."""
    again = f"with {CHANGED}, " + bm25.removeprefix("with ").replace("from documents", "from changed")
    return {
        "q117_large_lexicon": _lexicon(),
        "q118_index_after_changes": again + "select * from top",
        "q120_stream_approvals": """with e as (select event_id as i, user_id as u, date_trunc('second', cast(ts as timestamp)) as asked from events where event_id % 2 = 0),
            claims as (select i, u, asked, asked + to_seconds(i * 37 % 1800 * 2 + 1) as said, i % 14 <> 0 as own from e where i % 6 <> 0 union all select i, u, asked, asked + to_seconds(i * 53 % 2700 * 2 + 2), true from e where i % 6 <> 0),
            every as (select u, asked as x from e union all select u, said from claims), newest as (select max(x) - interval 10 minutes as wm from every),
            taken as (select i, min(said) as done from claims where own and said <= asked + interval 30 minutes group by i),
            seen as (select u, max(x) as x from every group by u),
            told as (select u, case when said > asked + interval 30 minutes or said > done then 'unknown' when own then 'claimed' else 'refused' end as outcome from claims left join taken using (i)
                union all select e.u, 'expired' from e left join taken using (i) join seen on seen.u = e.u cross join newest where done is null and (asked + interval 30 minutes < wm or asked + interval 30 minutes < seen.x))
            select cast(u as varchar) as scope, outcome, count(*) as n from told group by all""",
        "q121_stream_budgets": f"""with u as ({USAGE}), r as (
            select user_id, 'daily' as "window", strftime(ts, '%Y-%m-%d') as period, sum(tokens_in + tokens_out) over (partition by user_id, strftime(ts, '%Y-%m-%d') order by epoch_ms(ts), tokens_in + tokens_out rows unbounded preceding) as used, 1500 as most from u
            union all select user_id, 'monthly', strftime(ts, '%Y-%m'), sum(tokens_in + tokens_out) over (partition by user_id, strftime(ts, '%Y-%m') order by epoch_ms(ts), tokens_in + tokens_out rows unbounded preceding), 40000 from u)
            select user_id, "window", period, cast(min(used) as bigint) as used from r where used >= most group by user_id, "window", period""",
        "q122_ingest_outputs": ingest + "select doc_id, case when reason = '' then 'indexed' else 'quarantined' end as status, reason, reason = '' as indexed, reason <> '' as quarantined, true as audited from s",
        "q119_index_sums": again + "select (select count(*) from len) as units, (select cast(sum(length) as bigint) from len) as length, (select count(*) from tf) as postings",
    }
