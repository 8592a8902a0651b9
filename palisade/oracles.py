"""DuckDB SQL for the queries, on views of the same tables."""

from __future__ import annotations

from palisade import oracles_controls, oracles_governance, oracles_runs, oracles_stores
from palisade.functions import rails
from palisade.operators import retrieval
from palisade.sources.carriers import PROMPTS, RATES, USAGE



def _moves() -> str:
    """Places of digits in the check of twelve-digit numbers: powers of one permutation, row after row."""
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([(1, 5, 7, 6, 2, 8, 3, 0, 9, 4)[x] for x in rows[-1]])
    return str([x for r in rows for x in r])


def _products() -> str:
    """The symmetries of a pentagon, 0 to 4 turns, 5 to 9 the same after a flip."""
    turn = lambda a, b: (a + b) % 5 if a < 5 and b < 5 else 5 + (a + b - 5) % 5 if a < 5 else 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5
    return str([turn(a, b) for a in range(10) for b in range(10)])



def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _spans(pattern: str, kind: str, keep: str = "true", source: str = "documents") -> str:
    """Rows (doc_id, source, kind, value, start, stop), by the lengths of matches and gaps."""
    return f"""
select doc_id, source, '{kind}' as kind, m[i] as value,
  list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as start,
  list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) as stop
from (select *, unnest(range(1, len(m) + 1)) as i from (
  select doc_id, source, regexp_extract_all(text, '{pattern}') as m, regexp_split_to_array(text, '{pattern}') as g from {source}))
where {keep}"""


_LUHN = """length(regexp_replace(VALUE, '[^0-9]', '', 'g')) between 13 and 19 and list_sum(list_transform(
  range(1, length(regexp_replace(VALUE, '[^0-9]', '', 'g')) + 1),
  lambda k: case when k % 2 = 1 then cast(substr(reverse(regexp_replace(VALUE, '[^0-9]', '', 'g')), k, 1) as int)
    else (case when 2 * cast(substr(reverse(regexp_replace(VALUE, '[^0-9]', '', 'g')), k, 1) as int) > 9 then 2 * cast(substr(reverse(regexp_replace(VALUE, '[^0-9]', '', 'g')), k, 1) as int) - 9 else 2 * cast(substr(reverse(regexp_replace(VALUE, '[^0-9]', '', 'g')), k, 1) as int) end) end)) % 10 = 0"""


def _luhn(value: str) -> str:
    return _LUHN.replace("VALUE", value)


_FOUR = " union all ".join(
    (
        _spans(r"[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+[\p{L}\p{N}_]", "EMAIL_ADDRESS"),
        _spans(r"\b(?:\d[ -]?){13,19}\b", "CREDIT_CARD", _luhn("m[i]")),
        _spans(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP_ADDRESS"),
        _spans(r"(?:\+\d{1,3}[ -]?)?(?:\(\d{3}\)|\d{3})[ -]\d{3}[ -]\d{4}\b", "PHONE_NUMBER"),
    )
)


def _rank(v: str) -> str:
    return f"list_position([{_in(rails.LEVELS)}], {v}) - 1"


def _rules(rules) -> str:
    ps = [rails.parse_rule(r)[0] for r in rules]
    return "case when " + " or ".join(f"regexp_matches(text, '(?i){p}')" for p in ps) + " then 'block' else 'pass' end"


_INJECTION = "greatest(" + ", ".join(f"case when regexp_matches(text, '(?i){p}') then {s} else 0.0 end" for _, s, p in rails.INJECTION) + ")"
_TECHNIQUE = "case " + " ".join(f"when score = {s} and regexp_matches(text, '(?i){p}') then '{t}'" for t, s, p in rails.INJECTION) + " end"

_WORDS3 = "regexp_split_to_array(lower(text), '[^a-z0-9_]+')"

_P = f"with prompts as ({PROMPTS}) "
_STEM_RX = f"^(.{{3,}}?)({retrieval.SUFFIXES})$"


def _stem(w: str) -> str:
    base = f"(case when regexp_extract({w}, '{_STEM_RX}', 2) in ('ies', 'ied') then regexp_extract({w}, '{_STEM_RX}', 1) || 'y' when regexp_extract({w}, '{_STEM_RX}', 1) <> '' then regexp_extract({w}, '{_STEM_RX}', 1) else {w} end)"
    return f"case when length({w}) <= 3 or regexp_matches({w}, '^[0-9]+$') then {w} when length({base}) > 3 then regexp_replace({base}, 'e$', '') else {base} end"


_TERMS = f"list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 and w not in ({_in(retrieval.STOP)})), lambda w: {_stem('w')})"

_BM25 = f"""with tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TERMS}) as term from documents) group by all),
len as (select doc_id, sum(tf) as length from tf group by doc_id),
df as (select term, count(*) as df from tf group by term),
tot as (select count(*) as n, avg(length) as a from len),
qs as (select item_id as query_id, array_to_string(string_split(text, ' ')[1:12], ' ') as text from benchmark),
qt as (select query_id, len(q) as n_terms, unnest(q) as term from (select query_id, list_distinct({_TERMS}) as q from qs) where len(q) > 0),
hit as (select query_id, doc_id, n_terms, count(*) as matched,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))), 6) as score
  from tf join qt using (term) join df using (term) join len using (doc_id) cross join tot group by all),
gate as (select *, matched / n_terms as coverage from hit where matched / n_terms >= 0.15 and (n_terms <= 3 or matched >= 2)),
top as (select query_id, doc_id, score, round(coverage, 6) as coverage, row_number() over (partition by query_id order by score desc, coverage desc, doc_id) as rank from gate qualify rank <= 4)
"""


def _rate(side: int) -> str:
    return "case " + " ".join(f"when starts_with(model, '{r[0]}') then {r[side]}" for r in sorted(RATES, key=lambda r: -len(r[0]))) + " else 0 end"


_OUTCOMES = f"""with outcomes as (
  select event_id as case_id, 'a' as arm, [{_in(rails.LEVELS)}][1 + cast(floor(abs(value) * 3) as bigint) % 4] as actual, user_id from events
  union all select event_id, 'b', [{_in(rails.LEVELS)}][1 + cast(floor(abs(value) * 5) as bigint) % 4], user_id from events where event_id % 10 <> 0)
"""

_FOLD = f"""translate(regexp_replace(raw, '[​-‏]', '', 'g'), 'а', 'a')"""


def oracle_sql() -> dict[str, str]:
    at = r"[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+[\p{L}\p{N}_]"
    masked = lambda put: f"select doc_id, md5(array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || case when i <= len(m) then {put} else '' end), '')) as masked from (select doc_id, regexp_extract_all(text, '{at}') as m, regexp_split_to_array(text, '{at}') as g from documents)"
    local, domain = "split_part(m[i], '@', 1)", "split_part(m[i], '@', 2)"
    partly = f"substr({local}, 1, 2) || repeat('*', greatest(0, length({local}) - 2)) || '@' || repeat('*', greatest(1, length(regexp_extract({domain}, '^(.*)\\.[^.]*$', 1)))) || '.' || regexp_extract({domain}, '[^.]*$')"
    value = lambda p, ok: f"{_P}, v as (select request_id, regexp_extract(text, '{p}') as value from prompts) select request_id, value, case when value = '' then false else coalesce({ok}, false) end as valid from v"
    ds = "regexp_replace(value, '[^0-9]', '', 'g')"
    turned = f"list_transform(range(1, 13), lambda k: {_moves()}[1 + ((k - 1) % 8) * 10 + cast(substr(reverse({ds}), k, 1) as int)])"
    verhoeff = f"regexp_matches({ds}, '^[2-9][0-9]{{11}}$') and list_reduce(list_prepend(0, {turned}), lambda c, x: {_products()}[1 + c * 10 + x]) = 0"
    digits = lambda v: f"regexp_replace({v}, '[^0-9]', '', 'g')"
    first = lambda p: f"regexp_extract(text, '{p}')"
    twelve, iban, ssn = first(r"\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b"), first(r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"), first(r"\b\d{3}[- ]\d{2}[- ]\d{4}\b")
    personal = " or ".join(
        (
            f"regexp_matches(text, '{at}')", r"regexp_matches(text, 'CLM-\d{8}')", r"regexp_matches(text, '\b(?:0?[1-9]|[12]\d|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19|20)\d{2}\b')",
            f"({first(r'[A-Z]{5}[0-9]{4}[A-Z]')} <> '' and regexp_matches(text, '\\b[A-Z]{{3}}[ABCFGHLJPTK][A-Z][0-9]{{4}}[A-Z]\\b'))",
            f"({ssn} <> '' and not (substr({ssn}, 1, 3) in ('000', '666') or substr({ssn}, 1, 1) = '9' or substr({ssn}, 5, 2) = '00' or substr({ssn}, 8, 4) = '0000'))",
            f"coalesce(({_luhn(first(r'\b[0-9][0-9 -]{11,22}[0-9]\b'))}), false)",
            f"case when {twelve} = '' then false else coalesce({verhoeff.replace(ds, digits(twelve))}, false) end",
            f"case when {iban} = '' then false else coalesce(try_cast(array_to_string(list_transform(string_split(substr({iban}, 5) || substr({iban}, 1, 4), ''), lambda c: case when regexp_matches(c, '[A-Z]') then cast(ascii(c) - 55 as varchar) else c end), '') as hugeint) % 97 = 1, false) end",
        )
    )
    judged = f"""{_P}, r as (select request_id, surface, case when regexp_matches(lower(text), '(^|[^a-z0-9_])(idiot|moron|imbecile|scum|vermin)($|[^a-z0-9_])') then 'mask' else 'pass' end as words_verdict, {_rules((*rails.SECURITY_RULES, *rails.USE_CASE_RULES))} as rules_verdict,
        case when surface in ('user.prompt', 'user.feedback', 'ingest.document', 'agent.data') and {_INJECTION} >= 0.85 then 'block' else 'pass' end as injection_verdict, {personal} as personal from prompts),
        v as (select request_id, surface, words_verdict, rules_verdict, injection_verdict, case when rules_verdict = 'block' or injection_verdict = 'block' then 'block' when personal or words_verdict = 'mask' then 'mask' else 'pass' end as verdict from r) """
    figures = lambda c: f"list_distinct(list_filter(list_transform(regexp_extract_all({c}, '[0-9][0-9,]*'), lambda x: replace(x, ',', '')), lambda x: length(x) >= 2))"
    status = "case when length(text) > 200000 then 'oversized' when bad then 'blocked' when trim(text) = '' then 'empty' else '' end"
    ingest = f"with d as (select doc_id, text, {_INJECTION} >= 0.85 or {_rules((*rails.SECURITY_RULES, *rails.USE_CASE_RULES))} = 'block' as bad from documents), s as (select *, {status} as reason from d) "
    return oracles_governance.oracle_sql() | oracles_controls.oracle_sql() | oracles_stores.oracle_sql(_BM25, ingest) | oracles_runs.oracle_sql() | {
        "q01_normalize_fold": f"""{_P}, r as (select request_id, regexp_replace(regexp_replace(text, 'a', 'а', 'g'), 'the ', 'the​ \t ', 'g') as raw from prompts),
            c as (select request_id, raw, regexp_replace({_FOLD}, '[ \t]+', ' ', 'g') as clean from r)
            select request_id, clean, cast(list_sum(list_transform(range(1, least(length(raw), length(clean)) + 1), lambda i: case when substr(raw, i, 1) <> substr(clean, i, 1) then 1 else 0 end)) + abs(length(raw) - length(clean)) as bigint) as changes from c""",
        "q03_word_hits": """with w as (select doc_id, regexp_split_to_array(lower(text), '[^a-z0-9_]+') as w, regexp_extract_all(lower(text), '[^a-z0-9_]+') as g from documents),
            e as (select doc_id, w, g, unnest(range(1, len(w) + 1)) as i from w)
            select doc_id, w[i] as term, count(*) as n, cast(sum(coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[1:i-1], lambda x: length(x))), 0)) as bigint) as starts
            from e where w[i] in ('idiot','moron','imbecile','scum','vermin') group by doc_id, w[i]""",
        "q04_word_rail_mask": r"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bidiot\b', '*****', 'g'), '(?i)\bmoron\b', '*****', 'g'), '(?i)\bscum\b', '****', 'g'), '', '')) as masked from documents",
        "q05_pii_spans": f"select doc_id, kind, count(*) as n, cast(sum(start) as bigint) as starts from ({_FOUR}) group by all",
        "q06_luhn": value("4539[0-9 ]{15}", _luhn("value")),
        "q07_verhoeff": value("2345 [0-9]{4} [0-9]{4}", verhoeff),
        "q08_iban_mod97": value("GB[0-9A-Z]+", "length(value) between 15 and 34 and try_cast(array_to_string(list_transform(string_split(substr(value, 5) || substr(value, 1, 4), ''), lambda c: case when regexp_matches(c, '[A-Z]') then cast(ascii(c) - 55 as varchar) else c end), '') as hugeint) % 97 = 1"),
        "q09_ssn": value("[0-9]{3}-[0-9]{2}-[0-9]{4}", "not (substr(value, 1, 3) in ('000', '666') or substr(value, 1, 1) = '9' or substr(value, 5, 2) = '00' or substr(value, 8, 4) = '0000')"),
        "q10_pan": value("[A-Z]{5}[0-9]{4}[A-Z]", "substr(value, 4, 1) in ('A','B','C','F','G','H','L','J','P','T','K')"),
        "q11_allowlist_partition": f"select count(*) as found, count(*) filter (where ends_with(value, '@mail1.example.com')) as exempt from ({_FOUR}) where kind = 'EMAIL_ADDRESS'",
        "q12_mask_redact": masked("'[REDACTED]'"),
        "q13_mask_replace": masked("'<EMAIL_ADDRESS>'"),
        "q14_mask_hash": masked("'<EMAIL_ADDRESS:' || substr(sha256(m[i]), 1, 8) || '>'"),
        "q15_mask_partial": masked(partly),
        "q16_rules_verdict": f"{_P} select request_id, {_rules(rails.SECURITY_RULES)} as security, {_rules(rails.USE_CASE_RULES)} as use_case, cast({' + '.join(f'''len(regexp_extract_all(text, '(?i){rails.parse_rule(r)[0]}'))''' for r in rails.USE_CASE_RULES)} as bigint) as use_case_hits from prompts",
        "q17_injection_scan": f"{_P}, s as (select request_id, text, cast({_INJECTION} as double) as score from prompts) select request_id, score, {_TECHNIQUE} as technique, score >= 0.85 as blocked from s",
        "q19_scope_vocab": "select doc_id, array_to_string(list_filter(['claim', 'death', 'fee', 'license', 'permit'], lambda t: contains(lower(text), t)), ',') as hits from documents",
        "q20_evaluate_verdict": judged + "select * from v",
        "q21_verdict_counts": judged + "select surface, verdict, count(*) as n from v group by all",
        "q25_review_trigger": judged + ", w as (select verdict, cast(('0x' || right(sha256(cast(request_id as varchar)), 2)) as int) < 13 as picked from v) select case when verdict in ('block', 'mask') then verdict when picked then 'sampled' else 'none' end as why, count(*) as n from w group by 1",
        "q23_severity_thresholds": "select event_id, round(case event_id % 4 when 3 then 2.0 else least(1.0, greatest(0.0, (event_id % 101) / 100.0 * [0.7, 1.0, 1.3][1 + event_id % 4])) end, 6)::double as threshold from events",
        "q27_tokens_df": f"select term, count(*) as df from (select doc_id, unnest(list_distinct({_TERMS})) as term from documents) group by term",
        "q28_stem": f"select distinct w as word, {_stem('w')} as stem from (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents)",
        "q29_bm25_topk": _BM25 + "select * from top",
        "q32_retrieval_metrics": _BM25 + """, ds as (select doc_id, array_to_string(w[i:i+7], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from (select doc_id, string_split(text, ' ') as w from documents))),
            bs as (select item_id as query_id, array_to_string(w[i:i+7], ' ') as s from (select item_id, w, unnest(range(1, len(w) - 6)) as i from (select item_id, string_split(text, ' ') as w from benchmark))),
            rel as (select distinct query_id, doc_id from ds join bs using (s)),
            want as (select query_id, count(*) as n_rel from rel group by 1),
            per as (select t.query_id, count(*) as returned, count(r.doc_id) as found, min(case when r.doc_id is not null then rank end) as first from top t left join rel r using (query_id, doc_id) group by 1),
            a as (select coalesce(n_rel, 0) as n_rel, coalesce(returned, 0) as returned, coalesce(found, 0) as found, first from qs left join want using (query_id) left join per using (query_id))
            select round(avg(case when n_rel > 0 then found / n_rel end), 3) as recall, round(avg(case when n_rel > 0 and returned > 0 then found / returned when n_rel > 0 then 0.0 end), 3) as precision,
              round(avg(case when n_rel > 0 then coalesce(1.0 / first, 0.0) end), 3) as mrr, round(avg(case when n_rel > 0 then case when first = 1 then 1.0 else 0.0 end end), 3) as hit_at_1,
              count(*) filter (where n_rel = 0 and returned = 0) as silent from a""",
        "q33_rail_confusion": f"""with h as (select toxic = 1 as e, len(list_filter({_WORDS3}, lambda w: w in ('idiot','moron','scum'))) > 0 as a from documents join labels using (doc_id)),
            c as (select count(*) filter (where e and a) as tp, count(*) filter (where not e and a) as fp, count(*) filter (where e and not a) as fn, count(*) filter (where not e and not a) as tn from h)
            select *, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall from c""",
        "q34_ingest_status": ingest + "select doc_id, case when reason = '' then 'indexed' else 'quarantined' end as status, reason from s",
        "q35_corpus_stats": ingest + "select count(*) filter (where reason = '') as indexed, count(*) filter (where reason <> '') as quarantined, cast(sum(length(text)) filter (where reason = '') as bigint) as chars from s",
        "q36_sessions": "select conv_id % 10 as user, conv_id as session_id, count(*) as turns, arg_min(text, turn) filter (where role = 'user') as first_question, max(turn) as last_ordinal, array_to_string(list_sort(list_distinct(list(role))), ',') as roles from conversations group by conv_id",
        "q37_user_stats": "select conv_id % 10 as user, count(*) as turns, count(distinct conv_id) as sessions, cast(sum(length(text)) as bigint) as chars from conversations group by 1",
        "q38_usage_cost": f"with u as ({USAGE}) select user_id, model, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out, cast(sum(tokens_in * ({_rate(1)}) + tokens_out * ({_rate(2)})) as bigint) as micros from u group by all",
        "q39_budget_breach": f"with u as ({USAGE}), r as (select user_id, strftime(ts, '%Y-%m-%d') as day, sum(tokens_in + tokens_out) over (partition by user_id, strftime(ts, '%Y-%m-%d') order by ts, tokens_in, tokens_out rows unbounded preceding) as used from u) select user_id, day, cast(min(used) as bigint) as used_at_breach, count(*) as uses_after from r where used >= 1500 group by all",
        "q40_history_cap": "select conv_id as session_id, turn as ordinal, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3",
        "q41_audit_chain_verify": f"""{_P.replace('with', 'with recursive', 1)}, r as (select request_id, surface, text, strftime(ts, '%Y-%m-%d') as day, request_id // 64 as block, concat_ws('|', cast(request_id as varchar), surface, text) as body from prompts),
            k as (select *, sha256(day || '|' || block) as start, row_number() over (partition by day, block order by request_id) as i from r),
            c as (select *, start as prev, sha256(start || '|' || body) as hash from k where i = 1 union all select k.*, c.hash, sha256(c.hash || '|' || k.body) from c join k on k.day = c.day and k.block = c.block and k.i = c.i + 1),
            s as (select day, block, count(*) as n, arg_max(hash, i) as last from c group by all),
            t as (select * replace (case when request_id % 97 = 0 then text || '!' when request_id % 89 = 0 then text || '?' else text end as text) from c where request_id % 101 <> 0),
            u as (select *, sha256(prev || '|' || concat_ws('|', cast(request_id as varchar), surface, text)) as now from t),
            w as (select * replace (case when request_id % 89 = 0 then now else hash end as hash) from u),
            v as (select *, now <> hash or prev <> coalesce(lag(hash) over (partition by day, block order by request_id), start) as broken from w),
            b as (select day, block, count(*) as n, count(*) filter (where broken) as broken, min(case when broken then request_id end) as first_broken, arg_max(hash, i) as last from v group by all)
            select day, cast(sum(coalesce(b.n, 0)) as bigint) as records, cast(sum(coalesce(broken, 0)) as bigint) as broken, min(first_broken) as first_broken, count(*) filter (where b.n is distinct from s.n or b.last is distinct from s.last) as broken_blocks from s left join b using (day, block) group by day""",
        "q42_entitlement": "select (a.p = o_custkey) or coalesce(c_mktsegment = 'BUILDING', false) as entitled, count(*) as n from (select *, o_custkey + o_orderkey % 2 as p from orders) a left join customer on c_custkey = a.p group by 1",
        "q44_supervisor_floor": f"{_OUTCOMES}, e as (select user_id, case when case_id % 5 = 0 then null else {_rank('actual')} end as r from outcomes where user_id % 3 <> 0 or case_id % 7 = 0) select user_id, [{_in(rails.LEVELS)}][1 + coalesce(max(r), 0)] as verdict from e group by 1",
        "q47_lexical_grounding": """with t as (select conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from conversations)
            select a.conv_id, a.turn, round(case when len(a.w) = 0 then 0.0 else len(list_intersect(a.w, u.w)) / len(a.w) end, 6) as overlap from t a join t u on a.conv_id = u.conv_id and a.turn = u.turn + 1 where a.role = 'assistant' and u.role = 'user'""",
        "q49_figures_except": f"select a.doc_id, cast(len(list_filter({figures('a.text')}, lambda x: not list_contains({figures('b.text')}, x))) as bigint) as unsupported from documents a join documents b on b.doc_id = a.doc_id + 1",
        "q50_arm_delta": f"{_OUTCOMES}, p as (select a.actual as x, b.actual as y from (select * from outcomes where arm = 'a') a full join (select * from outcomes where arm = 'b') b using (case_id)) select case when x is null or y is null then 'only' when {_rank('y')} < {_rank('x')} then 'looser' when {_rank('y')} > {_rank('x')} then 'stricter' else 'same' end as change, count(*) as cases from p group by 1",
        "q51_p50_p95": "select event_type, round(median(value), 6) as p50, round(list_sort(list(value))[1 + least(count(*) - 1, cast(floor(count(*) * 0.95) as bigint))], 6) as p95 from events group by 1",
        "q54_tool_lookup": "select l_linenumber, count(*) as calls, count(p_retailprice) as known from (select *, case when l_linenumber % 3 = 0 then -l_partkey else l_partkey end as k from lineitem) left join part on p_partkey = k group by 1",
        "q56_regeneration_pick": "select event_id // 3 as request, coalesce(min(case when abs(value) % 10 >= 5 then event_id % 3 end), -1) as picked from events group by 1",
        "q59_approval_ttl": """with a as (select user_id, event_id as ask, ts from events where event_type = 'signup'), s as (select user_id, ts from events where event_type = 'purchase'),
            h as (select distinct ask from a join s on a.user_id = s.user_id and epoch(date_trunc('second', s.ts)) - epoch(date_trunc('second', a.ts)) between 0 and 86400)
            select case when h.ask is null then 'expired' else 'claimed' end as state, count(*) as n from a left join h using (ask) group by 1""",
        "q60_stream_tumbling": "select strftime(ts, '%Y-%m-%d') as day, user_id, count(*) as n, cast(sum(floor(abs(value))) as bigint) as used from events group by all",
        "q61_stream_sliding": "with w as (select time_bucket(interval 15 minutes, ts) - to_minutes(15 * k) as s, event_type from events, range(4) r(k)) select strftime(s, '%Y-%m-%d %H:%M') as start, count(*) as n, count(*) filter (where event_type = 'error') as errors from w group by 1",
        "q63_html_text": r"select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) as text_md5 from pages",
        "q65_detection_by_source": f"select source, kind, count(*) as n from ({_FOUR}) group by all",
        "q22_rail_counts": f"""{_P}, r as (select case when regexp_matches(lower(text), '(^|[^a-z0-9_])(idiot|moron|imbecile|scum|vermin)($|[^a-z0-9_])') then 'mask' else 'pass' end as words, {_rules((*rails.SECURITY_RULES, *rails.USE_CASE_RULES))} as rules,
            case when surface in ('user.prompt', 'user.feedback', 'ingest.document', 'agent.data') and {_INJECTION} >= 0.85 then 'block' else 'pass' end as injection from prompts)
            select rail, verdict, count(*) as n from (unpivot r on words, rules, injection into name rail value verdict) group by all""",
        "q30_coverage_gate": _BM25 + "select query_id, count(*) as candidates, count(*) filter (where matched / n_terms >= 0.15 and (n_terms <= 3 or matched >= 2)) as passed from hit group by 1",
        "q31_seed_overlap": """with qw as (select item_id as query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:12], ' ')), '[a-z0-9]+'), lambda w: w not in ('a','an','and','the','of','to','in','is')))) as w from benchmark),
            dw as (select doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w not in ('a','an','and','the','of','to','in','is')))) as w from documents),
            h as (select query_id, doc_id, count(*) as m from qw join dw using (w) group by all), n as (select query_id, count(*) as n from qw group by 1)
            select query_id, doc_id, round(m / n, 6) as overlap, row_number() over (partition by query_id order by m desc, doc_id) as rank from h join n using (query_id) qualify rank <= 4""",
        "q43_policy_floor": f"""with e as (select [{_in(rails.LEVELS)}][1 + event_id % 4] as v, event_id % 3 as f, ['pass','mask','flag','block','escalate','unheard',null][1 + event_id % 7] as act from events),
            g as (select v, f, act, case when act in ({_in(rails.LEVELS)}, 'escalate') then act else 'block' end as floor from e),
            o as (select v, case when f = 0 or act is null then v when floor = 'escalate' then floor when {_rank('floor')} > {_rank('v')} then floor else v end as verdict from g)
            select verdict, verdict <> v as overridden, count(*) as n from o group by all""",
        "q45_adjudicate_marginal": f"""with e as (select event_id % 101 as s, case when event_id % 101 >= 70 then 'block' else 'pass' end as v, [{_in(rails.LEVELS)}, 'unsure'][1 + event_id % 5] as w, event_id % 10 as c from events),
            o as (select v, case when abs(s - 70) > 10 or w = 'unsure' then v when {_rank('w')} > {_rank('v')} then w when c >= 8 then [{_in(rails.LEVELS)}][1 + least({_rank('v')}, greatest({_rank('w')}, 1))] else v end as a from e)
            select v as before, a as after, count(*) as n from o group by all""",
        "q46_content_breach": """with s as (select event_id, event_id * 7 % 101 / 100 as hate, event_id * 11 % 101 / 100 as insults, event_id * 15 % 101 / 100 as misconduct, event_id * 19 % 101 / 100 as self_harm, event_id * 23 % 101 / 100 as sexual, event_id * 27 % 101 / 100 as violence from events),
            b as (select event_id, concat_ws(',', case when hate >= 0.7 then 'hate' end, case when insults >= 0.75 then 'insults' end, case when misconduct >= 0.7 then 'misconduct' end, case when self_harm >= 0.4 then 'self_harm' end, case when sexual >= 0.6 then 'sexual' end, case when violence >= 0.65 then 'violence' end) as breached,
              round(greatest(hate / 0.7, insults / 0.75, misconduct / 0.7, self_harm / 0.4, sexual / 0.6, violence / 0.65), 6) as worst from s)
            select event_id, case when breached = '' then 'pass' else 'block' end as verdict, breached, worst from b""",
        "q48_claims": r"""with t as (select conv_id, turn, role, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda c: trim(c)), lambda c: c <> '') as cl from conversations)
            select a.conv_id, a.turn, cast(len(a.cl) as bigint) as claims, cast(len(list_filter(a.cl, lambda c: len(regexp_extract_all(lower(c), '[a-z0-9]+')) > 0
              and len(list_intersect(list_distinct(regexp_extract_all(lower(c), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(u.text), '[a-z0-9]+')))) >= 0.1 * len(list_distinct(regexp_extract_all(lower(c), '[a-z0-9]+'))))) as bigint) as supported
            from t a join t u on a.conv_id = u.conv_id and a.turn = u.turn + 1 where a.role = 'assistant' and u.role = 'user'""",
        "q58_price_prefix": f"""with u as ({USAGE}), p as (select * from (values {', '.join(map(str, RATES))}) v(prefix, i, o)),
            m as (select model, coalesce(arg_max(prefix, length(prefix)), '') as prefix, coalesce(arg_max(i, length(prefix)), 0) as i, coalesce(arg_max(o, length(prefix)), 0) as o from (select distinct model from u) left join p on starts_with(model, prefix) group by 1)
            select model, prefix, count(*) as uses, cast(sum(tokens_in * i + tokens_out * o) as bigint) as micros from u join m using (model) group by all""",
        "q62_stream_session": """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events),
            s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e)
            select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, user_id, count(*) as n from s group by user_id, k""",
        "q67_permission_check": "select c_mktsegment as role, count(*) as users from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1",
        "q69_two_arm_pivot": f"{_OUTCOMES} select actual as verdict, count(*) filter (where arm = 'a') as arm_a, count(*) filter (where arm = 'b') as arm_b from outcomes group by 1",
    }
