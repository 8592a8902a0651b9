"""Deterministic rails: lexicon, rule sets, injection patterns, scope words; and how verdicts fold."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import spans

LEVELS = ("pass", "flag", "mask", "block")
#: Terms that a text may not hold.
BLOCKLIST = ("idiot", "moron", "imbecile", "scum", "vermin", "under the table", "grease the wheels", "look the other way", "lorem ipsum", "TODO: fill in", "XXXXX")
ALLOWLIST = ("vermin control",)
#: Rules of the form pattern => action.
SECURITY_RULES = (
    r"password\s*[:=]\s*\S+ => block",
    r"api[_-]?key\s*[:=]\s*\S+ => block",
    r"\b(?:sk|pk)-[A-Za-z0-9]{16,}\b => block",
    r"\bghp_[A-Za-z0-9]{20,}\b => block",
    r"\bAKIA[0-9A-Z]{16}\b => block",
    r"\bBEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY\b => block",
    r"\bbearer\s+[A-Za-z0-9._-]{20,}\b => block",
)
USE_CASE_RULES = (
    r"\b(?:drop|truncate)\s+(?:the\s+)?(?:table|database)\b => block",
    r"\bdelete\s+from\s+\w+ => block",
    r"\bdelete\s+(?:all|every)\s+(?:the\s+)?(?:record|row|file|licence|license|claim|applicant)s?\b => block",
    r"\brm\s+-rf\b => block",
    r"\bwipe\s+(?:the\s+)?(?:database|records|corpus|index)\b => block",
)
#: Injection patterns with their techniques and scores, in order.
INJECTION = (
    ("instruction_override", 0.95, r"ignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+instructions?"),
    ("instruction_override", 0.95, r"disregard\s+(?:your|all|the|any)\s+(?:instructions?|rules?|guidelines?|training)"),
    ("exfiltration", 0.95, r"(?:reveal|print|show|repeat|output|display)\s+(?:me\s+)?(?:your|the)\s+(?:system\s+|initial\s+|original\s+)?(?:prompt|instructions?|rules)"),
    ("role_play", 0.85, r"you\s+are\s+now\s+(?:a|an|in)\b"),
    ("role_play", 0.88, r"\b(?:developer|debug|god)\s+mode\b"),
    ("role_play", 0.90, r"\bjailbreak\b|\bDAN\b"),
    ("role_play", 0.80, r"pretend\s+(?:that\s+)?(?:you|to\s+be)\b"),
    ("delimiter_confusion", 0.88, r"</?(?:system|instructions?|assistant)>"),
    ("delimiter_confusion", 0.85, r"\[\s*(?:system|inst|end\s+of\s+prompt)\s*\]"),
)
INJECTION_THRESHOLD = 0.85
SEVERITY = {"high": 0.70, "medium": 1.00, "low": 1.30, "off": -1.0}


def rank(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), verdict).cast("int") - 1


def verdict_of(rank_: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), rank_)


def fold(*verdicts: Column) -> Column:
    """The strictest of some verdicts: block over mask over flag over pass."""
    ranks = [rank(v) for v in verdicts]
    return verdict_of(F.greatest(F.lit(0), *ranks) if ranks else F.lit(0))


def scaled(base: Column, level: Column) -> Column:
    """A content threshold under a severity level; 2.0 can't be reached."""
    factor = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.coalesce(level, F.lit("medium"))]
    return F.when(factor < 0, 2.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * factor)))


def _term(t: str, mode: str) -> str:
    quoted = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", t.lower())
    return {"word": rf"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])", "substring": quoted, "exact": rf"^{quoted}$"}[mode]


def blocked_terms(text: Column, terms=BLOCKLIST, allow=ALLOWLIST, mode: str = "word") -> Column:
    """Hits of a lexicon, without those inside an allowed phrase. Terms over 256 characters are ignored.

    Terms are looked for one by one, with their borders, only in texts that hold any as a plain string."""
    used = [t for t in terms if 0 < len(t) <= 256]
    if not used:
        return F.expr(spans.NONE)

    def found(low: Column) -> Column:
        find = lambda ts, kind: spans.find_all(low, [(_term(t, mode), kind, i) for i, t in enumerate(ts)], {_term(t, mode): low.contains(t.lower()) for t in ts})
        hits = find(used, "blocked_term")
        if allow:
            free = find(allow, "allowed")
            hits = F.filter(hits, lambda h: ~F.exists(free, lambda a: (a["start"] <= h["start"]) & (h["stop"] <= a["stop"])))
        return F.when(reduce(or_, (low.contains(t.lower()) for t in used)), hits).otherwise(F.expr(spans.NONE))

    return spans.let(F.lower(text), found)


def star_out(text: Column, hits: Column) -> Column:
    return spans.splice(text, spans.resolve(hits), lambda s: F.repeat(F.lit("*"), s["stop"] - s["start"]))


def parse_rule(rule: str) -> tuple[str, str]:
    pattern, _, action = re.split(r"(\s*=>\s*)", rule, maxsplit=1) if "=>" in rule else (rule, "", "flag")
    if action not in ("block", "mask", "flag"):
        raise ValueError(f"unknown action in rule: {rule}")
    re.compile(pattern)
    return pattern.strip(), action


def needed(pattern: str) -> list[set[str]]:
    """Sets of lower-case ASCII strings: a text that `pattern` matches, in either case, holds one of each set. Longest first."""
    from re import _constants as c
    from re import _parser

    def walk(sequence) -> list[set[str]]:
        out, run = [], ""
        for op, arg in [*sequence, (None, None)]:
            if op is c.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            if op is c.AT:
                continue
            out, run = out + [{run}] if run else out, ""
            if op is c.SUBPATTERN:
                out += walk(arg[3])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
                out += walk(arg[2])
            elif op is c.BRANCH:
                sides = [walk(side) for side in arg[1]]
                if all(sides):
                    out.append(set.union(*(max(side, key=_least) for side in sides)))
        return out

    return sorted(walk(_parser.parse(pattern)), key=_least, reverse=True)


def _least(strings: set[str]) -> int:
    return min(map(len, strings))


def _matching(text: Column, patterns: list[str], then) -> Column:
    """`then` of one column a pattern: whether the text holds it in either case. The strings that every match has are far cheaper to
    look for than the pattern, so only texts with all of them meet it. The text is bound too: within a lambda Spark takes a column's
    name for an alias that stands before it in the same select."""
    def hold(whole: Column, low: Column, p: str) -> Column:
        parts = [reduce(or_, (low.contains(s) for s in sorted(some))) for some in needed(p)]
        return reduce(and_, [*parts, whole.rlike(f"(?i){p}")])

    return spans.let(text, lambda whole: spans.let(F.lower(whole), lambda low: then([hold(whole, low, p) for p in patterns])))


def rule_verdict(text: Column, rules) -> Column:
    parsed = [parse_rule(r) for r in rules if r.strip() and not r.lstrip().startswith("#")]
    return _matching(text, [p for p, _ in parsed], lambda held: fold(*[F.when(h, a).otherwise("pass") for h, (_, a) in zip(held, parsed)]))


def rule_hits(text: Column, rules) -> Column:
    counts = [F.regexp_count(text, F.lit(f"(?i){parse_rule(r)[0]}")) for r in rules]
    return sum(counts[1:], counts[0]).cast("long")


def rule_spans(text: Column, rules) -> Column:
    """All places of all rules."""
    return spans.find_all(text, [(f"(?i){parse_rule(r)[0]}", parse_rule(r)[1], i) for i, r in enumerate(rules)])


def injection_score(text: Column, techniques: set[str] | None = None) -> Column:
    used = [(s, p) for t, s, p in INJECTION if techniques is None or t in techniques]
    return _matching(text, [p for _, p in used], lambda held: F.greatest(*(F.when(h, s).otherwise(0.0) for h, (s, _) in zip(held, used))))


def injection_technique(text: Column) -> Column:
    """Technique of the first pattern with the largest score."""
    # the first of equal scores comes first, as the sort is stable
    ordered = sorted(INJECTION, key=lambda x: -x[1])

    def first(held: list[Column]) -> Column:
        out = F.when(F.lit(False), "")
        for h, (t, _, _) in zip(held, ordered):
            out = out.when(h, t)
        return out

    return _matching(text, [p for _, _, p in ordered], first)


def in_scope(text: Column, terms) -> Column:
    """Scope words found, as substrings of the folded text."""
    words = F.array(*map(F.lit, sorted(t.lower() for t in terms)))
    return spans.let(F.lower(text), lambda low: F.filter(words, lambda t: F.contains(low, t)))
