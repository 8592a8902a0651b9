"""Named entities: when to look for them, what a recogniser and a judge found, and what of it holds. Spans stay arrays of their row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import spans
from palisade.functions.vault import TOKEN
from palisade.operators.agents import chosen

#: A recogniser's kinds as ours, a number before a street, a capitalised word inside a sentence.
MAPPED = {"PERSON": "PERSON", "LOCATION": "ADDRESS", "GPE": "ADDRESS", "NRP": "PERSON"}
HOUSE_NUMBER = r"(?i)(?:(?:no|door|plot|flat|house)\.?\s*)?\d+[A-Za-z]?[,/\s-]*$"
CANDIDATE = r"(?mdU)(?<![.!?]\s)(?<!^)\b[A-Z][a-z]{2,}\b"
REACH = 24
MOST_JUDGED = 40

FOUND = "array<struct<start:int,stop:int,kind:string,score:double>>"
JUDGED = "array<struct<value:string,kind:string,confidence:double>>"


def candidate(text: Column) -> Column:
    """A name may be there: a capitalised word inside a sentence, tokens of the vault aside. Null texts have none."""
    return F.coalesce(F.regexp_replace(text, TOKEN, " ").rlike(CANDIDATE), F.lit(False))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def widened(text: Column, start: Column) -> Column:
    """`start`, or where the house number right before it begins."""
    at = F.greatest(start - REACH, F.lit(0))
    return start - F.length(F.regexp_extract(F.substr(text, at + 1, start - at), HOUSE_NUMBER, 0))


def named(text: Column, found: Column, taken: Column, kinds: tuple[str, ...], least: float) -> Column:
    """Spans of a recogniser's `found` (FOUND) that hold, surest first: of wanted kinds, off the spans `taken` and off
    surer ones, with the house number before them, which makes them addresses, and two characters or more."""
    usable = F.filter(found, lambda p: chosen(MAPPED, p["kind"]).isin(*kinds) & (p["score"] >= least))
    ordered = F.array_sort(F.transform(usable, lambda p, i: F.struct((-p["score"]).alias("k"), p["start"].alias("start"), i.alias("i"), p["stop"].alias("stop"), p["kind"].alias("kind"))))
    claimed = F.transform(taken, lambda t: F.struct(t["start"].cast("int").alias("start"), t["stop"].cast("int").alias("stop")))

    def step(acc: Column, x: Column) -> Column:
        meets = lambda a, b: F.exists(acc["claimed"], lambda c: (a < c["stop"]) & (c["start"] < b))

        def placed(p: Column) -> Column:
            span = F.struct(p["start"].alias("start"), (p["start"] + F.length(p["raw"])).alias("stop"), F.when(p["wider"], "ADDRESS").otherwise(chosen(MAPPED, x["kind"])).alias("kind"), p["raw"].alias("value"), F.size(acc["out"]).alias("ord"), (-x["k"]).alias("score"))
            more = F.struct(
                F.array_append(acc["claimed"], F.struct(p["start"].alias("start"), x["stop"].alias("stop"))).alias("claimed"),
                F.array_append(acc["out"], span).alias("out"),
            )
            return F.when(F.length(p["raw"]) < 2, acc).otherwise(more)

        # each value is bound once: what names an expression would work it out anew
        start = lambda w: F.when(w["wider"], w["wide"]).otherwise(x["start"])
        wider = lambda wide: F.struct(wide.alias("wide"), ((wide < x["start"]) & ~meets(wide, x["start"])).alias("wider"))
        raw = lambda w: F.struct(w["wider"].alias("wider"), start(w).alias("start"), _strip(F.substr(text, start(w) + 1, x["stop"] - start(w))).alias("raw"))
        kept = spans.let(widened(text, x["start"]), lambda wide: spans.let(wider(wide), lambda w: spans.let(raw(w), placed)))
        return F.when(meets(x["start"], x["stop"]), acc).otherwise(kept)

    first = F.struct(claimed.alias("claimed"), F.expr("cast(array() as array<struct<start:int,stop:int,kind:string,value:string,ord:int,score:double>>)").alias("out"))
    return F.aggregate(ordered, first, step, lambda a: a["out"])


def merged(text: Column, proposed: Column, judged: Column, kinds: tuple[str, ...], least: float, allow: str | None = None, most: int | None = MOST_JUDGED) -> Column:
    """Struct of `kept` spans and how many proposals were corroborated, rejected, findings unverifiable, allowlisted.

    A judge's findings (JUDGED, the first `most`; None: all) all count, proposals only where they touch one of them; a null `judged`
    is no judge, and proposals stand. A finding that isn't in the text word for word is counted and dropped."""
    said = F.transform(judged if most is None else F.slice(judged, 1, most), lambda j: F.struct(_strip(F.coalesce(j["value"], F.lit(""))).alias("value"), F.upper(F.trim(j["kind"])).alias("kind"), F.coalesce(j["confidence"], F.lit(0.0)).alias("score")))
    at = lambda v: F.instr(text, v) - 1
    item = lambda start, value, kind, score: F.struct(start.cast("int").alias("start"), value.alias("value"), kind.alias("kind"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))
    free = spans.find(text, allow, "allowed") if allow else F.expr(spans.NONE)
    stop = lambda x: x["start"] + F.length(x["value"])

    def counts(there: Column, items: Column, held: Column, free: Column) -> Column:
        covered = lambda x: F.exists(free, lambda a: (a["start"] <= x["start"]) & (x["stop"] <= a["stop"]))
        return F.struct(
            spans.resolve(F.filter(there, lambda x: ~covered(x))).alias("kept"), F.when(judged.isNotNull(), F.size(held)).otherwise(0).alias("corroborated"),
            (F.size(proposed) - F.size(held)).alias("rejected"), (F.size(items) - F.size(there)).alias("unverifiable"), F.size(F.filter(there, covered)).alias("allowlisted"),
        )

    def joined(theirs: Column, held: Column) -> Column:
        own = F.transform(held, lambda p: item(F.when(F.substr(text, p["start"] + 1, F.length(p["value"])) == p["value"], p["start"]).otherwise(at(p["value"])), p["value"], p["kind"], p["score"]))
        items = F.filter(F.concat(own, F.coalesce(theirs, F.array())), lambda x: (x["value"] != "") & x["kind"].isin(*kinds) & (x["score"] >= least))
        there = lambda all_: F.transform(F.filter(all_, lambda x: x["start"] >= 0), lambda x, i: F.struct(x["start"].alias("start"), stop(x).alias("stop"), x["kind"].alias("kind"), x["value"].alias("value"), i.alias("ord")))
        return spans.let(items, lambda all_: spans.let(there(all_), lambda here: spans.let(free, lambda f: counts(here, all_, held, f))))

    def against(theirs: Column) -> Column:
        places = F.filter(theirs, lambda x: (x["value"] != "") & (x["start"] >= 0))
        held = lambda p: F.filter(proposed, lambda x: judged.isNull() | F.exists(F.coalesce(p, F.array()), lambda a: (x["start"] < stop(a)) & (a["start"] < x["stop"])))
        return spans.let(places, lambda p: spans.let(held(p), lambda h: joined(theirs, h)))

    return spans.let(said, lambda s: spans.let(F.transform(s, lambda j: item(at(j["value"]), j["value"], j["kind"], j["score"])), against))


def starred(span: Column) -> Column:
    """An entity's first character, the rest as stars."""
    return F.concat(F.substr(span["value"], F.lit(1), F.lit(1)), F.repeat(F.lit("*"), F.length(span["value"]) - 1))
