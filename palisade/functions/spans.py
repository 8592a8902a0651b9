"""Spans as arrays of structs (start, stop, kind, value, ord): found, resolved, and spliced, without a UDF.

Work grows with the number of spans and the length of the text, not with their product: arrays are walked in
stretches of stretches, so that nothing that grows is copied for each element, and texts are cut from pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,stop:int,kind:string,value:string,ord:int>"
NONE = f"cast(array() as array<{SPAN}>)"
STRETCH = 64


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of the value, which is evaluated once however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def stretches(items: Column, n: int = STRETCH) -> Column:
    """`items` in arrays of n, the last one shorter; none for none. Give it a name that `let` has bound."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int")), lambda j: F.slice(items, j * n + 1, F.lit(n)))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _before(numbers: Column, first: Column, levels: int) -> Column:
    if levels == 0:
        walked = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        return F.aggregate(numbers, F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out")), walked, lambda a: a["out"])
    each = lambda s, at: _before(s, at, 0)
    return let(stretches(numbers), lambda s: F.flatten(F.zip_with(s, let(F.transform(s, _sum), lambda n: _before(n, first, levels - 1)), each)))


def sums_before(numbers: Column) -> Column:
    """For each of the `numbers` (int) the sum of those before it."""
    return let(numbers, lambda n: _before(n, F.lit(0), 1))


def find_all(text: Column, patterns: list[tuple[str, str, int]], holds: dict[str, Column] | None = None) -> Column:
    """Leftmost non-overlapping matches of each of `patterns` (pattern, kind, order), those of the first one first; offsets come
    from the lengths of matches and gaps, by one expression for all. `holds`: by pattern, what a text with a match fulfils."""

    def placed(f: Column) -> Column:
        lengths = F.zip_with(F.slice(f["g"], F.lit(1), F.size(f["m"])), f["m"], lambda g, m: F.length(g) + F.length(m))
        start = lambda at, i: F.get(at, i) + F.length(F.get(f["g"], i))
        span = lambda at, m, i: F.struct(start(at, i).alias("start"), (start(at, i) + F.length(m)).alias("stop"), f["kind"].alias("kind"), m.alias("value"), f["ord"].alias("ord"))
        return let(sums_before(lengths), lambda at: F.transform(f["m"], lambda m, i: span(at, m, i)))

    def each(pattern: str, kind: str, order: int) -> Column:
        found = F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("ord"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
        guard = (holds or {}).get(pattern)
        return F.when(text.rlike(pattern) if guard is None else guard & text.rlike(pattern), found)

    if not patterns:
        return F.expr(NONE)
    return F.flatten(F.transform(F.filter(F.array(*(each(*p) for p in patterns)), lambda f: f.isNotNull()), placed))


def find(text: Column, pattern: str, kind: str, order: int = 0) -> Column:
    """Leftmost non-overlapping matches of one pattern."""
    return find_all(text, [(pattern, kind, order)])


def resolve(spans: Column) -> Column:
    """Earliest start wins, then the longer span, then the order of recognizers; what overlaps a kept span goes.

    Folds hold no spans, since every step copies what a fold holds: one finds where the last span kept before each stretch
    stops, others the numbers of the spans kept within a stretch."""
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["stop"]).alias("n"), s["ord"].alias("ord"), s.alias("s"))))
    ints = F.expr("cast(array() as array<int>)")

    def leaves(stretch: Column, stop: Column) -> Column:
        return F.aggregate(stretch, stop, lambda a, x: F.when(x["start"] >= a, x["s"]["stop"]).otherwise(a))

    def enters(all_: Column) -> Column:
        step = lambda a, stretch: F.struct(leaves(stretch, a["stop"]).alias("stop"), F.array_append(a["out"], a["stop"]).alias("out"))
        return F.aggregate(all_, F.struct(F.lit(0).alias("stop"), ints.alias("out")), step, lambda a: a["out"])

    def kept(stretch: Column, stop: Column) -> Column:
        taken = lambda a, x: F.struct(x["s"]["stop"].alias("stop"), F.array_append(a["out"], a["i"]).alias("out"), (a["i"] + 1).alias("i"))
        left = lambda a: F.struct(a["stop"].alias("stop"), a["out"].alias("out"), (a["i"] + 1).alias("i"))
        start = F.struct(stop.alias("stop"), ints.alias("out"), F.lit(0).alias("i"))
        numbers = F.aggregate(stretch, start, lambda a, x: F.when(x["start"] >= a["stop"], taken(a, x)).otherwise(left(a)), lambda a: a["out"])
        return F.transform(numbers, lambda i: F.get(stretch, i)["s"])

    return let(keyed, lambda k: let(stretches(k), lambda s: F.flatten(F.zip_with(s, enters(s), kept))))


def _spliced(text: Column, first: Column, spans: Column, put, sizes: tuple[int, ...]) -> Column:
    """`text`, which begins at place `first` and ends with the last of the spans, with every span replaced."""

    def begins(all_: Column, i: Column, stop: Callable[[Column], Column]) -> Column:
        return F.when(i == 0, first).otherwise(stop(F.get(all_, i - 1)))

    def one(s: Column, i: Column) -> Column:
        at = begins(spans, i, lambda x: x["stop"])
        return F.concat(F.substr(text, at - first + 1, s["start"] - at), put(s))

    def some(all_: Column) -> Column:
        last = lambda part: F.element_at(part, -1)["stop"]
        piece = lambda part, i: F.struct(begins(all_, i, last).alias("at"), F.substr(text, begins(all_, i, last) - first + 1, last(part) - begins(all_, i, last)).alias("text"), part.alias("spans"))
        return F.transform(F.transform(all_, piece), lambda p: _spliced(p["text"], p["at"], p["spans"], put, sizes[1:]))

    parts = let(stretches(spans, sizes[0]), some) if sizes else F.transform(spans, one)
    return F.array_join(parts, "")


def splice(text: Column, spans: Column, put) -> Column:
    """`text` with every span (sorted, disjoint) replaced by `put(span)`; null where a replacement is."""

    def done(b: Column) -> Column:
        last = F.element_at(b["spans"], -1)["stop"]
        head = _spliced(F.substr(b["text"], F.lit(1), last), F.lit(0), b["spans"], put, (STRETCH * STRETCH, STRETCH))
        return F.when(F.size(b["spans"]) == 0, b["text"]).otherwise(F.concat(head, F.substr(b["text"], last + 1)))

    return let(F.struct(text.alias("text"), spans.alias("spans")), done)
