"""Lexicons as tables against plain search, in every mode, and with very many terms."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import rails
from palisade.operators import lexicon

WORD = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def plain(text, terms, mode):
    low, out = (text or "").lower(), set()
    for t in {t.lower() for t in terms if t and len(t) <= 256}:
        at = low.find(t)
        while at >= 0:
            end = at + len(t)
            edges = (at == 0 or low[at - 1] not in WORD) and (end == len(low) or low[end] not in WORD)
            if mode == "substring" or mode == "word" and edges or mode == "exact" and t == low:
                out.add((at, end, t))
            at = low.find(t, at + 1)
    return sorted(out)


TEXTS = ["ushers", "she, he and HERS", "vermin control or vermin", "TODO: fill in XXXXX now", "a#tag #tag ##tag# x#tag#y", "é😀 she é", "", None, "x" * 300, "the the the the", "look\nthe other way; look the other way", "she", "_she she_ she-"]
TERMS = ["he", "she", "hers", "vermin", "TODO: fill in", "xxxxx", "#tag", "tag#", "é", "😀 she", "the the", "look the other way", "x" * 300, "x" * 256, "", None, "She", "the other"]


@pytest.mark.parametrize("mode", ["word", "substring", "exact"])
@pytest.mark.parametrize("broadcast", [lexicon.BROADCAST, 0])
def test_modes(spark, mode, broadcast):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS * 2)], "doc_id int, text string, term string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    out = {r.doc_id: [(h.start, h.stop, h.value) for h in r.hits] for r in lexicon.hits(docs, terms, mode=mode, broadcast=broadcast).collect()}
    assert len(out) == 2 * len(TEXTS)
    for i, found in out.items():
        assert found == plain(TEXTS[i % len(TEXTS)], TERMS, mode), (mode, TEXTS[i % len(TEXTS)])


def test_allowed_phrases(spark):
    docs = spark.createDataFrame([("vermin control and vermin",), ("fine",)], "text string")
    terms, allow = (spark.createDataFrame([(t,) for t in x], "term string") for x in (["vermin", "control and"], ["vermin control", "fine"]))
    out = [[(h.start, h.value) for h in r.hits] for r in lexicon.hits(docs, terms, allow).collect()]
    assert sorted(out) == [[], [(7, "control and"), (19, "vermin")]]


def test_same_as_the_rail_and_masks(spark):
    docs = spark.createDataFrame([("you IDIOT, grease the wheels of vermin control",)], "text string")
    terms, allow = (spark.createDataFrame([(t,) for t in x], "term string") for x in (rails.BLOCKLIST, rails.ALLOWLIST))
    row = lexicon.hits(docs, terms, allow).select("hits", F.array_sort(rails.blocked_terms(F.col("text"))).alias("rail"), rails.star_out(F.col("text"), F.col("hits")).alias("masked")).first()
    assert [h.value for h in row.hits] == [h.value for h in row.rail] and row.masked == "you *****, ***************** of vermin control"


def test_hundred_thousand_terms(spark):
    """One plan, whatever the number of terms; hits equal to looking every one up."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) for _ in range(3_000)]
    terms = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(130_000)})[:100_000]
    assert len(terms) == 100_000
    texts = [" ".join(rng.choice(words) for _ in range(400)) + " " + " and ".join(rng.sample(terms, 30)) for _ in range(12)]
    known = {}
    for t in terms:
        known.setdefault(len(t.split(" ")), set()).add(t)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    many = lexicon.hits(docs, spark.createDataFrame([(t,) for t in terms], "term string"))
    few = lexicon.hits(docs, spark.createDataFrame([(t,) for t in terms[:10]], "term string"))
    shape = lambda df: [x.strip(" +-:").split(" ")[0] for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    assert shape(many) == shape(few)
    total = 0
    for r in many.collect():
        w, at, want = texts[r.doc_id].split(" "), 0, set()
        for i in range(len(w)):
            want |= {(at, " ".join(w[i : i + n])) for n, k in known.items() if " ".join(w[i : i + n]) in k and i + n <= len(w)}
            at += len(w[i]) + 1
        assert {(h.start, h.value) for h in r.hits} == want
        total += len(want)
    assert total > 12 * 30


def test_nothing(spark):
    none = spark.createDataFrame([], "term string")
    docs = spark.createDataFrame([(1, "a", 5)], "doc_id int, text string, hits int")
    assert [tuple(r) for r in lexicon.hits(docs, none).collect()] == [(1, "a", [])]
    assert lexicon.hits(docs.limit(0), spark.createDataFrame([("a",)], "term string")).count() == 0
    with pytest.raises(ValueError):
        lexicon.hits(docs, none, mode="other")


def test_few_terms_are_found_without_a_shuffle(spark):
    """As by joins, allowed phrases included, in rows of any columns; and however many hits a text has."""
    docs = spark.createDataFrame([(i, t, [i]) for i, t in enumerate([*TEXTS, "the " * 30_000])], "`a.b` int, text string, other array<int>")
    terms, allow = (spark.createDataFrame([(t,) for t in x], "term string") for x in (TERMS, ["the other", "she,", "the the the the"]))
    few = lexicon.hits(docs, terms, allow)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString() and few.columns == [*docs.columns, "hits"]
    many = lexicon.hits(docs.where("length(text) < 1000"), terms, allow, broadcast=1)
    assert sorted(map(tuple, few.where("length(text) < 1000").collect())) == sorted(map(tuple, many.collect()))
    assert few.where("length(text) > 1000").select(F.size("hits")).first()[0] == 0
    assert lexicon.hits(docs, terms).where("length(text) > 1000").select(F.size("hits")).first()[0] == 29_999
