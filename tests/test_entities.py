"""Named entities held against a plain version, over the query's rows and over random spans."""

import random
import re

from pyspark.sql import functions as F

from palisade.functions import spans
from palisade.operators import entities
from palisade.queries_controls import KINDS, entity_rows

DATA = "/root/testdata/sf0.001"
LEAST = 0.6
HOUSE = re.compile(r"(?:(?:no|door|plot|flat|house)\.?\s*)?\d+[A-Za-z]?[,/\s-]*$", re.I)


def touches(a, b, c, d):
    return a < d and c < b


def plain_named(text, found, taken):
    claimed, out = [tuple(t) for t in taken], []
    for score, a, b, kind in sorted(((-p["score"], p["start"], p["stop"], entities.MAPPED.get(p["kind"])) for p in found), key=lambda x: x[:2]):
        if kind not in KINDS or -score < LEAST or any(touches(a, b, *c) for c in claimed):
            continue
        house = HOUSE.search(text[max(0, a - 24):a])
        wide = a - len(house.group()) if house else a
        if wide < a and not any(touches(wide, a, *c) for c in claimed):
            a, kind = wide, "ADDRESS"
        raw = text[a:b].strip()
        if len(raw) >= 2:
            claimed.append((a, b))
            out.append((a, a + len(raw), kind, raw, -score))
    return out


def plain_merged(text, proposed, judged, allow):
    items, rejected = list(proposed), 0
    if judged is not None:
        said = [(j["value"].strip(), j["kind"].strip().upper(), j["confidence"]) for j in judged[:40]]
        places = [(text.find(v), text.find(v) + len(v)) for v, _, _ in said if v and v in text]
        items = [p for p in proposed if any(touches(p[0], p[1], *c) for c in places)]
        rejected = len(proposed) - len(items)
        items += [(None, None, k, v, s) for v, k, s in said]
    good = [(a, k, v) for a, _, k, v, s in items if v and k in KINDS and s >= LEAST]
    there = [(a if a is not None and text[a:a + len(v)] == v else text.find(v), k, v) for a, k, v in good]
    there = [(a, a + len(v), k, v) for a, k, v in there if a >= 0]
    free = [m.span() for m in re.finditer(allow, text)]
    left = [x for x in there if not any(a <= x[0] and x[1] <= b for a, b in free)]
    kept, last = [], -1
    for x in sorted(left, key=lambda x: (x[0], x[0] - x[1])):
        if x[0] >= last:
            kept.append(x)
            last = x[1]
    return [(a, b, k) for a, b, k, _ in kept], rejected, len(good) - len(there), len(there) - len(left)


def held(df):
    named = entities.named(F.col("text"), F.col("found"), F.col("taken"), KINDS, LEAST)
    out = df.withColumn("named", named).withColumn("m", entities.merged(F.col("text"), F.col("named"), F.col("judged"), KINDS, LEAST, "Birth Office"))
    rows = out.collect()
    for r in rows:
        want = plain_named(r["text"], r["found"], r["taken"])
        assert [(s["start"], s["stop"], s["kind"], s["value"], s["score"]) for s in r["named"]] == want, r
        kept = [(s["start"], s["stop"], s["kind"]) for s in r["m"]["kept"]]
        assert (kept, r["m"]["rejected"], r["m"]["unverifiable"], r["m"]["allowlisted"]) == plain_merged(r["text"], want, r["judged"], "Birth Office"), r
    return rows


def test_query_rows(spark):
    assert any(r["m"]["unverifiable"] for r in held(entity_rows(spark, DATA)))


def test_random_spans(spark):
    rng = random.Random(5)
    words = ["Anna", "no. 4 ", "Birth Office", "12/", "x", "  ", "Nair", "plot 7B, ", "of", "\n"]
    rows = []
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randint(0, 9)))
        cut = lambda: sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
        found = [(*cut(), rng.choice(("PERSON", "GPE", "DATE", "NRP")), i / 16 + rng.random() / 32) for i in range(rng.randint(0, 15), 16)]
        judged = None if rng.random() < 0.2 else [(text[slice(*cut())] if rng.random() < 0.7 else "absent", rng.choice((" person", "ADDRESS", "OTHER")), rng.random()) for _ in range(rng.choice((0, 3, 45)))]
        rows.append((text, found, judged, [tuple(cut()) for _ in range(rng.randint(0, 1))]))
    schema = f"text string, found {entities.FOUND}, judged {entities.JUDGED}, taken array<struct<start:int,stop:int>>"
    assert sum(len(r["m"]["kept"]) for r in held(spark.createDataFrame(rows, schema))) > 100


def test_stars_and_gate(spark):
    df = spark.createDataFrame([("Ask Ann Lee",), ("<PERSON:0123456789ab> it",), ("End. Then\nNew",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(entities.candidate(F.col("text"))).collect()] == [True, False, False, False, False]
    found = spans.find(F.col("text"), "Ann Lee", "PERSON")
    assert df.select(spans.splice(F.col("text"), found, entities.starred)).first()[0] == "Ask A******"


def test_house_number_is_read_once_a_span():
    """What names an expression works it out anew, so each pattern stands in the plan's text once for each bound value."""
    from palisade.operators import entities as e

    plan = str(e.named(F.col("text"), F.col("found"), F.col("taken"), ("PERSON", "ADDRESS"), 0.6))
    assert plan.count(e.HOUSE_NUMBER) <= 1
