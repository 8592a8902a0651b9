"""Periodic runs against trying every period."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import periodic_runs as pr
from palisade.llm import queries as q
from tests.llm import brute
from tests.llm.test_contracts import SMALL, odd, texts  # noqa: F401


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([2, 3, 4, 7, 12]))
def test_all_runs(w, shortest):
    assert pr.find_runs(w, shortest) == brute.runs(w, shortest)


def test_nested_and_neighbouring_runs():
    rng = random.Random(5)
    for _ in range(300):
        w: list[int] = []
        while len(w) < 150:
            part = [rng.randrange(3) for _ in range(rng.randrange(1, 8))]
            w += part * rng.randrange(1, 6)
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w += w[at : at + rng.randrange(40)]
        assert pr.find_runs(w) == brute.runs(w)


def test_factors_are_longest():
    rng = random.Random(6)
    for _ in range(100):
        w = [rng.randrange(3) for _ in range(60)]
        at = 0
        for b, e, distance in pr.factorise(w):
            earlier = lambda n: any(w[s : s + n] == w[b : b + n] for s in range(b))
            assert b == at and (w[b:e] == w[b - distance : e - distance] if distance else e == b + 1 and w[b] not in w[:b])
            assert e == len(w) or not distance or not earlier(e - b + 1)
            at = e
        assert at == len(w)


def _check(spark, at: str) -> None:
    out = {r.doc_id: r for r in q.queries()["op12_periodic_runs"](spark, at).collect()}
    rows = texts(spark, at)
    assert set(out) == set(rows)
    for i, t in rows.items():
        w = brute.with_planted_runs(t, i)
        found = brute.runs(w) if len(w) < 25_000 else [(0, len(w), 1)]  # the long odd text is one word again and again
        s, n, p = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want = (len(found), s, n, p, 1000 * n // p if found else None, brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), brute.sha(" ".join(brute.collapsed(w, found))))
        assert tuple(out[i])[1:] == want, i


def test_query_on_odd_rows(spark, odd):  # noqa: F811
    _check(spark, odd)


def test_query(spark):
    _check(spark, SMALL)


def test_rows_pass_through(spark):
    docs = spark.createDataFrame([(None, "x y " * 8, 1), (None, "x y " * 8, 1), (3, None, 2), (4, "", 3)], "doc_id long, text string, runs int")
    out = pr.periodic_runs(docs, keep_text=True).selectExpr("row.doc_id", "row.runs AS own", "n_runs", "size(runs) AS n", "collapsed").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(None, 1, 1, 1, "x y"), (None, 1, 1, 1, "x y"), (3, 2, 0, 0, ""), (4, 3, 0, 0, "")], key=str)


def test_null_id_plants_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert pr.with_planted_runs(docs).first().text == "a b c d"


def test_long_text(spark):
    """A text of 150,000 words: linear time."""
    words = [f"w{i % 97}" if i % 1000 else f"v{i}" for i in range(150_000)]
    out = pr.periodic_runs(spark.createDataFrame([(" ".join(words),)], "text string")).first()
    assert out.n_runs == 150 and (out.length, out.period) == (999, 97)
