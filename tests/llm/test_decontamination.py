"""Benchmark passages in documents against looking up every window."""

from pyspark.sql import functions as F

from palisade.llm import decontamination as dc
from palisade.llm import queries as q
from tests.llm import brute
from tests.llm.test_contracts import ITEMS, SMALL, odd, texts  # noqa: F401


def _check(spark, at: str) -> int:
    out = {r.doc_id: tuple(r)[1:] for r in q.queries()["op13_benchmark_decontamination"](spark, at).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{at}/benchmark.parquet").select("item_id", "text").collect()]
    rows = texts(spark, at)
    assert set(out) == set(rows)
    for i, t in rows.items():
        assert out[i] == brute.contamination(t, items), (i, (t or "")[:80])
    return sum(r[1] > 0 for r in out.values())


def test_odd_rows(spark, odd):  # noqa: F811
    assert _check(spark, odd) >= 10


def test_small_table(spark):
    assert _check(spark, SMALL) > 0


def test_spans_copies_and_bounds(spark):
    docs = spark.createDataFrame([(1, "b c a b c x"), (1, "b c a b c x"), (None, "A-B-c"), (2, "c x")], "doc_id long, text string").withColumn("items", F.lit("x")).withColumn("n_hit", F.lit(7))
    items = spark.createDataFrame([(5, "a b c"), (6, "c x y"), (7, "c x")], "item_id long, text string").withColumn("window", F.lit(1))
    out = sorted((r.doc_id or 0, r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"]) for r in dc.contamination(docs, items).collect())
    assert out == [(0, 3, 3, [(0, 3)], ["5"]), (1, 6, 4, [(2, 5), (4, 6)], ["5", "7"]), (1, 6, 4, [(2, 5), (4, 6)], ["5", "7"]), (2, 2, 2, [(0, 2)], ["7"])]


def test_wide_windows_and_items_in_common(spark):
    """Windows wider than the contract's, and many items that share one passage."""
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"own{i} {passage} tail{i}") for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{passage} q{i}") for i in range(50)], "item_id long, text string")
    out = dc.contamination(docs, items, width=25).collect()
    assert all((r.n_hit, len(r["items"])) == (40, 50) for r in out) and len(out) == 30


def test_no_python_in_the_plan(spark):
    plan = q.queries()["op13_benchmark_decontamination"](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
