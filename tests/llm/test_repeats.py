"""Repeated rows, clashing ids and null ids: of each group one document keeps its text."""

import corpus_pipeline as pipeline
from palisade.llm import jaccard_join
from palisade.llm.common import Staged

A, B, C, D = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
ROWS = [
    (1, A), (1, A), (1, A), (None, A), (None, A + " tail"),  # repeats and null-id copies of a row with an id
    (None, B), (None, B), (None, B + " tail"),  # only null ids
    (5, C), (5, C + " tail"), (9, C),  # near copies under one id
    (7, D), (7, C), (2, None), (2, None), (None, None), (None, " "), (None, ""),  # other texts under one id; no words
]
COLUMNS = "doc_id long, text string, row string, print string"


def test_one_document_of_each_group_keeps_its_text(spark):
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in ROWS], COLUMNS).repartition(5)
    near = Staged(pipeline.drop_near_copies(spark, docs, ""), "near").df
    assert near.columns == docs.columns
    held = sorted(((r.doc_id, r.text) for r in near.collect()), key=repr)
    groups = {x: [(i, t) for i, t in held if (t or "").startswith(f"{x}0 ")] for x in "abcd"}
    assert groups["a"] == [(1, A)] and groups["d"] == [(7, D)]
    assert len(groups["b"]) == 1 and groups["b"][0][0] is None
    assert len(groups["c"]) == 1 and groups["c"][0][0] == 5
    assert sorted((r for r in held if not (r[1] or "").strip()), key=repr) == sorted([(2, None), (None, None), (None, " "), (None, "")], key=repr)
    left = {(r.doc_id, r.text) for r in pipeline.drop_repeated_passages(spark, near, "").collect()}
    assert left == set(held)


def test_null_ids_stay_without_the_flag(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    kept = jaccard_join.keep_one(docs).collect()
    assert sum(r.doc_id is None for r in kept) == sum(i is None for i, _ in ROWS)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 5, 7]


def test_ids_over_the_whole_range(spark):
    ids = (-(2**63), 2**63 - 1, None)
    docs = spark.createDataFrame([(i, A) for i in ids], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in jaccard_join.keep_one(docs, null_ids=True).collect()] == [(-(2**63), A)]
