"""The pipeline's stages against brute force, each on what the one before kept."""

import os

import corpus_pipeline as pipeline
from palisade.llm.common import Staged, read
from tests.llm import brute

SMALL = os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = read(spark, SMALL, "documents")
    columns = docs.columns
    held = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in read(spark, SMALL, "labels").where("toxic = 1").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        before = held
        docs = Staged(stage(spark, docs, SMALL), f"test-{name}").df
        held = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and docs.count() == len(held) and set(held) <= set(before)
        if name == "toxicity":
            gone = set(before) - set(held)
            assert len(gone & toxic) >= 0.7 * len(toxic & set(before)) and len(gone - toxic) <= 0.05 * len(before)
            assert all(held[i] == before[i] for i in held)
        elif name == "ngram_jaccard_join":
            groups = brute.jaccard_components(list(before.items()), 5, 4, 5)
            assert held == {i: t for i, t in before.items() if groups[i][1] == i}
        elif name == "substring_dedup":
            want = brute.without_repeats(list(before.values()), pipeline.PASSAGE)
            for (i, t), (_, n, kept) in zip(before.items(), want):
                assert (brute.sha(" ".join(brute.words(held[i]))) == kept) if n else held[i] == t
        else:
            assert set(held) == set(before)
    packed = pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    assert set(packed.doc_id) == set(held)
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.max()).all()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
