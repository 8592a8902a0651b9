"""Counts of n-grams don't depend on how rows are spread over tasks."""

from collections import Counter


from palisade.llm import toxicity


def test_counts_over_many_tasks(spark):
    rows = [(f"plain text {i}" if i % 2 else f"vile{chr(97 + i)} zqxjkv", 1 - i % 2) for i in range(20)]
    want = Counter()
    for text, label in rows:
        want.update((int(f), label) for f in toxicity.present(text))
        want[-1, label] += 1
    for parts in (1, 20):
        spread = spark.sparkContext.parallelize(rows, parts).toDF("text string, toxic int")
        got = {r.feature: (r.neg, r.pos) for r in toxicity.totals(spread).collect()}
        assert got == {f: (want[f, 0], want[f, 1]) for f, _ in want}


def test_scores_whatever_the_partitions(spark):
    rows = [(i, f"you vile{chr(97 + i % 7)} zqxjkv" if i % 3 == 0 else f"a plain sentence number {i % 11}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    scores = []
    for n in (1, 7, 60):
        model = toxicity.train(docs.repartition(n), labels)
        scores.append([round(model.score(t), 9) for _, t in rows])
    assert scores[0] == scores[1] == scores[2]
    assert all((s > 0.5) == (i % 3 == 0) for s, (i, _) in zip(scores[0], rows))


def test_blocks_of_long_texts(monkeypatch):
    text = "".join(chr(97 + i * i % 26) for i in range(1_000))
    want = toxicity.present(text)
    monkeypatch.setattr(toxicity, "PLACES", 37)
    assert (toxicity.present(text) == want).all() and sum(map(len, toxicity.ngrams(text))) == sum(1_001 - k for k in toxicity.SIZES)
