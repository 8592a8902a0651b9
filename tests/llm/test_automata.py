"""Broadcast suffix automata against counts of windows."""

import random
from collections import Counter

from palisade.llm import suffix_automata as sa
from tests.llm import brute
from tests.llm.test_contracts import ODD


def test_automaton_counts():
    rng = random.Random(5)
    for _ in range(300):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(0, 5))]
        known = sa.Automaton(texts)
        for width in (2, 3, 4):
            often = Counter(tuple(t[i : i + width]) for t in texts for i in range(len(t) - width + 1))
            for words in [[rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(20)], *texts]:
                at, times = known.windows(words, width)
                assert dict(zip(at, times)) == {i: n for i in range(len(words) - width + 1) if (n := often[tuple(words[i : i + width])])}


def test_corpus_against_itself(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    want = {i: n for (i, _), (_, n, _) in zip(ODD, brute.without_repeats([t for _, t in ODD], 35))}
    for shard_words in (1_000, 1_000_000):
        out = sa.remove_known(docs, docs, least=2, shard_words=shard_words).collect()
        assert {r.doc_id: r.n_removed for r in out} == want
        assert all(r.left == dict(ODD)[r.doc_id] for r in out if not r.n_removed)


def test_known_passages(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a  b {passage} c"), (2, "a  b"), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: (r.n_removed, r.left) for r in sa.remove_known(docs, spark.createDataFrame([(passage,), (None,)], "text string")).collect()}
    assert out == {1: (40, "a b c"), 2: (0, "a  b"), 3: (0, None), 4: (0, "")}
    none = sa.remove_known(docs, docs.where("false")).collect()
    assert {r.n_removed for r in none} == {0} and len(none) == 4
