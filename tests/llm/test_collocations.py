"""Collocations against plain counts."""

import numpy as np
import pyarrow as pa
import pytest

from palisade.llm import collocations as co
from palisade.llm import queries as q
from tests.llm import brute
from tests.llm.test_contracts import SMALL, odd  # noqa: F401

ROWS = [
    ("en", None), ("en", ""), ("en", " \t\n"), (None, "a b. a b, A\tb  a b"), ("und", "a b"), ("de", "a b c d e f! a b c d e"), ("de", "a b c d e; b c d e"),
    ("de", "x x x x x x x"), ("fr", "\x00 nul \x00 nul \x85 é É é  É"), ("fr", "été été été\x0bété\x0cété\rété"), ("fr", "\u3000 a\u3000b 😀 😀 😀 a\u3000b 😀"),
    ("es", "de la " * 50 + "de lo " * 30), ("es", "de la casa. " * 20), ("en", "the cat " * 300 + "sat"), ("en", "w" * 5_000 + " " + "w" * 5_000 + " z"), ("en", "the cat" + " " * 3_000 + "sat"),
]


def _rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, longest, top, shard", [(2, 5, 2_000, co.SHARD), (3, 3, 4, 60), (300, 5, 10, co.SHARD)])
def test_odd_texts(spark, least, longest, top, shard):
    docs = spark.createDataFrame(ROWS * 2, "lang string, text string").repartition(3)
    for c in ("n", "phrase", "id", "shard"):
        docs = docs.selectExpr("*", f"'x' AS {c}")
    want = brute.collocations(ROWS * 2, least, longest, top)
    assert _rows(co.collocations(docs, least, longest, top, shard)) == want and want


def test_small_table_in_many_shards(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute.collocations([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 6, 5, 300)
    assert _rows(co.collocations(docs.repartition(5), 6, 5, 300, shard=20_000)) == want and len(want) > 300


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert _rows(q.queries()["op11_phrase_collocations"](spark, SMALL)) == brute.collocations([(r.lang, r.text) for r in docs.select("lang", "text").collect()])


def test_full_bitmap_gives_the_same(spark, monkeypatch):
    """Where every cell reaches the threshold, all sequences are counted, with the same result."""
    monkeypatch.setattr(co, "_bitmap", lambda sketch, least: np.full(1 << co.BITS - 3, 255, np.uint8))
    docs = spark.createDataFrame(ROWS, "lang string, text string")
    assert _rows(co.collocations(docs, 3)) == brute.collocations(ROWS, 3)


def test_texts_are_read_as_often_for_many_automata_as_for_one(spark, monkeypatch):
    docs, staged = spark.createDataFrame(ROWS, "lang string, text string"), []
    made = co.Staged.__init__
    monkeypatch.setattr(co.Staged, "__init__", lambda self, df, name: (staged.append(name), made(self, df, name))[1])
    want = brute.collocations(ROWS, 2)
    assert _rows(co.collocations(docs, 2, shard=40)) == want and len(staged) == 3
    assert _rows(co.collocations(docs, 2)) == want and len(staged) == 6


def test_words_that_stand_alone_count(spark):
    """Also where their task has no pairs; a word isn't counted anew by what begins with it."""
    rows = [("en", "a b")] * 3 + [("en", "a")] * 4 + [("en", "a b c")] * 3 + [("de", "a b")] * 2
    assert _rows(co.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(12), 3)) == brute.collocations(rows, 3)


def test_large_numbers(spark):
    """Products beyond 64 bits stay exact."""
    counts = spark.createDataFrame([("en", "a b", 3 * 10**9 + 7), ("en", "a", 3 * 10**9 + 11), ("en", "b", 7 * 10**9 + 1)], "lang string, phrase string, f long")
    n = spark.createDataFrame([("en", 9 * 10**15 + 1)], "lang string, n long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(co, "counted", lambda *_: (counts, n))
        out = co.collocations(spark.createDataFrame([], "lang string, text string")).first()
    assert out.score == 1000 * (3 * 10**9 + 7) * (9 * 10**15 + 1) // ((3 * 10**9 + 11) * (7 * 10**9 + 1))


def test_sketch_bounds_from_above():
    texts = ["a b a b a b c", "b c a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(texts)], ["lang", "text"])
    chunk = next(co._chunks(iter([batch])))
    cells, inside = chunk.cells(2)
    out = list(co._sketch(3, 5)(iter([batch])))
    counts = np.concatenate([np.frombuffer(x, np.uint8) for b in out[:-1] for x in b.column(2).to_pylist()])
    assert sorted(counts.tolist(), reverse=True) == [3, 2, 2, 1] and inside.sum() == 9
    assert out[-1].column(4).to_pylist() == [11]
