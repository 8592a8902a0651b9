"""What the methods promise besides results: one comparison a pair, bounded automata, limits that bind, accuracy."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palisade.llm import jaccard_join, packing, queries, secret_scan, substring_dedup
from palisade.llm.common import Staged, held_out, scratch, shared_dir
from tests.llm import brute

MIDDLE = "/root/testdata/sf0.01"


def test_each_pair_once(spark):
    """A family of near copies around the limit: links of both rounds, no pair compared twice, hot n-grams dealt."""
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w if (j * 7 + i) % 23 else f"x{i}" for j, w in enumerate(base))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = jaccard_join._Join(docs, 2, 3, 4)
    join.links()
    pairs = [(r.a, r.b) for t in join.checked for r in t.collect()]
    assert len(pairs) == len(set(pairs)) > 0 and len(join.checked) == 2
    want = brute.jaccard_components(rows, 2, 3, 4)
    for group in (2_000, 3):
        jaccard_join.GROUP = group
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(docs, 2, 3, 4).collect()} == want
    jaccard_join.GROUP = 2_000


def test_common_passages_go_deeper(spark):
    """Passages that many texts share among different words, with shards too small for them: all levels of anchors."""
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([f"a{i}", f"b{i % 3}", *passage[i % 4 :], f"c{i % 2}", f"d{i % 5}", *(f"e{i % 2}{j}" for j in range(12))]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: (n, gone, sha) for i, (n, gone, sha) in enumerate(brute.without_repeats(texts, 35))}
    for shard in (20_000, 300):
        substring_dedup.SHARD = shard
        out = substring_dedup.remove_repeats(docs).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert {r.doc_id: tuple(r)[1:] for r in out} == want
    substring_dedup.SHARD = 20_000


def test_limits_bind():
    packer = packing.Packer(64, 4, 40, 0)
    for i, n in enumerate([3, 2, 100, 1, 5, 64, 7, 2, 2, 2, 40, 33, 1, 1]):
        packer.add(i, b"\1\0\0\0" * n, n // 8)
    pieces = list(packer.pack(True))
    at = {}
    for key, start, n, _, size, seq, offset in pieces:
        free = max(0, min(start + n, size // 8) - start)
        used, segments, loss = at.get(seq, (0, 0, 0))
        assert offset == used
        at[seq] = (used + n, segments + 1, loss + n - free)
    assert sum(n for n, _, _ in at.values()) == 263
    assert all(n <= 64 and s <= 4 and b <= 40 for n, s, b in at.values())
    assert max(s for _, s, _ in at.values()) == 4 and max(b for _, _, b in at.values()) == 40
    assert all(n == 64 or n & (n - 1) == 0 for n, _, _ in at.values())


def test_limits_bind_in_the_query(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    out = packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))
    cut = F.floor(F.col("doc_tokens") / packing.PROMPT)
    bearing = F.col("length") - F.greatest(F.lit(0), F.least(F.col("start") + F.col("length"), cut) - F.col("start"))
    by = out.groupBy("sequence_id").agg(F.count("*").alias("segments"), F.sum(bearing).alias("loss"), F.sum("length").alias("used"))
    r = by.agg(F.max("segments").alias("s"), F.max("loss").alias("l"), F.sum("used").alias("used"), F.sum(F.expr("if(bit_count(used) = 1, used, 4096)")).alias("places")).first()
    assert r.s <= packing.SEGMENTS and r.l == packing.LOSS and r.used > 0.99 * r.places


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"token = abcdefghijkl{i} login: user{i} 0123456789abcdef" for i in range(8_000))
    r = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    n, _, hexes, base = brute.base_secrets(text)
    assert (r.n_assign, r.n_hex, r.base_sha256) == (n, hexes, brute.sha(base)) and r.n_linked == 8_000


def test_clashing_names(spark):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, "Mail a@b.org now", 5, 7, 9), (2, None, 5, 7, 9)], "doc_id long, text string, score long, n_entities long, spans long")
    assert pipeline.replace_personal_data(spark, docs, "").columns == docs.columns
    out = secret_scan.scan(docs)
    assert len(set(out.columns)) == len(out.columns) and out.count() == 2


def test_scratch_goes(spark):
    import os

    with scratch():
        path = Staged(spark.range(3), "gone").path
        assert os.path.isdir(path)
    assert not os.path.exists(path) and shared_dir(spark)


def test_held_out_accuracy(spark):
    """Floors on rows that training may not read."""
    tox = queries.queries()["op3_toxicity"](spark, MIDDLE).where("held_out").join(spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    r = tox.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("right"), F.sum(F.col("toxic")).alias("toxic")).first()
    assert r.toxic > 0 and r.right >= 0.93
    lang = queries.queries()["op6_language_id"](spark, MIDDLE).where("held_out").join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert lang.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.95


def test_learned_rules_on_rows_left_out(spark):
    """Rules learned without a quarter of the labels reject low rows among them, and few others."""
    from palisade.llm import quality_rules as qr

    stats = qr.statistics(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    stats = Staged(stats, "stats").df
    rules = qr.learn(stats, labels.where(~held_out(F.col("doc_id"))))
    assert rules
    left = stats.join(labels.where(held_out(F.col("doc_id"))), "doc_id").withColumn("kept", qr.verdict(rules))
    r = left.agg(F.avg(F.expr("if(quality = 0, cast(not kept as int), null)")).alias("caught"), F.avg(F.expr("if(quality = 1, cast(not kept as int), null)")).alias("lost")).first()
    assert r.caught >= 0.8 and r.lost <= 0.05


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_quality_rules", "op3_toxicity", "op4_ogg_media", "op6_language_id", "op9_prefix_bpe"])
def test_repeated_rows_and_null_ids(spark, tmp_path, name):
    rows = [(1, "token = abcdefghijkl9 and more words here"), (1, "token = abcdefghijkl9 and more words here"), (None, "other text"), (None, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = [tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).collect()]
    ones = [r for r in out if r[0] == 1]
    assert len(out) == 5 and len(ones) == 2 and ones[0] == ones[1] and sum(r[0] is None for r in out) == 2
