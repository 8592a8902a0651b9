"""The lasting index: after any changes it equals one that is built anew."""

import random

from pyspark.sql import functions as F

from palisade.operators import retrieval, store

WORDS = "permit license fees claims buildings inspection officer renewals planning appeal garden market bridge station harbour".split()


def state(spark, path):
    rows = {r.key: (r.length, sorted((t.term, t.tf) for t in r.terms)) for r in store.live(spark, path).collect()}
    every = spark.createDataFrame([(0, " ".join(WORDS))], "query_id int, text string")
    df = {r.term: r.df for r in store.frequencies(spark, path, every).collect() if r.df}
    return rows, store.totals(spark, path), df


def fresh(units):
    """The same from the texts at hand, plainly."""
    rows, df = {}, {}
    for key, text in units.items():
        words = [w for w in (text or "").lower().split() if len(w) > 2 and w not in retrieval.STOP]
        tf = {}
        for w in words:
            tf[w] = tf.get(w, 0) + 1
        if tf:
            rows[key] = tf
    return rows, df


def hits(spark, path):
    q = spark.createDataFrame([(i, f"{a} {b} matter") for i, (a, b) in enumerate(zip(WORDS, WORDS[3:]))], "query_id int, text string")
    return sorted(tuple(r) for r in store.search(spark, path, q).collect()), sorted(tuple(r) for r in store.gate(spark, path, q).collect())


def test_random_changes_equal_a_new_build(spark, tmp_path):
    rng = random.Random(9)
    now: dict[int, str | None] = {}
    text = lambda: rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))]) if rng.random() < 0.2 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30)))
    path = str(tmp_path / "index")
    store.create(spark, path)
    for step in range(4):
        put = {rng.randrange(25): text() for _ in range(8)}
        drop = {rng.randrange(25) for _ in range(3)} - set(put)
        store.change(spark, path, spark.createDataFrame(list(put.items()), "key long, text string"), spark.createDataFrame([(k,) for k in drop], "key long"))
        now = {k: t for k, t in {**now, **put}.items() if k not in drop}
        if step == 2:
            store.compact(spark, path)
    anew = store.built(spark.createDataFrame(list(now.items()), "key long, text string"), str(tmp_path / "anew"))
    assert state(spark, path) == state(spark, anew) and hits(spark, path) == hits(spark, anew)
    assert set(state(spark, path)[0]) == set(fresh(now)[0])
    old = retrieval.index(spark.createDataFrame(list(now.items()), "doc_id long, text string"))
    q = spark.createDataFrame([(i, f"{a} {b} matter") for i, (a, b) in enumerate(zip(WORDS, WORDS[3:]))], "query_id int, text string")
    assert [(a, b, e) for a, b, _, _, e in hits(spark, path)[0]] == sorted((r.query_id, r.doc_id, r["rank"]) for r in retrieval.search(old, q).collect())


def test_deletes_only_and_repeats(spark, tmp_path):
    path = str(tmp_path / "index")
    units = spark.createDataFrame([("a", "permit fees"), ("a", "bridge"), ("b", "permit"), (None, "lost")], "key string, text string")
    store.built(units, path)
    assert set(state(spark, path)[0]) == {"a", "b"} and state(spark, path)[1] == (2, 3)
    store.change(spark, path, deletes=spark.createDataFrame([("b",), ("zz",)], "key string"))
    assert set(state(spark, path)[0]) == {"a"} and state(spark, path)[2].get("permit") == 1
    store.change(spark, path, units.limit(0))
    assert set(state(spark, path)[0]) == {"a"} and len(store.segments(spark, path)[1]) == 3
    store.compact(spark, path)
    assert set(state(spark, path)[0]) == {"a"} and len(store.segments(spark, path)[1]) == 1


def test_a_change_that_breaks_off_or_runs_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    units = lambda *x: spark.createDataFrame(list(x), "key string, text string")
    store.built(units(("a", "permit")), path)
    before = state(spark, path)
    with monkeypatch.context() as m:
        m.setattr(store, "_write_manifest", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        try:
            store.change(spark, path, units(("b", "bridge")), generation=7)
        except OSError:
            pass
    assert state(spark, path) == before
    for _ in range(2):
        assert store.change(spark, path, units(("b", "bridge")), generation=7) == 7
    assert set(state(spark, path)[0]) == {"a", "b"} and len(store.segments(spark, path)[1]) == 2


def test_builtins_are_installed_once(spark, tmp_path):
    path = str(tmp_path / "index")
    store.create(spark, path)
    seeds = [("s1", "permit"), ("s2", "bridge")]
    make = lambda rows: spark.createDataFrame(rows, "key string, text string")
    store.install(spark, path, make(seeds))
    store.change(spark, path, make([("s3", "own text market")]), make([("s1", "")]).select("key"))
    store.install(spark, path, make([*seeds, ("s3", "harbour"), ("s4", "station")]))
    rows = state(spark, path)[0]
    assert set(rows) == {"s2", "s3", "s4"} and ("market", 1) in rows["s3"][1]  # s1 stays deleted, s3 is in use


def test_one_scan_and_pruned_buckets(spark, tmp_path):
    path = store.built(spark.createDataFrame([(i, f"{WORDS[i % 15]} common") for i in range(50)], "key long, text string"), str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "permit")], "query_id int, text string")
    plan = store.matches(spark, path, q)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "BroadcastHashJoin" in plan and "(bucket#" in plan.split("PartitionFilters:")[1][:60]
    assert store.matches(spark, path, q).where(F.col("term") != "permit").count() == 0
