"""A chain's blocks against a plain fold; their order needs no comparison by a lambda."""

import hashlib

from pyspark.sql import functions as F

from palisade import queries_controls
from palisade.operators import records


def test_as_a_plain_fold(spark):
    rows = [((i * 7) % 50, "ab"[i % 2], f"body {i}", {"k": str(i)}) for i in range(50)]
    df = spark.createDataFrame(rows, "n long, g string, body string, extra map<string,string>")
    out = records.chain(df, "g", "n", F.col("body"), block=8)
    assert "CASE WHEN" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.n: r for r in out.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    at = {}
    for n, g, body, extra in sorted(rows, key=lambda r: r[0]):
        prev = at.get((g, n // 8), sha(f"{g}|{n // 8}"))
        at[g, n // 8] = sha(f"{prev}|{body}")
        assert (got[n].prev, got[n].hash, got[n].body, got[n].extra, got[n].block) == (prev, at[g, n // 8], body, extra, n // 8)
    assert len(got) == 50 and records.chain(df.limit(0), "g", "n", F.col("body")).count() == 0


def test_batches_have_files_for_many_tasks():
    assert queries_controls.AUDIT_FILES >= 12
