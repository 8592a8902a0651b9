"""Approvals and budgets in keyed state: a replayed stream equals the batch form, in batches or at once."""

import datetime as dt
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palisade.streaming import state

T0 = dt.datetime(2024, 3, 1)
EVENTS = "scope string, kind string, token string, who string, at timestamp"
USAGE = "user string, at timestamp, tokens long"


def stream(spark, root, batches, schema):
    """A file stream with one file, and so one batch, for each list of rows."""
    for i, rows in enumerate(batches):
        before = set(Path(root).glob("*.parquet"))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
        for f in set(Path(root).glob("*.parquet")) - before:
            os.utime(f, (1000 + i, 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def told(df):
    return sorted((r.scope, r.token, r.outcome) for r in df.collect())


def test_one_use_owner_and_lifetime(spark, tmp_path):
    rows = [
        [("s", "park", "a", "ann", at(0)), ("s", "park", "b", "ann", at(1)), ("s", "claim", "a", "bob", at(2))],
        [("s", "claim", "a", "ann", at(5)), ("s", "claim", "a", "ann", at(6)), (None, "park", "x", "ann", at(6))],
        [("s", "claim", "b", "ann", at(40)), ("t", "park", "c", "cy", at(41)), ("s", "claim", "zz", None, at(41))],
    ]
    out = state.collected(state.approvals(stream(spark, str(tmp_path / "in"), rows, EVENTS)), str(tmp_path / "place"))
    want = [("s", "a", "claimed"), ("s", "a", "refused"), ("s", "a", "unknown"), ("s", "b", "expired"), ("s", "b", "unknown"), ("s", "zz", "unknown")]
    assert told(out) == want
    assert told(state.replayed(spark.createDataFrame([r for b in rows for r in b], EVENTS))) == want


def test_expiry_without_new_rows_of_the_scope(spark, tmp_path):
    rows = [[("quiet", "park", "a", "ann", at(0))], [("other", "park", "b", "bob", at(300))], [("other", "claim", "b", "bob", at(301))]]
    out = state.collected(state.approvals(stream(spark, str(tmp_path / "in"), rows, EVENTS)), str(tmp_path / "place"))
    assert told(out) == [("other", "b", "claimed"), ("quiet", "a", "expired")]
    assert out.where("token = 'a'").select(F.date_format("at", "HH:mm").alias("x")).first().x == "00:30"


@pytest.mark.parametrize("parts", [1, 4])
def test_random_replay(spark, tmp_path, parts):
    rng = random.Random(11)
    rows = sorted(((f"s{rng.randrange(3)}", rng.choice(["park", "park", "claim"]), f"t{rng.randrange(60)}", rng.choice(["ann", "bob"]), at(i * 0.7)) for i in range(400)), key=lambda r: r[4])
    cut = [rows[i * len(rows) // parts : (i + 1) * len(rows) // parts] for i in range(parts)]
    out = state.collected(state.approvals(stream(spark, str(tmp_path / "in"), cut, EVENTS), most=5), str(tmp_path / "place"))
    batch = state.replayed(spark.createDataFrame(rows, EVENTS), most=5)
    assert told(out) == told(batch) and {"claimed", "refused", "unknown", "expired", "evicted"} <= {o for _, _, o in told(out)}


def test_at_most_32_are_parked():
    parked, gone = [], []
    for i in range(40):
        parked, new = state.step(parked, "park", f"t{i}", "ann", i, state.TTL_S * 1000, state.MOST)
        gone += new
    assert [p[0] for p in parked] == [f"t{i}" for i in range(8, 40)] and [(t, o) for t, o, _ in gone] == [(f"t{i}", "evicted") for i in range(8)]


@pytest.mark.parametrize("parts", [1, 3])
def test_budgets(spark, tmp_path, parts):
    rng = random.Random(12)
    rows = sorted((f"u{rng.randrange(3)}", T0 + dt.timedelta(hours=i * 1.3), rng.randrange(0, 400)) for i in range(900))
    rows.sort(key=lambda r: r[1])
    limits = {"daily": 700, "monthly": 30_000, "total": 60_000}
    cut = [rows[i * len(rows) // parts : (i + 1) * len(rows) // parts] for i in range(parts)]
    out = state.collected(state.budgets(stream(spark, str(tmp_path / "in"), cut, USAGE), limits), str(tmp_path / "place"))
    sums, want = {}, []
    for user, when, n in rows:
        for window, form in (("daily", "%Y-%m-%d"), ("monthly", "%Y-%m"), ("total", "")):
            k = (user, window, when.strftime(form))
            sums[k] = sums.get(k, 0) + n
            if sums[k] - n < limits[window] <= sums[k]:
                want.append((*k, sums[k]))
    assert sorted((r.user, r.window, r.period, r.used) for r in out.collect()) == sorted(want) and {w for _, w, _, _ in want} == set(limits)


def test_no_rows(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    none = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    assert state.collected(state.approvals(none), str(tmp_path / "place")).count() == 0
