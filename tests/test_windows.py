"""Windowed counts over several batches: late rows within the watermark count, later ones don't."""

import datetime as dt
import os
from pathlib import Path

from palisade.streaming import windows

SCHEMA = "ts timestamp, user_id long, value double, event_type string"


def files(spark, root, batches):
    """One file a batch, in this order of age."""
    for i, days in enumerate(batches):
        at = [dt.datetime(2024, 1, 1) + dt.timedelta(days=x) for x in days]
        spark.createDataFrame([(t, 1, 2.5, "error") for t in at], SCHEMA).coalesce(1).write.mode("append").parquet(root)
        for f in set(Path(root).glob("*.parquet")) - {f for f in Path(root).glob("*.parquet") if f.stat().st_mtime < 2000}:
            os.utime(f, (1000 + i, 1000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(root)


def test_late_rows(spark, tmp_path):
    events = files(spark, str(tmp_path / "in"), [[10.2, 10.3], [9.5, 11.1], [10.9, 1.5], [10.95, 9.9]])
    out = windows.newest(windows.tumbling(events), str(tmp_path / "place"), "start", "user_id")
    assert {(r.start.day - 1, r.n, r.used) for r in out.collect()} == {(10, 4, 8), (9, 1, 2), (11, 1, 2)}


def test_one_batch_and_none(spark, tmp_path):
    events = files(spark, str(tmp_path / "in"), [[10.2, 1.5]])
    out = windows.newest(windows.sliding(events), str(tmp_path / "place"), "start")
    assert out.count() == 8 and all(r.errors == 1 for r in out.collect())
    os.makedirs(tmp_path / "empty")
    nothing = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "empty"))
    assert windows.newest(windows.sliding(nothing), str(tmp_path / "other"), "start").count() == 0
