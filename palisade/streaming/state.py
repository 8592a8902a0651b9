"""State that lives on between batches: approvals with a lifetime and one use, and budgets as they are used.

Each works on a stream with an event-time watermark and holds little for a key: at most `most` parked tokens for a scope,
one sum for each open period of a user. What a key's rows do is a plain function of its state, `step` and `spend`, which
replays them in the order of their times; over a table it gives what a replay of the stream gives. Rows later than the
watermark are dropped by Spark. Rows with a null key, time or token are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Lifetime of a parked call in seconds, and how many may be parked.
TTL_S, MOST = 1_800, 32
APPROVALS = "scope string, token string, outcome string, at timestamp"
BREACHES = "user string, window string, period string, used long, at timestamp"


def step(parked: list[list], kind: str, token: str, who: str, at: int, ttl: int, most: int) -> tuple[list[list], list[tuple[str, str, int]]]:
    """What one row does to the parked [token, owner, at] of a scope, oldest first: the new list, and what to tell (token, outcome, at).

    First what is older than the lifetime goes. A call is parked once; beyond `most` the oldest goes. A claim by the owner takes the call,
    one by anybody else is refused and takes nothing, one of a token that isn't there is unknown."""
    told = [(t, "expired", a + ttl) for t, _, a in parked if at - a > ttl]
    parked = [p for p in parked if at - p[2] <= ttl]
    own = next((p for p in parked if p[0] == token), None)
    if kind == "park":
        if own is None:
            told += [(t, "evicted", at) for t, _, _ in parked[: max(0, len(parked) + 1 - most)]]
            parked = [*parked[max(0, len(parked) + 1 - most) :], [token, who, at]]
    elif own is None:
        told.append((token, "unknown", at))
    elif own[1] != who:
        told.append((token, "refused", at))
    else:
        told.append((token, "claimed", at))
        parked = [p for p in parked if p is not own]
    return parked, told


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    every = pd.concat(list(batches))
    return every.sort_values(order, kind="stable")


def approvals(events: DataFrame, ttl: int = TTL_S, most: int = MOST, late: str = "10 minutes") -> DataFrame:
    """What becomes of parked calls, from a stream of `events` (scope, kind, token, who, at): kind is 'park' with its owner in
    `who`, or 'claim' with the claimant. One row (APPROVALS) for each claim, and for each call that expires or is evicted.
    A call nobody claims expires by the watermark, with or without new rows. Rows of one time go in the order park, claim, token, who."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parked, told = json.loads(state.get[0]) if state.exists else [], []
        if not state.hasTimedOut:
            for r in _rows(batches, ["ms", "rank", "token", "who"]).itertuples():
                parked, new = step(parked, r.kind, r.token, r.who, int(r.ms), ttl * 1000, most)
                told += new
        now = state.getCurrentWatermarkMs()
        told += [(t, "expired", a + ttl * 1000) for t, _, a in parked if a + ttl * 1000 < now]
        parked = [p for p in parked if p[2] + ttl * 1000 >= now]
        if parked:
            state.update((json.dumps(parked),))
            state.setTimeoutTimestamp(max(parked[0][2] + ttl * 1000, now + 1))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame({"scope": key[0], "token": [t for t, _, _ in told], "outcome": [o for _, o, _ in told], "at": pd.to_datetime([a for _, _, a in told], unit="ms", utc=True)})

    return _timed(events, late).groupBy("scope").applyInPandasWithState(run, APPROVALS, "parked string", "append", GroupStateTimeout.EventTimeTimeout)


def _timed(events: DataFrame, late: str) -> DataFrame:
    rows = events.where("scope is not null and at is not null and token is not null").withWatermark("at", late)
    rank = F.when(F.col("kind") == "park", 0).otherwise(1)
    return rows.select(F.col("scope").cast("string").alias("scope"), "kind", F.col("token").cast("string").alias("token"), F.coalesce(F.col("who").cast("string"), F.lit("")).alias("who"), "at", F.unix_millis("at").alias("ms"), rank.alias("rank"))


def replayed(events: DataFrame, ttl: int = TTL_S, most: int = MOST, late_s: int = 600) -> DataFrame:
    """The same over a table: what the stream tells once its watermark has come to the newest time less `late_s` seconds."""
    rows = events.where("scope is not null and at is not null and token is not null")
    rank = F.when(F.col("kind") == "park", 0).otherwise(1)
    rows = rows.select(F.col("scope").cast("string").alias("scope"), "kind", F.col("token").cast("string").alias("token"), F.coalesce(F.col("who").cast("string"), F.lit("")).alias("who"), F.unix_millis("at").alias("ms"), rank.alias("rank"))
    newest = rows.agg(F.max("ms")).first()[0]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parked, told = [], []
        for r in frame.sort_values(["ms", "rank", "token", "who"], kind="stable").itertuples():
            parked, new = step(parked, r.kind, r.token, r.who, int(r.ms), ttl * 1000, most)
            told += new
        told += [(t, "expired", a + ttl * 1000) for t, _, a in parked if a + ttl * 1000 < newest - late_s * 1000]
        return pd.DataFrame({"scope": pd.Series([key[0]] * len(told), dtype=object), "token": pd.Series([t for t, _, _ in told], dtype=object), "outcome": pd.Series([o for _, o, _ in told], dtype=object), "at": pd.to_datetime([a for _, _, a in told], unit="ms", utc=True)})

    return rows.groupBy("scope").applyInPandas(run, APPROVALS)


PERIODS = {"daily": "%Y-%m-%d", "monthly": "%Y-%m", "total": ""}


def spend(sums: dict[str, int], at: pd.Timestamp, tokens: int, limits: dict[str, int]) -> list[tuple[str, str, int]]:
    """Adds one use to the sums by window and period: the ceilings that it reaches (window, period, sum), the day's first."""
    told = []
    for window, form in PERIODS.items():
        if limits.get(window, 0) > 0:
            name = f"{window} {at.strftime(form)}"
            before, sums[name] = sums.get(name, 0), sums.get(name, 0) + tokens
            if before < limits[window] <= sums[name]:
                told.append((window, at.strftime(form), sums[name]))
    return told


def _ended(name: str, now: pd.Timestamp) -> bool:
    window, _, period = name.partition(" ")
    return window != "total" and period < now.strftime(PERIODS[window])


def budgets(usage: DataFrame, limits: dict[str, int], late: str = "1 day") -> DataFrame:
    """The use that brings a user's sum to the ceiling of a window, once a window and period, from a stream of
    `usage` (user, at, tokens); `limits` by window: daily, monthly and total, 0 or left out for none. Days and months are those of UTC, and
    sums of periods that the watermark has passed leave the state, also of users without new rows. One that has no ceiling left to
    watch but the total's stays, with one sum."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums, told = json.loads(state.get[0]) if state.exists else {}, []
        if not state.hasTimedOut:
            for r in _rows(batches, ["ms", "tokens"]).itertuples():
                at = pd.Timestamp(int(r.ms), unit="ms")
                told += [(*x, int(r.ms)) for x in spend(sums, at, int(r.tokens), limits)]
        wm = state.getCurrentWatermarkMs()
        now = pd.Timestamp(wm, unit="ms")
        sums = {k: v for k, v in sums.items() if wm <= 0 or not _ended(k, now)}
        if sums:
            state.update((json.dumps(sums),))
            if set(sums) != {"total "}:
                state.setTimeoutTimestamp(max(wm, 0) + 86_400_000 + 1)
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame({"user": key[0], "window": [w for w, _, _, _ in told], "period": [p for _, p, _, _ in told], "used": [u for _, _, u, _ in told], "at": pd.to_datetime([a for _, _, _, a in told], unit="ms", utc=True)})

    rows = usage.where("user is not null and at is not null").withWatermark("at", late)
    rows = rows.select(F.col("user").cast("string").alias("user"), "at", F.unix_millis("at").alias("ms"), F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"))
    return rows.groupBy("user").applyInPandasWithState(run, BREACHES, "sums string", "append", GroupStateTimeout.EventTimeTimeout)


def collected(out: DataFrame, place: str) -> DataFrame:
    """Runs such a stream over all that its source holds; `place` is a shared folder, and a batch that runs again overwrites its part."""

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={n}")

    spark = out.sparkSession
    spark.createDataFrame([], out.schema).write.mode("overwrite").parquet(f"{place}/out/batch=-1")
    out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")
