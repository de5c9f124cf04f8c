"""Events while they run: opened, updated, merged and ended by keyed state with timers.

The state of a key is its open events, each a few numbers; how many can be open at once
follows from lateness and quiet time, not from the traffic.  Every batch tells what changed,
as rows of a log with a version for each event, so a reader sees an event as soon as it
begins.  An event ends when the watermark has passed its quiet time, because no row can
prolong it any more.  Rows in any order within the lateness give the events that
``detect.sessions`` gives; when a late row joins two told events, the one opened later is
told as merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weirgauge.operators import detect

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = ["opened", "first", "last", "trigger_value", "trigger_threshold", "last_value", "last_threshold", "peak", "points", "version"]
EVENT_SCHEMA = (
    "opened long, first long, last long, trigger_value double, trigger_threshold double, last_value double, last_threshold double, "
    "peak double, points long, version long"
)
TOLD = (
    "event_id timestamp, version long, status string, first_seen timestamp, last_seen timestamp, trigger_value double, trigger_threshold double, "
    "last_value double, last_threshold double, peak_value double, points long"
)


def use_timers(spark: SparkSession) -> SparkSession:
    """The state store that timers need; set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def opened(at: int, value: float, threshold: float) -> dict:
    return {"opened": at, "first": at, "last": at, "trigger_value": value, "trigger_threshold": threshold, "last_value": value, "last_threshold": threshold, "peak": value, "points": 1, "version": 0}


def joined(a: dict, b: dict) -> dict:
    """Two events as one; it keeps the name of the one opened first."""
    early = a if (a["first"], a["trigger_value"]) <= (b["first"], b["trigger_value"]) else b
    late = a if (a["last"], a["last_value"]) >= (b["last"], b["last_value"]) else b
    named = min((a, b), key=lambda e: (e["version"] == 0, e["opened"]))  # a told event keeps its name
    return {
        "opened": named["opened"], "first": early["first"], "last": late["last"],
        "trigger_value": early["trigger_value"], "trigger_threshold": early["trigger_threshold"],
        "last_value": late["last_value"], "last_threshold": late["last_threshold"],
        "peak": max(a["peak"], b["peak"]), "points": a["points"] + b["points"], "version": named["version"],
    }


def taken_in(events: list[dict], new: dict, quiet: int) -> tuple[list[dict], list[dict]]:
    """(events with ``new`` in them, told events that went into another one); times in microseconds."""
    near = [e for e in events if e["first"] - quiet <= new["last"] and new["first"] <= e["last"] + quiet]
    whole = new
    for e in near:
        whole = joined(whole, e)
    gone = [e for e in near if e["version"] and e["opened"] != whole["opened"]]
    return [*[e for e in events if e not in near], whole], gone


class Lifecycle(StatefulProcessor):
    """Open events of a key."""

    def __init__(self, keys: list[str], quiet: int):
        self.keys, self.quiet = keys, int(quiet) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("open", EVENT_SCHEMA)

    def _open(self) -> list[dict]:
        return [dict(zip(EVENT, row, strict=True)) for row in self.events.get()] if self.events.exists() else []

    def _keep(self, events: list[dict]) -> None:
        if events:
            self.events.put([tuple(e[c] for c in EVENT) for e in events])
        else:
            self.events.clear()

    def _told(self, key: tuple, rows: list[tuple[str, dict]]) -> pd.DataFrame:
        at = lambda name: pd.to_datetime([e[name] for _, e in rows], unit="us")
        table = {k: [key[i]] * len(rows) for i, k in enumerate(self.keys)}
        table |= {"event_id": at("opened"), "version": [e["version"] for _, e in rows], "status": [s for s, _ in rows]}
        table |= {"first_seen": at("first"), "last_seen": at("last")}
        table |= {c: [e[c] for _, e in rows] for c in EVENT[3:7]}
        table |= {"peak_value": [e["peak"] for _, e in rows], "points": [e["points"] for _, e in rows]}
        return pd.DataFrame(table)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events, told = self._open(), []
        before = {e["opened"]: e for e in events}
        for part in rows:
            micros = part["seen_at"].astype("datetime64[us]").astype("int64")
            for at, value, threshold in zip(micros, part["value"], part["threshold"], strict=True):
                events, gone = taken_in(events, opened(int(at), float(value), float(threshold)), self.quiet)
                told += [("merged", {**e, "version": e["version"] + 1}) for e in gone]
        for e in events:
            if before.get(e["opened"]) != e:
                e["version"] += 1
                told.append(("active" if e["version"] == 1 else "updated", e))
                self.handle.registerTimer((e["last"] + self.quiet) // 1000 + 1)
        self._keep(events)
        if told:
            yield self._told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = expiredTimerInfo.getExpiryTimeInMs()
        events = self._open()
        over = [e for e in events if (e["last"] + self.quiet) // 1000 + 1 <= passed]
        if over:
            self._keep([e for e in events if e not in over])
            yield self._told(key, [("ended", {**e, "version": e["version"] + 1}) for e in over])

    def close(self) -> None:
        pass


def event_log(hits: DataFrame, keys: list[str], quiet: int = detect.CLOSE_AFTER) -> DataFrame:
    """What happens to events, as it happens: ``hits`` are a stream with a watermark on ``seen_at``, ``value`` and ``threshold``.

    ``status`` is active (new), updated, merged (into another event) or ended.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.select(*keys).schema)
    points = hits.select(*keys, "seen_at", F.col("value").cast("double").alias("value"), F.col("threshold").cast("double").alias("threshold"))
    return points.groupBy(*keys).transformWithStateInPandas(Lifecycle(keys, quiet), f"{kinds}, {TOLD}", "Append", "EventTime")


def current_events(log: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of every event of a stored log; events that went into others are left out."""
    rest = [c for c in log.columns if c not in (*keys, "event_id")]
    newest = log.groupBy(*keys, "event_id").agg(F.max_by(F.struct(*rest), "version").alias("e"))
    return newest.select(*keys, "event_id", "e.*").filter("status != 'merged'")
