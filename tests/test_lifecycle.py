"""Events on a stream: told when they begin, while they go on and when they end."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirgauge.operators import detect
from weirgauge.streaming import lifecycle

T0 = datetime(2026, 7, 10, 12, 0)
SCHEMA = "who string, seen_at timestamp, value double, threshold double"


def run(spark, folder, batches):
    """Land one file for each batch and work it off; the log after each."""
    lifecycle.use_timers(spark)
    seen, logs = set(), []
    for n, rows in enumerate(batches):
        spark.createDataFrame([(w, T0 + timedelta(seconds=s), v, 10.0) for w, s, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
        hits = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in").withWatermark("seen_at", "60 seconds")
        query = (
            lifecycle.event_log(hits, ["who"]).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/log")
        )
        query.awaitTermination()
        log = spark.read.parquet(f"{folder}/log").collect()
        new = [r for r in log if (r["who"], r["event_id"], r["version"]) not in seen]
        seen |= {(r["who"], r["event_id"], r["version"]) for r in log}
        logs.append(sorted((r["who"], (r["event_id"] - T0).seconds, r["version"], r["status"], r["points"], r["peak_value"]) for r in new))
    return logs


def test_an_event_is_active_then_updated_then_ended(spark, tmp_path):
    logs = run(spark, str(tmp_path), [[("a", 0, 20.0)], [("a", 60, 50.0), ("b", 60, 11.0)], [("b", 400, 12.0)], [("c", 900, 1.0)]])
    assert logs[0] == [("a", 0, 1, "active", 1, 20.0)]
    assert logs[1] == [("a", 0, 2, "updated", 2, 50.0), ("b", 60, 1, "active", 1, 11.0)]
    assert ("a", 0, 3, "ended", 2, 50.0) in logs[2] and ("b", 400, 1, "active", 1, 12.0) in logs[2] and ("b", 60, 2, "ended", 1, 11.0) in logs[2]
    assert ("b", 400, 2, "ended", 1, 12.0) in logs[3]
    now = {(r["who"], r["status"]) for r in lifecycle.current_events(spark.read.parquet(f"{tmp_path}/log"), ["who"]).collect()}
    assert now == {("a", "ended"), ("b", "ended"), ("c", "active")}


@pytest.mark.parametrize("seed", range(6))
def test_any_order_gives_the_events_of_the_batch_form(spark, seed):
    draw = random.Random(seed)
    points = [(draw.randrange(0, 4000), float(draw.randrange(100))) for _ in range(60)]
    quiet, events, told = 120_000_000, [], {}
    for at, value in points:  # the state machine alone, one row after another
        before = {e["opened"] for e in events}
        events, gone = lifecycle.taken_in(events, lifecycle.opened(at * 1_000_000, value, 10.0), quiet)
        for e in gone:
            told[e["opened"]] = "merged"
        for e in events:
            e["version"] += 1
            told[e["opened"]] = "open"
        assert len({e["opened"] for e in events}) == len(events) and before is not None
    table = spark.createDataFrame([("a", T0 + timedelta(seconds=s), v, 10.0) for s, v in points], "who string, bucket timestamp, value double, threshold double")
    want = {((r["first_seen"] - T0).total_seconds(), (r["last_seen"] - T0).total_seconds(), r["points"], r["peak_value"], r["trigger_value"], r["last_value"]) for r in detect.sessions(table, ["who"]).collect()}
    assert {(e["first"] / 1e6, e["last"] / 1e6, e["points"], e["peak"], e["trigger_value"], e["last_value"]) for e in events} == want
    assert {k for k, s in told.items() if s == "open"} >= {e["opened"] for e in events}


def test_current_events_leave_merged_ones_out(spark):
    rows = [("a", T0, 1, "active"), ("a", T0, 2, "updated"), ("a", T0 + timedelta(seconds=200), 1, "active"), ("a", T0 + timedelta(seconds=200), 2, "merged")]
    log = spark.createDataFrame(rows, "who string, event_id timestamp, version long, status string").withColumn("points", F.lit(1))
    assert [(r["event_id"], r["status"]) for r in lifecycle.current_events(log, ["who"]).collect()] == [(T0, "updated")]
