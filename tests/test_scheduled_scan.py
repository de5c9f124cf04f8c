"""Scheduled scans: the shared plan against one analysis for each job, and duplicates inside a batch."""

import datetime as dt
from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from weirgauge.operators import peaks, rates
from weirgauge.plans import scheduled_scan as scan
from weirgauge.sources import dims
from weirgauge.sources.lineitem_flows import flows

DATA = "/root/testdata/sf0.001"
START = dt.datetime(2026, 7, 10, 12, 0)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def scans_of(spark, windows):
    rows = [("edge-0", 1, d, m, at(a), at(b), t, s) for d, m, a, b, t, s in windows]
    schema = "sensor string, interface_id int, direction string, metric string, window_start timestamp, window_end timestamp, threshold double, sensitivity string"
    return scan.with_scan(spark.createDataFrame(rows, schema))


def test_overlapping_windows_give_what_each_gives_alone(spark):
    rows, current = flows(spark, DATA), rates.current_rates(dims.rate_config(spark, DATA))
    points = scan.series_points(rows, current, 5)
    windows = [
        ("sends", "bits_s", 0, 120, None, "high"), ("sends", "bits_s", 30, 61, None, "low"), ("sends", "bits_s", 59.99, 60.01, None, "medium"),
        ("receives", "packets_s", 10, 90, 500.0, None), ("receives", "packets_s", 59, 61, None, "medium"), ("receives", "packets_s", 200, 300, None, None),
    ]
    asked = scans_of(spark, windows)
    found = {r["scan"]: [] for r in asked.collect()}
    for r in scan.scan_peaks(points, asked).collect():
        found[r["scan"]].append((r["peak_time"], round(r["peak_value"], 6)))
    series = points.filter("sensor = 'edge-0' AND interface_id = 1 AND scope = -1").orderBy("bucket").collect()
    factors = {"high": 1.5, "medium": 2.0, "low": 3.0, None: 1.5}
    keys = [r["scan"] for r in asked.collect()]
    some = 0
    for key, (direction, metric, a, b, threshold, level) in zip(keys, windows, strict=True):
        own = [(r["bucket"], r["value"]) for r in series if (r["direction"], r["metric"]) == (direction, metric) and at(a) <= r["bucket"] <= at(b)]
        want = []
        if own:
            values = [v for _, v in own]
            p95, p99 = (np.percentile(values, q) if len(values) >= 3 else max(values) for q in (95, 99))
            limit = threshold or max(p99, p95 * factors[level])
            padded = [-1, *values, -1]
            want = [(t, round(v, 6)) for i, (t, v) in enumerate(own) if v >= limit and v >= padded[i] and v >= padded[i + 2]]
        assert sorted(found[key]) == want
        some += len(want)
    assert some


def test_every_peak_is_kept_unless_a_number_is_asked_for(spark):
    points = scan.series_points(flows(spark, DATA), rates.current_rates(dims.rate_config(spark, DATA)), 5)
    asked = scans_of(spark, [("receives", "packets_s", 0, 120, 1.0, None)])
    assert scan.scan_peaks(points, asked).count() > 5
    assert scan.scan_peaks(points, asked, 5).count() == 5


def greedy(rows, seconds=300):
    """The run that each peak repeats, one run after another."""
    out, order = {}, sorted(rows, key=lambda r: (r[0], r[2], r[3]))
    for key, group in groupby(order, key=lambda r: r[0]):
        stored = []
        for _, time, job, run in sorted(group, key=lambda r: (r[2], r[3])):
            near = [s for s in stored if abs((s[0] - time).total_seconds()) <= seconds]
            if not near:
                stored.append((time, job, run))
            out[(key, time, job, run)] = tuple((near or [(time, job, run)])[0][1:])
    return out


def test_duplicates_follow_the_order_of_runs(spark):
    rng = np.random.default_rng(3)
    rows = [("a", at(0), 1, 1), ("a", at(4), 2, 1), ("a", at(8), 3, 1), ("a", at(8), 4, 1), ("a", at(2), 5, 1), ("b", at(4), 1, 2)]
    rows += [("c", at(int(m) / 2), int(j), 1) for j, m in enumerate(rng.integers(0, 120, 300))]
    table = spark.createDataFrame(rows, "sensor string, peak_time timestamp, job_id int, run_number int").withColumns(
        {"interface_id": F.lit(1), "direction": F.lit("sends"), "metric": F.lit("bits_s"), "classification": F.lit("icmp_flood")}
    )
    by = {(r["sensor"], r["peak_time"]): tuple(r["by"]) for r in scan.first_of_batch(table).collect()}
    # Runs that share a peak time share the stored one; of those the first stores it.
    want = greedy(rows)
    for (sensor, time, job, run), stored in want.items():
        assert by[(sensor, time)] == stored, (sensor, time, job, run)


def test_all_statuses_and_job_rows(spark):
    rows, current = flows(spark, DATA), rates.current_rates(dims.rate_config(spark, DATA))
    columns = "job_id int, sensor string, interface_id int, direction string, metric string, interval_minutes int, last_run_at timestamp, runs_count int, lookback_minutes int, min_peak_score double, min_peak_value double, save_negative_samples boolean, negative_sample_interval_runs int"
    jobs = spark.createDataFrame(
        [
            (1, "edge-0", 1, "receives", "packets_s", 60, None, 0, 90, 1.0, None, False, 1),
            (2, "edge-0", 1, "receives", "packets_s", 60, None, 4, 60, 1.0, None, False, 1),  # the same peak again
            (3, "edge-0", 2, "receives", "packets_s", 60, None, 0, 90, 1e9, None, True, 1),
            (4, "edge-0", 2, "receives", "packets_s", 60, None, 0, 90, 1.0, 1e12, False, 1),
            (5, "edge-0", 2, "receives", "packets_s", 60, at(89), 0, 90, 1.0, None, False, 1),  # not due
        ],
        columns,
    )
    now = F.lit(at(90)).cast("timestamp")
    empty = spark.createDataFrame([], "id bigint, sensor string, interface_id int, direction string, metric string, classification string, peak_time timestamp")
    runs = peaks.job_matrix(jobs, rows.select("sensor", F.col("input_if").alias("interface_id")), now)
    got = {r["job_id"]: r for r in scan.scheduled_runs(rows, current, runs, empty).collect()}
    assert {j: r["run_status"] for j, r in got.items()} == {1: "success", 2: "skipped_duplicate", 3: "negative_sample", 4: "no_peak"}
    assert (got[2]["duplicate_of_job"], got[2]["duplicate_of_run"]) == (1, 1)
    first = got[1]
    told = spark.createDataFrame([(7, "edge-0", 1, "receives", "packets_s", first["classification"], first["peak_time"] + dt.timedelta(seconds=300))], empty.schema)
    outcome = scan.scheduled_runs(rows, current, runs, told)
    again = {r["job_id"]: r for r in outcome.collect()}
    assert (again[1]["run_status"], again[1]["duplicate_of_id"]) == ("skipped_duplicate", 7)
    after = {r["job_id"]: (r["runs_count"], r["last_run_at"]) for r in scan.advanced_jobs(jobs, outcome, now).collect()}
    assert after[2] == (5, at(90)) and after[5] == (0, at(89))
    none = scan.scheduled_runs(rows, current, runs.limit(0), empty)
    assert none.count() == 0


def test_pairs_of_flow_and_peak_are_not_shuffled(spark):
    schema = "flow_time timestamp, sensor string, exporter_ip string, input_if int, output_if int, sample_rate bigint, bytes bigint, packets bigint, flow_count bigint, src_ip string, src_port int, dst_ip string, dst_port int, proto int"
    rows = [(at(1) + dt.timedelta(seconds=s), "edge-0", "192.0.2.1", 1, 2, 10, 100, p, 1, "100.64.0.1", 2000, "203.0.113.1", 53, n) for s, p, n in [(0, 1, 17), (5, 2, 17), (16, 4, 6), (61, 8, 17), (240, 16, 17)]]
    peaks_at = [("edge-0", 1, "receives", at(1), True, [-1, 6]), ("edge-0", 1, "receives", at(1) + dt.timedelta(seconds=65), False, [17])]
    asked = spark.createDataFrame(peaks_at, "sensor string, interface_id int, direction string, peak_time timestamp, whole boolean, protocols array<int>")
    config = spark.createDataFrame([], "exporter_ip string, if_index int, direction int, sample_rate bigint")
    found = peaks.peak_evidence(asked, spark.createDataFrame(rows, schema), config, "receives")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "window_seconds" in line]
    got = {(r["peak_time"] > at(1), r["scope"], r["window_seconds"], r["proto"]): r["packets"] for r in found.collect()}
    first = {(False, -1, 5, 17): 30, (False, -1, 15, 17): 30, (False, -1, 30, 17): 30, (False, -1, 60, 17): 30}
    tcp = {(False, s, w, 6): 40 for s in (-1, 6) for w in (30, 60)}
    second = {(True, 17, 5, 17): 80, (True, 17, 15, 17): 80, (True, 17, 30, 17): 80, (True, 17, 60, 17): 100}
    assert got == {**first, **tcp, **second}
    plain = peaks.peak_evidence(asked.drop("whole", "protocols"), spark.createDataFrame(rows, schema), config, "receives")
    assert {(r["proto"], r["packets"]) for r in plain.filter("window_seconds = 60").collect()} == {(17, 30), (6, 40), (17, 100)} and "scope" not in plain.columns
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "window_seconds" in line]


def test_leading_groups_are_those_of_all_evidence(spark):
    rng = np.random.default_rng(5)
    start = dt.datetime(2026, 7, 10, 12, 3, 30)
    rows = []
    for _ in range(1500):
        s, p, n = int(rng.integers(0, 2_000)) / 4, int(rng.integers(0, 60)), int(rng.integers(0, 4))
        rows.append((start + dt.timedelta(seconds=s), "edge-0", f"192.0.2.{n % 2}", 1 + n % 2, 2, 1 + n, None if p == 7 else p * 70, None if p == 9 else p, 1,
                     f"100.64.0.{n}", 2000 + n, None if p == 3 else f"203.0.113.{p % 5}", (0, 53, 80)[p % 3], (17, 6, 47)[n % 3]))
    schema = "flow_time timestamp, sensor string, exporter_ip string, input_if int, output_if int, sample_rate bigint, bytes bigint, packets bigint, flow_count bigint, src_ip string, src_port int, dst_ip string, dst_port int, proto int"
    flows_seen = spark.createDataFrame([*rows, *rows[:40]], schema)
    config = spark.createDataFrame([("192.0.2.0", 1, 1, 50)], "exporter_ip string, if_index int, direction int, sample_rate bigint")
    wanted = [("edge-0", 1 + k % 2, "receives", start + dt.timedelta(seconds=5 * k), k % 3 > 0, [[-1], [-1, 6], [17]][k % 3] if k % 3 else [17, 47]) for k in range(0, 110, 3)]
    asked = spark.createDataFrame(wanted, "sensor string, interface_id int, direction string, peak_time timestamp, whole boolean, protocols array<int>")
    window = ["sensor", "interface_id", "direction", "peak_time", "scope", "window_seconds"]

    def dominant(evidence, totals=None):
        groups = peaks.with_shares(peaks.vector_sums(evidence, ["__bin", *window]).drop("__bin"), window, totals)
        out = {}
        for metric in ("packets_s", "bits_s"):
            for r in peaks.dominant_groups(groups, window, metric).collect():
                out[(metric, *[r[c] for c in window])] = r.asDict()
        return out

    leads = peaks.leading_vectors(asked, peaks.vector_cells(flows_seen, 5), config, "receives", 5)
    assert leads.count() == leads.distinct().count()
    totals = leads.select(*window, "all_packets", "all_bytes").distinct()
    got = dominant(peaks.peak_evidence(asked, flows_seen, config, "receives", leads=leads), totals)
    want = dominant(peaks.peak_evidence(asked, flows_seen, config, "receives"))
    assert len(want) > 200 and got == want
    # Only vectors that lead go on, not every flow near a peak.
    assert leads.select("dst_ip", "dst_port", "proto", *window).count() < len(want) * 2
