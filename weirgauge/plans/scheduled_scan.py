"""Scheduled peak scans: all due jobs of all sensors in one plan.

Jobs that look at the same series through the same window with the same threshold share
one scan.  The series of all interfaces, directions, metrics and protocols are built from one
reduction of the flows.  Windows overlap at will: a window meets the points of its series
through ``(series, time bin)`` and exact bounds, and its percentiles are one aggregate over
that join.  Neighbours of a point are found once for the series; a window only has to forget
the neighbours that lie outside it.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.functions import scalars
from weirgauge.operators import peaks, rates
from weirgauge.operators.ordered import ordered_scan, time_chunk
from weirgauge.operators.series import SCAN_CHUNK_SECONDS
from weirgauge.session import staged

SERIES = ["sensor", "interface_id", "direction", "metric", "scope"]  # scope: a protocol number, -1 for all
BIN_SECONDS = 600
NO_PEAK_CLASS = "no_significant_peak"


def series_points(flows: DataFrame, current: DataFrame, window_seconds: int) -> DataFrame:
    """(series, bucket, value) of every interface in both directions, for all protocols and for each, both metrics."""
    partial = staged(
        flows.groupBy(
            scalars.bucket(F.col("flow_time"), window_seconds).alias("bucket"),
            "sensor", "exporter_ip", "input_if", "output_if", "proto", "sample_rate",
        ).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
    )
    sides = []
    for direction, interface, side in (("receives", "input_if", "input"), ("sends", "output_if", "output")):
        rated = rates.with_rate(partial, current, side)
        sides.append(
            rated.select(
                "sensor", F.col(interface).alias("interface_id"), F.lit(direction).alias("direction"), "proto", "bucket",
                (F.col("packets") * F.col("rate")).alias("packets"), (F.col("bytes") * F.col("rate") * 8).alias("bits"),
            )
        )
    seconds = float(max(1, window_seconds))
    scoped = sides[0].unionByName(sides[1]).withColumn("scope", F.explode(F.array(F.lit(-1), F.col("proto").cast("int"))))
    sums = scoped.groupBy("sensor", "interface_id", "direction", "scope", "bucket").agg(F.sum("packets").alias("p"), F.sum("bits").alias("b"))
    metrics = F.explode(
        F.array(
            F.struct(F.lit("packets_s").alias("metric"), (F.col("p") / seconds).alias("value")),
            F.struct(F.lit("bits_s").alias("metric"), (F.col("b") / seconds).alias("value")),
        )
    )
    return sums.withColumn("m", metrics).select("sensor", "interface_id", "direction", "m.metric", "scope", "bucket", "m.value")


def scan_key() -> Column:
    """One text for each distinct scan; the only free text, the sensor, comes last."""
    return F.concat_ws(
        "|", F.col("interface_id").cast("string"), "direction", "metric", F.col("scope").cast("string"),
        F.unix_micros("window_start").cast("string"), F.unix_micros("window_end").cast("string"),
        F.coalesce(F.col("threshold").cast("string"), F.lit("")), F.col("factor").cast("string"), "sensor",
    )


def with_scan(runs: DataFrame) -> DataFrame:
    """Runs of ``peaks.job_matrix`` with the scan that answers them.

    ``protocol`` (name or number), ``threshold`` and ``sensitivity`` (high unless given) may be missing columns.
    """
    given = set(runs.columns)
    column = lambda name, kind: F.col(name) if name in given else F.lit(None).cast(kind)
    named = F.nullif(F.trim(column("protocol", "string").cast("string")), F.lit(""))
    known = runs.withColumns(
        {
            "scope": F.when(named.isNull(), F.lit(-1)).otherwise(scalars.proto_num(named)),
            "threshold": column("threshold", "double").cast("double"),
            "factor": scalars.sensitivity_factor(F.coalesce(column("sensitivity", "string"), F.lit("high"))),
        }
    )
    return known.withColumn("scan", scan_key())


def _within(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Points with every window of their series that covers them."""
    bins = F.sequence(*[F.floor(F.unix_seconds(c) / BIN_SECONDS) for c in ("window_start", "window_end")])
    wanted = windows.select(*[F.col(c).alias(f"__{c}") for c in SERIES], *[c for c in windows.columns if c not in SERIES], F.explode(bins).alias("__bin"))
    dated = points.withColumn("__at", F.floor(F.unix_seconds("bucket") / BIN_SECONDS))
    same = F.col("__at") == F.col("__bin")
    for c in SERIES:
        same = same & (F.col(c) == F.col(f"__{c}"))
    inside = F.col("bucket").between(F.col("window_start"), F.col("window_end"))
    return dated.join(wanted, same & inside).drop("__at", "__bin", *[f"__{c}" for c in SERIES])


def scan_peaks(points: DataFrame, scans: DataFrame, max_peaks: int | None = None) -> DataFrame:
    """Local peaks of every scan above its own threshold, ranked; a window sees the buckets that begin in it."""
    shared = ["scan", *SERIES, "window_start", "window_end", "threshold", "factor"]
    based = peaks.baseline(_within(points, scans.select(*shared)).select("scan", "value"), ["scan"])
    limits = staged(
        scans.select(*shared).join(based, "scan").withColumn(
            "threshold_used",
            F.when(F.col("threshold") > 0, F.col("threshold")).otherwise(F.greatest("baseline_p99", F.col("baseline_p95") * F.col("factor"))),
        )
    )
    neighbour = F.struct("value", "bucket")
    around = ordered_scan(points, SERIES, time_chunk("bucket", SCAN_CHUNK_SECONDS), ["bucket"], {"__prev": ("prev", neighbour), "__next": ("next", neighbour)})
    number = F.col("value")
    not_below = lambda side: F.coalesce(
        ~F.col(f"{side}.bucket").between(F.col("window_start"), F.col("window_end")) | (number >= F.col(f"{side}.value")), F.lit(True)
    )
    found = _within(around, limits.drop("threshold", "factor")).filter((number >= F.col("threshold_used")) & not_below("__prev") & not_below("__next"))
    score = F.when(F.col("baseline_p95") > 0, number / F.col("baseline_p95")).otherwise(number)
    kept = found.select(
        "scan", *SERIES, F.col("bucket").alias("peak_time"), number.alias("peak_value"), F.bround(score, 3).alias("score"),
        "baseline_p95", "baseline_p99", "threshold_used",
    )
    return kept if max_peaks is None else peaks.top_peaks(kept, ["scan"], max_peaks).drop("peak_rank")


def judged(found: DataFrame, flows: DataFrame, current: DataFrame, window_seconds: int = 1) -> DataFrame:
    """Peaks with the class of their dominant group; evidence is gathered once for each interface, direction and time.

    Peaks begin buckets of ``window_seconds``.  Which groups lead around a peak is told by sums that
    no flow meets a peak for; the evidence of those that lead is gathered whole.
    """
    place = ["sensor", "interface_id", "direction", "peak_time"]
    # A peak names at most as many protocols as there are.
    wanted = staged(
        found.groupBy(*place).agg(F.coalesce(F.max(F.col("scope") == -1), F.lit(False)).alias("whole"), F.collect_set(F.col("scope").cast("int")).alias("protocols"))
    )
    window = [*place, "scope", "window_seconds"]
    grid = gcd(max(1, window_seconds), *peaks.EVIDENCE_WINDOWS)
    cells = staged(peaks.vector_cells(flows, grid))
    each, totals = [], []
    for d in ("receives", "sends"):
        own = wanted.filter(F.col("direction") == d)
        leads = staged(peaks.leading_vectors(own, cells, current, d, grid))
        evidence = peaks.peak_evidence(own, flows, current, d, leads=leads)
        each.append(peaks.vector_sums(evidence, ["__bin", *window]).drop("__bin"))
        totals.append(leads.select(*window, "all_packets", "all_bytes").distinct())
    groups = peaks.with_shares(staged(each[0].unionByName(each[1])), window, totals[0].unionByName(totals[1]))
    best = None
    for metric in ("packets_s", "bits_s"):
        own = peaks.best_window(peaks.dominant_groups(groups, window, metric), [*place, "scope"]).withColumn("metric", F.lit(metric))
        best = own if best is None else best.unionByName(own)
    return found.join(best, [*place, "scope", "metric"], "left").withColumns(
        {
            "evidence_status": F.coalesce("evidence_status", F.lit("insufficient")),
            "classification": F.coalesce("classification", F.lit("insufficient_flow_evidence")),
        }
    )


RUN_ORDER = ["job_id", "run_number"]


def first_of_batch(relevant: DataFrame, seconds: int = peaks.DUPLICATE_SECONDS) -> DataFrame:
    """(case keys, peak_time, job_id, run_number) of the run that a peak of this batch repeats, itself if it is stored.

    Runs store their case one after another; a later one within ``seconds`` of a stored one is
    not stored.  Only the first run of each peak time can be, so a case key brings as many
    entries as its series has peaks, however many jobs ask.
    """
    keys = peaks.SERIES_KEYS
    micros = F.unix_micros("peak_time")
    first = relevant.groupBy(*keys, "peak_time").agg(F.min(F.struct(*RUN_ORDER)).alias("run"))
    lists = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", micros.alias("at"), "peak_time"))).alias("all"))
    near = lambda one: lambda kept: F.abs(kept["at"] - one["at"]) <= seconds * 1_000_000
    none = F.slice("all", 1, 0)
    stored = F.aggregate("all", none, lambda kept, one: F.when(F.exists(kept, near(one)), kept).otherwise(F.concat(kept, F.array(one))))
    each = lists.withColumn("stored", stored).withColumn("one", F.explode("all"))
    by = F.filter("stored", near(F.col("one")))[0]["run"]
    return each.select(*keys, F.col("one.peak_time").alias("peak_time"), by.alias("by"))


def scheduled_runs(
    flows: DataFrame, current: DataFrame, runs: DataFrame, history: DataFrame, window_seconds: int = 5, max_peaks: int | None = None
) -> DataFrame:
    """Every run with the best peak of its window and its status.

    ``runs`` come from ``peaks.job_matrix``.  ``history`` holds stored cases (id, peak_time and
    ``peaks.SERIES_KEYS``).  A relevant peak within five minutes of a stored case, or of one that
    an earlier run of this batch stores, is ``skipped_duplicate``.
    """
    asked = staged(with_scan(runs))
    scans = staged(asked.select("scan", *SERIES, "window_start", "window_end", "threshold", "factor").distinct())
    first, last = scans.agg(F.min("window_start"), F.max("window_end")).first()
    if first is None:
        first = last = "1970-01-01"
    near = lambda before, after: flows.filter(
        (F.col("flow_time") >= F.lit(first).cast("timestamp") - F.expr(f"INTERVAL {before} SECONDS"))
        & (F.col("flow_time") < F.lit(last).cast("timestamp") + F.expr(f"INTERVAL {after} SECONDS"))
    )
    points = staged(series_points(near(0, window_seconds), current, window_seconds))
    found = staged(scan_peaks(points, scans, max_peaks))
    widest = max(peaks.EVIDENCE_WINDOWS) + window_seconds
    cases = staged(judged(found, near(widest, widest), current, window_seconds))
    counted = cases.groupBy("scan").agg(F.count(F.lit(1)).alias("peaks_detected"))
    kept = ["scan", "peak_time", "peak_value", "score", "baseline_p95", "baseline_p99", "threshold_used", "evidence_status", "classification", "evidence_window_used", "dst_ip", "dst_port", "protocol", "unique_src_count", "share_packets", "share_bits"]
    best = peaks.best_peak(cases.select(*kept), ["scan"]).withColumnRenamed("protocol", "dominant_protocol").join(counted, "scan")
    answered = staged(asked.join(best, "scan", "left").withColumn("peaks_detected", F.coalesce("peaks_detected", F.lit(0))))
    with_history = peaks.dedupe_peaks(answered.filter(peaks.relevant()).select(*peaks.SERIES_KEYS, "peak_time").distinct(), history)
    new = [*peaks.SERIES_KEYS, "peak_time"]
    fresh = answered.filter(peaks.relevant()).join(with_history.filter("duplicate_of_id IS NULL").select(*new), new, "left_semi")
    stored = first_of_batch(fresh.select(*new, *RUN_ORDER))
    marked = answered.join(with_history, new, "left").join(stored, new, "left")
    other = F.col("by").isNotNull() & (F.col("by") != F.struct(*RUN_ORDER)) & peaks.relevant()
    told = marked.withColumns(
        {
            "duplicate_of_id": F.when(peaks.relevant(), F.col("duplicate_of_id")),
            "duplicate_of_job": F.when(other, F.col("by.job_id")),
            "duplicate_of_run": F.when(other, F.col("by.run_number")),
        }
    )
    return peaks.run_outcome(told.drop("by"))


def stored_cases(runs: DataFrame) -> DataFrame:
    """The cases that ``scheduled_runs`` store: peaks, and the samples of windows without one."""
    negative = F.col("run_status") == "negative_sample"
    of = lambda value, instead: F.when(negative, instead).otherwise(value)
    return runs.filter(F.col("run_status").isin("success", "negative_sample")).select(
        *RUN_ORDER, "sensor", "interface_id", "direction", "metric",
        of(F.col("peak_time"), F.col("window_end")).alias("peak_time"),
        of(F.col("peak_value"), F.lit(0.0)).alias("peak_value"),
        of(F.col("score"), F.lit(0.0)).alias("score"),
        of(F.col("classification"), F.lit(NO_PEAK_CLASS)).alias("classification"),
        of(F.col("evidence_status"), F.lit("no_peak")).alias("evidence_status"),
        negative.alias("is_negative_sample"),
    )


def advanced_jobs(jobs: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Job rows after a batch: runs counted, time of the last run and of the last success."""
    done = runs.groupBy(F.col("job_id").alias("__job")).agg(F.count(F.lit(1)).alias("__n"))
    ran = F.col("__n").isNotNull()
    new = {
        "runs_count": F.coalesce("runs_count", F.lit(0)) + F.coalesce("__n", F.lit(0)),
        "last_run_at": F.when(ran, now).otherwise(F.col("last_run_at")),
    }
    if "last_success_at" in jobs.columns:
        new["last_success_at"] = F.when(ran, now).otherwise(F.col("last_success_at"))
    return jobs.join(done, F.col("job_id") == F.col("__job"), "left").withColumns(new).drop("__job", "__n")
