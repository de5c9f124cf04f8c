"""Peak analysis of all interfaces in one plan, from flows to advised cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgauge.operators import advise, peaks, series
from weirgauge.session import staged

SERIES = ["sensor", "interface_id", "direction"]


def find_peaks(
    flows: DataFrame,
    current: DataFrame,
    direction: str,
    metric: str = "packets_s",
    window_seconds: int = 5,
    max_peaks: int | None = None,
    sensitivity: str = "medium",
    explicit: float | None = None,
    baseline: float | tuple[float, float] | None = None,
) -> DataFrame:
    """Ranked peaks of every series with baseline, threshold and score; all unless ``max_peaks`` is given."""
    # The series is read by the baseline, the neighbour scan and the chunk totals: one scan of the flows.
    points = staged(series.interface_series(flows, current, direction, metric, window_seconds))
    based = peaks.with_baseline(points, SERIES, baseline)
    limit = peaks.threshold(
        F.col("baseline_p95"), F.col("baseline_p99"), None if explicit is None else F.lit(explicit), sensitivity
    )
    found = peaks.local_peaks(based.withColumn("threshold_used", limit), SERIES)
    return staged(peaks.top_peaks(found, SERIES, max_peaks))


def evidence_flows(flows: DataFrame, current: DataFrame, found: DataFrame, direction: str) -> DataFrame:
    """Every 5-tuple around each peak, once for each window; ``peaks.top_peak_flows`` lists the heaviest."""
    return staged(peaks.peak_evidence(found, flows, current, direction))


def judged_peaks(found: DataFrame, evidence: DataFrame, metric: str = "packets_s") -> DataFrame:
    """Each peak with its best evidence window, dominant group and class."""
    per_window = [*SERIES, "peak_time", "window_seconds"]
    groups = peaks.vector_groups(evidence, per_window, metric)
    best = peaks.best_window(peaks.dominant_groups(groups, per_window, metric), [*SERIES, "peak_time"])
    kept = found.select(*SERIES, "peak_time", "peak_value", "score", "baseline_p95", "baseline_p99", "threshold_used", "peak_rank")
    judged = kept.join(best, [*SERIES, "peak_time"], "left")
    return judged.withColumns(
        {
            "evidence_status": F.coalesce("evidence_status", F.lit("insufficient")),
            "classification": F.coalesce("classification", F.lit("insufficient_flow_evidence")),
            "evidence_window_used": F.coalesce("evidence_window_used", F.lit(min(peaks.EVIDENCE_WINDOWS))),
        }
    )


def advised_cases(judged: DataFrame, metric: str = "packets_s") -> DataFrame:
    """Best peak per series with its mitigation verdict, as case records."""
    best = staged(peaks.best_peak(judged, SERIES))
    kind = F.col("classification")
    template = (
        F.when(kind == "dns_udp_abuse_outbound", "dns_udp_abuse_outbound")
        .when(kind.contains("tcp"), "tcp_syn_flood")
        .when(kind.contains("icmp"), "icmp_flood")
        .otherwise("udp_flood_outbound_cpe")
    )
    identity = F.concat_ws("|", "sensor", F.col("interface_id").cast("string"), "direction")
    incident = best.filter("evidence_status = 'complete' AND dst_ip IS NOT NULL").select(
        identity.alias("incident_id"),
        template.alias("suspected_template"),
        "direction",
        "protocol",
        "dst_ip",
        "dst_port",
        F.concat(F.substring_index("dst_ip", ".", 3), F.lit(".0/24")).alias("dst_prefix"),
        F.lit(True).alias("src_is_customer"),
        F.lit(True).alias("src_is_internal"),
        F.lit(False).alias("dst_is_customer"),
        F.lit(True).alias("dst_is_external"),
        F.lit(True).alias("same_dst_24"),
        F.lit(True).alias("has_dominant"),
        "unique_src_count",
        F.col("total_packets").alias("packets"),
        F.col("total_bytes").alias("bytes"),
    )
    # The first candidate that acts decides; with alerts only, nothing may be mitigated.
    choice = advise.default_choice(advise.validate(advise.candidates(incident)))
    verdict = choice.select(
        F.col("incident_id").alias("__inc"), ((F.col("action") != "alert_only") & F.col("valid")).alias("mitigation_allowed")
    )
    judged_best = best.withColumn("__id", identity).join(verdict, F.col("__id") == F.col("__inc"), "left").drop("__id", "__inc")
    allowed = F.coalesce("mitigation_allowed", F.lit(False))
    advised = judged_best.withColumns(
        {"mitigation_allowed": allowed, **peaks.recommend(F.col("evidence_status"), allowed)}
    )
    return peaks.case_record(advised, metric)
