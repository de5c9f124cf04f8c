"""Peak analysis, flow grouping and mitigation advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirgauge.catalog.registry import query
from weirgauge.functions import scalars
from weirgauge.operators import advise, grouping, peaks, rates, series
from weirgauge.plans import peak_analysis as plan
from weirgauge.plans import playbook as pb
from weirgauge.plans import scheduled_scan as scan
from weirgauge.sources import dims
from weirgauge.sources.lineitem_flows import flows, table
from weirgauge.sources.tables import case_lines

# --- peaks -------------------------------------------------------------------


def peak_sql(direction: str, metric: str) -> str:
    side, rate = ("output_if", "out_rate") if direction == "sends" else ("input_if", "in_rate")
    value = f"sum(bytes * {rate})::BIGINT * 8 / 5.0" if metric == "bits_s" else f"sum(packets * {rate})::BIGINT / 5.0"
    share = "share_bits" if metric == "bits_s" else "share_packets"
    top = "max_bits_s" if metric == "bits_s" else "max_packets_s"
    return f"""{dims.RATE_CTE},
s AS (SELECT sensor, {side} AS interface_id, time_bucket(INTERVAL '5 seconds', flow_time, TIMESTAMP '2026-07-10') AS bucket, {value} AS value FROM rated GROUP BY ALL),
b AS (SELECT sensor, interface_id, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM s GROUP BY ALL),
n AS (SELECT s.*, p95, p99, greatest(p99, p95 * 2.0) AS threshold_used, lag(value, 1, -1) OVER w AS pv, lead(value, 1, -1) OVER w AS nv FROM s JOIN b USING (sensor, interface_id) WINDOW w AS (PARTITION BY sensor, interface_id ORDER BY bucket)),
pk AS (SELECT sensor, interface_id, bucket AS peak_time, value AS peak_value, p95, p99, threshold_used, round_even(value / p95, 3) AS score FROM n WHERE value >= threshold_used AND value >= pv AND value >= nv),
rk AS (SELECT *, row_number() OVER (PARTITION BY sensor, interface_id ORDER BY score DESC, peak_value DESC, peak_time) AS peak_rank FROM pk),
t5 AS (SELECT * FROM rk WHERE peak_rank <= 5),
ev AS (SELECT r.sensor, t5.interface_id, peak_time, w.w AS window_seconds, src_ip, src_port, dst_ip, dst_port, proto, sum(bytes)::BIGINT AS raw_bytes, sum(packets)::BIGINT AS raw_packets,
 sum(bytes * {rate})::BIGINT AS bytes, sum(packets * {rate})::BIGINT AS packets, sum(flow_count)::BIGINT AS flow_count, max({rate}) AS effective_sample_rate, min(flow_time) AS first_seen, max(flow_time) AS last_seen
 FROM rated r JOIN t5 ON r.sensor = t5.sensor AND r.{side} = t5.interface_id AND abs(date_diff('second', peak_time, flow_time)) <= 60
 JOIN (VALUES (5), (15), (30), (60)) w(w) ON abs(date_diff('second', peak_time, flow_time)) <= w.w GROUP BY ALL),
er AS (SELECT *, packets / (window_seconds * 2) AS packets_s, bytes * 8 / (window_seconds * 2) AS bits_s FROM ev),
e2 AS (SELECT *, CASE proto WHEN 17 THEN 'udp' WHEN 6 THEN 'tcp' ELSE 'icmp' END AS protocol FROM er),
g AS (SELECT sensor, interface_id, peak_time, window_seconds, dst_ip, dst_port, protocol, sum(packets)::BIGINT AS total_packets, sum(bytes)::BIGINT AS total_bytes, max(packets_s) AS max_packets_s, max(bits_s) AS max_bits_s, count(DISTINCT src_ip) AS unique_src_count FROM e2 GROUP BY ALL),
gt AS (SELECT *, total_packets::DOUBLE / (sum(total_packets) OVER k)::DOUBLE * 100 AS share_packets, total_bytes::DOUBLE / (sum(total_bytes) OVER k)::DOUBLE * 100 AS share_bits FROM g WINDOW k AS (PARTITION BY sensor, interface_id, peak_time, window_seconds)),
gd AS (SELECT *, row_number() OVER (PARTITION BY sensor, interface_id, peak_time, window_seconds ORDER BY {share} DESC, {top} DESC, dst_ip, dst_port, protocol) AS rn FROM gt),
dm AS (SELECT *, {share} >= 20 AND (total_packets >= 1000 OR total_bytes >= 1000000) AS complete FROM gd WHERE rn = 1),
bw AS (SELECT *, row_number() OVER (PARTITION BY sensor, interface_id, peak_time ORDER BY NOT complete, CASE WHEN complete THEN window_seconds ELSE 0 END, -{share}, window_seconds) AS pick FROM dm),
jd AS (SELECT t5.*, window_seconds AS evidence_window_used, dst_ip, dst_port, protocol, total_packets, total_bytes, unique_src_count, share_packets, share_bits, complete,
 CASE WHEN NOT complete THEN 'insufficient_flow_evidence' {"WHEN protocol = 'udp' AND dst_port = 53 THEN 'dns_udp_abuse_outbound' WHEN protocol = 'udp' AND unique_src_count >= 2 THEN 'udp_flood_outbound_to_single_destination_port'" if direction == "sends" else ""}
 WHEN protocol = 'tcp' THEN 'tcp_syn_flood_to_single_destination_port' WHEN protocol = 'icmp' THEN 'icmp_flood' ELSE 'aggregate_udp_without_dominant_vector' END AS classification
 FROM t5 JOIN bw ON bw.sensor = t5.sensor AND bw.interface_id = t5.interface_id AND bw.peak_time = t5.peak_time AND pick = 1),
bp AS (SELECT *, row_number() OVER (PARTITION BY sensor, interface_id ORDER BY NOT complete, score DESC, peak_value DESC, peak_time) AS best FROM jd)
"""


def _found(s, d, direction, metric):
    rows, current = flows(s, d), rates.current_rates(dims.rate_config(s, d))
    return rows, current, plan.find_peaks(rows, current, direction, metric, max_peaks=5)


def _judged(s, d, direction, metric):
    rows, current, found = _found(s, d, direction, metric)
    return plan.judged_peaks(found, plan.evidence_flows(rows, current, found, direction), metric)


for _direction, _metric in (("receives", "packets_s"), ("sends", "bits_s")):
    _sql = peak_sql(_direction, _metric)
    _args = (_direction, _metric)
    query(
        f"peak_baseline_{_direction}",
        f"{_sql} SELECT sensor, interface_id, '{_direction}' AS direction, round(p95, 6)::DOUBLE AS baseline_p95, round(p99, 6)::DOUBLE AS baseline_p99 FROM b",
    )(
        lambda s, d, a=_args: peaks.baseline(
            series.interface_series(flows(s, d), rates.current_rates(dims.rate_config(s, d)), *a), plan.SERIES
        ).withColumns({c: F.round(c, 6) for c in ("baseline_p95", "baseline_p99")})
    )
    query(
        f"local_peaks_{_direction}",
        f"{_sql} SELECT sensor, interface_id, peak_time, round(peak_value, 3)::DOUBLE AS peak_value, score::DOUBLE AS score, peak_rank::INT AS peak_rank FROM t5",
    )(
        lambda s, d, a=_args: _found(s, d, *a)[2].select(
            "sensor", "interface_id", "peak_time", F.round("peak_value", 3).alias("peak_value"), "score", "peak_rank"
        )
    )

_ARGS = ("receives", "packets_s")


@query(
    "peak_evidence_flows",
    f"{peak_sql(*_ARGS)} SELECT sensor, interface_id, peak_time, window_seconds, src_ip, src_port, dst_ip, dst_port, proto, raw_bytes, raw_packets, bytes, packets, flow_count, effective_sample_rate, first_seen, last_seen, round(packets_s, 3)::DOUBLE AS packets_s, round(bits_s, 3)::DOUBLE AS bits_s FROM e2",
)
def _evidence(s, d):
    rows, current, found = _found(s, d, *_ARGS)
    out = plan.evidence_flows(rows, current, found, _ARGS[0])
    return out.drop("direction", "input_if", "output_if", "db_sample_rate").withColumns(
        {c: F.round(c, 3) for c in ("packets_s", "bits_s")}
    )


@query(
    "peak_vector_groups",
    f"{peak_sql(*_ARGS)} SELECT sensor, interface_id, peak_time, window_seconds, dst_ip, dst_port, protocol, total_packets, total_bytes, unique_src_count, round(share_packets, 3)::DOUBLE AS share_packets, round(share_bits, 3)::DOUBLE AS share_bits FROM gt",
)
def _groups(s, d):
    rows, current, found = _found(s, d, *_ARGS)
    evidence = plan.evidence_flows(rows, current, found, _ARGS[0])
    out = peaks.vector_groups(evidence, [*plan.SERIES, "peak_time", "window_seconds"])
    return out.select(
        "sensor", "interface_id", "peak_time", "window_seconds", "dst_ip", "dst_port", "protocol", "total_packets", "total_bytes",
        "unique_src_count", F.round("share_packets", 3).alias("share_packets"), F.round("share_bits", 3).alias("share_bits"),
    )


@query(
    "peak_vector_sources",
    f"{peak_sql(*_ARGS)} SELECT sensor, interface_id, peak_time, window_seconds, dst_ip, dst_port, protocol, src_ip, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes FROM e2 GROUP BY ALL",
)
def _sources(s, d):
    rows, current, found = _found(s, d, *_ARGS)
    evidence = plan.evidence_flows(rows, current, found, _ARGS[0])
    return peaks.vector_sources(evidence, ["sensor", "interface_id", "peak_time", "window_seconds"])


for _side in ("src_ip", "dst_ip"):
    query(
        f"peak_top_endpoints_{_side}",
        f"""{peak_sql(*_ARGS)}, q AS (SELECT sensor, interface_id, peak_time, {_side}, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes FROM e2 WHERE window_seconds = 60 GROUP BY ALL),
q2 AS (SELECT *, row_number() OVER (PARTITION BY sensor, interface_id, peak_time ORDER BY bytes DESC, packets DESC, {_side}) AS endpoint_rank, round(packets::DOUBLE / (sum(packets) OVER k)::DOUBLE * 100, 2)::DOUBLE AS share_packets, round(bytes::DOUBLE / (sum(bytes) OVER k)::DOUBLE * 100, 2)::DOUBLE AS share_bytes FROM q WINDOW k AS (PARTITION BY sensor, interface_id, peak_time))
SELECT * FROM q2 WHERE endpoint_rank <= 20""",
    )(
        lambda s, d, side=_side: (
            lambda r: peaks.top_endpoints(
                plan.evidence_flows(r[0], r[1], r[2], _ARGS[0]).filter("window_seconds = 60"), ["sensor", "interface_id", "peak_time"], side
            )
        )(_found(s, d, *_ARGS))
    )

for _direction, _metric in (("receives", "packets_s"), ("sends", "bits_s")):
    query(
        f"judged_peaks_{_direction}",
        f"{peak_sql(_direction, _metric)} SELECT sensor, interface_id, peak_time, evidence_window_used, dst_ip, dst_port, protocol, total_packets, unique_src_count, CASE WHEN complete THEN 'complete' ELSE 'insufficient' END AS evidence_status, classification FROM jd",
    )(
        lambda s, d, a=(_direction, _metric): _judged(s, d, *a).select(
            "sensor", "interface_id", "peak_time", "evidence_window_used", "dst_ip", "dst_port", "protocol", "total_packets",
            "unique_src_count", "evidence_status", "classification",
        )
    )
    # A complete case has a valid candidate when the flow is outbound or not TCP/ICMP bound to flags it lacks.
    query(
        f"peak_cases_{_direction}",
        f"""{peak_sql(_direction, _metric)}, c AS (SELECT *, complete AND ({"unique_src_count >= 2 OR protocol = 'udp'" if _direction == "sends" else "protocol = 'udp'"}) AS allowed FROM bp WHERE best = 1)
SELECT peak_time, strftime(peak_time, '%Y-%m-%dT%H:%M:%SZ') AS peak_time_utc, strftime(peak_time - INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S') || '-03:00' AS peak_time_local, sensor, interface_id, '{_direction}' AS direction, '{_metric}' AS metric, round(peak_value, 3)::DOUBLE AS peak_value, score::DOUBLE AS score,
CASE WHEN complete THEN 'complete' ELSE 'insufficient' END AS evidence_status, classification, allowed AS mitigation_allowed, CASE WHEN complete AND allowed THEN 'manual_review' ELSE 'alert_only' END AS recommended_action, dst_ip AS dominant_dst_ip, dst_port AS dominant_dst_port, protocol AS dominant_protocol, unique_src_count AS dominant_unique_src_count FROM c""",
    )(
        lambda s, d, a=(_direction, _metric): plan.advised_cases(_judged(s, d, *a), a[1]).select(
            "peak_time", "peak_time_utc", "peak_time_local", "sensor", "interface_id", "direction", "metric",
            F.round("peak_value", 3).alias("peak_value"), "score", "evidence_status", "classification", "mitigation_allowed",
            "recommended_action", "dominant_dst_ip", "dominant_dst_port", "dominant_protocol", "dominant_unique_src_count",
        )
    )


# --- case tables derived from orders -------------------------------------------

CASES_CTE = """cases AS (SELECT o_orderkey AS id, TIMESTAMP '2026-07-10 00:00:00' + to_seconds(o_orderkey * 37 % 86400) AS peak_time, 'edge-' || (o_custkey % 3) AS sensor,
o_custkey % 4 + 1 AS interface_id, CASE WHEN o_custkey % 2 = 0 THEN 'sends' ELSE 'receives' END AS direction, CASE WHEN o_custkey % 5 = 0 THEN 'bits_s' ELSE 'packets_s' END AS metric,
['dns_udp_abuse_outbound','udp_flood_outbound_to_single_destination_port','tcp_syn_flood_to_single_destination_port','icmp_flood','aggregate_udp_without_dominant_vector'][o_orderkey % 5 + 1] AS classification,
['complete','complete','insufficient','no_peak'][o_orderkey % 4 + 1] AS evidence_status, (o_orderkey * 7 % 1000)::DOUBLE AS baseline_p99, (o_custkey % 5000)::DOUBLE AS peak_value,
CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '203.0.113.' || (o_orderkey % 200) END AS dominant_dst_ip, ([0, 53, 443, 9004][o_orderkey % 4 + 1])::INT AS dominant_dst_port,
['udp','tcp','icmp','gre'][o_custkey % 4 + 1] AS dominant_protocol, 'case-' || o_orderkey AS case_key, o_orderkey % 3 = 0 AS mitigation_allowed, o_orderkey % 13 = 0 AS is_negative_sample FROM orders)"""


def cases(s, d):
    return table(s, d, "orders").selectExpr(
        "o_orderkey AS id",
        "TIMESTAMP '2026-07-10 00:00:00' + make_dt_interval(0, 0, 0, o_orderkey * 37 % 86400) AS peak_time",
        "concat('edge-', o_custkey % 3) AS sensor",
        "o_custkey % 4 + 1 AS interface_id",
        "CASE WHEN o_custkey % 2 = 0 THEN 'sends' ELSE 'receives' END AS direction",
        "CASE WHEN o_custkey % 5 = 0 THEN 'bits_s' ELSE 'packets_s' END AS metric",
        "array('dns_udp_abuse_outbound','udp_flood_outbound_to_single_destination_port','tcp_syn_flood_to_single_destination_port','icmp_flood','aggregate_udp_without_dominant_vector')[cast(o_orderkey % 5 AS int)] AS classification",
        "array('complete','complete','insufficient','no_peak')[cast(o_orderkey % 4 AS int)] AS evidence_status",
        "cast(o_orderkey * 7 % 1000 AS double) AS baseline_p99",
        "cast(o_custkey % 5000 AS double) AS peak_value",
        "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('203.0.113.', o_orderkey % 200) END AS dominant_dst_ip",
        "array(0, 53, 443, 9004)[cast(o_orderkey % 4 AS int)] AS dominant_dst_port",
        "array('udp','tcp','icmp','gre')[cast(o_custkey % 4 AS int)] AS dominant_protocol",
        "concat('case-', o_orderkey) AS case_key",
        "o_orderkey % 3 = 0 AS mitigation_allowed",
        "o_orderkey % 13 = 0 AS is_negative_sample",
        "30 AS evidence_window_used",
    )


@query(
    "draft_detection_rules",
    f"""{CASES_CTE}, k AS (SELECT *, CASE WHEN upper(dominant_protocol) IN ('UDP','TCP','ICMP') THEN upper(dominant_protocol) ELSE 'ALL' END AS proto FROM cases)
SELECT case_key AS source_case, CASE WHEN evidence_status IN ('insufficient','no_peak') THEN 'insufficient_evidence' WHEN dominant_dst_ip = '' THEN 'no_dominant_group' END AS reason,
'PH_RULE_' || classification || CASE WHEN dominant_dst_port > 0 THEN '_' || dominant_dst_port ELSE '' END || '_' || lower(proto) AS vector, CASE direction WHEN 'sends' THEN 'internal_ip_to_dst' ELSE 'internal_ip' END AS domain,
CASE direction WHEN 'sends' THEN 'transmits' ELSE 'receives' END AS direction, proto AS protocol, metric, round_even(greatest(baseline_p99 * 1.2::DOUBLE, peak_value * 0.5::DOUBLE), 2) AS warning_value, round_even(greatest(baseline_p99 * 1.5::DOUBLE, peak_value * 0.8::DOUBLE), 2) AS critical_value,
30 AS window_seconds, false AS enabled, CASE WHEN dominant_dst_port > 0 THEN dominant_dst_port::VARCHAR ELSE 'any' END AS dst_port, CASE classification WHEN 'aggregate_udp_without_dominant_vector' THEN 'src_ip,dst_ip,dst_port,protocol' ELSE 'dst_ip,dst_port,protocol' END AS group_by,
CASE direction WHEN 'sends' THEN '' ELSE interface_id::VARCHAR END AS input_if, CASE direction WHEN 'sends' THEN interface_id::VARCHAR ELSE '' END AS output_if FROM k""",
)
def _draft_rules(s, d):
    return peaks.draft_rules(cases(s, d)).drop("comparison", "mitigation_mode", "ttl_seconds", "dst_cidr")


@query(
    "draft_attack_vectors",
    f"""{CASES_CTE} SELECT case_key AS source_case, CASE WHEN evidence_status IN ('insufficient','no_peak') THEN 'insufficient_evidence' WHEN dominant_dst_ip = '' THEN 'no_dominant_group' END AS reason, CASE WHEN dominant_protocol IN ('udp','tcp','icmp') THEN dominant_protocol ELSE 'any' END AS protocol, direction,
CASE WHEN dominant_protocol IN ('udp','tcp','icmp') THEN upper(dominant_protocol) ELSE 'IP' END AS decoder, round_even(greatest(baseline_p99 * 1.2::DOUBLE, peak_value * 0.5::DOUBLE), 2) AS threshold_value, metric AS threshold_unit FROM cases""",
)
def _draft_vectors(s, d):
    out = peaks.draft_vectors(peaks.draft_rules(cases(s, d)))
    return out.select("source_case", "reason", "protocol", "direction", "decoder", "threshold_value", "threshold_unit")


@query(
    "draft_response_profiles",
    f"""{CASES_CTE} SELECT case_key AS source_case, CASE WHEN evidence_status IN ('insufficient','no_peak') THEN 'insufficient_evidence' WHEN dominant_dst_ip = '' THEN 'no_dominant_group' WHEN NOT mitigation_allowed THEN 'no_safe_candidate' END AS reason, CASE classification WHEN 'aggregate_udp_without_dominant_vector' THEN 'src_and_dst_ip' ELSE 'dst_ip' END AS target_selector,
CASE classification WHEN 'tcp_syn_flood_to_single_destination_port' THEN 'tcp' WHEN 'icmp_flood' THEN 'icmp' ELSE 'udp' END AS protocol_selector,
CASE WHEN classification = 'icmp_flood' THEN 'any' WHEN classification = 'dns_udp_abuse_outbound' THEN 'fixed' WHEN classification = 'aggregate_udp_without_dominant_vector' OR dominant_dst_port = 0 THEN 'anomaly_dst_port' ELSE 'fixed' END AS dst_port_selector,
CASE WHEN classification = 'icmp_flood' THEN '' WHEN classification = 'dns_udp_abuse_outbound' THEN '53' WHEN dominant_dst_port > 0 THEN dominant_dst_port::VARCHAR ELSE '' END AS dst_port_value FROM cases""",
)
def _draft_profiles(s, d):
    out = peaks.draft_profiles(cases(s, d))
    return out.select("source_case", "reason", "target_selector", "protocol_selector", "dst_port_selector", "dst_port_value")


@query(
    "draft_playbooks",
    f"""{CASES_CTE} SELECT case_key AS source_case, 'PH_PLAYBOOK_' || classification || CASE WHEN dominant_dst_port > 0 THEN '_' || dominant_dst_port ELSE '' END || '_' || dominant_protocol AS name,
CASE classification WHEN 'aggregate_udp_without_dominant_vector' THEN 'src_and_dst_ip' ELSE 'dst_ip' END AS target_selector, evidence_status IN ('insufficient','no_peak') OR NOT mitigation_allowed AS investigation_only FROM cases""",
)
def _draft_playbooks(s, d):
    return peaks.draft_playbooks(cases(s, d)).select("source_case", "name", "target_selector", "investigation_only")


@query(
    "peak_case_history",
    f"""{CASES_CTE} SELECT id, peak_time, sensor, interface_id, direction, metric FROM cases WHERE sensor = 'edge-1' AND direction = 'sends' AND evidence_status = 'complete' AND NOT is_negative_sample
AND interface_id = 3 AND peak_time BETWEEN TIMESTAMP '2026-07-10 02:00:00' AND TIMESTAMP '2026-07-10 20:00:00' ORDER BY peak_time DESC, id DESC LIMIT 150""",
)
def _history(s, d):
    wanted = {"sensor": "edge-1", "direction": "sends", "evidence_status": "complete", "is_negative_sample": "no", "interface_id": 3,
              "start_time": "2026-07-10 02:00:00", "end_time": "2026-07-10 20:00:00"}
    return peaks.history(cases(s, d), wanted, 150).select("id", "peak_time", "sensor", "interface_id", "direction", "metric")


@query(
    "peak_duplicates_of_history",
    f"""{CASES_CTE}, new AS (SELECT id, peak_time, sensor, interface_id, direction, metric, classification FROM cases WHERE id % 2 = 1), old AS (SELECT * FROM cases WHERE id % 2 = 0)
SELECT n.id, n.peak_time, min(o.id) AS duplicate_of_id FROM new n LEFT JOIN old o ON o.sensor = n.sensor AND o.interface_id = n.interface_id AND o.direction = n.direction AND o.metric = n.metric AND o.classification = n.classification
AND o.peak_time BETWEEN n.peak_time - INTERVAL 5 MINUTE AND n.peak_time + INTERVAL 5 MINUTE GROUP BY ALL""",
)
def _duplicates(s, d):
    rows = cases(s, d)
    out = peaks.dedupe_peaks(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"))
    return out.select("id", "peak_time", "duplicate_of_id")


@query(
    "peak_duplicates_in_batch",
    f"""{CASES_CTE}, u AS (SELECT DISTINCT sensor, interface_id, direction, metric, classification, peak_time FROM cases),
w AS (SELECT *, lag(peak_time) OVER (PARTITION BY sensor, interface_id, direction, metric, classification ORDER BY peak_time) AS prev FROM u)
SELECT sensor, interface_id, direction, metric, classification, peak_time, coalesce(date_diff('second', prev, peak_time) <= 300, false) AS is_duplicate FROM w""",
)
def _batch_duplicates(s, d):
    keys = [*peaks.SERIES_KEYS, "peak_time"]
    return peaks.batch_duplicates(cases(s, d).select(*keys).distinct())


@query(
    "operator_feedback",
    f"""{CASES_CTE}, fb AS (SELECT l_orderkey AS id, ['attack','false_positive','bogus','normal_traffic','unknown'][l_linenumber % 5 + 1] AS operator_label, l_partkey * 10 + l_linenumber AS v FROM lineitem),
ok AS (SELECT id, operator_label, row_number() OVER (PARTITION BY id ORDER BY v DESC, operator_label DESC) AS rn FROM fb WHERE operator_label <> 'bogus')
SELECT c.id, ok.operator_label FROM cases c LEFT JOIN ok ON ok.id = c.id AND rn = 1""",
)
def _feedback(s, d):
    given = table(s, d, "lineitem").selectExpr(
        "l_orderkey AS id",
        "array('attack','false_positive','bogus','normal_traffic','unknown')[l_linenumber % 5] AS operator_label",
        "'' AS operator_vector", "'' AS operator_best_action", "'' AS operator_comment", "false AS resolved_by_mitigation",
        "struct(l_partkey * 10 + l_linenumber AS v, array('attack','false_positive','bogus','normal_traffic','unknown')[l_linenumber % 5] AS l) AS feedback_updated_at",
    )
    return peaks.apply_feedback(cases(s, d), given).select("id", "operator_label")


@query(
    "exported_training_cases",
    f"""{CASES_CTE}, t AS (SELECT *, strftime(peak_time, '%Y-%m-%dT%H:%M:%SZ') AS u, strftime(peak_time - INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S') || '-03:00' AS l FROM cases)
SELECT to_json(struct_pack(case_id := 'peak-analysis-' || id, input := struct_pack(technical_report := '', sensor := sensor, interface_id := interface_id, direction := direction, metric := metric, protocol := upper(dominant_protocol),
peak := struct_pack(peak_time_utc := u, peak_time_local := l, peak_value := peak_value, score := 0.0::DOUBLE), baseline := struct_pack(p95 := 0.0::DOUBLE, p99 := baseline_p99),
dominant_group := struct_pack(dst_ip := dominant_dst_ip, dst_port := dominant_dst_port, protocol := dominant_protocol, unique_src_count := 0, share_packets := 0.0::DOUBLE, share_bits := 0.0::DOUBLE)),
expected_output := struct_pack(classification := classification, evidence_status := evidence_status, recommended_action := 'alert_only', operator_label := '', operator_vector := '', operator_best_action := ''),
metadata := struct_pack(created_at := '', peak_time_utc := u, peak_time_local := l, timezone := 'America/Sao_Paulo', analysis_source := 'manual', job_id := NULL::INT, run_id := NULL::INT, is_negative_sample := is_negative_sample, duplicate_of_id := NULL::INT, operator_comment := '')))::VARCHAR AS value FROM t""",
)
def _export(s, d):
    rows = cases(s, d).withColumns(
        {
            "technical_report": F.lit(""), "protocol": F.lit(""), "peak_time_utc": scalars.utc_text(F.col("peak_time")),
            "peak_time_local": scalars.local_ts(F.col("peak_time")), "score": F.lit(0.0), "baseline_p95": F.lit(0.0),
            "dominant_unique_src_count": F.lit(0), "dominant_share_packets": F.lit(0.0), "dominant_share_bits": F.lit(0.0),
            "recommended_action": F.lit("alert_only"), "operator_label": F.lit(""), "operator_vector": F.lit(""),
            "operator_best_action": F.lit(""), "created_at": F.lit(""), "analysis_source": F.lit("manual"),
            "job_id": F.lit(None).cast("int"), "run_id": F.lit(None).cast("int"), "duplicate_of_id": F.lit(None).cast("int"),
            "operator_comment": F.lit(""),
        }
    )
    return case_lines(rows)


@query(
    "anomaly_prefill_windows",
    """a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS started_at, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 7 MINUTE END AS ended_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 3 MINUTE END AS last_seen_at, o_orderdate + INTERVAL 1 MINUTE AS detected_at,
['packets_s','bits_s','flows_s'][o_orderkey % 3 + 1] AS metric, ['sends','receives','both'][o_custkey % 3 + 1] AS direction FROM orders)
SELECT id, CASE WHEN metric IN ('packets_s','bits_s') THEN metric ELSE 'packets_s' END AS metric, CASE WHEN direction IN ('sends','receives') THEN direction ELSE 'sends' END AS direction,
CASE WHEN started_at IS NOT NULL AND coalesce(ended_at, last_seen_at) IS NOT NULL THEN started_at - INTERVAL 2 MINUTE ELSE detected_at - INTERVAL 5 MINUTE END AS start_time,
CASE WHEN started_at IS NOT NULL AND coalesce(ended_at, last_seen_at) IS NOT NULL THEN coalesce(ended_at, last_seen_at) + INTERVAL 2 MINUTE ELSE detected_at + INTERVAL 5 MINUTE END AS end_time FROM a""",
)
def _prefill(s, d):
    rows = table(s, d, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey", "cast(o_orderdate AS timestamp) AS o"
    ).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN NULL ELSE o END AS started_at",
        "CASE WHEN id % 5 = 0 THEN o + INTERVAL 7 MINUTES END AS ended_at",
        "CASE WHEN id % 2 = 0 THEN o + INTERVAL 3 MINUTES END AS last_seen_at",
        "o + INTERVAL 1 MINUTE AS detected_at", "o AS created_at",
        "array('packets_s','bits_s','flows_s')[cast(id % 3 AS int)] AS metric",
        "array('sends','receives','both')[cast(o_custkey % 3 AS int)] AS direction",
    )
    return peaks.prefill(rows).select("id", "metric", "direction", "start_time", "end_time")


SCAN_NOW = "2026-07-10 13:30:00"

# Both sides of every row, all protocols and each, both metrics; then every scan's points, percentiles, peaks and verdicts.
SCAN_CTE = f"""{dims.RATE_CTE},
jobs AS (SELECT c_custkey AS job_id, 'edge-' || (c_custkey % 3) AS sensor, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 + 1 END AS own, ['sends','receives','both'][c_custkey % 3 + 1] AS direction, ['packets_s','both'][c_custkey % 2 + 1] AS metric,
 30 + c_custkey % 60 AS every, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE TIMESTAMP '{SCAN_NOW}' - to_minutes(c_custkey % 97) END AS last_run_at, c_custkey % 6 AS runs_count, [20, 60, 90][c_custkey % 3 + 1] AS lookback,
 CASE WHEN c_custkey % 7 = 0 THEN 17 ELSE -1 END AS scope, CASE WHEN c_custkey % 11 = 0 THEN 2000.0::DOUBLE END AS threshold, CASE c_custkey % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 WHEN 2 THEN 3.0 ELSE 1.5 END::DOUBLE AS factor,
 (2 + c_custkey % 3)::DOUBLE AS min_score, CASE WHEN c_custkey % 13 = 0 THEN 1000.0::DOUBLE END AS min_value FROM customer),
due AS (SELECT * FROM jobs WHERE last_run_at IS NULL OR date_diff('second', last_run_at, TIMESTAMP '{SCAN_NOW}') >= every * 60),
i AS (SELECT DISTINCT sensor, input_if AS interface_id FROM flows),
x AS (SELECT due.*, coalesce(own, i.interface_id) AS interface_id FROM due LEFT JOIN i ON own IS NULL AND i.sensor = due.sensor),
y AS (SELECT * EXCLUDE (direction), unnest(CASE direction WHEN 'both' THEN ['sends','receives'] ELSE [direction] END) AS direction FROM x),
z AS (SELECT * EXCLUDE (metric), unnest(CASE metric WHEN 'both' THEN ['packets_s','bits_s'] ELSE [metric] END) AS metric FROM y),
runs AS (SELECT *, runs_count + row_number() OVER (PARTITION BY job_id ORDER BY interface_id, direction DESC, metric DESC) AS run_number,
 concat_ws('|', sensor, interface_id, direction, metric, scope, lookback, coalesce(threshold::VARCHAR, ''), factor) AS scan FROM z),
sc AS (SELECT DISTINCT scan, sensor, interface_id, direction, metric, scope, threshold, factor, TIMESTAMP '{SCAN_NOW}' - to_minutes(lookback) AS w0, TIMESTAMP '{SCAN_NOW}' AS w1 FROM runs),
sided AS (SELECT sensor, input_if AS interface_id, 'receives' AS direction, in_rate AS r, proto, flow_time, bytes, packets, flow_count, src_ip, src_port, dst_ip, dst_port FROM rated UNION ALL
 SELECT sensor, output_if, 'sends', out_rate, proto, flow_time, bytes, packets, flow_count, src_ip, src_port, dst_ip, dst_port FROM rated),
scoped AS (SELECT *, unnest([-1, proto]) AS scope FROM sided),
pts AS (SELECT sensor, interface_id, direction, scope, time_bucket(INTERVAL '5 seconds', flow_time, TIMESTAMP '2026-07-10') AS bucket, sum(packets * r)::BIGINT / 5.0 AS packets_s, sum(bytes * r * 8)::BIGINT / 5.0 AS bits_s FROM scoped GROUP BY ALL),
pm AS (UNPIVOT pts ON packets_s, bits_s INTO NAME metric VALUE value),
wp AS (SELECT sc.*, bucket, value, lag(value, 1, -1) OVER w AS pv, lead(value, 1, -1) OVER w AS nv, quantile_cont(value, 0.95) OVER k AS p95q, quantile_cont(value, 0.99) OVER k AS p99q, count(*) OVER k AS n, max(value) OVER k AS top
 FROM sc JOIN pm ON pm.sensor = sc.sensor AND pm.interface_id = sc.interface_id AND pm.direction = sc.direction AND pm.metric = sc.metric AND pm.scope = sc.scope AND bucket BETWEEN w0 AND w1 WINDOW w AS (PARTITION BY scan ORDER BY bucket), k AS (PARTITION BY scan)),
wb AS (SELECT *, CASE WHEN n < 3 THEN top ELSE p95q END AS p95, CASE WHEN n < 3 THEN top ELSE p99q END AS p99 FROM wp),
pk AS (SELECT scan, sensor, interface_id, direction, metric, scope, bucket AS peak_time, value AS peak_value, round_even(value / p95, 3) AS score FROM wb WHERE value >= coalesce(threshold, greatest(p99, p95 * factor)) AND value >= pv AND value >= nv),
pt AS (SELECT DISTINCT sensor, interface_id, direction, scope, peak_time FROM pk),
ev AS (SELECT pt.sensor, pt.interface_id, pt.direction, pt.scope, peak_time, w.w AS window_seconds, src_ip, src_port, dst_ip, dst_port, r.proto, sum(bytes * r)::BIGINT AS bytes, sum(packets * r)::BIGINT AS packets
 FROM pt JOIN sided r ON r.sensor = pt.sensor AND r.interface_id = pt.interface_id AND r.direction = pt.direction AND (pt.scope = -1 OR pt.scope = r.proto) AND abs(date_diff('second', peak_time, flow_time)) <= 60
 JOIN (VALUES (5), (15), (30), (60)) w(w) ON abs(date_diff('second', peak_time, flow_time)) <= w.w GROUP BY ALL),
g AS (SELECT sensor, interface_id, direction, scope, peak_time, window_seconds, dst_ip, dst_port, CASE proto WHEN 17 THEN 'udp' WHEN 6 THEN 'tcp' ELSE 'icmp' END AS protocol, sum(packets)::BIGINT AS total_packets, sum(bytes)::BIGINT AS total_bytes,
 max(packets / (window_seconds * 2)) AS max_packets_s, max(bytes * 8 / (window_seconds * 2)) AS max_bits_s, count(DISTINCT src_ip) AS unique_src_count FROM ev GROUP BY ALL),
gt AS (SELECT *, total_packets::DOUBLE / (sum(total_packets) OVER k)::DOUBLE * 100 AS share_packets, total_bytes::DOUBLE / (sum(total_bytes) OVER k)::DOUBLE * 100 AS share_bits FROM g WINDOW k AS (PARTITION BY sensor, interface_id, direction, scope, peak_time, window_seconds)),
gm AS (SELECT *, 'packets_s' AS metric, share_packets AS share, max_packets_s AS top FROM gt UNION ALL SELECT *, 'bits_s', share_bits, max_bits_s FROM gt),
gd AS (SELECT *, row_number() OVER (PARTITION BY sensor, interface_id, direction, scope, metric, peak_time, window_seconds ORDER BY share DESC, top DESC, dst_ip, dst_port, protocol) AS rn FROM gm),
dm AS (SELECT *, share >= 20 AND (total_packets >= 1000 OR total_bytes >= 1000000) AS complete FROM gd WHERE rn = 1),
bw AS (SELECT *, row_number() OVER (PARTITION BY sensor, interface_id, direction, scope, metric, peak_time ORDER BY NOT complete, CASE WHEN complete THEN window_seconds ELSE 0 END, -share, window_seconds) AS pick,
 CASE WHEN NOT complete THEN 'insufficient_flow_evidence' WHEN protocol = 'udp' AND dst_port = 53 AND direction = 'sends' THEN 'dns_udp_abuse_outbound' WHEN protocol = 'udp' AND unique_src_count >= 2 AND direction = 'sends' THEN 'udp_flood_outbound_to_single_destination_port'
 WHEN protocol = 'tcp' THEN 'tcp_syn_flood_to_single_destination_port' WHEN protocol = 'icmp' THEN 'icmp_flood' ELSE 'aggregate_udp_without_dominant_vector' END AS classification FROM dm),
jd AS (SELECT pk.*, complete, classification, count(*) OVER (PARTITION BY scan) AS peaks_detected, row_number() OVER (PARTITION BY scan ORDER BY NOT complete, score DESC, peak_value DESC, pk.peak_time) AS best
 FROM pk JOIN bw ON bw.sensor = pk.sensor AND bw.interface_id = pk.interface_id AND bw.direction = pk.direction AND bw.scope = pk.scope AND bw.metric = pk.metric AND bw.peak_time = pk.peak_time AND pick = 1),
an AS (SELECT runs.*, coalesce(peaks_detected, 0) AS peaks_detected, peak_time, peak_value, score, classification, coalesce(score >= min_score AND (min_value IS NULL OR peak_value >= min_value), false) AS relevant FROM runs LEFT JOIN jd ON jd.scan = runs.scan AND best = 1),
hist AS (SELECT s_suppkey AS id, 'edge-' || (s_suppkey % 3) AS sensor, s_suppkey % 4 + 1 AS interface_id, ['sends','receives'][s_suppkey % 2 + 1] AS direction, ['packets_s','bits_s'][s_suppkey % 5 % 2 + 1] AS metric,
 ['tcp_syn_flood_to_single_destination_port','insufficient_flow_evidence','dns_udp_abuse_outbound'][s_suppkey % 7 % 3 + 1] AS classification, TIMESTAMP '2026-07-10 12:50:00' + to_seconds(s_suppkey * 31 % 1800) AS peak_time FROM supplier),
hd AS (SELECT an.*, (SELECT min(id) FROM hist h WHERE an.relevant AND h.sensor = an.sensor AND h.interface_id = an.interface_id AND h.direction = an.direction AND h.metric = an.metric AND h.classification = an.classification
 AND abs(date_diff('second', h.peak_time, an.peak_time)) <= 300) AS duplicate_of_id FROM an),
od AS (SELECT *, row_number() OVER (PARTITION BY sensor, interface_id, direction, metric, classification ORDER BY job_id, run_number) AS k FROM (SELECT sensor, interface_id, direction, metric, classification, peak_time, min((job_id, run_number)) AS run, min(run)[1] AS job_id, min(run)[2] AS run_number
 FROM (SELECT *, (job_id, run_number) AS run FROM hd WHERE relevant AND duplicate_of_id IS NULL) GROUP BY ALL)),
gr AS (WITH RECURSIVE r AS (SELECT sensor, interface_id, direction, metric, classification, k, [{{'job': job_id, 'run': run_number, 'at': peak_time}}] AS stored FROM od WHERE k = 1
 UNION ALL SELECT r.sensor, r.interface_id, r.direction, r.metric, r.classification, od.k, CASE WHEN len(list_filter(stored, lambda s: abs(date_diff('second', s.at, od.peak_time)) <= 300)) > 0 THEN stored ELSE list_append(stored, {{'job': od.job_id, 'run': od.run_number, 'at': od.peak_time}}) END
 FROM r JOIN od ON od.k = r.k + 1 AND od.sensor = r.sensor AND od.interface_id = r.interface_id AND od.direction = r.direction AND od.metric = r.metric AND od.classification = r.classification) SELECT * FROM r),
ge AS (SELECT sensor, interface_id, direction, metric, classification, max_by(stored, k) AS stored FROM gr GROUP BY ALL),
st AS (SELECT hd.*, list_filter(stored, lambda s: abs(date_diff('second', s.at, hd.peak_time)) <= 300)[1] AS by_run FROM hd LEFT JOIN ge ON hd.relevant AND hd.duplicate_of_id IS NULL AND ge.sensor = hd.sensor AND ge.interface_id = hd.interface_id AND ge.direction = hd.direction AND ge.metric = hd.metric AND ge.classification = hd.classification),
fin AS (SELECT *, by_run.job IS NOT NULL AND (by_run.job <> job_id OR by_run.run <> run_number) AS repeats FROM st),
told AS (SELECT *, CASE WHEN repeats THEN by_run.job END AS duplicate_of_job, CASE WHEN repeats THEN by_run.run END AS duplicate_of_run, CASE WHEN relevant AND (duplicate_of_id IS NOT NULL OR repeats) THEN 'skipped_duplicate' WHEN relevant THEN 'success'
 WHEN run_number % 4 = 0 AND job_id % 2 = 1 THEN 'negative_sample' ELSE 'no_peak' END AS run_status FROM fin)"""


def scan_jobs(s, d):
    return table(s, d, "customer").selectExpr(
        "c_custkey AS job_id",
        "concat('edge-', c_custkey % 3) AS sensor",
        "CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 + 1 END AS interface_id",
        "array('sends','receives','both')[cast(c_custkey % 3 AS int)] AS direction",
        "array('packets_s','both')[cast(c_custkey % 2 AS int)] AS metric",
        "30 + c_custkey % 60 AS interval_minutes",
        f"CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE timestampadd(MINUTE, -cast(c_custkey % 97 AS int), TIMESTAMP '{SCAN_NOW}') END AS last_run_at",
        "c_custkey % 6 AS runs_count",
        "array(20, 60, 90)[cast(c_custkey % 3 AS int)] AS lookback_minutes",
        "CASE WHEN c_custkey % 7 = 0 THEN 'udp' ELSE '' END AS protocol",
        "CASE WHEN c_custkey % 11 = 0 THEN 2000D END AS threshold",
        "array('high','medium','low','')[cast(c_custkey % 4 AS int)] AS level",
        "cast(2 + c_custkey % 3 AS double) AS min_peak_score", "CASE WHEN c_custkey % 13 = 0 THEN 1000D END AS min_peak_value",
        "c_custkey % 2 = 1 AS save_negative_samples", "4 AS negative_sample_interval_runs",
    ).withColumn("sensitivity", F.nullif("level", F.lit(""))).drop("level")


def scan_history(s, d):
    return table(s, d, "supplier").selectExpr(
        "s_suppkey AS id", "concat('edge-', s_suppkey % 3) AS sensor", "s_suppkey % 4 + 1 AS interface_id",
        "array('sends','receives')[cast(s_suppkey % 2 AS int)] AS direction", "array('packets_s','bits_s')[cast(s_suppkey % 5 % 2 AS int)] AS metric",
        "array('tcp_syn_flood_to_single_destination_port','insufficient_flow_evidence','dns_udp_abuse_outbound')[cast(s_suppkey % 7 % 3 AS int)] AS classification",
        "TIMESTAMP '2026-07-10 12:50:00' + make_dt_interval(0, 0, 0, s_suppkey * 31 % 1800) AS peak_time",
    )


def scan_runs(s, d):
    rows = flows(s, d)
    interfaces = rows.select("sensor", F.col("input_if").alias("interface_id")).distinct()
    runs = peaks.job_matrix(scan_jobs(s, d), interfaces, F.to_timestamp(F.lit(SCAN_NOW)))
    return scan.scheduled_runs(rows, rates.current_rates(dims.rate_config(s, d)), runs, scan_history(s, d))


@query(
    "scheduled_peak_runs",
    f"""{SCAN_CTE} SELECT job_id, interface_id, direction, metric, run_number, peaks_detected, peak_time, round(peak_value, 3)::DOUBLE AS peak_value, score::DOUBLE AS score, classification, duplicate_of_id, duplicate_of_job, duplicate_of_run, run_status FROM told""",
)
def _jobs(s, d):
    return scan_runs(s, d).select(
        "job_id", "interface_id", "direction", "metric", "run_number", "peaks_detected", "peak_time", F.round("peak_value", 3).alias("peak_value"),
        "score", "classification", "duplicate_of_id", "duplicate_of_job", "duplicate_of_run", "run_status",
    )


@query(
    "scheduled_stored_cases",
    f"""{SCAN_CTE} SELECT job_id, run_number, sensor, interface_id, direction, metric, CASE run_status WHEN 'success' THEN peak_time ELSE TIMESTAMP '{SCAN_NOW}' END AS peak_time, CASE run_status WHEN 'success' THEN score::DOUBLE ELSE 0.0::DOUBLE END AS score,
CASE run_status WHEN 'success' THEN classification ELSE 'no_significant_peak' END AS classification, run_status = 'negative_sample' AS is_negative_sample FROM told WHERE run_status IN ('success', 'negative_sample')""",
)
def _stored(s, d):
    return scan.stored_cases(scan_runs(s, d)).drop("peak_value", "evidence_status")


@query(
    "scheduled_jobs_advanced",
    f"""{SCAN_CTE}, done AS (SELECT job_id, count(*) AS n FROM told GROUP BY job_id)
SELECT jobs.job_id, runs_count + coalesce(n, 0) AS runs_count, CASE WHEN n IS NULL THEN last_run_at ELSE TIMESTAMP '{SCAN_NOW}' END AS last_run_at FROM jobs LEFT JOIN done USING (job_id)""",
)
def _advanced(s, d):
    now = F.to_timestamp(F.lit(SCAN_NOW))
    return scan.advanced_jobs(scan_jobs(s, d), scan_runs(s, d), now).select("job_id", "runs_count", "last_run_at")


# --- grouping ------------------------------------------------------------------

GROUP_CTE = """
inc AS (SELECT DISTINCT sensor || '|' || dst_ip || '|' || (date_diff('second', TIMESTAMP '2026-07-10 12:00:00', flow_time) // 600) AS incident_id, src_ip, src_port, dst_ip, dst_port,
 CASE proto WHEN 17 THEN 'udp' WHEN 6 THEN 'tcp' ELSE 'icmp' END AS protocol, bytes, packets, flow_count, flow_time FROM flows),
grp AS (SELECT incident_id, dst_ip, dst_port, protocol, sum(bytes)::BIGINT AS total_bytes, sum(packets)::BIGINT AS total_packets, sum(flow_count)::BIGINT AS total_flow_count, count(*) AS flows_count,
 count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT src_port) AS unique_src_ports, min(src_ip) AS first_src_ip FROM inc GROUP BY ALL),
shr AS (SELECT *, round(total_bytes::DOUBLE / (sum(total_bytes) OVER k)::DOUBLE * 100, 2)::DOUBLE AS share_bytes_percent, round(total_packets::DOUBLE / (sum(total_packets) OVER k)::DOUBLE * 100, 2)::DOUBLE AS share_packets_percent FROM grp WINDOW k AS (PARTITION BY incident_id)),
rnk AS (SELECT *, row_number() OVER w AS rn, lead(total_packets) OVER w AS np, lead(total_bytes) OVER w AS nb FROM shr WINDOW w AS (PARTITION BY incident_id ORDER BY total_packets DESC, total_bytes DESC, flows_count DESC, dst_ip, dst_port, protocol)),
dom AS (SELECT * FROM rnk WHERE rn = 1 AND (total_packets >= 1000 OR total_bytes >= 1000000) AND (share_packets_percent >= 50 OR share_bytes_percent >= 50)
 AND (unique_src_ips >= 2 OR np IS NULL OR total_packets >= greatest(np * 3, 1) OR total_bytes >= greatest(nb * 3, 1)))
"""


def incident_rows(s, d):
    start = F.unix_seconds(F.to_timestamp(F.lit("2026-07-10 12:00:00")))
    slot = F.floor((F.unix_seconds("flow_time") - start) / 600).cast("string")
    keyed = flows(s, d).withColumn("incident_id", F.concat_ws("|", "sensor", "dst_ip", slot))
    return grouping.distinct_flows(grouping.incident_flows(keyed))


GROUP_COLUMNS = ["incident_id", "dst_ip", "dst_port", "protocol", "total_bytes", "total_packets", "total_flow_count", "flows_count",
                 "unique_src_ips", "unique_src_ports", "share_bytes_percent", "share_packets_percent"]

query("incident_flow_groups", f"{GROUP_CTE} SELECT {', '.join(GROUP_COLUMNS)} FROM shr")(
    lambda s, d: grouping.flow_groups(incident_rows(s, d)).select(*GROUP_COLUMNS)
)
query("incident_dominant_groups", f"{GROUP_CTE} SELECT {', '.join(GROUP_COLUMNS)} FROM dom")(
    lambda s, d: grouping.dominant(grouping.flow_groups(incident_rows(s, d))).select(*GROUP_COLUMNS)
)


@query(
    "incident_noise_counts",
    f"""{GROUP_CTE} SELECT i.incident_id, count(*) FILTER (i.dst_port = d.dst_port AND i.protocol = d.protocol) AS primary_flows, count(*) FILTER (NOT (i.dst_port = d.dst_port AND i.protocol = d.protocol)) AS ignored_noise_flows_count
FROM inc i JOIN dom d ON d.incident_id = i.incident_id GROUP BY 1""",
)
def _noise(s, d):
    rows = incident_rows(s, d)
    return grouping.noise_counts(grouping.split_noise(rows, grouping.dominant(grouping.flow_groups(rows))))


@query(
    "incident_rewritten",
    f"""{GROUP_CTE}, i0 AS (SELECT DISTINCT incident_id, split_part(incident_id, '|', 2) AS target FROM inc)
SELECT i0.incident_id, coalesce(d.dst_ip, target) AS dst_ip, d.dst_port, coalesce(d.protocol, 'any') AS protocol, CASE WHEN d.dst_ip IS NOT NULL THEN '203.0.113.0/24' ELSE '' END AS dst_prefix, CASE WHEN d.dst_ip IS NOT NULL THEN true END AS same_dst_24, coalesce(d.first_src_ip, '') AS src_ip,
CASE d.protocol WHEN 'udp' THEN 'udp_flood_outbound_to_single_destination_port' WHEN 'tcp' THEN 'tcp_flow_to_single_destination_port' WHEN 'icmp' THEN 'icmp_to_single_destination_port' ELSE 'any_to_single_destination_port' END AS attack_vector
FROM i0 LEFT JOIN dom d ON d.incident_id = i0.incident_id""",
)
def _rewritten(s, d):
    rows = incident_rows(s, d)
    base = rows.select("incident_id").distinct().select(
        "incident_id", F.split("incident_id", r"\|")[1].alias("dst_ip"), F.lit(None).cast("int").alias("dst_port"), F.lit("any").alias("protocol"),
        F.lit("").alias("dst_prefix"), F.lit(None).cast("boolean").alias("same_dst_24"), F.lit("").alias("src_ip"),
    )
    out = grouping.incident_from_group(base, grouping.dominant(grouping.flow_groups(rows))).drop("dominant")
    return out.withColumn("src_ip", F.coalesce("src_ip", F.lit(""))).withColumn(
        "attack_vector", grouping.attack_vector(F.lit("outbound"), F.col("protocol"))
    )


# --- advice --------------------------------------------------------------------

ADVICE_CTE = """
v AS (SELECT sensor, split_part(dst_ip, '.', 4)::INT AS o, dst_ip, dst_port, CASE proto WHEN 17 THEN 'udp' WHEN 6 THEN 'tcp' ELSE 'icmp' END AS protocol, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes,
 count(DISTINCT src_ip) AS unique_src_count, min(src_ip) AS src_ip FROM flows GROUP BY ALL),
incident AS (SELECT sensor || '|' || dst_ip || '|' || dst_port || '|' || protocol AS incident_id, CASE o % 3 WHEN 0 THEN 'outbound' WHEN 1 THEN 'inbound' ELSE 'sends' END AS direction, protocol, src_ip, dst_ip, dst_port, CASE WHEN o % 4 = 0 THEN '203.0.113.0/24' ELSE '' END AS dst_prefix,
 CASE WHEN o % 5 = 1 THEN 'SYN+ACK' ELSE 'ack' END AS tcp_flags, CASE WHEN o % 6 = 0 THEN '8/0' ELSE '' END AS icmp_type_code, o % 3 <> 1 AS src_is_customer, o % 7 = 0 AS dst_is_customer, o % 7 <> 0 AS dst_is_external, o % 2 = 0 AS same_dst_24, unique_src_count, o % 8 = 1 AS has_dominant,
 o % 9 = 2 AS top_flow_empty, packets, bytes, (o % 50)::DOUBLE AS share_top_flow_percent, (o * 1000)::DOUBLE AS peak_pps, o % 10 = 3 AS is_fallback,
 CASE WHEN o % 11 = 4 THEN 'possible_l7_http_https' WHEN o % 11 = 5 THEN 'unknown_template' ELSE '' END AS suspected_template FROM v)
"""


def advice_incidents(s, d):
    octet = F.substring_index("dst_ip", ".", -1).cast("int")
    groups = flows(s, d).groupBy("sensor", "dst_ip", "dst_port", scalars.vector_protocol(F.col("proto")).alias("protocol")).agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.count_distinct("src_ip").alias("unique_src_count"), F.min("src_ip").alias("src_ip")
    )
    return groups.withColumn("o", octet).selectExpr(
        "concat_ws('|', sensor, dst_ip, dst_port, protocol) AS incident_id",
        "CASE o % 3 WHEN 0 THEN 'outbound' WHEN 1 THEN 'inbound' ELSE 'sends' END AS direction",
        "protocol", "src_ip", "dst_ip", "dst_port",
        "CASE WHEN o % 4 = 0 THEN '203.0.113.0/24' ELSE '' END AS dst_prefix",
        "CASE WHEN o % 5 = 1 THEN 'SYN+ACK' ELSE 'ack' END AS tcp_flags",
        "CASE WHEN o % 6 = 0 THEN '8/0' ELSE '' END AS icmp_type_code",
        "o % 3 <> 1 AS src_is_customer", "o % 7 = 0 AS dst_is_customer", "o % 7 <> 0 AS dst_is_external", "o % 2 = 0 AS same_dst_24",
        "unique_src_count", "o % 8 = 1 AS has_dominant", "o % 9 = 2 AS top_flow_empty", "packets", "bytes",
        "cast(o % 50 AS double) AS share_top_flow_percent", "cast(o * 1000 AS double) AS peak_pps", "o % 10 = 3 AS is_fallback",
        "CASE WHEN o % 11 = 4 THEN 'possible_l7_http_https' WHEN o % 11 = 5 THEN 'unknown_template' ELSE '' END AS suspected_template",
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


_TEMPLATE_ROWS = ", ".join(
    f"('{name}', '{t[0]}', '{t[1]}', {str(t[2]).lower()}, {_list(t[3])}, {_list(t[4])})" for name, t in pb.TEMPLATES.items()
)
_PREFERRED = " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in pb.PREFERRED.items())
_TTL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pb.MINIMUM_TTL.items())

CANDIDATE_CTE = f"""{ADVICE_CTE},
it AS (SELECT *, protocol = 'tcp' AND contains(lower(tcp_flags), 'syn') AS syn, CASE WHEN suspected_template <> '' THEN suspected_template WHEN protocol = 'tcp' AND contains(lower(tcp_flags), 'syn') THEN 'tcp_syn_flood' WHEN protocol = 'tcp' AND dst_port IN (80, 443) THEN 'possible_l7_http_https'
 WHEN protocol = 'udp' AND dst_port = 53 AND direction = 'outbound' THEN 'dns_udp_abuse_outbound' WHEN protocol = 'icmp' THEN 'icmp_flood' ELSE 'udp_flood_outbound_cpe' END AS tpl FROM incident),
po AS (SELECT *, CASE WHEN top_flow_empty AND NOT has_dominant THEN ['alert_only'] WHEN has_dominant AND direction IN ('outbound', 'sends') AND unique_src_count >= 2 THEN {_list(pb.MULTI_SOURCE_ORDER)}
 WHEN tpl = 'possible_l7_http_https' AND syn THEN {_list(pb.ALLOWED_IF_SYN_FLOOD['possible_l7_http_https'])} ELSE CASE tpl {_PREFERRED} ELSE {_list(pb.DEFAULT_ORDER)} END END AS pref FROM it),
pu AS (SELECT *, CASE WHEN list_contains(pref, 'alert_only') THEN pref ELSE list_append(pref, 'alert_only') END AS plist FROM po),
px AS (SELECT *, unnest(plist) AS template, unnest(range(len(plist))) AS pos FROM pu),
tp(name, action, risk, manual_only, fields, reqs) AS (VALUES {_TEMPLATE_ROWS}),
pj AS (SELECT px.*, action, risk, manual_only, fields FROM px JOIN tp ON tp.name = px.template WHERE len(list_filter(reqs, lambda r: NOT CASE r WHEN 'src_is_customer' THEN src_is_customer WHEN 'dst_is_external' THEN dst_is_external AND NOT dst_is_customer WHEN 'dst_is_customer' THEN dst_is_customer
 WHEN 'src_is_external' THEN NOT src_is_customer WHEN 'protocol_known' THEN true WHEN 'dst_port_known' THEN true WHEN 'dst_prefix_is_external' THEN dst_prefix <> '' AND NOT dst_is_customer WHEN 'same_asn_or_same_prefix_detected' THEN same_dst_24
 WHEN 'protocol_tcp' THEN protocol = 'tcp' WHEN 'protocol_udp' THEN protocol = 'udp' WHEN 'protocol_icmp' THEN protocol = 'icmp' WHEN 'icmp_type_code_known' THEN icmp_type_code <> '' WHEN 'tcp_flag_syn' THEN syn WHEN 'dst_port_53' THEN dst_port = 53
 WHEN 'manual_approval' THEN true WHEN 'dst_is_external_or_attack_destination' THEN NOT dst_is_customer ELSE false END)) = 0),
cd AS (SELECT *, (row_number() OVER (PARTITION BY incident_id ORDER BY pos) - 1)::INT AS candidate_index, CASE tpl {_TTL} ELSE '30m' END AS ttl,
 CASE WHEN list_contains(fields, 'src_ip') THEN src_ip || '/32' END AS match_src_ip, CASE WHEN list_contains(fields, 'dst_ip') THEN dst_ip || '/32' END AS match_dst_ip, CASE WHEN list_contains(fields, 'dst_prefix') THEN dst_prefix END AS match_dst_prefix,
 CASE WHEN list_contains(fields, 'protocol') THEN protocol END AS match_protocol, CASE WHEN list_contains(fields, 'dst_port') THEN dst_port::VARCHAR END AS match_dst_port, CASE WHEN list_contains(fields, 'tcp_flags') THEN CASE WHEN contains(lower(tcp_flags), 'syn') THEN lower(tcp_flags) ELSE 'syn' END END AS match_tcp_flags,
 CASE WHEN list_contains(fields, 'icmp_type_code') THEN icmp_type_code END AS match_icmp_type_code FROM pj),
vl AS (SELECT *, action <> 'alert_only' AS acts, action = 'flowspec_block' AS blocks, (match_src_ip IS NOT NULL)::INT + (match_dst_ip IS NOT NULL)::INT + (match_dst_prefix IS NOT NULL)::INT + (match_protocol IS NOT NULL)::INT + (match_dst_port IS NOT NULL)::INT + (match_tcp_flags IS NOT NULL)::INT + (match_icmp_type_code IS NOT NULL)::INT AS nm,
 (src_is_customer AND match_src_ip IS NOT NULL) OR (dst_is_customer AND match_dst_ip IS NOT NULL) AS touches FROM cd),
vx AS (SELECT *, concat_ws(',', CASE WHEN acts AND is_fallback AND share_top_flow_percent = 0 THEN 'fallback_analysis_share_top_flow_zero' END, CASE WHEN acts AND is_fallback AND packets < 1000 THEN 'fallback_analysis_packets_below_min' END,
 CASE WHEN acts AND is_fallback AND bytes < 1000000 THEN 'fallback_analysis_bytes_below_min' END, CASE WHEN acts AND is_fallback AND share_top_flow_percent < 20 THEN 'fallback_analysis_share_below_min' END,
 CASE WHEN acts AND packets < 1000 AND peak_pps > 40000 THEN 'insufficient_flow_evidence_packets_vs_peak' END, CASE WHEN acts AND top_flow_empty THEN 'top_flow_scope_empty' END,
 CASE WHEN blocks AND nm > 0 AND touches AND (nm = 1 OR NOT (match_protocol IS NOT NULL AND (match_dst_port IS NOT NULL OR match_dst_ip IS NOT NULL OR match_src_ip IS NOT NULL))) THEN 'block_customer_ip_only' END,
 CASE WHEN dst_is_customer AND match_dst_prefix IS NOT NULL THEN 'block_customer_prefix' END, CASE WHEN blocks AND match_src_ip IS NULL AND match_dst_ip IS NULL AND match_dst_prefix IS NULL THEN 'block_without_ip' END,
 CASE WHEN blocks AND match_protocol IS NULL THEN 'block_without_protocol' END,
 CASE WHEN acts AND direction IN ('outbound', 'sends') AND NOT src_is_customer THEN '{pb.OUTBOUND_UNCONFIRMED}' END, CASE WHEN acts AND direction = 'inbound' AND NOT dst_is_customer THEN '{pb.INBOUND_UNCONFIRMED}' END) AS violations FROM vl)
"""
_MATCHES = ["match_src_ip", "match_dst_ip", "match_dst_prefix", "match_protocol", "match_dst_port", "match_tcp_flags", "match_icmp_type_code"]

query(
    "mitigation_candidates",
    f"{CANDIDATE_CTE} SELECT incident_id, tpl AS suspected_template, candidate_index, template, action, risk, manual_only, ttl, {', '.join(_MATCHES)} FROM cd",
)(
    lambda s, d: advise.candidates(advice_incidents(s, d)).select(
        "incident_id", "suspected_template", "candidate_index", "template", "action", "risk", "manual_only", "ttl", *_MATCHES
    )
)
query(
    "mitigation_validation",
    f"{CANDIDATE_CTE} SELECT incident_id, candidate_index, template, violations, violations = '' AS valid FROM vx",
)(
    lambda s, d: advise.validate(advise.candidates(advice_incidents(s, d))).select(
        "incident_id", "candidate_index", "template", F.array_join("violations", ",").alias("violations"), "valid"
    )
)
query(
    "mitigation_recommendation",
    f"""{CANDIDATE_CTE}, ch AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY NOT acts, candidate_index) AS pick FROM vx),
st AS (SELECT *, CASE WHEN has_dominant THEN CASE WHEN violations = '' THEN 'complete' ELSE 'weak' END WHEN acts THEN 'weak' ELSE 'insufficient' END AS evidence_status FROM ch WHERE pick = 1)
SELECT incident_id, evidence_status, template, CASE WHEN acts THEN 'high' ELSE 'medium' END AS confidence, evidence_status = 'complete' AND acts AND violations = '' AS mitigation_allowed, CASE WHEN evidence_status = 'complete' AND acts AND violations = '' THEN action ELSE 'alert_only' END AS recommended_action,
CASE WHEN evidence_status = 'complete' AND acts AND violations = '' THEN template ELSE 'alert_only' END AS recommended_candidate FROM st""",
)(
    lambda s, d: advise.recommendation(advice_incidents(s, d)).select(
        "incident_id", "evidence_status", "template", "confidence", "mitigation_allowed", "recommended_action", "recommended_candidate"
    )
)


@query(
    "mitigation_decisions_checked",
    f"""{CANDIDATE_CTE}, de AS (SELECT incident_id, (o2 % 4)::INT AS idx, o2 % 6 = 0 AS allow_auto, o2 % 5 <> 0 AS manual, CASE o2 % 3 WHEN 0 THEN '' WHEN 1 THEN '10m' ELSE '4h' END AS asked FROM (SELECT incident_id, split_part(dst_ip, '.', 4)::INT AS o2 FROM incident)),
al AS (SELECT * FROM vx WHERE action = 'alert_only'),
jn AS (SELECT de.*, c.incident_id IS NOT NULL AS known, coalesce(c.candidate_index, al.candidate_index) AS candidate_index, coalesce(c.template, al.template) AS template, coalesce(c.action, al.action) AS action, coalesce(c.ttl, al.ttl) AS ttl, CASE WHEN c.incident_id IS NOT NULL THEN c.violations ELSE al.violations END AS cv
 FROM de LEFT JOIN vx c ON c.incident_id = de.incident_id AND c.candidate_index = de.idx LEFT JOIN al ON al.incident_id = de.incident_id),
ms AS (SELECT *, CASE WHEN asked = '10m' THEN 'recommended_ttl must be at least ' || ttl WHEN asked = '4h' THEN 'ai_can_change_ttl is false' END AS tv FROM jn)
SELECT incident_id, candidate_index, template, action, ttl, concat_ws(',', CASE WHEN NOT known THEN 'recommended_candidate_index does not exist' END, CASE WHEN allow_auto THEN 'allow_auto must be 0 in this phase' END, CASE WHEN NOT manual THEN 'manual_approval_required must be 1 in this phase' END, tv, CASE WHEN cv <> '' THEN cv END) AS violations FROM ms""",
)
def _decisions(s, d):
    rows = advice_incidents(s, d)
    given = rows.withColumn("o2", F.substring_index("dst_ip", ".", -1).cast("int")).selectExpr(
        "incident_id", "o2 % 4 AS recommended_candidate_index", "o2 % 6 = 0 AS allow_auto", "o2 % 5 <> 0 AS manual_approval_required",
        "CASE o2 % 3 WHEN 0 THEN '' WHEN 1 THEN '10m' ELSE '4h' END AS recommended_ttl",
    )
    out = advise.check_decisions(given, advise.candidates(rows))
    return out.withColumn("violations", F.array_join("violations", ",")).drop("valid")
