"""Mitigation advice as expressions over incident rows.

An incident row carries the columns of ``INCIDENT``; missing ones are added as null.
Candidates come from literal playbook maps inside one projection, so generating and
checking them needs no shuffle at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.functions import ip, scalars
from weirgauge.plans import playbook as pb

INCIDENT = {
    "incident_id": "string", "suspected_template": "string", "direction": "string", "protocol": "string",
    "src_ip": "string", "dst_ip": "string", "dst_port": "int", "dst_prefix": "string", "tcp_flags": "string",
    "tcp_flag_syn": "boolean", "syn_pps_above_baseline": "boolean", "icmp_type_code": "string", "rate_limit": "string",
    "src_is_customer": "boolean", "src_is_internal": "boolean", "src_is_protected": "boolean",
    "dst_is_customer": "boolean", "dst_is_internal": "boolean", "dst_is_protected": "boolean",
    "dst_is_external": "boolean", "dst_is_attack_destination": "boolean", "same_dst_24": "boolean", "same_asn": "boolean",
    "service_should_remain_available": "boolean", "top_flow_empty": "boolean", "unique_src_count": "bigint",
    "has_dominant": "boolean", "packets": "bigint", "bytes": "bigint", "share_top_flow_percent": "double",
    "peak_pps": "double", "is_fallback": "boolean",
}


def incidents(df: DataFrame) -> DataFrame:
    """Complete incident rows: known columns cast, missing ones null."""
    extra = [c for c in df.columns if c not in INCIDENT]
    return df.select(
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in INCIDENT.items()], *extra
    )


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _text(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


def syn_flood() -> Column:
    return (_text("protocol") == "tcp") & (_text("tcp_flags").contains("syn") | _flag("tcp_flag_syn") | _flag("syn_pps_above_baseline"))


def infer_template() -> Column:
    """Attack template from protocol, port, direction and flags."""
    proto, port, outbound = _text("protocol"), F.col("dst_port"), _text("direction") == "outbound"
    syn = _text("tcp_flags").contains("syn") | _flag("tcp_flag_syn")
    return (
        F.when((proto == "tcp") & syn, "tcp_syn_flood")
        .when((proto == "tcp") & port.isin(80, 443), "possible_l7_http_https")
        .when((proto == "udp") & (port == 53) & outbound, "dns_udp_abuse_outbound")
        .when(proto == "icmp", "icmp_flood")
        .when((proto == "udp") & outbound & _flag("src_is_customer"), "udp_flood_outbound_cpe")
        .otherwise(F.coalesce(F.nullif("suspected_template", F.lit("")), F.lit("udp_flood_outbound_cpe")))
    )


def _requirements() -> dict[str, Column]:
    proto, port = _text("protocol"), F.col("dst_port")
    return {
        "src_is_customer": _flag("src_is_customer"),
        "dst_is_external": _flag("dst_is_external") & ~_flag("dst_is_customer"),
        "dst_is_customer": _flag("dst_is_customer"),
        "src_is_external": ~_flag("src_is_customer") & ~_flag("src_is_internal"),
        "protocol_known": proto != "",
        "dst_port_known": port.isNotNull(),
        "dst_prefix_is_external": (_text("dst_prefix") != "") & ~_flag("dst_is_customer"),
        "same_asn_or_same_prefix_detected": _flag("same_asn") | _flag("same_dst_24"),
        "protocol_tcp": proto == "tcp",
        "protocol_udp": proto == "udp",
        "protocol_icmp": proto == "icmp",
        "icmp_type_code_known": _text("icmp_type_code") != "",
        "tcp_flag_syn": syn_flood(),
        "dst_port_53": F.coalesce(port == 53, F.lit(False)),
        "manual_approval": F.lit(True),
        "service_should_remain_available": _flag("service_should_remain_available"),
        "dst_is_external_or_attack_destination": ~_flag("dst_is_customer") | _flag("dst_is_attack_destination"),
    }


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _by_template(template: Column, values: dict[str, list[str]], default: list[str]) -> Column:
    expression = _names(default)
    for name, listed in values.items():
        expression = F.when(template == name, _names(listed)).otherwise(expression)
    return expression


def candidates(incident_rows: DataFrame) -> DataFrame:
    """Mitigation candidates of each incident in order of preference, always ending with an alert.

    Overrides: a clear SYN flood on web ports, a dominant group with several sources, and
    an explicitly empty top flow.
    """
    rows = incidents(incident_rows)
    template = F.coalesce(F.nullif("suspected_template", F.lit("")), infer_template())
    rows = rows.withColumn("suspected_template", template)
    chosen = F.col("suspected_template")
    multi_source = (
        _flag("has_dominant")
        & _text("direction").isin("outbound", "sends")
        & (F.coalesce("unique_src_count", F.lit(0)) >= 2)
        & (_text("dst_ip") != "")
        & (F.coalesce("dst_port", F.lit(0)) > 0)
        & (_text("protocol") != "")
    )
    preferred = (
        F.when(_flag("top_flow_empty") & ~_flag("has_dominant"), _names(["alert_only"]))
        .when(multi_source, _names(pb.MULTI_SOURCE_ORDER))
        .when((chosen == "possible_l7_http_https") & syn_flood(), _names(pb.ALLOWED_IF_SYN_FLOOD["possible_l7_http_https"]))
        .otherwise(_by_template(chosen, pb.PREFERRED, pb.DEFAULT_ORDER))
    )
    met = _requirements()
    forbidden_port = F.coalesce(F.col("dst_port").isin(*pb.RATE_LIMIT_FORBIDDEN_PORTS), F.lit(False)) & _flag("dst_is_customer")
    allowed = []
    for name, (action, *_rest, needs) in pb.TEMPLATES.items():
        test = reduce(lambda a, b: a & b, [met[n] for n in needs], F.lit(True))
        test = test & ~forbidden_port if action == "flowspec_rate_limit" else test
        allowed.append(F.when(test, F.lit(name)))
    staged = rows.withColumns(
        {"__order": F.array_distinct(F.concat(preferred, _names(["alert_only"]))), "__allowed": F.array_compact(F.array(*allowed))}
    )
    kept = F.filter("__order", lambda t: F.array_contains(F.col("__allowed"), t))
    exploded = staged.withColumn("__kept", kept).select(
        *rows.columns, F.posexplode("__kept").alias("candidate_index", "template")
    )
    name = F.col("template")

    def of(position: int) -> Column:
        expression = None
        for key, spec in pb.TEMPLATES.items():
            value = F.lit(spec[position])
            expression = F.when(name == key, value) if expression is None else expression.when(name == key, value)
        return expression

    fields = _by_template(name, {k: v[3] for k, v in pb.TEMPLATES.items()}, [])
    ttl = F.lit(pb.DEFAULT_TTL)
    for key, value in pb.MINIMUM_TTL.items():
        ttl = F.when(F.col("suspected_template") == key, value).otherwise(ttl)
    flags = F.when(_text("tcp_flags").contains("syn"), _text("tcp_flags")).otherwise("syn")
    values = {
        "src_ip": F.nullif(ip.host_cidr(F.col("src_ip")), F.lit("")),
        "dst_ip": F.nullif(ip.host_cidr(F.col("dst_ip")), F.lit("")),
        "dst_prefix": F.nullif("dst_prefix", F.lit("")),
        "protocol": F.nullif(_text("protocol"), F.lit("")),
        "dst_port": F.col("dst_port").cast("string"),
        "tcp_flags": flags,
        "rate_limit": F.coalesce(F.nullif("rate_limit", F.lit("")), F.lit("manual")),
        "icmp_type_code": F.nullif("icmp_type_code", F.lit("")),
    }
    with_fields = exploded.withColumn("__fields", fields)
    match = {f"match_{k}": F.when(F.array_contains("__fields", k), v) for k, v in values.items()}
    return with_fields.withColumns(
        {
            "action": of(0),
            "risk": of(1),
            "manual_only": of(2),
            "ttl": ttl,
            "allow_auto": F.lit(False),
            "manual_approval_required": F.lit(True),
            **match,
        }
    ).drop("__fields")


MATCH = ["src_ip", "dst_ip", "dst_prefix", "protocol", "dst_port", "tcp_flags", "rate_limit", "icmp_type_code"]


def _peak_pps() -> Column:
    return F.coalesce("peak_pps", F.lit(0.0))


def validate(cands: DataFrame) -> DataFrame:
    """Violations of each candidate and whether it is valid; one projection."""
    action, is_block = F.col("action"), F.col("action").isin("flowspec_block", "blackhole_dst")
    acts = action != "alert_only"
    m = {k: F.col(f"match_{k}") for k in MATCH}
    has = {k: c.isNotNull() for k, c in m.items()}
    count = reduce(lambda a, b: a + b, [has[k].cast("int") for k in MATCH])
    packets, size = F.coalesce("packets", F.lit(0)), F.coalesce("bytes", F.lit(0))
    share = F.coalesce("share_top_flow_percent", F.lit(0.0))
    fallback = _flag("is_fallback")
    touches = (_flag("src_is_customer") & has["src_ip"]) | (_flag("dst_is_customer") & has["dst_ip"])
    context = has["protocol"] & (has["dst_port"] | has["dst_ip"] | has["src_ip"])
    only = (count == 1) & touches
    limit_port = F.coalesce(m["dst_port"].try_cast("int"), F.col("dst_port"))
    limits_customer = (action == "flowspec_rate_limit") & _flag("dst_is_customer")
    no_scope = _flag("top_flow_empty") | ~(has["src_ip"] | has["dst_ip"] | has["dst_prefix"] | has["dst_port"] | has["protocol"] | (_text("protocol") != ""))
    outbound = _text("direction").isin("outbound", "sends")
    source_known = (
        _flag("src_is_customer") | _flag("src_is_internal") | _flag("src_is_protected")
        | (_flag("has_dominant") & (F.coalesce("unique_src_count", F.lit(0)) > 0) & F.coalesce("src_is_customer", F.lit(True)))
    )
    target_known = _flag("dst_is_customer") | _flag("dst_is_internal") | _flag("dst_is_protected")
    rules = [
        ("fallback_analysis_share_top_flow_zero", acts & fallback & (share == 0)),
        ("fallback_analysis_packets_below_min", acts & fallback & (packets < pb.MIN_PACKETS)),
        ("fallback_analysis_bytes_below_min", acts & fallback & (size < pb.MIN_BYTES)),
        ("fallback_analysis_share_below_min", acts & fallback & (share < pb.MIN_SHARE)),
        ("insufficient_flow_evidence_packets_vs_peak", acts & (packets < pb.MIN_PACKETS) & (_peak_pps() > pb.HIGH_PEAK_PPS)),
        ("top_flow_scope_empty", acts & no_scope),
        ("block_customer_ip_only", is_block & (count > 0) & (only | (touches & ~context))),
        ("block_customer_prefix", _flag("dst_is_customer") & has["dst_prefix"]),
        ("block_without_ip", is_block & ~(has["src_ip"] | has["dst_ip"] | has["dst_prefix"])),
        ("block_without_protocol", (action == "flowspec_block") & ~has["protocol"] & (F.col("template") != "dst_blackhole_32")),
        ("rate_limit_dns_as_customer_destination", limits_customer & (limit_port == 53)),
        ("rate_limit_http_https_as_customer_destination", limits_customer & limit_port.isin(80, 443)),
        (pb.OUTBOUND_UNCONFIRMED, acts & outbound & ~source_known),
        (pb.INBOUND_UNCONFIRMED, acts & (_text("direction") == "inbound") & ~target_known),
    ]
    violations = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules]))
    return cands.withColumn("violations", violations).withColumn("valid", F.size("violations") == 0)


def check_decisions(decisions: DataFrame, cands: DataFrame) -> DataFrame:
    """Decisions of an advisor (or of ``default_choice``) against the candidates of their incident.

    ``decisions(incident_id, recommended_candidate_index, allow_auto, manual_approval_required,
    recommended_ttl)``.  An unknown index falls back to the alert; automatic use is never allowed.
    """
    checked = validate(cands)
    picked = checked.select(
        F.col("incident_id").alias("__inc"), F.col("candidate_index").alias("__idx"), "template", "action", "ttl", "violations"
    )
    alerts = checked.filter("action = 'alert_only'").groupBy("incident_id").agg(
        F.min_by(F.struct("candidate_index", "template", "action", "ttl", "violations"), "candidate_index").alias("__alert")
    )
    joined = (
        decisions.join(picked, (F.col("incident_id") == F.col("__inc")) & (F.col("recommended_candidate_index") == F.col("__idx")), "left")
        .join(alerts, "incident_id", "left")
    )
    known = F.col("__idx").isNotNull()
    ttl = F.coalesce("ttl", "__alert.ttl")
    asked = F.coalesce(F.nullif("recommended_ttl", F.lit("")), ttl)
    short = F.coalesce(scalars.ttl_seconds(asked), F.lit(0)) < F.coalesce(scalars.ttl_seconds(ttl), F.lit(0))
    own = F.array_compact(
        F.array(
            F.when(~known, "recommended_candidate_index does not exist"),
            F.when(F.coalesce("allow_auto", F.lit(False)), "allow_auto must be 0 in this phase"),
            F.when(~F.coalesce("manual_approval_required", F.lit(True)), "manual_approval_required must be 1 in this phase"),
            F.when(short, F.concat(F.lit("recommended_ttl must be at least "), ttl)),
            F.when(~short & (asked != ttl), "ai_can_change_ttl is false"),
        )
    )
    violations = F.concat(own, F.coalesce("violations", "__alert.violations"))
    return joined.select(
        "incident_id",
        F.coalesce("__idx", "__alert.candidate_index").alias("candidate_index"),
        F.coalesce("template", "__alert.template").alias("template"),
        F.coalesce("action", "__alert.action").alias("action"),
        ttl.alias("ttl"),
        violations.alias("violations"),
        (F.size(violations) == 0).alias("valid"),
    )


def default_choice(cands: DataFrame) -> DataFrame:
    """First candidate that acts, else the first one; never automatic."""
    acts = F.col("action") != "alert_only"
    rest = [c for c in cands.columns if c != "incident_id"]
    first = cands.groupBy("incident_id").agg(
        F.min_by(F.struct(*rest), F.struct((~acts).alias("a"), F.col("candidate_index").alias("b"))).alias("c")
    )
    return first.select("incident_id", "c.*").withColumn(
        "confidence", F.when(F.col("action") != "alert_only", "high").otherwise("medium")
    )


def recommendation(incident_rows: DataFrame) -> DataFrame:
    """Evidence status and recommended action per incident."""
    chosen = default_choice(validate(candidates(incident_rows)))
    acts = F.col("action") != "alert_only"
    status = (
        F.when(_flag("has_dominant"), F.when(F.col("valid"), "complete").otherwise("weak"))
        .when(acts, "weak")
        .otherwise("insufficient")
    )
    allowed = (F.col("evidence_status") == "complete") & acts & F.col("valid")
    return chosen.withColumn("evidence_status", status).withColumns(
        {
            "mitigation_allowed": allowed,
            "recommended_action": F.when(allowed, F.col("action")).otherwise("alert_only"),
            "recommended_candidate": F.when(allowed, F.col("template")).otherwise("alert_only"),
            "recommendation_class": F.when(allowed, "unknown").otherwise("insufficient_flow_evidence"),
        }
    )


# --- executions ---------------------------------------------------------------

LIVE = ("generated", "queued", "applying", "active", "withdraw_pending")


def mitigation_key(df: DataFrame) -> Column:
    """Deterministic key of the rule a candidate stands for."""

    def clean(name: str) -> Column:
        return _text(name) if name in df.columns else F.lit("")

    prefix = F.coalesce(F.nullif(clean("dst_prefix"), F.lit("")), F.nullif(clean("src_prefix"), F.lit("")))
    family = F.when(prefix.isNull(), "").when(prefix.contains(":"), "ipv6").otherwise("ipv4")
    return scalars.stable_key(
        "mit",
        connector_id=F.coalesce(F.col("connector_id").cast("string"), F.lit("0")),
        address_family=family,
        source=clean("src_prefix"),
        destination=clean("dst_prefix"),
        protocol=clean("protocol"),
        source_port=clean("src_port"),
        destination_port=clean("dst_port"),
        tcp_flags=clean("tcp_flags"),
        action=clean("action"),
    )


def dedupe_mitigations(requests: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One live execution per rule key.

    ``requests(anomaly_id, request_id, ..., idempotency_key)``, ``live(execution_id,
    idempotency_key, status)``.  Returns ``(queued, associations)``: the requests that become
    executions, and every anomaly with the execution that serves it (its id, or null and the
    key when it was queued in this batch).
    """
    running = live.filter(F.col("status").isin(*LIVE)).groupBy("idempotency_key").agg(F.max("execution_id").alias("execution_id"))
    firsts = requests.groupBy("idempotency_key").agg(F.min("request_id").alias("__first"))
    fresh = firsts.join(running, "idempotency_key", "left_anti")
    queued = requests.join(
        fresh, (requests["idempotency_key"] == fresh["idempotency_key"]) & (requests["request_id"] == fresh["__first"]), "left_semi"
    )
    associations = (
        requests.select("anomaly_id", "idempotency_key").distinct().join(running, "idempotency_key", "left")
        .withColumn("deduplicated", F.col("execution_id").isNotNull())
    )
    return queued, associations


def blocking_reason(
    kind: str = "candidate_kind",
) -> Column:
    """First reason that stops an automatic execution, empty when none does."""

    def mode(name: str) -> Column:
        return _text(name).isin("auto", "automatic")

    gate = F.coalesce(F.nullif(F.trim("gate_reason"), F.lit("")), F.lit("blocked_by_gate"))
    return (
        F.when(F.coalesce(F.col(kind), F.lit("")) != "automatic_primary", "candidate_not_automatic_primary")
        .when(~_flag("automatic_eligible"), "candidate_not_automatic_eligible")
        .when(~_flag("auto_allowed") | ~_flag("policy_authorized"), "blocked_by_policy")
        .when(~mode("profile_mode"), "profile_not_automatic")
        .when(~mode("connector_mode"), "connector_not_automatic")
        .when(F.coalesce("anomaly_status", F.lit("")) != "active", "anomaly_not_active")
        .when(F.col("connector_id").isNull(), "connector_not_resolved")
        .when(_text("connector_type") == "", "connector_type_missing")
        .when(_text("command") == "", "validation_failed")
        .when(F.coalesce("ttl_seconds", F.lit(0)) <= 0, "invalid_ttl")
        .when(_flag("gate_blocking"), gate)
        .otherwise("")
    )


def expired(executions: DataFrame, now: Column) -> DataFrame:
    """Active executions whose time to live has run out."""
    end = F.unix_seconds("applied_at") + F.coalesce("ttl_seconds", F.lit(0))
    return executions.filter((F.col("status") == "active") & (F.col("ttl_seconds") > 0) & (end <= F.unix_seconds(now)))


def target_candidates(flows: DataFrame, whitelisted_keys: DataFrame | None, min_packets: int) -> DataFrame:
    """One destination-only candidate per distinct target with the reason it is refused, if any.

    A source is never a target on its own.  Rows that mark each source's first one (``new_source``)
    are added up, with the distinct ones in ``source``; others have their sources counted.
    """
    sources = F.count_if("new_source") + F.count_distinct("source") if "new_source" in flows.columns else F.count_distinct("src_ip")
    targets = flows.filter(F.coalesce("dst_ip", F.lit("")) != "").groupBy("event_id", "dst_ip", "dst_ip_key", "dst_port", "proto").agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), sources.alias("sources")
    )
    if whitelisted_keys is not None:
        known = whitelisted_keys.select(F.col("ip_key").alias("__k")).distinct().withColumn("__w", F.lit(True))
        targets = targets.join(known, F.col("dst_ip_key") == F.col("__k"), "left").drop("__k")
    else:
        targets = targets.withColumn("__w", F.lit(None).cast("boolean"))
    reason = F.when(F.coalesce("__w", F.lit(False)), "destination_whitelisted").when(F.col("packets") < min_packets, "below_threshold")
    return targets.select(
        "event_id", ip.host_cidr(F.col("dst_ip")).alias("dst_prefix"), "dst_port", scalars.vector_protocol(F.col("proto")).alias("protocol"),
        "packets", "bytes", "sources", F.coalesce(reason, F.lit("")).alias("rejection_reason"), reason.isNull().alias("accepted"),
    )
