"""Mitigation playbook tables."""

from __future__ import annotations

# Attack templates with preferred candidates and lowest time to live.
PREFERRED = {
    "udp_flood_outbound_cpe": ["src_customer_32_dst_external_32_proto_dst_port", "dst_external_32_proto_dst_port",
                               "dst_external_prefix_proto_dst_port"],
    "dns_udp_abuse_outbound": ["src_customer_32_dst_external_32_udp_dst_port_53", "dst_external_32_udp_dst_port_53"],
    "tcp_syn_flood": ["src_32_dst_32_tcp_dst_port_syn", "dst_32_tcp_dst_port_syn", "src_32_dst_32_tcp_syn", "dst_32_tcp_syn"],
    "icmp_flood": ["src_32_dst_32_icmp_type_code", "dst_32_icmp_type_code"],
    "possible_l7_http_https": ["alert_only"],
}
ALLOWED_IF_SYN_FLOOD = {"possible_l7_http_https": ["dst_32_tcp_dst_port_syn", "src_32_dst_32_tcp_dst_port_syn"]}
MULTI_SOURCE_ORDER = ["dst_external_32_proto_dst_port", "dst_external_prefix_proto_dst_port", "alert_only"]
DEFAULT_ORDER = [
    "src_customer_32_dst_external_32_proto_dst_port", "dst_external_32_proto_dst_port",
    "src_external_32_dst_customer_32_proto_dst_port", "dst_customer_32_proto_dst_port",
    "src_customer_32_dst_external_32_proto", "dst_external_32_proto", "dst_external_prefix_proto_dst_port",
    "rate_limit_specific", "alert_only",
]
MINIMUM_TTL = {
    "udp_flood_outbound_cpe": "2h",
    "dns_udp_abuse_outbound": "2h",
    "tcp_syn_flood": "30m",
    "icmp_flood": "30m",
    "possible_l7_http_https": "30m",
}
DEFAULT_TTL = "30m"

# Candidate templates as (action, risk, manual only, match fields, requirements).
TEMPLATES = {
    "src_customer_32_dst_external_32_proto_dst_port": ("flowspec_block", "low", False,
        ["src_ip", "dst_ip", "protocol", "dst_port"], ["src_is_customer", "dst_is_external", "protocol_known", "dst_port_known"]),
    "src_customer_32_dst_external_32_udp_dst_port_53": ("flowspec_block", "low", False,
        ["src_ip", "dst_ip", "protocol", "dst_port"], ["src_is_customer", "dst_is_external", "protocol_udp", "dst_port_53"]),
    "dst_external_32_proto_dst_port": ("flowspec_block", "medium", False,
        ["dst_ip", "protocol", "dst_port"], ["dst_is_external", "protocol_known", "dst_port_known"]),
    "dst_external_32_udp_dst_port_53": ("flowspec_block", "medium", False,
        ["dst_ip", "protocol", "dst_port"], ["dst_is_external", "protocol_udp", "dst_port_53"]),
    "src_external_32_dst_customer_32_proto_dst_port": ("flowspec_block", "medium", True,
        ["src_ip", "dst_ip", "protocol", "dst_port"], ["dst_is_customer", "src_is_external", "protocol_known", "dst_port_known"]),
    "dst_customer_32_proto_dst_port": ("flowspec_block", "high", True,
        ["dst_ip", "protocol", "dst_port"], ["dst_is_customer", "protocol_known", "dst_port_known"]),
    "src_customer_32_dst_external_32_proto": ("flowspec_block", "medium", True,
        ["src_ip", "dst_ip", "protocol"], ["src_is_customer", "dst_is_external", "protocol_known"]),
    "dst_external_32_proto": ("flowspec_block", "high", True,
        ["dst_ip", "protocol"], ["dst_is_external", "protocol_known"]),
    "dst_external_prefix_proto_dst_port": ("flowspec_block", "high", True,
        ["dst_prefix", "protocol", "dst_port"],
        ["dst_prefix_is_external", "protocol_known", "dst_port_known", "same_asn_or_same_prefix_detected"]),
    "src_32_dst_32_tcp_dst_port_syn": ("flowspec_block", "low", False,
        ["src_ip", "dst_ip", "protocol", "dst_port", "tcp_flags"], ["protocol_tcp", "tcp_flag_syn", "dst_port_known"]),
    "dst_32_tcp_dst_port_syn": ("flowspec_block", "medium", False,
        ["dst_ip", "protocol", "dst_port", "tcp_flags"], ["protocol_tcp", "tcp_flag_syn", "dst_port_known"]),
    "src_32_dst_32_tcp_syn": ("flowspec_block", "medium", True,
        ["src_ip", "dst_ip", "protocol", "tcp_flags"], ["protocol_tcp", "tcp_flag_syn"]),
    "dst_32_tcp_syn": ("flowspec_block", "high", True,
        ["dst_ip", "protocol", "tcp_flags"], ["protocol_tcp", "tcp_flag_syn"]),
    "src_32_dst_32_icmp_type_code": ("flowspec_block", "low", False,
        ["src_ip", "dst_ip", "protocol", "icmp_type_code"], ["protocol_icmp", "icmp_type_code_known"]),
    "dst_32_icmp_type_code": ("flowspec_block", "medium", False,
        ["dst_ip", "protocol", "icmp_type_code"], ["protocol_icmp", "icmp_type_code_known"]),
    "dst_blackhole_32": ("blackhole_dst", "high", True,
        ["dst_ip"], ["dst_is_external_or_attack_destination", "manual_approval"]),
    "rate_limit_specific": ("flowspec_rate_limit", "medium", True,
        ["src_ip", "dst_ip", "protocol", "dst_port", "rate_limit"], ["manual_approval", "service_should_remain_available"]),
    "alert_only": ("alert_only", "none", False, [], []),
}
# A rate limit is refused for these ports of a customer destination.
RATE_LIMIT_FORBIDDEN_PORTS = [53, 80, 443]

# Actions that a candidate may never amount to.
FORBIDDEN_ACTIONS = [
    "block_customer_ip_only", "block_customer_prefix", "block_all_udp", "block_all_tcp", "block_all_icmp",
    "block_dns_as_customer_destination", "rate_limit_dns_as_customer_destination",
    "rate_limit_http_https_as_customer_destination", "block_without_protocol", "block_without_ip",
    "block_prefix_internal", "block_all_dns", "block_all_icmp_without_type_code",
    "rate_limit_80_443_as_customer_destination",
]

# Evidence floors of the validation.
MIN_PACKETS, MIN_BYTES, MIN_SHARE, HIGH_PEAK_PPS = 1000, 1_000_000, 20.0, 40_000

# Direction findings.
OUTBOUND_UNCONFIRMED = "Origem interna/protegida nao confirmada para mitigacao outbound."
INBOUND_UNCONFIRMED = "Destino nao confirmado dentro de prefixo protegido."
