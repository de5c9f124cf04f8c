"""Filters on flow rows.  Each becomes a plain predicate that reaches the scan."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.functions import ip, scalars

SENDS = {"sends", "transmits", "outbound", "output", "upload"}
RECEIVES = {"receives", "inbound", "input", "download"}
MAX_FILTERS = 30
MAX_CIDRS = 50


def ts_lit(value: datetime | str) -> Column:
    return F.to_timestamp(F.lit(str(value)))


def in_range(df: DataFrame, start, end=None, ts: str = "flow_time") -> DataFrame:
    """Closed time range; also a date predicate so that partitions are pruned."""
    out = df.filter(F.col(ts) >= ts_lit(start))
    if "flow_date" in df.columns:
        out = out.filter(F.col("flow_date") >= F.to_date(ts_lit(start)))
    if end is not None:
        out = out.filter(F.col(ts) <= ts_lit(end))
        if "flow_date" in df.columns:
            out = out.filter(F.col("flow_date") <= F.to_date(ts_lit(end)))
    return out


def by_sensor(df: DataFrame, sensor: str | None = None, exporter_ip: str | None = None) -> DataFrame:
    out = df if not sensor else df.filter(F.col("sensor") == sensor)
    return out if not exporter_ip else out.filter(F.col("exporter_ip") == exporter_ip)


def interface_column(direction: str) -> str:
    """Traffic that an interface sends leaves by it, everything else enters by it."""
    return "output_if" if direction in SENDS else "input_if"


def by_interface(df: DataFrame, if_index: int, direction: str = "both") -> DataFrame:
    if direction in SENDS:
        return df.filter(F.col("output_if") == if_index)
    if direction in RECEIVES:
        return df.filter(F.col("input_if") == if_index)
    return df.filter((F.col("input_if") == if_index) | (F.col("output_if") == if_index))


def by_protocol(df: DataFrame, protocol: str | int | None) -> DataFrame:
    text = str(protocol or "any").strip().lower()
    if text in {"", "any", "all"}:
        return df
    if text == "dns":
        return df.filter((F.col("proto") == 17) & ((F.col("src_port") == 53) | (F.col("dst_port") == 53)))
    return df.filter(F.col("proto") == scalars.proto_number_literal(text))


def _sides(side: str) -> list[str]:
    return {"src": ["src_ip_key"], "dst": ["dst_ip_key"], "any": ["src_ip_key", "dst_ip_key"]}[side]


def by_ip(df: DataFrame, value: str, side: str = "any") -> DataFrame:
    """An address or block on the source, the destination or either side."""
    return df.filter(reduce(lambda a, b: a | b, [ip.key_in_cidr(F.col(c), value) for c in _sides(side)]))


def by_cidrs(df: DataFrame, cidrs: list[str], side: str = "any") -> DataFrame:
    """Any of up to 50 literal blocks; longer lists belong in a prefix table (see ``prefixes``)."""
    if not cidrs:
        return df
    if len(cidrs) > MAX_CIDRS:
        raise ValueError(f"at most {MAX_CIDRS} literal blocks; use prefixes.keep_matching for a table of blocks")
    return df.filter(reduce(lambda a, b: a | b, [ip.key_in_any(F.col(c), cidrs) for c in _sides(side)]))


def by_port(df: DataFrame, src: str = "any", dst: str = "any", either: str = "any") -> DataFrame:
    out = df.filter(scalars.port_matches(src, F.col("src_port"))).filter(scalars.port_matches(dst, F.col("dst_port")))
    text = (either or "any").strip()
    if text.startswith("!"):
        return out.filter(
            scalars.port_matches(text, F.col("src_port")) & scalars.port_matches(text, F.col("dst_port"))
        )
    return out.filter(scalars.port_matches(text, F.col("src_port")) | scalars.port_matches(text, F.col("dst_port")))


def syn_only(proto: Column, flags: Column) -> Column:
    return (proto == 6) & scalars.has_flag(flags, "SYN") & ~scalars.has_flag(flags, "ACK")


def tcp_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("proto") == 6)


def valid_vector(df: DataFrame, protocol: str = "protocol") -> DataFrame:
    """Rows that can be grouped into an attack vector."""
    return df.filter(
        F.col("dst_ip").isNotNull() & (F.trim("dst_ip") != "") & (F.col("dst_port") > 0)
        & F.col(protocol).isNotNull() & (F.col(protocol).cast("string") != "")
    )


# --- declarative filter lists ----------------------------------------------

# Accepted fields and operators.
FILTER_COLUMNS = {
    "protocol": ["proto"],
    "src_port": ["src_port"],
    "dst_port": ["dst_port"],
    "port": ["src_port", "dst_port"],
    "src_ip": ["src_ip_key"],
    "dst_ip": ["dst_ip_key"],
    "ip": ["src_ip_key", "dst_ip_key"],
    "src_prefix": ["src_ip_key"],
    "dst_prefix": ["dst_ip_key"],
    "prefix": ["src_ip_key", "dst_ip_key"],
    "src_asn": ["src_asn"],
    "dst_asn": ["dst_asn"],
    "asn": ["src_asn", "dst_asn"],
    "country": ["src_country", "dst_country"],
    "tcp_flags": ["tcp_flags"],
    "sensor": ["sensor"],
    "input_if": ["input_if"],
    "output_if": ["output_if"],
    "interface": ["input_if", "output_if"],
    "zone": ["src_zone", "dst_zone"],
    "subscriber": ["subscriber"],
    "ip_version": ["src_ip_key"],
    "addressing_mode": ["addressing_mode"],
    "exclude_internal": ["src_ip_key", "dst_ip_key"],
    "exclude_whitelist": ["whitelisted"],
}
FILTER_ALIASES = {"input_interface": "input_if", "output_interface": "output_if"}
FILTER_OPERATORS = (
    "eq", "neq", "in", "not_in", "gt", "gte", "lt", "lte", "contains", "not_contains",
    "exists", "not_exists", "prefix_contains", "prefix_not_contains", "between",
)
NUMERIC_FIELDS = {"src_port", "dst_port", "port", "input_if", "output_if", "interface", "src_asn", "dst_asn", "asn"}
ADDRESS_FIELDS = {"src_ip", "dst_ip", "ip", "src_prefix", "dst_prefix", "prefix"}
NEGATIVE = {"neq": "eq", "not_in": "in", "not_contains": "contains", "not_exists": "exists",
            "prefix_not_contains": "prefix_contains"}


def _truth(value: Any) -> bool:
    return value.strip().lower() in {"1", "true", "yes", "on"} if isinstance(value, str) else bool(value)


def check_filter(item: dict[str, Any]) -> dict[str, Any]:
    """One filter with its field, operator and value normalised, or ``ValueError``."""
    field = str(item.get("field") or "").strip().lower()
    field = FILTER_ALIASES.get(field, field)
    operator = str(item.get("operator") or "eq").strip().lower()
    if field not in FILTER_COLUMNS:
        raise ValueError(f"filter field not allowed: {field}")
    if operator not in FILTER_OPERATORS:
        raise ValueError(f"filter operator not allowed: {operator}")
    value = item.get("value")
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    if operator not in ("exists", "not_exists"):
        if not values:
            raise ValueError("filter without value")
        if operator == "between" and len(values) != 2:
            raise ValueError("between needs two values")
        if field in NUMERIC_FIELDS:
            values = [int(v) for v in values]
            top = 65535 if "port" in field else 4294967295
            if any(v < 0 or v > top for v in values):
                raise ValueError(f"value out of range for {field}")
        elif field in ADDRESS_FIELDS:
            values = [ip.norm_cidr_literal(str(v)) for v in values]
        elif field == "protocol":
            values = [v if str(v).lower() == "dns" else scalars.proto_number_literal(v) for v in values]
        elif field == "ip_version":
            values = [int(v) for v in values]
            if not set(values) <= {4, 6}:
                raise ValueError("ip_version must be 4 or 6")
        elif field == "addressing_mode":
            values = [str(v or "").strip().lower() for v in values]
            if not set(values) <= {"direct", "cgnat", "both"}:
                raise ValueError("addressing_mode must be direct, cgnat or both")
        elif field in ("exclude_internal", "exclude_whitelist"):
            values = [_truth(v) for v in values]
    return {"field": field, "operator": operator, "values": values}


def _positive(column: Column, field: str, operator: str, values: list[Any]) -> Column:
    if operator == "exists":
        text = column.cast("string")
        return column.isNotNull() & (text != "") & (text != "0" if field in NUMERIC_FIELDS else F.lit(True))
    if field in ADDRESS_FIELDS:
        if operator in ("eq", "in", "prefix_contains", "contains"):
            return ip.key_in_any(column, [str(v) for v in values])
        low, high = ip.cidr_literal(values[0])[0], ip.cidr_literal(values[-1])[1]
        return {"gt": column > high, "gte": column >= low, "lt": column < low, "lte": column <= high,
                "between": column.between(low, high)}[operator]
    if operator == "eq":
        return column == values[0]
    if operator == "in":
        return column.isin(*values)
    if operator in ("contains", "prefix_contains"):
        tests = [column.cast("string").contains(str(v)) for v in values]
        return reduce(lambda a, b: a | b, tests)
    return {"gt": column > values[0], "gte": column >= values[0], "lt": column < values[0],
            "lte": column <= values[0], "between": column.between(values[0], values[-1])}[operator]


def filter_predicate(item: dict[str, Any]) -> Column:
    """One checked filter as a predicate; either-side fields match when one side does."""
    field, operator, values = item["field"], item["operator"], item["values"]
    if field == "ip_version":
        test = ip.ip_version(F.col("src_ip_key")).isin(*values)
        return ~test if operator in NEGATIVE else test
    if field == "exclude_internal":
        both = ip.is_internal_key(F.col("src_ip_key")) & ip.is_internal_key(F.col("dst_ip_key"))
        return ~both if values[0] else F.lit(True)
    if field == "exclude_whitelist":
        return ~F.coalesce(F.col("whitelisted"), F.lit(False)) if values[0] else F.lit(True)
    if field == "addressing_mode" and "both" in values:
        return F.lit(True)
    positive = NEGATIVE.get(operator, operator)
    if field == "protocol" and any(str(v).lower() == "dns" for v in values):
        hit = (F.col("proto") == 17) & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))
        numbers = [v for v in values if str(v).lower() != "dns"]
        if numbers:
            hit = hit | _positive(F.col("proto"), field, positive, numbers)
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if operator in NEGATIVE else hit
    tests = [F.coalesce(_positive(F.col(c), field, positive, values), F.lit(False)) for c in FILTER_COLUMNS[field]]
    hit = reduce(lambda a, b: a | b, tests)
    return ~hit if operator in NEGATIVE else hit


def apply_filters(df: DataFrame, filters: list[dict[str, Any]]) -> DataFrame:
    """AND of up to 30 declarative filters; free SQL is never accepted.

    ``country``, ``zone``, ``subscriber``, ``addressing_mode`` and ``exclude_whitelist``
    need the columns that the matching enrichment adds.
    """
    if len(filters) > MAX_FILTERS:
        raise ValueError(f"at most {MAX_FILTERS} filters")
    for item in filters:
        df = df.filter(filter_predicate(check_filter(item)))
    return df
