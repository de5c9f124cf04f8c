"""Scalar functions on flow fields, each a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol names and numbers.
PROTOCOL_NUMBERS = {"icmp": 1, "tcp": 6, "udp": 17, "gre": 47, "esp": 50, "icmpv6": 58}

# TCP flag bits.
TCP_FLAG_BITS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128}

LOCAL_ZONE = "America/Sao_Paulo"
MILLISECOND_EPOCH_FLOOR = 10_000_000_000
MIN_RATE_SECONDS = 1.0

# Rate status labels.
RATE_ESTIMATED = "estimated_from_flow_duration"
RATE_UNAVAILABLE = "unavailable_no_flow_duration"


def blank_to_null(text: Column) -> Column:
    """``''``, ``null`` and ``NULL`` count as missing."""
    return F.when(text.isin("", "null", "NULL"), None).otherwise(text)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``: keeps plans and generated code small."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _unusual_int(text: Column) -> Column:
    """Hexadecimal, fractional or exponent text as an integer, null when it is none of these."""
    clean = F.trim(text)
    hex_digits = F.regexp_extract(clean, "^0[xX]([0-9a-fA-F]{1,15})$", 1)
    from_hex = F.when(hex_digits != "", F.conv(hex_digits, 16, 10).try_cast("bigint"))
    number = clean.try_cast("double")
    from_float = F.when(~F.isnan(number) & (F.abs(number) < 9.2e18), number.try_cast("bigint"))
    return F.coalesce(from_hex, from_float)


def safe_int(text: Column, default=0, low: int = 0, high: int | None = None) -> Column:
    """Integer from hex or decimal text; fractions are cut, failures give ``default``.

    Plain digits take a single cast; only other text reaches the slower forms.
    """
    plain = text.cast("string").try_cast("bigint")
    fallback = (default if isinstance(default, Column) else F.lit(default)).cast("bigint")
    value = F.greatest(F.coalesce(plain, bind(text.cast("string"), _unusual_int), fallback), F.lit(low).cast("bigint"))
    return value if high is None else F.least(value, F.lit(high).cast("bigint"))


# --- protocol --------------------------------------------------------------


def proto_num(text: Column) -> Column:
    """Protocol number from a name or number, clamped to 0..255."""
    plain = text.cast("string").try_cast("int")
    names = F.create_map(*[F.lit(v) for pair in PROTOCOL_NUMBERS.items() for v in pair])
    named = F.try_element_at(names, F.lower(F.trim(text.cast("string"))))
    return F.when(plain.between(0, 255), plain).otherwise(
        F.coalesce(named, safe_int(text.cast("string"), 0, 0, 255).cast("int"), F.lit(0))
    )


def proto_name(number: Column) -> Column:
    expression = F.concat(F.lit("PROTO-"), number.cast("string"))
    for name, value in PROTOCOL_NUMBERS.items():
        expression = F.when(number == value, F.lit(name.upper())).otherwise(expression)
    return expression


def vector_protocol(number: Column) -> Column:
    """Lowercase name used in attack-vector keys: udp, tcp, icmp, else the number as text."""
    return (
        F.when(number == 17, "udp").when(number == 6, "tcp").when(number == 1, "icmp").otherwise(number.cast("string"))
    )


def proto_number_literal(value: str | int) -> int:
    text = str(value).strip().lower()
    return PROTOCOL_NUMBERS[text] if text in PROTOCOL_NUMBERS else int(text)


# --- TCP flags -------------------------------------------------------------


def flags_num(text: Column) -> Column:
    """Flag bits from hex or decimal text, or from names joined by ``+``, ``|`` or ``,``."""

    def from_names(clean: Column) -> Column:
        bits = F.lit(0)
        tokens = F.split(clean, r"[+|,\s]+")
        for name, bit in TCP_FLAG_BITS.items():
            bits = bits + F.when(F.array_contains(tokens, name.lower()), bit).otherwise(0)
        return bits.cast("int")

    def parsed(clean: Column) -> Column:
        numeric = clean.rlike(r"^(0x.*|\d+\.?\d*|\.\d+)$")
        return F.when(numeric, safe_int(clean, 0, 0, 65535).cast("int")).otherwise(from_names(clean))

    plain = text.try_cast("int")
    return F.when(plain.between(0, 65535), plain).otherwise(F.coalesce(bind(F.lower(F.trim(text)), parsed), F.lit(0)))


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(TCP_FLAG_BITS[name])) != 0


def flags_name(flags: Column) -> Column:
    """``SYN+ACK`` style text, ``NONE`` when no known bit is set."""
    names = F.concat_ws("+", *[F.when(has_flag(flags, name), F.lit(name)) for name in TCP_FLAG_BITS])
    return F.when(names == "", F.lit("NONE")).otherwise(names)


# --- time ------------------------------------------------------------------


def _iso_ts(text: Column) -> Column:
    pattern = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(pattern), colon.try_cast("timestamp"))


def _epoch_ts(text: Column) -> Column:
    number = text.try_cast("double")
    seconds = F.when(number > MILLISECOND_EPOCH_FLOOR, number / 1000).otherwise(number)
    return F.when(seconds < 253402300800, F.timestamp_micros(F.round(seconds * 1000000).try_cast("bigint")))


def parse_ts(text: Column, now: Column | None = None) -> Column:
    """Timestamp from epoch seconds, epoch milliseconds or ISO text (naive means UTC).

    ``now`` replaces missing or unreadable values; without it they stay null.
    """

    def parsed(clean: Column) -> Column:
        return F.when(clean.rlike(r"^(\d+\.?\d*|\.\d+)$"), _epoch_ts(clean)).otherwise(_iso_ts(clean))

    value = F.when(blank_to_null(text).isNotNull(), bind(F.trim(text), parsed))
    return value if now is None else F.coalesce(value, now)


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the ``seconds``-wide bucket, counted from the epoch."""
    size = max(1, int(seconds))
    epoch = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(epoch - F.pmod(epoch, F.lit(size * 1_000_000)))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)


def minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def local_ts(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """ISO text with offset in the display time zone."""
    shifted = F.from_utc_timestamp(ts, zone)
    offset = ((F.unix_micros(shifted) - F.unix_micros(ts)) / 60_000_000).cast("int")
    sign = F.when(offset < 0, "-").otherwise("+")
    size = F.abs(offset)
    zone_text = F.concat(
        sign,
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )
    return F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), zone_text)


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- rates -----------------------------------------------------------------


def parse_duration_ms(text: Column, start: Column, end: Column) -> Column:
    """Exported duration, else end minus start when that is positive."""
    given = safe_int(text, 0, 0)
    span = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("bigint")
    return F.when(given > 0, given).when(end > start, F.greatest(span, F.lit(0).cast("bigint"))).otherwise(
        F.lit(0).cast("bigint")
    )


def duration_seconds(duration_ms: Column, start: Column, end: Column) -> Column:
    span = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000
    return F.when(duration_ms > 0, duration_ms / 1000).when(end > start, span)


def flow_rate(amount: Column, seconds: Column) -> Column:
    """Amount per second; null when the exported duration is missing or under a second."""
    return F.when(seconds >= MIN_RATE_SECONDS, amount / seconds)


def rate_status(seconds: Column) -> Column:
    return F.when(seconds >= MIN_RATE_SECONDS, F.lit(RATE_ESTIMATED)).otherwise(F.lit(RATE_UNAVAILABLE))


def pct(value: Column, total: Column, digits: int | None = 2) -> Column:
    """Share of total in percent, zero when the total is zero or missing."""
    share = F.coalesce(F.try_divide(value.cast("double"), total.cast("double")) * 100, F.lit(0.0))
    return share if digits is None else F.round(share, digits)


# --- text ------------------------------------------------------------------

# Unit steps of the readable formats.
UNIT_STEPS = {
    "bps": ((1e9, "Gbps"), (1e6, "Mbps"), (1e3, "Kbps")),
    "pps": ((1e6, "Mpps"), (1e3, "Kpps")),
    "B": ((1e9, "GB"), (1e6, "MB"), (1e3, "KB")),
    "": ((1e9, "G"), (1e6, "M"), (1e3, "K")),
}


def _short_number(value: Column) -> Column:
    one = F.format_string("%.1f", value)
    whole = F.format_string("%.0f", value)
    trimmed = F.regexp_replace(one, r"\.?0+$", "")
    return F.when((F.abs(value) < 1000) & (value != F.floor(value)), F.when(one.contains("."), trimmed)).otherwise(
        whole
    )


def humanize(value: Column, unit: str) -> Column:
    """Readable text of a rate or amount; ``unit`` is ``bps``, ``pps``, ``B`` or empty."""
    number = value.cast("double")
    expression = F.trim(F.concat(_short_number(number), F.lit(" " + unit)))
    for divisor, label in reversed(UNIT_STEPS[unit]):
        scaled = F.concat(_short_number(number / divisor), F.lit(" " + label))
        expression = F.when(F.abs(number) >= divisor, scaled).otherwise(expression)
    return F.when(number.isNull(), F.lit("-")).otherwise(expression)


def metric_text(value: Column, metric: str) -> Column:
    """Two-decimal text with a K, M, G or T step, used in peak reports."""
    suffix = {"bits_s": "bps", "packets_s": "pps"}.get(metric, metric)
    number = F.coalesce(value.cast("double"), F.lit(0.0))
    expression = F.concat(F.format_string("%.2f", number), F.lit(" " + suffix))
    for divisor, label in ((1e3, "K"), (1e6, "M"), (1e9, "G"), (1e12, "T")):
        scaled = F.concat(F.format_string("%.2f", number / divisor), F.lit(f" {label}{suffix}"))
        expression = F.when(F.abs(number) >= divisor, scaled).otherwise(expression)
    return expression


def conv_key(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, proto: Column) -> Column:
    return F.concat(
        src_ip, F.lit(":"), src_port.cast("string"), F.lit(" -> "),
        dst_ip, F.lit(":"), dst_port.cast("string"), F.lit("/"), proto.cast("string"),
    )


def ttl_seconds(text: Column) -> Column:
    """Seconds from ``30s``, ``15m``, ``2h`` or ``1d``; null when unreadable."""
    clean = F.lower(F.trim(text))
    amount = F.regexp_extract(clean, r"^(\d{1,12})\s*([smhd])$", 1).try_cast("bigint")
    unit = F.regexp_extract(clean, r"^(\d{1,12})\s*([smhd])$", 2)
    factor = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return amount * factor


def slug(text: Column) -> Column:
    replaced = F.regexp_replace(F.trim(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]", "_")
    return F.regexp_replace(replaced, "^_+|_+$", "")


def stable_key(prefix: str, **parts: Column) -> Column:
    """Deterministic key: ``prefix`` and the sha256 of ``name=value`` pairs in name order."""
    fields = [
        F.concat(F.lit(f"{name}="), F.coalesce(parts[name].cast("string"), F.lit(""))) for name in sorted(parts)
    ]
    return F.concat(F.lit(prefix + ":"), F.sha2(F.concat_ws("|", *fields), 256))


def asn_label(asn: Column, name: Column) -> Column:
    """Organisation name when known, else ``AS<n>``."""
    known = F.nullif(F.trim(F.coalesce(name, F.lit(""))), F.lit(""))
    return F.coalesce(known, F.concat(F.lit("AS"), asn.cast("string")))


# Sensitivity names and factors.
SENSITIVITY_ALIASES = {"alta": "high", "high": "high", "media": "medium", "média": "medium", "medium": "medium",
                       "baixa": "low", "low": "low"}
SENSITIVITY_FACTORS = {"high": 1.5, "medium": 2.0, "low": 3.0}


def sensitivity_factor_literal(name: str | None) -> float:
    return SENSITIVITY_FACTORS[SENSITIVITY_ALIASES.get(str(name or "medium").strip().lower(), "medium")]


def sensitivity_factor(name: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce(name, F.lit("medium"))))
    expression = F.lit(SENSITIVITY_FACTORS["medium"])
    for alias, level in SENSITIVITY_ALIASES.items():
        expression = F.when(clean == alias, F.lit(SENSITIVITY_FACTORS[level])).otherwise(expression)
    return expression


# --- ports -----------------------------------------------------------------


def port_matches(expression: str, port: Column) -> Column:
    """``any``, ``53``, ``53,123``, ``!53`` or ``!53,123`` as a predicate on a port column."""
    text = (expression or "any").strip().lower()
    if text in {"", "any", "all", "*"}:
        return F.lit(True)
    negated = text.startswith("!")
    ports = [int(part.strip().lstrip("!")) for part in text.split(",") if part.strip()]
    if any(p < 0 or p > 65535 for p in ports):
        raise ValueError(f"port out of range in {expression!r}")
    hit = port.isin(ports)
    return ~hit if negated else hit


def port_matches_column(expression: Column, port: Column) -> Column:
    """Same, with the expression itself in a column (rule tables)."""
    text = F.lower(F.trim(F.coalesce(expression, F.lit("any"))))
    body = F.regexp_replace(text, r"[!\s]", "")
    listed = F.array_contains(F.split(body, ","), port.cast("string"))
    return F.when(text.isin("", "any", "all", "*"), F.lit(True)).when(text.startswith("!"), ~listed).otherwise(listed)


# --- decoders --------------------------------------------------------------

def decoder_tests(proto: Column, sport: Column, dport: Column, flags: Column) -> dict[str, Column]:
    """One test per traffic decoder; a flow may pass several.

    ``FRAGMENT`` and ``INVALID`` are reserved: flow records do not carry what they need.
    """
    tcp, udp = proto == 6, proto == 17

    def either(*ports: int) -> Column:
        return sport.isin(*ports) | dport.isin(*ports)

    syn, ack, rst = has_flag(flags, "SYN"), has_flag(flags, "ACK"), has_flag(flags, "RST")
    known = {
        "TCP": tcp,
        "TCP+ALL": tcp,
        "TCP+SYN": tcp & syn & ~ack,
        "TCP+SYNACK": tcp & syn & ack,
        "TCP+ACK": tcp & ack & ~syn,
        "TCP+RST": tcp & rst,
        "TCP+NULL": tcp & (flags == 0),
        "UDP": udp,
        "ICMP": proto.isin(1, 58),
        "DNS": (tcp | udp) & either(53),
        "NTP": udp & either(123),
        "QUIC": udp & either(443, 8443),
        "UDP+QUIC": udp & either(443, 8443),
        "HTTP": tcp & either(80, 8080),
        "HTTPS": tcp & either(443, 8443),
        "MAIL": tcp & either(25, 110, 143, 465, 587, 993, 995),
        "SIP": (tcp | udp) & either(5060, 5061),
        "IPSEC": proto.isin(50, 51) | (udp & either(500, 4500)),
        "NETBIOS": (tcp | udp) & either(137, 138, 139),
        "MEMCACHED": (tcp | udp) & either(11211),
    }
    # All port-based decoders ride on TCP or UDP, so these four cover "none matched".
    other = ~(tcp | udp | proto.isin(1, 58) | proto.isin(50, 51))
    return {"IP": F.lit(True), **known, "FLOWS": F.lit(True), "OTHER": other}


def decoders(proto: Column, sport: Column, dport: Column, flags: Column) -> Column:
    """All decoder names a flow passes, as an array."""
    tests = decoder_tests(proto, sport, dport, flags)
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


# --- redaction -------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"\b({_OCTET}\.{_OCTET}\.{_OCTET})\.{_OCTET}\b"
_IPV6_FULL = r"\b([0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){3})(?::[0-9A-Fa-f]{1,4}){4}\b"
_IPV6_GAP = r"\b(?=[0-9A-Fa-f:]*::)([0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){0,3})[0-9A-Fa-f:]*"
# IPv4 ranges that are not globally reachable.
_PRIVATE = (
    rf"\b(?:(?:0|10|127|24\d|25[0-5])(?:\.{_OCTET}){{3}}"
    rf"|172\.(?:1[6-9]|2\d|3[01])(?:\.{_OCTET}){{2}}|198\.1[89](?:\.{_OCTET}){{2}}"
    rf"|(?:192\.168|169\.254)(?:\.{_OCTET}){{2}}"
    rf"|(?:192\.0\.0|192\.0\.2|198\.51\.100|203\.0\.113)\.{_OCTET})\b"
)
# Redaction policies and labels.
POLICIES = ("mask_ips", "remove_internal_ips", "remove_client_names", "remove_descriptions", "aggregates_only")


def redact(text: Column, policy: str, external: bool = False) -> Column:
    """Mask or remove addresses, client names and descriptions under a policy."""
    result = text
    if policy in ("mask_ips", "aggregates_only"):
        result = F.regexp_replace(result, _IPV4, "$1.x")
        result = F.regexp_replace(result, _IPV6_FULL, "$1:xxxx")
        result = F.regexp_replace(result, _IPV6_GAP, "$1:xxxx")
    if external or policy in ("remove_internal_ips", "aggregates_only"):
        result = F.regexp_replace(result, _PRIVATE, "[internal-ip]")
    if policy in ("remove_client_names", "aggregates_only"):
        result = F.regexp_replace(result, r"(?i)(client|cliente|customer)[=: ]+[^,;\n]+", "cliente=[removido]")
    if policy in ("remove_descriptions", "aggregates_only"):
        result = F.regexp_replace(
            result, r"(?iu)(description|descrição|descricao)[=: ]+[^,;\n]+", "descrição=[removida]"
        )
    return result
