"""Address functions as Column expressions.

Spark has no address type.  An address is kept as display text plus a *key*:
32 lowercase hex digits of the 128-bit value, with IPv4 in its IPv4-mapped
form.  All keys have the same width, so string order is address order, a CIDR
block is one ``between`` on the key and Parquet min/max statistics prune it.

Everything here stays in the JVM; no Python UDF is needed, not even for IPv6.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirgauge.functions.scalars import bind

MAPPED_KEY_PREFIX = "0" * 20 + "ffff"
MAPPED_TEXT_PREFIX = "::ffff:"
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_IPV4_TAIL = rf"{_OCTET}(\.{_OCTET}){{3}}$"


def _hex8(ipv4: Column) -> Column:
    part = [F.substring_index(F.substring_index(ipv4, ".", n), ".", -1).try_cast("bigint") for n in (1, 2, 3, 4)]
    number = ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3]
    return F.lower(F.lpad(F.hex(number), 8, "0"))


def ipv4_key(ipv4: Column) -> Column:
    """Key of text already known to be a valid dotted quad."""
    return F.concat(F.lit(MAPPED_KEY_PREFIX), _hex8(ipv4))


def _dotted_tail_as_groups(text: Column) -> Column:
    """``::ffff:1.2.3.4`` with its dotted quad written as two hexadecimal groups."""

    def rewrite(tail: Column) -> Column:
        digits = _hex8(tail)
        head = F.regexp_replace(text, _IPV4_TAIL, "")
        return F.concat(head, F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))

    return F.when(text.contains("."), bind(F.regexp_extract(text, _IPV4_TAIL, 0), rewrite)).otherwise(text)


def _ipv6_key(text: Column) -> Column:
    """Key of IPv6 text, null when the text is not an address."""

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: part != "")

    def padded(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda g: F.lpad(g, 4, "0")), "")

    def assemble(halves: Column) -> Column:
        left, right, has_gap = halves["left"], halves["right"], halves["gap"]
        count = F.size(left) + F.size(right)
        well_formed = F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.when(
            has_gap, count <= 7
        ).otherwise(count == 8)
        return F.when(well_formed, F.concat(padded(left), F.repeat(F.lit("0000"), F.lit(8) - count), padded(right)))

    def split(body: Column) -> Column:
        gap = body.contains("::")
        right = F.when(gap, F.substring_index(body, "::", -1)).otherwise(F.lit(""))
        halves = F.struct(
            groups(F.substring_index(body, "::", 1)).alias("left"), groups(right).alias("right"), gap.alias("gap")
        )
        return F.when(~body.rlike("::.*::|:::"), bind(halves, assemble))

    return bind(_dotted_tail_as_groups(F.lower(text)), split)


def ip_key(text: Column) -> Column:
    """Key of IPv4 or IPv6 text; null when the text is not an address."""
    clean = F.trim(text)
    return F.when(clean.rlike(IPV4_PATTERN), ipv4_key(clean)).when(clean.contains(":"), bind(clean, _ipv6_key))


def _octets_text(key: Column) -> Column:
    return F.concat_ws(".", *[F.conv(F.substring(key, pos, 2), 16, 10) for pos in (25, 27, 29, 31)])


def _compressed_groups(key: Column) -> Column:
    groups = [F.regexp_replace(F.substring(key, 1 + 4 * i, 4), "^0{1,3}", "") for i in range(8)]

    def compress(full: Column) -> Column:
        # The first of the longest runs of zero groups (two or more) is compressed.
        shown = full
        for run in range(2, 9):
            pattern = rf"^(|.*?:)0(?::0){{{run - 1}}}(|:.*)$"
            gap = F.regexp_replace(F.regexp_replace(full, pattern, "$1|$2"), r"^\||\|$", ":")
            shown = F.when(full.rlike(pattern), F.replace(gap, F.lit("|"), F.lit(""))).otherwise(shown)
        return F.when(key.isNull(), None).when(full == "0:0:0:0:0:0:0:0", "::").otherwise(shown)

    return bind(F.concat_ws(":", *groups), compress)


def key_text(key: Column) -> Column:
    """Canonical text of a key: dotted quad for IPv4, compressed text for IPv6."""
    return F.when(key.startswith(MAPPED_KEY_PREFIX), _octets_text(key)).otherwise(_compressed_groups(key))


def safe_ip(text: Column, default: str = "::") -> Column:
    """Canonical address text, ``default`` when the text is not an address."""
    clean = F.trim(text)

    def shown(key: Column) -> Column:
        mapped = F.concat(F.lit(MAPPED_TEXT_PREFIX), _octets_text(key))
        return F.when(key.startswith(MAPPED_KEY_PREFIX), mapped).otherwise(_compressed_groups(key))

    v6 = F.when(clean.contains(":"), bind(clean, lambda t: bind(_ipv6_key(t), shown)))
    return F.when(clean.rlike(IPV4_PATTERN), clean).otherwise(F.coalesce(v6, F.lit(default)))


def to_mapped(text: Column) -> Column:
    """IPv4 text in IPv4-mapped form, IPv6 text unchanged."""
    return F.when(text.rlike(IPV4_PATTERN), F.concat(F.lit(MAPPED_TEXT_PREFIX), text)).otherwise(text)


def display_ip(text: Column) -> Column:
    """Strip the IPv4-mapped prefix for display."""
    return F.regexp_replace(F.trim(text), "(?i)^::ffff:(?=[0-9.]+$)", "")


def is_ipv4_key(key: Column) -> Column:
    return key.startswith(MAPPED_KEY_PREFIX)


def ip_version(key: Column) -> Column:
    return F.when(is_ipv4_key(key), F.lit(4)).otherwise(F.lit(6))


# --- CIDR blocks -----------------------------------------------------------


def cidr_literal(cidr: str) -> tuple[str, str, int]:
    """``(low key, high key, prefix length of 128)`` of a literal block or address."""
    network = ipaddress.ip_network(cidr.strip(), strict=False)
    low, high, length = int(network.network_address), int(network.broadcast_address), network.prefixlen
    if network.version == 4:
        low, high, length = low + (0xFFFF << 32), high + (0xFFFF << 32), length + 96
    return f"{low:032x}", f"{high:032x}", length


def norm_cidr_literal(cidr: str) -> str:
    """A literal block with its host bits cleared."""
    return str(ipaddress.ip_network(cidr.strip(), strict=False))


def cidr_length(cidr: Column) -> Column:
    """Prefix length of 128; a bare address counts as a full-length block."""
    host = F.substring_index(cidr, "/", 1)
    bits = F.when(cidr.contains("/"), F.substring_index(cidr, "/", -1).try_cast("int"))
    v4 = ~host.contains(":")
    return F.when(v4, F.coalesce(bits, F.lit(32)) + 96).otherwise(F.coalesce(bits, F.lit(128)))


def _nibble(key: Column, position: Column) -> Column:
    return F.conv(F.substr(key, position, F.lit(1)), 16, 10).cast("int")


def _filled(key: Column, length: Column, low: bool) -> Column:
    """``key`` with every bit past ``length`` set to zero (low) or one."""
    whole = F.floor(length / 4).cast("int")
    spare = (length % 4).cast("int")
    nibble = _nibble(key, whole + 1)
    step = F.element_at(F.array(F.lit(16), F.lit(8), F.lit(4), F.lit(2)), spare + 1)
    floor = (nibble - nibble % step).cast("int")
    edge = floor if low else floor + step - 1
    fill = "0" if low else "f"
    masked = F.concat(
        F.substr(key, F.lit(1), whole),
        F.lower(F.hex(edge)),
        F.repeat(F.lit(fill), F.lit(31) - whole),
    )
    return F.when(length >= 128, key).otherwise(masked)


def _block_edge(key: Column, length: Column, low: bool) -> Column:
    return bind(F.struct(key.alias("k"), length.alias("n")), lambda s: _filled(s["k"], s["n"], low))


def network_key(key: Column, length: Column) -> Column:
    """First address of the block of ``length`` bits that holds ``key``."""
    return _block_edge(key, length, low=True)


def network_last_key(key: Column, length: Column) -> Column:
    """Last address of the block of ``length`` bits that holds ``key``."""
    return _block_edge(key, length, low=False)


def network_key_at(key: Column, length: int) -> Column:
    """``network_key`` for a length known when the plan is built: one substring."""
    whole, spare = divmod(length, 4)
    if length >= 128:
        return key
    if spare == 0:
        return F.rpad(F.substring(key, 1, whole), 32, "0") if whole else F.lit("0" * 32)
    step = 16 >> spare
    nibble = F.conv(F.substring(key, whole + 1, 1), 16, 10).cast("int")
    edge = F.lower(F.hex(nibble - nibble % step))
    return F.concat(F.substring(key, 1, whole), edge, F.lit("0" * (31 - whole)))


def norm_cidr(cidr: Column) -> Column:
    """Block text with its host bits cleared; null when unreadable."""

    def shown(block: Column) -> Column:
        bits = F.when(is_ipv4_key(block["k"]), block["n"] - 96).otherwise(block["n"])
        return F.concat(key_text(block["k"]), F.lit("/"), bits.cast("string"))

    def cleared(text: Column) -> Column:
        length = cidr_length(text)
        key = ip_key(F.substring_index(text, "/", 1))
        return bind(F.struct(network_key(key, length).alias("k"), length.alias("n")), shown)

    return bind(cidr, cleared)


def key_in_cidr(key: Column, cidr: str) -> Column:
    """Address-in-block test against a literal block; pushes down to Parquet."""
    low, high, _ = cidr_literal(cidr)
    return key == low if low == high else key.between(low, high)


def key_in_any(key: Column, cidrs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [key_in_cidr(key, c) for c in cidrs])


# --- labels ----------------------------------------------------------------


def prefix64(key: Column) -> Column:
    """``/64`` block label.  All IPv4 falls in ``::/64`` because keys are mapped."""
    return F.concat(key_text(F.rpad(F.substring(key, 1, 16), 32, "0")), F.lit("/64"))


def prefix24(text: Column) -> Column:
    """``/24`` label of IPv4 text, empty for anything else."""
    label = F.concat(F.substring_index(text, ".", 3), F.lit(".0/24"))
    return F.when(text.rlike(IPV4_PATTERN), label).otherwise(F.lit(""))


def host_cidr(text: Column) -> Column:
    """Single-host block; text that already names a block is kept."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when((clean == "") | clean.contains("/"), clean)
        .when(clean.contains(":"), F.concat(clean, F.lit("/128")))
        .otherwise(F.concat(clean, F.lit("/32")))
    )


# Ranges treated as private or otherwise internal.
INTERNAL_CIDRS = [
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "fc00::/7",
    "fe80::/10",
    "::1/128",
]


def is_internal_key(key: Column) -> Column:
    return key_in_any(key, INTERNAL_CIDRS)
