"""Joins between addresses and prefix tables.

Blocks of any length are spread to the next whole byte (at most 128 pieces each), and pieces
of the same address range keep the longest block as their owner.  What is left are disjoint
intervals for each number of bytes, named by the leading digits of their addresses.  An
address looks its own digits up, longest first: an ordinary equi-join for each number of
bytes that occurs (at most 16, four for IPv4), each of which meets one row at most.  So rows
never multiply, nothing is joined back, the facts are read once, and Spark broadcasts each
level by its own measured size.  Callers should aggregate flows first where they can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.functions import ip, scalars
from weirgauge.operators.listing import checked
from weirgauge.session import staged


def prefix_table(df: DataFrame, cidr: str = "prefix") -> DataFrame:
    """Add ``plen`` (of 128) and ``net_key`` to a table of blocks; unreadable blocks are dropped."""
    key = ip.ip_key(F.substring_index(F.col(cidr), "/", 1))
    return (
        df.withColumns({"__key": key, "plen": ip.cidr_length(F.col(cidr))})
        .filter("__key IS NOT NULL AND plen BETWEEN 0 AND 128")
        .withColumn("net_key", ip.network_key(F.col("__key"), F.col("plen")))
        .drop("__key")
    )


def pieces(prefixes: DataFrame) -> DataFrame:
    """Each block of a prefix table as byte-wise pieces: ``__digits`` are the leading digits of ``__bytes`` bytes."""
    whole = F.greatest(F.ceil(F.col("plen") / 8), F.lit(1)).cast("int")
    spread = F.pow(F.lit(2.0), F.col("__bytes") * 8 - F.col("plen"))
    first = F.conv(F.substr(F.col("net_key"), F.col("__bytes") * 2 - 1, F.lit(2)), 16, 10).cast("int")
    last = F.lower(F.lpad(F.hex(first + F.col("__piece")), 2, "0"))
    return (
        prefixes.withColumn("__bytes", whole)
        .withColumn("__piece", F.explode(F.sequence(F.lit(0), spread.cast("int") - 1)))
        .withColumn("__digits", F.concat(F.substr(F.col("net_key"), F.lit(1), F.col("__bytes") * 2 - 2), last))
        .drop("__piece")
    )


def _levels(table: DataFrame) -> list[int]:
    """Numbers of bytes that occur, longest first; at most 16 integers reach the driver."""
    return sorted((row[0] for row in table.select("__bytes").distinct().collect()), reverse=True)


def _digits(key: str, many: int) -> Column:
    return F.substring(F.col(key), 1, 2 * many)


def match_prefixes(addresses: DataFrame, key: str, prefixes: DataFrame, also: Column | None = None) -> DataFrame:
    """Every prefix that holds each address: inner join, all matching pairs of address and prefix.

    ``also`` is a further condition; equalities in it become part of the join key.
    """
    table = pieces(prefixes)
    levels = _levels(table)
    if not levels:
        return addresses.limit(0).join(prefixes.limit(0), F.lit(False)).drop("net_key")
    exploded = addresses.withColumn("__cut", F.explode(F.array(*[_digits(key, n) for n in levels])))
    same = F.col("__cut") == F.col("__digits")
    return exploded.join(table, same if also is None else same & also, "inner").drop("__cut", "__digits", "__bytes", "net_key")


def _looked_up(df: DataFrame, key: str, owners: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``df`` with the owner of each level, longest first; ``owners(__bytes, __digits, own)`` has one row for each range."""
    stored = staged(owners)
    found = []
    for n in _levels(stored):
        level = stored.filter(F.col("__bytes") == n).select(F.col("__digits").alias(f"__cut{n}"), F.col("own").alias(f"__own{n}"))
        df = df.join(level, _digits(key, n) == F.col(f"__cut{n}"), "left").drop(f"__cut{n}")
        found.append(F.col(f"__own{n}"))
    return df, found


def longest_prefix(df: DataFrame, key: str, prefixes: DataFrame, payload: dict[str, str]) -> DataFrame:
    """Left join with the longest prefix that holds ``key``.

    ``payload`` maps prefix-table columns to output names.  Equal lengths are decided
    by the payload values so that the result does not depend on row order.
    """
    fields = F.struct(*[F.col(c).alias(n) for c, n in payload.items()])
    # Rows of one block are one row before the block is spread: what is spread are distinct blocks.
    blocks = prefixes.groupBy("plen", "net_key").agg(F.max(fields).alias("__own"))
    owners = pieces(blocks).groupBy("__bytes", "__digits").agg(F.max_by("__own", F.struct("plen", "__own")).alias("own"))
    joined, found = _looked_up(df, key, owners)
    own = F.coalesce(*found) if found else F.lit(None).cast(owners.schema["own"].dataType)
    return joined.withColumn("__own", own).select(*df.columns, *[F.col(f"__own.{n}").alias(n) for n in payload.values()])


def keep_matching(df: DataFrame, key: str, prefixes: DataFrame, anti: bool = False) -> DataFrame:
    """Rows whose address lies in (or with ``anti`` outside) any block of a table."""
    held = longest_prefix(df, key, prefixes.select("plen", "net_key", F.lit(True).alias("__in")), {"__in": "__in"})
    return held.filter(F.col("__in").isNull() if anti else F.col("__in").isNotNull()).drop("__in")


# --- ASN -------------------------------------------------------------------


def resolve_asn(df: DataFrame, prefixes: DataFrame, side: str = "src") -> DataFrame:
    """ASN of one side: the exported number if non-zero, else the longest prefix, else unresolved.

    Adds ``<side>_asn_resolved``, ``<side>_asn_name`` and ``<side>_asn_state``
    (``flow``, ``prefix`` or ``unresolved``).
    """
    key, asn, name = f"{side}_ip_key", f"{side}_asn", f"{side}_as_name"
    # Rows that bring their own number are looked up too: a null key for them would be a hot one.
    found = longest_prefix(df, key, prefixes, {"asn": "__asn", "as_name": "__name"})
    own = F.coalesce(F.col(asn), F.lit(0)) > 0
    return found.select(
        *df.columns,
        F.when(own, F.col(asn)).otherwise(F.coalesce(F.col("__asn"), F.lit(0))).cast("bigint").alias(f"{side}_asn_resolved"),
        F.when(own, F.col(name)).otherwise(F.coalesce(F.col("__name"), F.lit(""))).alias(f"{side}_asn_name"),
        F.when(own, "flow").when(F.col("__asn").isNotNull(), "prefix").otherwise("unresolved").alias(f"{side}_asn_state"),
    )


def asn_queue(flows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Addresses without an exported ASN and without a prefix, with the traffic they carried."""
    sides = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip"), F.col("src_ip_key").alias("key"), F.col("src_asn").alias("asn")),
            F.struct(F.col("dst_ip").alias("ip"), F.col("dst_ip_key").alias("key"), F.col("dst_asn").alias("asn")),
        )
    ).alias("side")
    seen = (
        flows.select("bytes", sides)
        .filter("side.asn = 0")
        .groupBy(F.col("side.ip").alias("ip"), F.col("side.key").alias("ip_key"))
        .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("flows"))
    )
    return keep_matching(seen, "ip_key", prefixes, anti=True)


def with_country(df: DataFrame, asn: str, countries: DataFrame) -> DataFrame:
    """Country of an ASN column, ``N/D`` when unknown; ``countries(asn, country)`` has one row per ASN."""
    known = countries.select(F.col("asn").alias("__asn"), F.col("country").alias("__country"))
    joined = df.join(known, F.col(asn) == F.col("__asn"), "left")
    return joined.select(*df.columns, F.coalesce("__country", F.lit("N/D")).alias("country"))


# --- zones and whitelists ---------------------------------------------------


def with_zone(df: DataFrame, zone_prefixes: DataFrame, side: str = "src") -> DataFrame:
    """Zone of one side by longest active prefix; null outside every zone."""
    active = zone_prefixes.filter(F.col("active").cast("int") == 1)
    return longest_prefix(
        df, f"{side}_ip_key", active, {"zone_name": f"{side}_zone", "prefix_type": f"{side}_prefix_type"}
    )


CONTROLS = ["use_global_whitelist", "extra_whitelist_ids", "bypass_whitelist"]


def whitelist_hits(df: DataFrame, key: str, whitelist: DataFrame, out: str = "whitelist_name") -> DataFrame:
    """Name of the whitelist entry that excludes a row, null when none does.

    ``whitelist`` is a prefix table with ``whitelist_id``, ``name`` and ``is_global``.
    Each row brings its rule's controls: global entries count only with
    ``use_global_whitelist``, others only when listed in ``extra_whitelist_ids``, and
    ``bypass_whitelist`` switches all of them off.
    """
    entry = F.struct("whitelist_id", "name", "is_global")
    listed = pieces(whitelist).groupBy("__bytes", "__digits").agg(F.collect_set(entry).alias("own"))  # entries over one address
    joined, found = _looked_up(df, key, listed)
    if not found:
        return df.withColumn(out, F.lit(None).cast("string"))

    def applies(e: Column) -> Column:
        on = (e["is_global"] & F.coalesce(F.col("use_global_whitelist"), F.lit(True))) | F.coalesce(
            F.array_contains("extra_whitelist_ids", e["whitelist_id"]), F.lit(False)
        )
        return on & ~F.coalesce(F.col("bypass_whitelist"), F.lit(False))

    none = F.array().cast(listed.schema["own"].dataType)
    every = F.concat(*[F.coalesce(f, none) for f in found])
    return joined.withColumn("__hit", F.array_min(F.filter(every, applies))).select(*df.columns, F.col("__hit.name").alias(out))


def drop_whitelisted(df: DataFrame, key: str, whitelist: DataFrame) -> DataFrame:
    return whitelist_hits(df, key, whitelist, "__name").filter("__name IS NULL").drop("__name")


# --- traffic by prefix ------------------------------------------------------


def prefix_traffic_1m(flows: DataFrame, customer_prefixes: DataFrame) -> DataFrame:
    """Traffic per minute, customer prefix and direction.

    A flow counts as upload for the prefix of its source and as download for the prefix
    of its destination.  Rows are reduced to one per minute, sensor and address before
    the prefix join.
    """
    enabled = customer_prefixes.filter(F.col("enabled").cast("int") == 1)
    sides = F.explode(
        F.array(
            F.struct(F.lit("upload").alias("direction"), F.col("src_ip_key").alias("key")),
            F.struct(F.lit("download").alias("direction"), F.col("dst_ip_key").alias("key")),
        )
    ).alias("side")
    by_address = (
        flows.select(scalars.minute(F.col("flow_time")).alias("minute"), "sensor", "bytes", "packets", "flow_count", sides)
        .groupBy("minute", "sensor", F.col("side.direction").alias("direction"), F.col("side.key").alias("ip_key"))
        .agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.sum("flow_count").alias("flows"))
    )
    named = longest_prefix(
        by_address, "ip_key", enabled, {"customer_id": "customer_id", "customer_name": "customer_name", "prefix": "prefix"}
    )
    return (
        named.filter("prefix IS NOT NULL")
        .groupBy("minute", "sensor", "customer_id", "customer_name", "prefix", "direction")
        .agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.sum("flows").alias("flows"))
    )


def _place(group_by: str, side: str) -> Column:
    return {
        "city": F.coalesce(F.col(f"{side}_city"), F.lit("N/D")),
        "country": F.coalesce(F.col(f"{side}_country"), F.lit("N/D")),
        "asn": F.concat(F.lit("AS"), F.col(f"{side}_asn").cast("string")),
        "ip": F.col(f"{side}_ip"),
    }[group_by]


def geo_edges(flows: DataFrame, geo: DataFrame, group_by: str = "city", top_n: int = 100, seconds: int = 3600) -> DataFrame:
    """Heaviest edges between places with rates, flow count and the main protocol and ASN of each.

    ``geo`` is a prefix table with ``lat``, ``lon``, ``city`` and ``country``.  Traffic is
    first reduced to address pairs; only those meet the two prefix joins.
    """
    keys = ["src_ip", "src_ip_key", "dst_ip", "dst_ip_key", "proto", "src_asn", "dst_asn"]
    located = flows.groupBy(*keys).agg(
        F.sum(F.col("bytes") * F.col("rate")).alias("bytes"),
        F.sum(F.col("packets") * F.col("rate")).alias("packets"),
        F.sum("flow_count").alias("flows"),
    )
    for side in ("src", "dst"):
        located = longest_prefix(
            located, f"{side}_ip_key", geo,
            {"city": f"{side}_city", "country": f"{side}_country", "lat": f"{side}_lat", "lon": f"{side}_lon"},
        )
    sums = [F.sum(c).alias(c) for c in ("bytes", "packets", "flows")]
    spots = [F.min(f"{s}_{c}").alias(f"{s}_{c}") for s in ("src", "dst") for c in ("lat", "lon")]
    # Read by the totals, the protocols and the ASNs: stored once, the flows are scanned once.
    per_detail = staged(
        located.withColumns({"src_place": _place(group_by, "src"), "dst_place": _place(group_by, "dst")})
        .groupBy("src_place", "dst_place", "proto", "dst_asn")
        .agg(*sums, *spots)
    )
    weight = {c: F.struct(F.col("bytes"), F.col(c)) for c in ("proto", "dst_asn")}
    by_proto = per_detail.groupBy("src_place", "dst_place", "proto").agg(*sums).groupBy("src_place", "dst_place").agg(
        F.max_by("proto", weight["proto"]).alias("top_proto")
    )
    by_asn = per_detail.groupBy("src_place", "dst_place", "dst_asn").agg(*sums).groupBy("src_place", "dst_place").agg(
        F.max_by("dst_asn", weight["dst_asn"]).alias("top_asn")
    )
    edges = per_detail.groupBy("src_place", "dst_place").agg(*sums, *[F.min(c).alias(c) for c in (
        "src_lat", "src_lon", "dst_lat", "dst_lon")])
    top = edges.orderBy(F.desc("bytes"), "src_place", "dst_place").limit(checked(top_n))
    return (
        top.join(by_proto, ["src_place", "dst_place"])
        .join(by_asn, ["src_place", "dst_place"])
        .select(
            "src_place", "dst_place", "src_lat", "src_lon", "dst_lat", "dst_lon",
            F.round(F.col("bytes") * 8 / seconds, 2).alias("bits_s"),
            F.round(F.col("packets") / seconds, 2).alias("packets_s"),
            "flows",
            scalars.proto_name(F.col("top_proto")).alias("top_protocol"),
            "top_asn",
        )
    )
