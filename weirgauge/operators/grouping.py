"""Grouping the flows of an incident into vectors and finding the dominant one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirgauge.functions import ip, scalars
from weirgauge.operators.filters import valid_vector

# What makes a group dominant.
DEFAULTS = {
    "min_unique_sources": 2,
    "min_share_packets": 50.0,
    "min_share_bytes": 50.0,
    "min_packets": 1000,
    "min_bytes": 1_000_000,
}
FLOW_IDENTITY = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol", "bytes", "packets", "flow_count", "flow_time"]
VECTOR = ["dst_ip", "dst_port", "protocol"]


def distinct_flows(*sources: DataFrame, key: str = "incident_id") -> DataFrame:
    """Flows of several lists with repeats removed by their full identity."""
    merged = sources[0]
    for extra in sources[1:]:
        merged = merged.unionByName(extra)
    return merged.dropDuplicates([key, *FLOW_IDENTITY])


def incident_flows(flows: DataFrame, key: str = "incident_id") -> DataFrame:
    """Flow rows in the shape of this module, without those that cannot form a vector."""
    named = flows.withColumns(
        {
            "protocol": scalars.vector_protocol(F.col("proto")),
            "flow_count": F.greatest(F.coalesce("flow_count", F.lit(1)), F.lit(1)),
        }
    )
    return valid_vector(named).select(key, *FLOW_IDENTITY)


def flow_groups(flows: DataFrame, key: str = "incident_id") -> DataFrame:
    """Totals, shares and distinct sources per incident and vector."""
    groups = flows.groupBy(key, *VECTOR).agg(
        F.sum("bytes").alias("total_bytes"),
        F.sum("packets").alias("total_packets"),
        F.sum("flow_count").alias("total_flow_count"),
        F.count(F.lit(1)).alias("flows_count"),
        F.count_distinct(F.when(F.col("src_ip") != "", F.col("src_ip"))).alias("unique_src_ips"),
        F.count_distinct(F.when(F.col("src_port") > 0, F.col("src_port"))).alias("unique_src_ports"),
        F.min("src_ip").alias("first_src_ip"),
    )
    totals = groups.groupBy(key).agg(
        F.sum("total_bytes").alias("all_bytes"), F.sum("total_packets").alias("all_packets"),
        F.sum("flows_count").alias("all_flows"),
    )
    return groups.join(totals, key).withColumns(
        {
            "share_bytes_percent": scalars.pct(F.col("total_bytes"), F.col("all_bytes")),
            "share_packets_percent": scalars.pct(F.col("total_packets"), F.col("all_packets")),
        }
    )


def dominant(groups: DataFrame, key: str = "incident_id", **params) -> DataFrame:
    """The leading group of each incident that clearly dominates; other incidents give no row.

    Only the two heaviest groups of an incident are needed, and Spark keeps just those
    before the shuffle.
    """
    p = {**DEFAULTS, **params}
    order = Window.partitionBy(key).orderBy(
        F.desc("total_packets"), F.desc("total_bytes"), F.desc("flows_count"), "dst_ip", "dst_port", "protocol"
    )
    two = groups.withColumn("__rn", F.row_number().over(order)).filter("__rn <= 2")
    rest = [c for c in groups.columns if c != key]
    pairs = two.groupBy(key).agg(
        F.max(F.when(F.col("__rn") == 1, F.struct(*rest))).alias("top"),
        F.max(F.when(F.col("__rn") == 2, F.struct("total_packets", "total_bytes"))).alias("next"),
    )
    volume = (F.col("top.total_packets") >= p["min_packets"]) | (F.col("top.total_bytes") >= p["min_bytes"])
    share = (F.col("top.share_packets_percent") >= p["min_share_packets"]) | (
        F.col("top.share_bytes_percent") >= p["min_share_bytes"]
    )
    sources = F.col("top.unique_src_ips") >= p["min_unique_sources"]
    larger = F.col("next").isNull() | (
        (F.col("top.total_packets") >= F.greatest(F.col("next.total_packets") * 3, F.lit(1)))
        | (F.col("top.total_bytes") >= F.greatest(F.col("next.total_bytes") * 3, F.lit(1)))
    )
    return pairs.filter(volume & share & (sources | larger)).select(key, "top.*")


def split_noise(flows: DataFrame, dominants: DataFrame, key: str = "incident_id") -> DataFrame:
    """Flows of incidents with a dominant group, marked primary or tail."""
    lead = dominants.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in VECTOR])
    joined = flows.join(lead, F.col(key) == F.col("__key"))
    primary = (F.col("dst_ip") == F.col("__dst_ip")) & (F.col("dst_port") == F.col("__dst_port")) & (
        F.col("protocol") == F.col("__protocol")
    )
    return joined.select(
        *flows.columns,
        primary.alias("is_primary"),
        F.when(~primary, "not_part_of_primary_vector").alias("noise_classification"),
        F.when(~primary, "tail_flows").alias("noise_reason"),
    )


def noise_counts(marked: DataFrame, key: str = "incident_id") -> DataFrame:
    return marked.groupBy(key).agg(
        F.count_if("is_primary").alias("primary_flows"), F.count_if(~F.col("is_primary")).alias("ignored_noise_flows_count")
    )


def attack_vector(direction: Column, protocol: Column) -> Column:
    return (
        F.when(F.lower(direction).isin("outbound", "sends") & (protocol == "udp"), "udp_flood_outbound_to_single_destination_port")
        .when(protocol == "tcp", "tcp_flow_to_single_destination_port")
        .otherwise(F.concat(F.coalesce(F.nullif(protocol, F.lit("")), F.lit("unknown")), F.lit("_to_single_destination_port")))
    )


def incident_from_group(incidents: DataFrame, dominants: DataFrame, key: str = "incident_id") -> DataFrame:
    """Incidents rewritten from their dominant group; those without one stay as they are."""
    lead = dominants.select(F.col(key).alias("__key"), F.struct(*[c for c in dominants.columns if c != key]).alias("dominant"))
    joined = incidents.join(lead, F.col(key) == F.col("__key"), "left").drop("__key")
    found = F.col("dominant").isNotNull()

    def filled(column: str) -> Column:
        return F.coalesce(F.col(f"dominant.{column}"), F.col(column))

    return joined.withColumns(
        {
            "dst_ip": filled("dst_ip"),
            "dst_port": filled("dst_port"),
            "protocol": filled("protocol"),
            "dst_prefix": F.when(found, F.coalesce(F.nullif("dst_prefix", F.lit("")), ip.prefix24(F.col("dominant.dst_ip")))).otherwise(
                F.col("dst_prefix")
            ),
            "same_dst_24": F.when(found, F.coalesce("same_dst_24", F.lit(True))).otherwise(F.col("same_dst_24")),
            "src_ip": F.coalesce(F.nullif("src_ip", F.lit("")), F.col("dominant.first_src_ip")),
        }
    )
