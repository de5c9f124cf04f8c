"""Dimension tables projected from the provided tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirgauge.sources.lineitem_flows import table


def rate_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('192.0.2.', s_suppkey % 3 + 10) AS exporter_ip",
        "(s_suppkey div 3) % 5 AS if_index",
        "cast(1 + (s_suppkey div 15) % 2 AS int) AS direction",
        "s_suppkey % 7 * 100 AS sample_rate",
        "CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE 1 END AS active",
        "TIMESTAMP '2026-07-01 00:00:00' + make_dt_interval(0, 0, 0, s_suppkey) AS updated_at",
    )


RATE_CTE = """
rate_config AS (SELECT '192.0.2.' || (s_suppkey % 3 + 10) AS exporter_ip, (s_suppkey // 3) % 5 AS if_index,
  1 + (s_suppkey // 15) % 2 AS direction, s_suppkey % 7 * 100 AS sample_rate,
  CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE 1 END AS active, s_suppkey AS version FROM supplier),
rate_newest AS (SELECT *, row_number() OVER (PARTITION BY exporter_ip, if_index, direction ORDER BY version DESC) AS rn FROM rate_config),
rate_now AS (SELECT exporter_ip, if_index, direction, sample_rate FROM rate_newest WHERE rn = 1 AND active = 1),
rated AS (SELECT f.*,
  coalesce(nullif(i.sample_rate, 0), nullif(di.sample_rate, 0), greatest(f.sample_rate, 1)) AS in_rate,
  coalesce(nullif(o.sample_rate, 0), nullif(dout.sample_rate, 0), greatest(f.sample_rate, 1)) AS out_rate
  FROM flows f
  LEFT JOIN rate_now i ON i.exporter_ip = f.exporter_ip AND i.if_index = f.input_if AND i.direction = 1
  LEFT JOIN rate_now di ON di.exporter_ip = f.exporter_ip AND di.if_index = 0 AND di.direction = 1
  LEFT JOIN rate_now o ON o.exporter_ip = f.exporter_ip AND o.if_index = f.output_if AND o.direction = 2
  LEFT JOIN rate_now dout ON dout.exporter_ip = f.exporter_ip AND dout.if_index = 0 AND dout.direction = 2)
"""


def zone_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS zone_id",
        "n_name AS zone_name",
        "array('direct_public', 'cgnat', 'mixed', 'auto')[n_nationkey % 4] AS subscriber_addressing_mode",
        "concat('100.64.', n_nationkey % 4, '.', n_nationkey * 37 % 256, '/', 24 + n_nationkey % 7) AS prefix",
        "array('customer', 'public_cgnat', 'infrastructure')[n_nationkey % 3] AS prefix_type",
        "n_nationkey % 6 <> 5 AS active",
    )


def asn_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "CASE WHEN s_suppkey % 2 = 0 THEN concat('203.0.113.', s_suppkey * 13 % 256, '/', 24 + s_suppkey % 7) "
        "ELSE concat('100.64.', s_suppkey % 4, '.', s_suppkey * 29 % 256, '/', 26 + s_suppkey % 5) END AS prefix",
        "65000 + s_suppkey AS asn",
        "s_name AS as_name",
        "array('BR', 'US', 'DE', 'JP')[s_nationkey % 4] AS country",
    )


def geo_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "CASE WHEN n_nationkey % 2 = 0 THEN concat('203.0.113.', n_nationkey * 10, '/28') "
        "ELSE concat('100.64.', n_nationkey % 4, '.', n_nationkey * 10, '/21') END AS prefix",
        "cast(n_nationkey * 3 - 40 AS double) AS lat",
        "cast(n_nationkey * 5 - 60 AS double) AS lon",
        "concat('City ', n_nationkey) AS city",
        "concat('C', n_regionkey) AS country",
    )


def customer_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey AS string) AS customer_id",
        "c_name AS customer_name",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('100.64.', c_custkey % 4, '.', c_custkey % 250 + 1, '/32') "
        "ELSE concat('203.0.113.', c_custkey % 256, '/', 26 + c_custkey % 5) END AS prefix",
        "CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS enabled",
        "TIMESTAMP '2026-07-01 00:00:00' + make_dt_interval(0, 0, 0, c_custkey) AS updated_at",
    )


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr(
        "r_regionkey AS whitelist_id",
        "r_name AS name",
        "concat('100.64.', r_regionkey % 4, '.', r_regionkey * 40, '/', 25 + r_regionkey % 4) AS prefix",
        "r_regionkey % 2 = 0 AS is_global",
    )


def interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several versions per interface; the newest counts."""
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('edge-', n_nationkey % 3) AS sensor",
        "cast(1 + (n_nationkey div 3) % 5 AS bigint) AS if_index",
        "concat('if', n_nationkey) AS if_name",
        "n_name AS if_alias",
        "cast(1000000000 AS bigint) AS speed_bps",
        "TIMESTAMP '2026-07-01 00:00:00' + make_dt_interval(0, 0, 0, n_nationkey) AS updated_at",
    )


def sql_ip(text: str) -> str:
    """DuckDB integer of an IPv4 text expression."""
    parts = [f"split_part({text}, '.', {n})::BIGINT" for n in (1, 2, 3, 4)]
    return f"((({parts[0]}*256+{parts[1]})*256+{parts[2]})*256+{parts[3]})"


def sql_prefix(cte: str, select: str, source: str) -> str:
    """CTEs that give a prefix table an integer ``pint`` and a length ``plen`` of 32."""
    address = sql_ip("split_part(prefix, '/', 1)")
    return (
        f"{cte}_text AS (SELECT {select} FROM {source}),\n"
        f"{cte} AS (SELECT *, {address} AS pint, split_part(prefix, '/', 2)::INT AS plen FROM {cte}_text)"
    )


def sql_holds(address: str, cte: str) -> str:
    """Address-in-block test."""
    return f"({address} >> (32 - {cte}.plen)) = ({cte}.pint >> (32 - {cte}.plen))"


ZONE_CTE = sql_prefix(
    "zone",
    "n_nationkey AS zone_id, n_name AS zone_name, "
    "['direct_public','cgnat','mixed','auto'][n_nationkey % 4 + 1] AS subscriber_addressing_mode, "
    "'100.64.' || (n_nationkey % 4) || '.' || (n_nationkey * 37 % 256) || '/' || (24 + n_nationkey % 7) AS prefix, "
    "['customer','public_cgnat','infrastructure'][n_nationkey % 3 + 1] AS prefix_type, n_nationkey % 6 <> 5 AS active",
    "nation",
)
ASN_CTE = sql_prefix(
    "asnp",
    "CASE WHEN s_suppkey % 2 = 0 THEN '203.0.113.' || (s_suppkey * 13 % 256) || '/' || (24 + s_suppkey % 7) "
    "ELSE '100.64.' || (s_suppkey % 4) || '.' || (s_suppkey * 29 % 256) || '/' || (26 + s_suppkey % 5) END AS prefix, "
    "65000 + s_suppkey AS asn, s_name AS as_name, ['BR','US','DE','JP'][s_nationkey % 4 + 1] AS country",
    "supplier",
)
GEO_CTE = sql_prefix(
    "geo",
    "CASE WHEN n_nationkey % 2 = 0 THEN '203.0.113.' || (n_nationkey * 10) || '/28' "
    "ELSE '100.64.' || (n_nationkey % 4) || '.' || (n_nationkey * 10) || '/21' END AS prefix, "
    "(n_nationkey * 3 - 40)::DOUBLE AS lat, (n_nationkey * 5 - 60)::DOUBLE AS lon, "
    "'City ' || n_nationkey AS city, 'C' || n_regionkey AS country",
    "nation",
)
CUSTOMER_CTE = sql_prefix(
    "cust",
    "c_custkey::VARCHAR AS customer_id, c_name AS customer_name, CASE WHEN c_custkey % 3 = 0 "
    "THEN '100.64.' || (c_custkey % 4) || '.' || (c_custkey % 250 + 1) || '/32' "
    "ELSE '203.0.113.' || (c_custkey % 256) || '/' || (26 + c_custkey % 5) END AS prefix, "
    "CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS enabled",
    "customer",
)
WHITELIST_CTE = sql_prefix(
    "wl",
    "r_regionkey AS whitelist_id, r_name AS name, '100.64.' || (r_regionkey % 4) || '.' || (r_regionkey * 40) "
    "|| '/' || (25 + r_regionkey % 4) AS prefix, r_regionkey % 2 = 0 AS is_global",
    "region",
)
