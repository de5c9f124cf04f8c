"""Flow rows and dimensions projected from the provided tables.

The provided tables hold no flows.  A fixed integer projection of ``lineitem``
gives flow rows, and the other tables give dimensions.  ``FLOWS_CTE`` is the same
projection as SQL text for the result checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.functions import ip
from weirgauge.session import use_utc

EPOCH_START = "2026-07-10 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flow_raw`` rows with address keys and ``flow_date``."""
    return project_flows(table(spark, sf_dir, "lineitem"))


def stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a file stream."""
    schema = table(spark, sf_dir, "lineitem").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    return project_flows(source)


def project_flows(lineitem: DataFrame) -> DataFrame:
    base = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus",
        F.expr("l_orderkey*7919 + l_partkey*104729 + l_suppkey*31 + l_linenumber*17").alias("h"),
    )
    staged = base.selectExpr(
        "*",
        "h % 7200 AS sec",
        "CASE WHEN l_returnflag = 'A' THEN 6 WHEN l_returnflag = 'N' THEN 17 WHEN h % 10 = 0 THEN 1 ELSE 6 END AS p",
    ).selectExpr(
        "*",
        "cast(l_quantity AS bigint) * CASE WHEN sec BETWEEN 3600 AND 3604 THEN 100 ELSE 1 END AS pk",
        "CASE WHEN l_linestatus = 'F' THEN h % 5000 ELSE 0 END AS dur",
        "CASE WHEN h % 5 = 0 THEN 0 ELSE 64500 + l_suppkey % 20 END AS sa",
        "64600 + l_partkey % 30 AS da",
        f"TIMESTAMP '{EPOCH_START}' + make_dt_interval(0, 0, 0, h % 7200) AS ft",
    )
    return staged.selectExpr(
        "ft AS flow_time",
        "ft + INTERVAL 1 SECOND AS received_at",
        "concat('edge-', h % 3) AS sensor",
        "concat('192.0.2.', h % 3 + 10) AS exporter_ip",
        "concat('100.64.', l_suppkey % 4, '.', l_orderkey % 250 + 1) AS src_ip",
        "concat('203.0.113.', l_partkey % 200 + 1) AS dst_ip",
        "cast(1024 + h % 60000 AS int) AS src_port",
        "array(53,80,443,123,8443,3478,22,9004)[cast(l_partkey % 8 AS int)] AS dst_port",
        "p AS proto",
        "CASE WHEN p = 6 THEN array(16,18,2,24,17,4)[cast(h % 6 AS int)] ELSE 0 END AS tcp_flags",
        "1 + l_suppkey % 4 AS input_if",
        "1 + (l_suppkey + 2) % 4 AS output_if",
        "pk * (72 + h % 1329) AS bytes",
        "pk AS packets",
        "1L AS flow_count",
        "'netflow-v9' AS flow_type",
        "cast(array(1,100,1000)[cast(h % 3 AS int)] AS bigint) AS sample_rate",
        "CASE WHEN dur > 0 THEN timestampadd(MILLISECOND, -dur, ft) END AS flow_start",
        "CASE WHEN dur > 0 THEN ft END AS flow_end",
        "dur AS duration_ms",
        "sa AS src_asn",
        "da AS dst_asn",
        "CASE WHEN sa > 0 AND sa % 2 = 0 THEN concat('Org ', sa) ELSE '' END AS src_as_name",
        "CASE WHEN da % 3 = 0 THEN concat('Org ', da) ELSE '' END AS dst_as_name",
        # Address keys straight from the numbers; 100.64.0.0 and 203.0.113.0 as integers.
        f"concat('{ip.MAPPED_KEY_PREFIX}', lower(hex(1681915904 + l_suppkey % 4 * 256 + l_orderkey % 250 + 1))) AS src_ip_key",
        f"concat('{ip.MAPPED_KEY_PREFIX}', lower(hex(3405803776 + l_partkey % 200 + 1))) AS dst_ip_key",
        "to_date(ft) AS flow_date",
    )


FLOWS_CTE = """
base AS (SELECT *, l_orderkey*7919 + l_partkey*104729 + l_suppkey*31 + l_linenumber*17 AS h FROM lineitem),
staged AS (SELECT *, h % 7200 AS sec, CASE WHEN l_returnflag='A' THEN 6 WHEN l_returnflag='N' THEN 17
  WHEN h % 10 = 0 THEN 1 ELSE 6 END AS p FROM base),
flows AS (SELECT
  TIMESTAMP '2026-07-10 12:00:00' + to_seconds(sec) AS flow_time,
  TIMESTAMP '2026-07-10 12:00:01' + to_seconds(sec) AS received_at,
  'edge-' || (h % 3) AS sensor,
  '192.0.2.' || (h % 3 + 10) AS exporter_ip,
  '100.64.' || (l_suppkey % 4) || '.' || (l_orderkey % 250 + 1) AS src_ip,
  '203.0.113.' || (l_partkey % 200 + 1) AS dst_ip,
  (1024 + h % 60000)::INT AS src_port,
  [53,80,443,123,8443,3478,22,9004][l_partkey % 8 + 1] AS dst_port,
  p AS proto,
  CASE WHEN p = 6 THEN [16,18,2,24,17,4][h % 6 + 1] ELSE 0 END AS tcp_flags,
  1 + l_suppkey % 4 AS input_if,
  1 + (l_suppkey + 2) % 4 AS output_if,
  l_quantity::BIGINT * (CASE WHEN sec BETWEEN 3600 AND 3604 THEN 100 ELSE 1 END) * (72 + h % 1329) AS bytes,
  l_quantity::BIGINT * (CASE WHEN sec BETWEEN 3600 AND 3604 THEN 100 ELSE 1 END) AS packets,
  1::BIGINT AS flow_count,
  [1,100,1000][h % 3 + 1]::BIGINT AS sample_rate,
  CASE WHEN l_linestatus='F' THEN h % 5000 ELSE 0 END AS duration_ms,
  CASE WHEN h % 5 = 0 THEN 0 ELSE 64500 + l_suppkey % 20 END AS src_asn,
  64600 + l_partkey % 30 AS dst_asn,
  CASE WHEN h % 5 > 0 AND (64500 + l_suppkey % 20) % 2 = 0 THEN 'Org ' || (64500 + l_suppkey % 20) ELSE '' END AS src_as_name,
  CASE WHEN (64600 + l_partkey % 30) % 3 = 0 THEN 'Org ' || (64600 + l_partkey % 30) ELSE '' END AS dst_as_name
  FROM staged)
"""


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, the form the result checks compare."""
    changes = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"}
    return df.withColumns(changes) if changes else df
