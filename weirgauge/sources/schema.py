"""Canonical table layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgauge.functions import ip

FLOW_RAW = T.StructType(
    [
        T.StructField("flow_time", T.TimestampType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("exporter_ip", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("input_if", T.LongType()),
        T.StructField("output_if", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("packets", T.LongType()),
        T.StructField("flow_count", T.LongType()),
        T.StructField("flow_type", T.StringType()),
        T.StructField("sample_rate", T.LongType()),
        T.StructField("flow_start", T.TimestampType()),
        T.StructField("flow_end", T.TimestampType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("src_asn", T.LongType()),
        T.StructField("dst_asn", T.LongType()),
        T.StructField("src_as_name", T.StringType()),
        T.StructField("dst_as_name", T.StringType()),
    ]
)

SAMPLE_RATE_CONFIG = T.StructType(
    [
        T.StructField("exporter_ip", T.StringType()),
        T.StructField("if_index", T.LongType()),
        T.StructField("direction", T.IntegerType()),
        T.StructField("sample_rate", T.LongType()),
        T.StructField("active", T.IntegerType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def with_keys(flows: DataFrame) -> DataFrame:
    """Add the sortable address keys and the partition date to flow rows."""
    return flows.withColumns(
        {
            "src_ip_key": ip.ip_key(F.col("src_ip")),
            "dst_ip_key": ip.ip_key(F.col("dst_ip")),
            "flow_date": F.to_date("flow_time"),
        }
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a canonical layout."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
