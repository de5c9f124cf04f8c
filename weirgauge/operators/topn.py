"""Rankings, record search and inventory queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirgauge.functions import ip, scalars
from weirgauge.operators import filters as flt
from weirgauge.operators import rates
from weirgauge.operators.listing import checked, first_rows

MAX_ITEMS = 100
OTHERS = "__others__"

# What a ranking can be grouped by.  The last three need the enrichment that adds their column.
DIMENSIONS: dict[str, tuple[list[str], callable]] = {
    "src_ip": (["src_ip"], lambda: F.col("src_ip")),
    "dst_ip": (["dst_ip"], lambda: F.col("dst_ip")),
    "src_prefix": (["src_ip_key"], lambda: ip.prefix64(F.col("src_ip_key"))),
    "dst_prefix": (["dst_ip_key"], lambda: ip.prefix64(F.col("dst_ip_key"))),
    "src_prefix24": (["src_ip"], lambda: ip.prefix24(F.col("src_ip"))),
    "dst_prefix24": (["dst_ip"], lambda: ip.prefix24(F.col("dst_ip"))),
    "src_asn": (["src_asn"], lambda: F.col("src_asn").cast("string")),
    "dst_asn": (["dst_asn"], lambda: F.col("dst_asn").cast("string")),
    "src_port": (["src_port"], lambda: F.col("src_port").cast("string")),
    "dst_port": (["dst_port"], lambda: F.col("dst_port").cast("string")),
    "protocol": (["proto"], lambda: F.col("proto").cast("string")),
    "tcp_flags": (["tcp_flags"], lambda: F.col("tcp_flags").cast("string")),
    "input_if": (["input_if"], lambda: F.col("input_if").cast("string")),
    "output_if": (["output_if"], lambda: F.col("output_if").cast("string")),
    "sensor": (["sensor"], lambda: F.col("sensor")),
    "conversation": (
        ["src_ip", "src_port", "dst_ip", "dst_port", "proto"],
        lambda: scalars.conv_key(*[F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "proto")]),
    ),
    "country": (["country"], lambda: F.col("country")),
    "zone": (["zone"], lambda: F.col("zone")),
    "subscriber": (["subscriber"], lambda: F.col("subscriber")),
}
METRICS = ("bps", "bytes", "pps", "packets", "fps", "flows", "duration", "percentage")


def metric_value(metric: str, seconds: float) -> Column:
    """A ranking metric from summed ``bytes``, ``packets``, ``flows`` and ``duration_ms``."""
    return {
        "bps": F.col("bytes") * 8 / float(seconds),
        "bytes": F.col("bytes").cast("double"),
        "pps": F.col("packets") / float(seconds),
        "packets": F.col("packets").cast("double"),
        "fps": F.col("flows") / float(seconds),
        "flows": F.col("flows").cast("double"),
        "duration": F.col("duration_ms") / 1000.0,
        "percentage": F.col("bytes").cast("double"),
    }[metric]


def rate_side(direction: str) -> str:
    if direction in flt.SENDS or direction == "source":
        return "output"
    if direction in flt.RECEIVES or direction == "destination":
        return "input"
    return "auto"


def scaled_by_key(df: DataFrame, dimension: str, config: DataFrame | None, direction: str = "both") -> DataFrame:
    """Scaled sums per ranking key from flows or from a rollup that keeps the rate columns."""
    needed, expression = DIMENSIONS[dimension]
    flow_column = "flows" if "flows" in df.columns else "flow_count"
    side = rate_side(direction)
    source = df if side == "auto" else df.filter(F.col("output_if" if side == "output" else "input_if") > 0)
    duration = [F.sum("duration_ms").alias("duration_ms")] if "duration_ms" in df.columns else []
    if config is None:
        rated = rates.recorded_rate(source)
    else:
        # First reduce to what the rate depends on, then join the configuration.
        rate_keys = {"auto": ["input_if", "output_if"], "input": ["input_if"], "output": ["output_if"]}[side]
        keys = list(dict.fromkeys([*needed, "exporter_ip", *rate_keys, "sample_rate"]))
        small = source.groupBy(*keys).agg(
            F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.sum(flow_column).alias(flow_column), *duration
        )
        rated = rates.with_rate(small, config, side)
    return rated.groupBy(expression().alias("key")).agg(
        F.sum(F.col("bytes") * F.col("rate")).alias("bytes"),
        F.sum(F.col("packets") * F.col("rate")).alias("packets"),
        F.sum(flow_column).alias("flows"),
        *duration,
    )


def ranked(items: DataFrame, limit: int, *tiebreak: str) -> DataFrame:
    """Rank the few rows that survive a limit (at most ``limit`` of them)."""
    top = items.orderBy(F.desc("value"), *tiebreak).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), *tiebreak)).cast("int"))


def top_n(
    df: DataFrame,
    dimension: str,
    metric: str,
    seconds: float,
    limit: int = 10,
    config: DataFrame | None = None,
    direction: str = "both",
) -> DataFrame:
    """``(rank, key, label, value, percent)`` of the heaviest keys.

    The share is of the total over all keys, which is a scalar subquery over the same
    grouped rows.  Sort and limit run as one top-k, so no full sort is made.
    """
    grouped = scaled_by_key(df, dimension, config, direction).withColumn("value", metric_value(metric, seconds))
    total = grouped.agg(F.sum("value")).scalar()
    bounded = checked(limit, 1, MAX_ITEMS)
    shown = grouped.select("key", "value", scalars.pct(F.col("value"), total).alias("percent"))
    top = ranked(shown, bounded, "key")
    label = scalars.proto_name(F.col("key").try_cast("int")) if dimension == "protocol" else F.col("key")
    value = F.col("percent") if metric == "percentage" else F.round("value", 2)
    return top.select("rank", "key", label.alias("label"), value.alias("value"), "percent")


def with_others(ranking: DataFrame, limit: int = 8) -> DataFrame:
    """Keep ``limit`` - 1 items of a ranking and fold the rest into one, with their count and keys.

    A ranking has at most 100 items, so the list of folded keys is bounded.
    """
    visible = checked(limit, 2, MAX_ITEMS)
    size = ranking.agg(F.count(F.lit(1))).scalar()
    folded = (F.col("rank") >= visible) & (size > visible)
    keyed = ranking.withColumns(
        {
            "__key": F.when(folded, F.lit(OTHERS)).otherwise(F.col("key")),
            "__label": F.when(folded, F.lit("Outros")).otherwise(F.col("label")),
        }
    )
    grouped = keyed.groupBy(F.col("__key").alias("key"), F.col("__label").alias("label")).agg(
        F.min("rank").alias("rank"),
        F.sum("value").alias("value"),
        F.sum("percent").alias("percent"),
        F.count(F.lit(1)).alias("__n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]), ",").alias("__keys"),
    )
    other = F.col("key") == OTHERS
    return grouped.select(
        "rank", "key", "label", F.round("value", 2).alias("value"), F.round("percent", 2).alias("percent"),
        F.when(other, F.col("__n")).otherwise(F.lit(0)).cast("bigint").alias("grouped_items"),
        F.when(other, F.col("__keys")).otherwise(F.lit("")).alias("grouped_keys"),
    )


# --- record search ----------------------------------------------------------

ORDERS = ("flow_time", "bytes", "packets", "flow_count", "bits_s", "packets_s", "duration_seconds", "src_port", "dst_port")


def flow_search(
    flows: DataFrame,
    config: DataFrame | None = None,
    decoder: str | None = None,
    order_by: str = "flow_time",
    order_dir: str = "desc",
    limit: int | None = None,
) -> DataFrame:
    """Scaled flow records with a rate where the exporter gave a real duration.

    Filter the flows before.  An unknown order falls back to time; rows without a rate
    come last in a rate order.  With a limit, sort and limit are one top-k over the scan.
    """
    rows = rates.recorded_rate(flows) if config is None else rates.with_rate(flows, config, "auto")
    if decoder:
        tests = scalars.decoder_tests(*[F.col(c) for c in ("proto", "src_port", "dst_port", "tcp_flags")])
        rows = rows.filter(tests[decoder.upper()])
    seconds = scalars.duration_seconds(F.col("duration_ms"), F.col("flow_start"), F.col("flow_end"))
    records = rows.withColumns(
        {
            "raw_bytes": F.col("bytes"),
            "raw_packets": F.col("packets"),
            "bytes": F.col("bytes") * F.col("rate"),
            "packets": F.col("packets") * F.col("rate"),
            "duration_seconds": seconds,
        }
    ).withColumns(
        {
            "bits_s": scalars.flow_rate(F.col("bytes") * 8, F.col("duration_seconds")),
            "packets_s": scalars.flow_rate(F.col("packets"), F.col("duration_seconds")),
            "rate_status": scalars.rate_status(F.col("duration_seconds")),
        }
    )
    column = order_by if order_by in ORDERS else "flow_time"
    first = F.asc_nulls_last(column) if order_dir == "asc" else F.desc_nulls_last(column)
    ties = [F.desc("flow_time"), "src_ip", "dst_ip", "src_port", "dst_port", "raw_bytes"]
    return first_rows(records.orderBy(first, *ties), limit)


def sensor_options(flows: DataFrame, limit: int | None = None) -> DataFrame:
    """Sensors, latest seen first; all of them unless a limit is asked for."""
    options = (
        flows.filter("sensor != ''")
        .groupBy("sensor")
        .agg(F.max("flow_time").alias("last_seen"), F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("last_seen"), "sensor")
    )
    return options if limit is None else options.limit(limit)


def interface_rx_tx(flows: DataFrame) -> DataFrame:
    """Received and sent totals per interface, from one scan of both sides."""
    sides = F.array(
        F.struct(F.col("input_if").alias("interface_id"), F.lit(True).alias("rx")),
        F.struct(F.col("output_if").alias("interface_id"), F.lit(False).alias("rx")),
    )
    split = flows.select("flow_time", "packets", "bytes", F.explode(sides).alias("s")).filter("s.interface_id > 0")

    def total(column: str, rx: bool) -> Column:
        return F.sum(F.when(F.col("s.rx") == rx, F.col(column)).otherwise(0))

    return split.groupBy(F.col("s.interface_id").alias("interface_id")).agg(
        F.max("flow_time").alias("last_seen"),
        total("packets", True).alias("rx_packets"),
        total("packets", False).alias("tx_packets"),
        total("bytes", True).alias("rx_bytes"),
        total("bytes", False).alias("tx_bytes"),
    )


def with_interface_meta(df: DataFrame, interfaces: DataFrame, if_index: str = "interface_id") -> DataFrame:
    """Name, alias and sensor description; ``interfaces(sensor, if_index, if_name, if_alias)`` has unique keys."""
    meta = interfaces.select(
        F.col("sensor").alias("__s"), F.col("if_index").alias("__i"), "if_name", "if_alias"
    )
    joined = df.join(meta, (F.col("sensor") == F.col("__s")) & (F.col(if_index) == F.col("__i")), "left")
    return joined.select(
        *df.columns,
        F.coalesce("if_name", F.concat(F.lit("if"), F.col(if_index).cast("string"))).alias("interface_name"),
        F.coalesce("if_alias", F.lit("")).alias("interface_alias"),
    )
