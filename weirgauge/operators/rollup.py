"""Per-minute rollups: partial aggregates that keep adding up when merged."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.functions import scalars
from weirgauge.operators.filters import syn_only, ts_lit

MEASURES = ["bytes", "packets", "flows"]
RATE_KEYS = ["minute", "sensor", "exporter_ip", "input_if", "output_if", "sample_rate"]

# Dimensions of each dashboard rollup.
LAYOUTS = {
    "series": ["proto", "tcp_flags"],
    "src_ip": ["src_ip"],
    "dst_ip": ["dst_ip"],
    "dst_port": ["dst_port", "proto"],
    "protocol": ["proto"],
    "asn_src": ["src_asn", "src_as_name", "src_ip"],
    "asn_dst": ["dst_asn", "dst_as_name", "dst_ip"],
    "tcp_flags": ["tcp_flags"],
    "syn": ["src_ip", "dst_ip", "proto", "src_asn", "dst_asn", "src_as_name", "dst_as_name", "tcp_flags"],
    "conversations": ["src_ip", "dst_ip", "src_port", "dst_port", "proto", "src_asn", "dst_asn", "src_as_name",
                      "dst_as_name"],
}
# Distinct counts that keep adding up: a sketch for each, over the columns it counts.
SKETCHES = {
    "sources_sketch": ["src_ip"],
    "conversations_sketch": ["src_ip", "src_port", "dst_ip", "dst_port", "proto"],
    "ports_sketch": ["dst_port"],
}
SKETCH_BITS = 12  # standard error 1.04 / sqrt(2**12), 1.6 percent
SKETCH_ERROR = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)  # four standard errors
TOP_DIMENSIONS = ["src_ip", "dst_ip", "dst_port", "proto", "tcp_flags"]


def _minute() -> Column:
    return scalars.minute(F.col("flow_time")).alias("minute")


def _sums() -> list[Column]:
    return [F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.sum("flow_count").alias("flows")]


def flow_1m(flows: DataFrame) -> DataFrame:
    return flows.groupBy(_minute(), "sensor", "exporter_ip", "input_if", "output_if", "proto").agg(*_sums())


def flow_tops_1m(flows: DataFrame) -> DataFrame:
    """Long form over five dimensions in one scan; flag rows exist for TCP only.

    The five copies of a row meet the partial aggregation in the same task, so what is
    shuffled is one row per minute, sensor, dimension and key.
    """
    pairs = [
        F.when(
            F.col("proto") == 6 if name == "tcp_flags" else F.lit(True),
            F.struct(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("key")),
        )
        for name in TOP_DIMENSIONS
    ]
    return (
        flows.select(_minute(), "sensor", "bytes", "packets", "flow_count", F.explode(F.array(*pairs)).alias("top"))
        .filter("top IS NOT NULL")
        .groupBy("minute", "sensor", F.col("top.dimension").alias("dimension"), F.col("top.key").alias("key"))
        .agg(*_sums())
    )


def dash_rollup(flows: DataFrame, name: str) -> DataFrame:
    """One of the dashboard rollups; the rate keys stay in so that scaling can come later."""
    if name == "conversations":
        return conversations_1m(flows)
    if name == "distinct":
        return distinct_1m(flows)
    source = flows.filter(syn_only(F.col("proto"), F.col("tcp_flags"))) if name == "syn" else flows
    return source.groupBy(_minute(), *RATE_KEYS[1:], *LAYOUTS[name]).agg(*_sums())


def conversations_1m(flows: DataFrame) -> DataFrame:
    return flows.groupBy(_minute(), *RATE_KEYS[1:], *LAYOUTS["conversations"]).agg(
        *_sums(), F.min("flow_time").alias("first_seen"), F.max("flow_time").alias("last_seen")
    )


def distinct_1m(flows: DataFrame, keys: tuple[str, ...] = ("sensor", "dst_ip")) -> DataFrame:
    """Sketches of sources, conversations and ports per minute and key.

    A day's distinct sources come from 1,440 rows a key instead of all flows, within
    ``SKETCH_ERROR``; small counts are exact.
    """
    texts = {name: F.concat_ws("|", *[F.col(c).cast("string") for c in columns]) for name, columns in SKETCHES.items()}
    return flows.groupBy(_minute(), *keys).agg(*[F.hll_sketch_agg(text, SKETCH_BITS).alias(name) for name, text in texts.items()], *_sums())


def distinct_counts(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated distinct counts of ``distinct_1m`` rows for coarser keys or longer times."""
    merged = rollup.groupBy(*keys).agg(*[F.hll_union_agg(name).alias(name) for name in SKETCHES])
    return merged.select(*keys, *[F.hll_sketch_estimate(name).alias(name.removesuffix("_sketch")) for name in SKETCHES])


def merge_rollup(partials: DataFrame) -> DataFrame:
    """Merge stored partial rows.  Reading a rollup always goes through this."""
    kinds = {"bytes": F.sum, "packets": F.sum, "flows": F.sum, "first_seen": F.min, "last_seen": F.max, **dict.fromkeys(SKETCHES, F.hll_union_agg)}
    keys = [c for c in partials.columns if c not in kinds]
    return partials.groupBy(*keys).agg(*[kinds[c](c).alias(c) for c in partials.columns if c in kinds])


def interior_minutes(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """Whole minutes inside a window: first minute start, and end of the last one."""
    floor_start = start.replace(second=0, microsecond=0)
    first = floor_start if floor_start == start else floor_start + timedelta(minutes=1)
    return first, end.replace(second=0, microsecond=0)


def hybrid(flows: DataFrame, rollup: DataFrame, name: str, start: datetime, end: datetime) -> DataFrame:
    """Exact window: raw rows for the partial first and last minute, rollup rows between."""
    first, last = interior_minutes(start, end)
    when = F.col("flow_time")
    if first >= last:
        return dash_rollup(flows.filter((when >= ts_lit(start)) & (when <= ts_lit(end))), name)
    edges = flows.filter(
        ((when >= ts_lit(start)) & (when < ts_lit(first))) | ((when >= ts_lit(last)) & (when <= ts_lit(end)))
    )
    inner = rollup.filter((F.col("minute") >= ts_lit(first)) & (F.col("minute") < ts_lit(last)))
    return merge_rollup(dash_rollup(edges, name).unionByName(inner))


def is_covered(rollup: DataFrame, start: datetime, end: datetime) -> bool:
    """Whether a stored rollup has every whole minute of a window.

    A missing minute may be quiet or not stored; the raw rows are right in both cases.
    Reads the minute column inside the window only.
    """
    first, last = interior_minutes(start, end)
    if first >= last:
        return False
    inside = rollup.filter((F.col("minute") >= ts_lit(first)) & (F.col("minute") < ts_lit(last)))
    return inside.select("minute").distinct().count() == (last - first) // timedelta(minutes=1)


def scaled(df: DataFrame, keys: list[str], flows: str = "flows") -> DataFrame:
    """Sums corrected by ``rate``; flow counts are not scaled."""
    return df.groupBy(*keys).agg(
        F.sum(F.col("bytes") * F.col("rate")).alias("bytes"),
        F.sum(F.col("packets") * F.col("rate")).alias("packets"),
        F.sum(flows).alias("flows"),
    )
