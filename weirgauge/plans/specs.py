"""Checked request objects that turn into DataFrame calls.

A request names dimensions, metrics and filters from fixed lists; it never carries SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgauge.functions import ip
from weirgauge.operators import filters as flt
from weirgauge.operators import rates, rollup, series, topn

# Names a request may use, and their aliases.
DIMENSION_ALIASES = {"input_interface": "input_if", "output_interface": "output_if"}
METRIC_ALIASES = {"bits_per_second": "bps", "packets_per_second": "pps", "flows_per_second": "fps"}
DIRECTIONS = ("both", "input", "output", "upload", "download", "source", "destination", "transmits", "receives")
DIRECTION_ALIASES = {
    "ingress": "download", "egress": "upload", "involving_zone": "both", "originated_from_zone": "transmits",
    "destined_to_zone": "receives",
}
TIME_GROUPS = ("total", "protocol", "sensor", "interface", "src_asn", "dst_asn", "zone", "asn")
AGGREGATIONS = ("sum", "avg", "max", "min", "p95")
COMPARISONS = ("none", "previous_period", "yesterday_same_time", "last_week_same_time")
RESOLUTIONS = (0, 1, 5, 10, 30, 60, 300, 900, 3600)
CALCULATIONS = ("last", "last_not_null", "mean", "max", "min", "total", "difference", "current")
TABLE_METRICS = {
    "traffic_bps": ("timeseries", "bps", None),
    "traffic_pps": ("timeseries", "pps", None),
    "top_download_origins": ("ranking", "bps", "src_asn"),
    "top_upload_destinations": ("ranking", "bps", "dst_asn"),
    "top_protocols": ("ranking", "bps", "protocol"),
}
TABLE_GROUPS = ("direction", "sensor", "interface", "protocol")
TABLE_MAX_WINDOW_SECONDS = 604_800

# Which rollup holds a dimension; others need raw flows.
ROLLUP_OF = {
    "src_ip": "src_ip", "dst_ip": "dst_ip", "src_prefix": "src_ip", "dst_prefix": "dst_ip", "src_asn": "asn_src", "dst_asn": "asn_dst",
    "dst_port": "dst_port", "protocol": "protocol", "tcp_flags": "tcp_flags", "input_if": "series", "output_if": "series",
    "sensor": "series", "conversation": "conversations",
}


def _one_of(value: Any, allowed, what: str, aliases: dict[str, str] | None = None) -> str:
    name = str(value or "").strip().lower()
    name = (aliases or {}).get(name, name)
    if name not in allowed:
        raise ValueError(f"{what} not allowed: {name}")
    return name


@dataclass
class QuerySpec:
    """A ranking (``top_n``), series (``timeseries``) or single number (``kpi``) over a window."""

    kind: str
    start: datetime
    end: datetime
    metric: str = "bps"
    dimension: str = "src_ip"
    direction: str = "both"
    limit: int = 10
    group_by: str = "total"
    aggregation: str = "sum"
    resolution: int = 0
    comparison: str = "none"
    calculation: str = "last_not_null"
    filters: list[dict[str, Any]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.kind = _one_of(self.kind, ("top_n", "timeseries", "kpi"), "kind")
        self.metric = _one_of(self.metric, topn.METRICS, "metric", METRIC_ALIASES)
        self.direction = _one_of(self.direction, DIRECTIONS, "direction", DIRECTION_ALIASES)
        self.comparison = _one_of(self.comparison, COMPARISONS, "comparison")
        self.calculation = _one_of(self.calculation, CALCULATIONS, "calculation")
        if self.kind == "top_n":
            self.dimension = _one_of(self.dimension, topn.DIMENSIONS, "dimension", DIMENSION_ALIASES)
            if not 1 <= int(self.limit) <= topn.MAX_ITEMS:
                raise ValueError(f"limit must be between 1 and {topn.MAX_ITEMS}")
        else:
            if self.metric not in series.RATE_METRICS:
                raise ValueError("a series takes bps, pps or fps")
            self.group_by = _one_of(self.group_by, TIME_GROUPS, "group")
            self.aggregation = _one_of(self.aggregation, AGGREGATIONS, "aggregation")
            if self.resolution not in RESOLUTIONS:
                raise ValueError("resolution not allowed")
        if len(self.filters) > flt.MAX_FILTERS:
            raise ValueError(f"at most {flt.MAX_FILTERS} filters")
        for item in self.filters:
            flt.check_filter(item)

    @property
    def seconds(self) -> float:
        return max(1.0, (self.end - self.start).total_seconds())

    @property
    def bucket_seconds(self) -> int:
        return self.resolution or series.choose_bucket(self.start, self.end, 1000)

    def rollup_name(self) -> str | None:
        """The rollup that answers this request together with raw edge minutes, if any does."""
        if self.kind != "top_n" and self.bucket_seconds % 60:
            return None  # rollups know minutes only
        if self.filters:
            held = set(rollup.RATE_KEYS[1:])
            name = ROLLUP_OF.get(self.dimension) if self.kind == "top_n" else "series"
            held |= set(rollup.LAYOUTS.get(name, []))
            needed = {c for f in self.filters for c in flt.FILTER_COLUMNS[flt.check_filter(f)["field"]]}
            needed = {c.removesuffix("_key") for c in needed}
            if not needed <= held:
                return None
        if self.kind == "top_n":
            return None if self.metric == "duration" else ROLLUP_OF.get(self.dimension)
        return "series" if self.group_by in ("total", "protocol", "sensor", "interface") else None

    def source(self, flows: DataFrame, rollups: dict[str, DataFrame] | None = None) -> DataFrame:
        """Rows to aggregate: a rollup with raw edges where one fits and covers the window, else raw flows."""
        name = self.rollup_name()
        if name and rollups and name in rollups and rollup.is_covered(rollups[name], self.start, self.end):
            rows = rollup.hybrid(flows, rollups[name], name, self.start, self.end)
            keys = {f"{c}_key": ip.ip_key(F.col(c)) for c in ("src_ip", "dst_ip") if c in rows.columns}
            rows = rows.withColumns(keys) if keys else rows
        else:
            rows = flt.in_range(flows, self.start, self.end)
        return flt.apply_filters(rows, self.filters)

    def run(self, flows: DataFrame, config: DataFrame | None = None, rollups: dict[str, DataFrame] | None = None) -> DataFrame:
        rows = self.source(flows, rollups)
        if self.kind == "top_n":
            return topn.top_n(rows, self.dimension, self.metric, self.seconds, self.limit, config, self.direction)
        points = self._series(rows, config)
        if self.kind == "kpi":
            return series.reduce_series(points, ["key"], self.calculation)
        if self.comparison == "none":
            return points
        shift = series.COMPARISON_SHIFTS.get(self.comparison) or int(self.seconds)
        moved = timedelta(seconds=shift)
        earlier = flt.in_range(flows, self.start - moved, min(self.end - moved, self.start)).filter(
            F.col("flow_time") < flt.ts_lit(self.start)
        )
        before = self._series(flt.apply_filters(earlier, self.filters), config)
        return series.compare(points.unionByName(before), ["key"], self.start, self.end, self.comparison)

    def _series(self, rows: DataFrame, config: DataFrame | None) -> DataFrame:
        source = series.GROUP_KEYS[self.group_by]
        size = self.bucket_seconds
        # Sub-minute buckets need raw rows; the counters keep just what the series and the rates look at.
        at = "minute" if "minute" in rows.columns else "flow_time"
        flow_column = "flows" if "flows" in rows.columns else "flow_count"
        step = size if size < 60 else 60
        bucket = F.timestamp_micros(F.unix_micros(F.col(at)) - F.pmod(F.unix_micros(F.col(at)), F.lit(step * 1_000_000)))
        side = topn.rate_side(self.direction)
        kept = list(dict.fromkeys(["exporter_ip", "input_if", "output_if", "sample_rate", *([source] if source else [])]))
        small = rows.groupBy(bucket.alias("minute"), *kept).agg(
            F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.sum(flow_column).alias("flows")
        )
        if side != "auto":
            small = small.filter(F.col("output_if" if side == "output" else "input_if") > 0)
        rated = rates.recorded_rate(small) if config is None else rates.with_rate(small, config, side)
        counters = rollup.scaled(rated, ["minute", *([source] if source else [])])
        return series.traffic_series(counters, self.group_by, self.metric, size, self.aggregation, step)


@dataclass
class TableRequest:
    """The public table interface: bounded window, one sensor, interface and protocol."""

    metric: str
    start: datetime
    end: datetime
    group_by: str = "direction"
    direction: str = "both"
    sensor: str | None = None
    interface: int | None = None
    protocol: str | None = None
    interval_ms: int = 60_000
    max_points: int = 1000
    limit: int = 10

    def __post_init__(self) -> None:
        self.metric = _one_of(self.metric, TABLE_METRICS, "metric")
        self.group_by = _one_of(self.group_by, TABLE_GROUPS, "group")
        self.direction = _one_of(self.direction, ("both", "upload", "download"), "direction")
        if self.start >= self.end:
            raise ValueError("from must be before to")
        if (self.end - self.start).total_seconds() > TABLE_MAX_WINDOW_SECONDS:
            raise ValueError("the window exceeds the limit")
        if self.interface is not None and int(self.interface) < 1:
            raise ValueError("interface must be positive")
        if not 1 <= int(self.limit) <= topn.MAX_ITEMS:
            raise ValueError(f"limit must be between 1 and {topn.MAX_ITEMS}")

    def rows(self, flows: DataFrame) -> DataFrame:
        rows = flt.by_protocol(flt.by_sensor(flt.in_range(flows, self.start, self.end), self.sensor), self.protocol)
        return rows if self.interface is None else flt.by_interface(rows, int(self.interface), self.direction)

    def run(self, flows: DataFrame, config: DataFrame | None = None) -> DataFrame:
        kind, unit, dimension = TABLE_METRICS[self.metric]
        seconds = (self.end - self.start).total_seconds()
        if kind == "ranking":
            return topn.top_n(self.rows(flows), dimension, unit, seconds, self.limit, config, self.direction)
        size = max(1, series.effective_interval_ms(int(seconds * 1000), self.interval_ms, self.max_points) // 1000)
        wanted = ("upload", "download") if self.direction == "both" else (self.direction,)
        split = series.direction_split(self.rows(flows)).filter(F.col("direction").isin(*wanted))
        if self.interface is not None:  # the split also yields the other interface of each flow
            split = split.filter(F.col("interface_id") == int(self.interface))
        keys = {"direction": "direction", "sensor": "sensor", "interface": "interface_id", "protocol": "proto"}[self.group_by]
        parts = []
        for direction in wanted:
            one = split.filter(F.col("direction") == direction)
            small = one.groupBy(
                "direction", "sensor", "interface_id", "proto", "exporter_ip", "input_if", "output_if", "sample_rate",
                F.timestamp_micros(F.unix_micros("flow_time") - F.pmod(F.unix_micros("flow_time"), F.lit(size * 1_000_000))).alias("bucket"),
            ).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
            side = "output" if direction == "upload" else "input"
            parts.append(rates.recorded_rate(small) if config is None else rates.with_rate(small, config, side))
        rated = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        column, factor = series.RATE_METRICS[unit]
        value = F.sum(F.col(column) * F.col("rate")) * factor / float(size)
        names = list(dict.fromkeys(["direction", keys]))
        return rated.groupBy(*names, "bucket").agg(value.alias("value"))
