"""Time series: building, shaping, comparing and reducing them.

A series row is ``(keys..., bucket or ts, value, partial, bucket_duration_seconds)``.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.functions import scalars
from weirgauge.operators import filters as flt
from weirgauge.operators import rates
from weirgauge.operators.filters import ts_lit
from weirgauge.operators.ordered import ordered_scan, time_chunk

# Bucket sizes offered, and the limits on ranges and points.
PREFERRED_BUCKETS = (1, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400)
MAX_RANGE_MINUTES = 259_200
STALE_FLOOR_SECONDS = 90
SCAN_CHUNK_SECONDS = 6 * 3600

# --- windows and bucket sizes (plan-time arithmetic on request values) ------


def choose_bucket(start: datetime, end: datetime, max_points: int, minimum: int = 1) -> int:
    """Smallest offered bucket that keeps the window within ``max_points``; beyond a day, whole days."""
    duration = (end - start).total_seconds()
    if duration <= 0:
        raise ValueError("the window must be longer than zero")
    needed = max(1, math.ceil(duration / max(1, max_points)), int(minimum))
    return next((size for size in PREFERRED_BUCKETS if size >= needed), math.ceil(needed / 86400) * 86400)


def effective_interval_ms(window_ms: int, interval_ms: int = 60_000, max_points: int = 1000) -> int:
    interval = max(1000, min(3_600_000, int(interval_ms)))
    points = max(1, min(5000, int(max_points)))
    return max(interval, math.ceil(max(1, window_ms) / points))


def resolve_range(
    now: datetime, range_minutes: int | None = None, start: datetime | None = None, end: datetime | None = None
) -> tuple[datetime, datetime, int]:
    """``(start, end, minutes)`` of a request; a future end is clipped to ``now``."""
    if start is None and end is None:
        minutes = max(1, min(MAX_RANGE_MINUTES, int(range_minutes or 60)))
        return now - timedelta(minutes=minutes), now, minutes
    if start is None or end is None:
        raise ValueError("start and end belong together")
    end = min(end, now)
    if start >= end:
        raise ValueError("start must be before end")
    minutes = max(1, math.ceil((end - start).total_seconds() / 60))
    if minutes > MAX_RANGE_MINUTES:
        raise ValueError(f"the window is limited to {MAX_RANGE_MINUTES} minutes")
    return start, end, minutes


# --- building ---------------------------------------------------------------


def interface_series(
    flows: DataFrame, current: DataFrame, direction: str, metric: str = "packets_s", window_seconds: int = 5
) -> DataFrame:
    """Scaled series of every sensor interface in one direction, all in one plan.

    Rows are first reduced per bucket and recorded rate; the rate join runs on those.
    """
    interface = flt.interface_column(direction)
    rate_side = "output" if interface == "output_if" else "input"
    # Only the chosen side takes part in the grouping and the rate join.
    partial = flows.groupBy(
        scalars.bucket(F.col("flow_time"), window_seconds).alias("bucket"), "sensor", "exporter_ip", interface, "sample_rate"
    ).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
    rated = rates.with_rate(partial, current, rate_side)
    seconds = float(max(1, window_seconds))
    sums = rated.groupBy("sensor", F.col(interface).alias("interface_id"), "bucket").agg(
        F.sum(F.col("packets") * F.col("rate")).alias("__p"),
        F.sum(F.col("bytes") * F.col("rate")).alias("__b"),
        F.sum("packets").alias("raw_packets"),
        F.sum("bytes").alias("raw_bytes"),
        F.max("sample_rate").alias("db_sample_rate"),
        F.max("rate").alias("effective_sample_rate"),
    )
    packets_s, bits_s = F.col("__p") / seconds, F.col("__b") * 8 / seconds
    return sums.select(
        "sensor",
        "interface_id",
        F.lit(direction).alias("direction"),
        "bucket",
        (bits_s if metric == "bits_s" else packets_s).alias("value"),
        packets_s.alias("packets_s"),
        bits_s.alias("bits_s"),
        "raw_packets",
        "raw_bytes",
        "db_sample_rate",
        "effective_sample_rate",
    )


def learning_series(flows: DataFrame, window_seconds: int = 60, keys: list[str] | None = None) -> DataFrame:
    """Unscaled packets, bits and flows per second per bucket; filter the flows before."""
    seconds = float(max(1, window_seconds))
    return (
        flows.groupBy(*(keys or []), scalars.bucket(F.col("flow_time"), window_seconds).alias("bucket"))
        .agg(
            F.sum("packets").alias("raw_packets"), F.sum("bytes").alias("raw_bytes"), F.sum("flow_count").alias("raw_flows")
        )
        .withColumns(
            {
                "packets_s": F.col("raw_packets") / seconds,
                "bits_s": F.col("raw_bytes") * 8 / seconds,
                "flows_s": F.col("raw_flows") / seconds,
            }
        )
    )


RATE_METRICS = {"bps": ("bytes", 8), "pps": ("packets", 1), "fps": ("flows", 1)}
GROUP_KEYS = {
    "total": None,
    "protocol": "proto",
    "sensor": "sensor",
    "interface": "input_if",
    "src_asn": "src_asn",
    "dst_asn": "dst_asn",
    "asn": "src_asn",
    "zone": "src_zone",
}


def traffic_series(
    counters: DataFrame,
    group_by: str,
    metric: str,
    resolution: int,
    aggregation: str = "sum",
    base_seconds: int = 60,
    ts: str = "minute",
) -> DataFrame:
    """Rates per key and bucket from scaled counters.

    ``sum`` spreads the bucket's counters over its length.  The other aggregations first
    build rates per ``base_seconds`` and then take their average, maximum, minimum or
    95th percentile inside the bucket.
    """
    column, factor = RATE_METRICS[metric]
    source = GROUP_KEYS[group_by]
    key = (F.lit("total") if source is None else F.col(source).cast("string")).alias("key")
    amount = F.sum(F.col(column)) * factor
    if aggregation == "sum":
        return counters.groupBy(key, scalars.bucket(F.col(ts), resolution).alias("bucket")).agg(
            (amount / float(resolution)).alias("value")
        )
    reducer = {
        "avg": F.avg("rate"),
        "max": F.max("rate"),
        "min": F.min("rate"),
        "p95": F.percentile("rate", 0.95),
    }[aggregation]
    base = counters.groupBy(key, scalars.bucket(F.col(ts), base_seconds).alias("at")).agg(
        (amount / float(base_seconds)).alias("rate")
    )
    return base.groupBy("key", scalars.bucket(F.col("at"), resolution).alias("bucket")).agg(reducer.alias("value"))


def direction_split(df: DataFrame) -> DataFrame:
    """Each row once per direction: the input interface is download, the output interface is upload."""
    sides = F.array(
        F.struct(F.lit("download").alias("direction"), F.col("input_if").alias("interface_id")),
        F.struct(F.lit("upload").alias("direction"), F.col("output_if").alias("interface_id")),
    )
    return df.withColumn("__side", F.explode(sides)).select(*df.columns, "__side.*").filter("interface_id > 0")


def by_direction(points: DataFrame, requested: str = "both", write_order: str = "seq") -> DataFrame:
    """Sum of all series of a direction per timestamp.

    Inside one series the point written last wins.  Null values do not count, and a
    timestamp with nulls only stays null.
    """
    wanted = [requested] if requested in ("upload", "download") else ["upload", "download"]
    newest = (
        points.withColumn("direction", F.lower(F.trim("direction")))
        .filter(F.col("direction").isin(wanted) & F.col("ts").isNotNull())
        .groupBy("direction", "series", "ts")
        .agg(F.max_by(F.struct("value", "partial", "bucket_duration_seconds"), F.col(write_order)).alias("p"))
    )
    return (
        newest.groupBy("direction", "ts")
        .agg(
            F.round(F.sum("p.value"), 2).alias("value"),
            F.max(F.coalesce("p.partial", F.lit(False))).alias("partial"),
            F.max("p.bucket_duration_seconds").alias("bucket_duration_seconds"),
        )
        .withColumn("series_order", F.when(F.col("direction") == "upload", 0).otherwise(1))
    )


# --- shaping ----------------------------------------------------------------


def bucket_rates(
    rows: DataFrame,
    totals: dict[str, str],
    bucket_seconds: int,
    cutoff: Column,
    ts: str = "ts",
    include_partial: bool = False,
    digits: int = 2,
) -> DataFrame:
    """Counters over the real length of each bucket.

    The open bucket is dropped, or with ``include_partial`` divided by the time elapsed
    and flagged.  Null counters stay null.  ``totals`` maps rate names to counters.
    """
    size = float(max(1, bucket_seconds))
    start = scalars.bucket(F.col(ts), bucket_seconds)
    elapsed = scalars.epoch_seconds(cutoff) - scalars.epoch_seconds(start)
    dated = rows.withColumns({ts: start, "__elapsed": elapsed}).filter("__elapsed > 0")
    kept = dated if include_partial else dated.filter(F.col("__elapsed") >= size)
    length = F.greatest(F.lit(0.001), F.least(F.lit(size), F.col("__elapsed")))
    return kept.withColumns(
        {
            "partial": F.col("__elapsed") < size,
            "bucket_duration_seconds": length,
            **{name: F.bround(F.col(total).cast("double") / length, digits) for name, total in totals.items()},
        }
    ).drop("__elapsed")


def downsample(series: DataFrame, keys: list[str], points: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Evenly spaced points of each series; the highest point is always among them."""
    limit = max(1, int(points))
    number = F.coalesce(F.col(value), F.lit(0.0))
    indexed = ordered_scan(
        series, keys, time_chunk(ts, SCAN_CHUNK_SECONDS), [ts], {"__i": ("index", None), "__n": ("count_all", None)}
    )
    grouped = indexed.groupBy(*keys) if keys else indexed.groupBy()
    top = grouped.agg(F.max_by("__i", F.struct(number, -F.col("__i"))).alias("__top"))
    if keys:
        same = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
        marked = indexed.alias("s").join(top.alias("t"), same, "left").select("s.*", "t.__top")
    else:
        marked = indexed.withColumn("__top", top.scalar())
    step = (F.col("__n") - 1) / F.lit(float(max(1, limit - 1)))

    def picked(index: Column) -> Column:
        near = F.floor(index / step)
        steps = F.array(*[near + d for d in (-1, 0, 1, 2)])
        return F.exists(steps, lambda i: i.between(0, limit - 1) & (F.bround(i * step).cast("bigint") == index))

    if limit == 1:
        keep = F.col("__i") == F.col("__top")
    else:
        last = F.col("__n") - 1
        keep = (F.col("__i") == F.col("__top")) | (
            picked(F.col("__i")) & ((F.col("__i") != last) | picked(F.col("__top")))
        )
    return marked.filter((F.col("__n") <= limit) | keep).drop("__i", "__n", "__top")


def thin(
    series: DataFrame, keys: list[str], points: int, ts: str = "ts", value: str = "value", reason: str = "reason"
) -> DataFrame:
    """Fewer points over the whole range: both ends stay, the rest is averaged in near-equal groups.

    The middle row of a group gives its timestamp, nulls and non-finite values do not
    count in the mean, and distinct reasons are joined in order of appearance.
    """
    limit = max(1, int(points))
    indexed = ordered_scan(
        series, keys, time_chunk(ts, SCAN_CHUNK_SECONDS), [ts], {"__i": ("index", None), "__n": ("count_all", None)}
    )
    i, n = F.col("__i"), F.col("__n")
    inner, slots = n - 2, max(1, limit - 2)
    slot = F.ceil(i * slots / inner).cast("bigint")  # smallest group whose end lies past row i-1
    if limit == 1:
        group = F.when(n <= 1, i).otherwise(F.lit(0))
    elif limit == 2:
        group = F.when(n <= 2, i).when(i == 0, 0).when(i == n - 1, 1)
    else:
        group = F.when(n <= limit, i).when(i == 0, 0).when(i == n - 1, F.lit(limit - 1)).otherwise(slot)
    placed = indexed.withColumn("__g", group.cast("bigint")).filter("__g IS NOT NULL")
    spans = [*keys, "__g"]
    finite = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    # The group's rows are contiguous, so its middle row sits at first + size div 2.
    sized = placed.groupBy(*spans).agg(
        F.min("__i").alias("__first"),
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(finite).alias(value),
        F.min(ts).alias("bucket_start"),
        F.max(ts).alias("bucket_end"),
    )
    texts = (
        placed.filter(F.trim(F.coalesce(F.col(reason), F.lit(""))) != "")
        .groupBy(*spans, F.trim(reason).alias("__r"))
        .agg(F.min("__i").alias("__at"))
        .groupBy(*spans)
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__r"))), lambda x: x["__r"]), " | ").alias(reason))
    )
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in spans]
    middle = F.col("z.__first") + F.floor(F.col("z.sample_count") / 2) if limit > 1 else F.col("z.__first")
    return (
        placed.alias("p")
        .join(sized.alias("z"), [*same("p", "z"), F.col("p.__i") == middle])
        .join(texts.alias("t"), same("p", "t"), "left")
        .select(
            *[F.col(f"p.{k}") for k in keys],
            F.col(f"p.{ts}"),
            F.col(f"z.{value}"),
            F.col(f"t.{reason}"),
            "z.bucket_start",
            "z.bucket_end",
            "z.sample_count",
            (F.col("z.sample_count") > 1).alias("aggregated"),
        )
    )


def series_quality(
    rows: DataFrame, keys: list[str], bucket_seconds: int, cutoff: Column, ts: str = "ts", stale_after: int | None = None
) -> DataFrame:
    """Freshness of each series: newest bucket, newest complete bucket, lag and status."""
    size = max(1, int(bucket_seconds))
    limit = max(size, int(stale_after)) if stale_after is not None else max(size * 3, STALE_FLOOR_SECONDS)
    start = scalars.bucket(F.col(ts), size)
    partial = F.coalesce(F.col("partial"), F.lit(False)) if "partial" in rows.columns else F.lit(False)
    summary = rows.groupBy(*keys).agg(
        F.max(start).alias("last_sample_at"), F.max(F.when(~partial, start)).alias("last_complete_sample_at")
    )
    lag = scalars.epoch_seconds(cutoff) - (scalars.epoch_seconds(F.col("last_complete_sample_at")) + size)
    return summary.withColumn(
        "ingestion_lag_seconds", F.greatest(F.lit(0), F.floor(lag)).cast("bigint")
    ).withColumns(
        {
            "ingestion_lag_seconds": F.when(F.col("last_complete_sample_at").isNotNull(), F.col("ingestion_lag_seconds")),
            "stale_after_seconds": F.lit(limit),
            "data_status": F.when(F.col("last_complete_sample_at").isNull(), "no_data")
            .when(F.col("ingestion_lag_seconds") > limit, "delayed")
            .otherwise("current"),
        }
    )


# --- comparing and reducing -------------------------------------------------

# Comparison modes with a fixed shift.
COMPARISON_SHIFTS = {"yesterday_same_time": 86_400, "last_week_same_time": 604_800}


def compare(series: DataFrame, keys: list[str], start: datetime, end: datetime, mode: str, ts: str = "bucket") -> DataFrame:
    """A window next to an earlier one, aligned on the window's own time axis."""
    shift = COMPARISON_SHIFTS.get(mode) or int((end - start).total_seconds())
    moved = F.timestamp_micros(F.unix_micros(F.col(ts)) + F.lit(shift * 1_000_000))
    inside = (F.col(ts) >= ts_lit(start)) & (F.col(ts) < ts_lit(end))
    now = series.filter(inside).select(*keys, F.col(ts), F.col("value").alias("value"))
    before = (
        series.filter((F.col(ts) >= ts_lit(start - timedelta(seconds=shift))) & (F.col(ts) < ts_lit(end - timedelta(seconds=shift))))
        .select(*keys, moved.alias(ts), F.col("value").alias("previous_value"))
    )
    return now.join(before, [*keys, ts], "full_outer").withColumn("difference", F.col("value") - F.col("previous_value"))


def reduce_series(series: DataFrame, keys: list[str], calculation: str, ts: str = "bucket", value: str = "value") -> DataFrame:
    """One number per series: last, last_not_null, mean, max, min, total, difference or current."""
    v, t = F.col(value), F.col(ts)
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    when_set = F.when(finite.isNotNull(), t)
    newest, oldest = F.max_by(finite, when_set), F.min_by(finite, when_set)
    reducer = {
        "last": F.max_by(F.struct(finite.alias("v")), t)["v"],
        "last_not_null": newest,
        "current": newest,
        "mean": F.avg(finite),
        "max": F.max(finite),
        "min": F.min(finite),
        "total": F.sum(finite),
        "difference": newest - oldest,
    }[calculation]
    return series.groupBy(*keys).agg(reducer.alias(calculation))
