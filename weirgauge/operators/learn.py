"""Learning thresholds from history and calibrating flow rates against interface counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.functions import scalars
from weirgauge.operators.ordered import ordered_scan, time_chunk

# Choices of this library where no formula is published: quiet buckets below the floor do
# not count; ratios further than a factor of four from the first median are outliers;
# confidence grows with the number of valid pairs and falls with their spread.
QUIET_FLOOR = {"bits_s": 1000.0, "packets_s": 1.0, "flows_s": 0.1}
OUTLIER_FACTOR = 4.0
FULL_CONFIDENCE_PAIRS = 12
AUTO_APPLY_CONFIDENCE = 0.6
MIN_CALIBRATION_BPS = 1000.0


def decoder_series(flows: DataFrame, names: list[str], window_seconds: int = 60, keys: list[str] | None = None) -> DataFrame:
    """Rates per bucket, decoder and direction.

    Flows are first reduced to what the decoders look at; only those rows are multiplied
    by the decoders they pass.
    """
    keys = keys or ["sensor"]
    looks = ["proto", "src_port", "dst_port", "tcp_flags"]
    interface = F.explode(
        F.array(
            F.struct(F.lit("receives").alias("direction"), F.col("input_if").alias("interface_id")),
            F.struct(F.lit("sends").alias("direction"), F.col("output_if").alias("interface_id")),
        )
    ).alias("side")
    reduced = flows.groupBy(
        *keys, scalars.bucket(F.col("flow_time"), window_seconds).alias("bucket"), "input_if", "output_if", *looks
    ).agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.sum("flow_count").alias("flows"))
    wanted = F.array_intersect(scalars.decoders(*[F.col(c) for c in looks]), F.array(*[F.lit(n) for n in names]))
    spread = reduced.withColumn("decoder", F.explode(wanted)).select("*", interface)
    seconds = float(max(1, window_seconds))
    return (
        spread.filter("side.interface_id > 0")
        .groupBy(*keys, "decoder", F.col("side.direction").alias("direction"), F.col("side.interface_id").alias("interface_id"), "bucket")
        .agg(
            (F.sum("packets") / seconds).alias("packets_s"),
            (F.sum("bytes") * 8 / seconds).alias("bits_s"),
            (F.sum("flows") / seconds).alias("flows_s"),
        )
    )


def exclude_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], size: int, bucket: str = "bucket") -> DataFrame:
    """Points outside known peak intervals ``(keys, start_time, end_time)``.

    Each interval lists the buckets it touches, so the join is on equality.
    """
    first = scalars.bucket(F.col("start_time"), size)
    steps = F.sequence(first, F.col("end_time"), F.expr(f"INTERVAL {int(size)} SECONDS"))
    touched = intervals.select(*keys, F.explode(steps).alias(bucket)).distinct()
    return points.join(touched, [*keys, bucket], "left_anti")


def learn_thresholds(points: DataFrame, keys: list[str], margin_percent: float = 20.0, template: str = "default") -> DataFrame:
    """p95, p99, maximum and mean per key and unit with a suggested threshold above the maximum."""
    units = F.explode(
        F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("value"), F.lit(f).alias("floor")) for u, f in QUIET_FLOOR.items()])
    ).alias("u")
    long = points.select(*keys, units).select(*keys, "u.*").filter("value >= floor")
    learned = long.groupBy(*keys, "unit").agg(
        F.percentile("value", F.array(F.lit(0.95), F.lit(0.99))).alias("__p"),
        F.max("value").alias("baseline_max"),
        F.avg("value").alias("baseline_mean"),
        F.count(F.lit(1)).alias("samples"),
    )
    return learned.select(
        scalars.stable_key("learn", template=F.lit(template), unit=F.col("unit"), **{k: F.col(k) for k in keys}).alias("suggestion_key"),
        *keys,
        "unit",
        F.col("__p")[0].alias("baseline_p95"),
        F.col("__p")[1].alias("baseline_p99"),
        "baseline_max",
        "baseline_mean",
        "samples",
        (F.col("baseline_max") * (1 + margin_percent / 100.0)).alias("suggested_threshold"),
    )


def merge_suggestions(stored: DataFrame, learned: DataFrame) -> DataFrame:
    """Pending suggestions: a newly learned one replaces the stored one of the same key."""
    kept = stored.join(learned.select("suggestion_key"), "suggestion_key", "left_anti")
    return kept.unionByName(learned, allowMissingColumns=True)


# --- interface counters -----------------------------------------------------------


def counter_rate(samples: DataFrame, keys: list[str], counters: list[str], ts: str = "sample_time") -> DataFrame:
    """Bits per second from octet counters; the first sample and a counter that ran backwards give null."""
    running = {f"__prev_{c}": ("prev", F.col(c)) for c in counters}
    seen = ordered_scan(samples, keys, time_chunk(ts, 86_400), [ts], {**running, "__prev_ts": ("prev", F.col(ts))})
    seconds = scalars.epoch_seconds(F.col(ts)) - scalars.epoch_seconds(F.col("__prev_ts"))

    def bps(counter: str) -> Column:
        delta = F.col(counter) - F.col(f"__prev_{counter}")
        return F.when((delta >= 0) & (seconds > 0), delta * 8 / seconds)

    out = seen.withColumns({c.replace("octets", "bps"): bps(c) for c in counters})
    return out.drop("__prev_ts", *running)


def calibration_pairs(snmp: DataFrame, flow_rates: DataFrame, keys: list[str], bucket_seconds: int, ts: str = "sample_time") -> DataFrame:
    """Counter rates next to flow rates per interface and bucket, both averaged in the bucket."""
    left = snmp.groupBy(*keys, scalars.bucket(F.col(ts), bucket_seconds).alias("bucket")).agg(F.avg("snmp_bps").alias("snmp_bps"))
    right = flow_rates.groupBy(*keys, scalars.bucket(F.col("bucket"), bucket_seconds).alias("bucket")).agg(F.avg("flow_bps").alias("flow_bps"))
    return left.join(right, [*keys, "bucket"])


def calibrate(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Median ratio of counter to flow rate with its confidence.

    Zeros, rates too low to compare and outliers are left out.  ``apply`` needs a positive
    factor and enough confidence.
    """
    usable = pairs.filter((F.col("snmp_bps") >= MIN_CALIBRATION_BPS) & (F.col("flow_bps") >= MIN_CALIBRATION_BPS)).withColumn(
        "ratio", F.col("snmp_bps") / F.col("flow_bps")
    )
    centre = usable.groupBy(*keys).agg(F.percentile("ratio", 0.5).alias("__centre"))
    near = usable.join(centre, keys).filter(
        (F.col("ratio") <= F.col("__centre") * OUTLIER_FACTOR) & (F.col("ratio") >= F.col("__centre") / OUTLIER_FACTOR)
    )
    fit = near.groupBy(*keys).agg(
        F.percentile("ratio", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"), F.count(F.lit(1)).alias("valid_pairs")
    )
    factor, spread = F.col("__q")[1], (F.col("__q")[2] - F.col("__q")[0]) / F.col("__q")[1]
    confidence = F.least(F.lit(1.0), F.col("valid_pairs") / float(FULL_CONFIDENCE_PAIRS)) * F.greatest(F.lit(0.0), 1 - spread)
    return fit.select(*keys, factor.alias("factor"), "valid_pairs", confidence.alias("confidence")).withColumn(
        "auto_apply", (F.col("factor") > 0) & (F.col("confidence") >= AUTO_APPLY_CONFIDENCE)
    )
