"""Sampling-rate resolution.

Counters are stored as exported.  The rate that scales them comes from the
configuration of the interface, else of the exporter, else from the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INPUT, OUTPUT = 1, 2


def current_rates(config: DataFrame) -> DataFrame:
    """Newest row per exporter, interface and direction; gone when the newest is inactive."""
    return (
        config.groupBy("exporter_ip", "if_index", "direction")
        .agg(F.max_by("sample_rate", "updated_at").alias("sample_rate"), F.max_by("active", "updated_at").alias("active"))
        .filter("active = 1")
        .drop("active")
    )


def _per_interface(current: DataFrame) -> DataFrame:
    """One row per exporter and interface with the two directions side by side."""

    def rate(direction: int) -> Column:
        return F.nullif(F.max(F.when(F.col("direction") == direction, F.col("sample_rate"))), F.lit(0))

    return current.groupBy("exporter_ip", "if_index").agg(
        rate(INPUT).alias("in_rate"), rate(OUTPUT).alias("out_rate")
    )


def with_rate(df: DataFrame, current: DataFrame, direction: str = "auto", out: str = "rate") -> DataFrame:
    """Add the effective rate as ``out``.

    Feed it aggregated rows where possible: a rollup that keeps exporter, interfaces
    and recorded rate in its key gives the same answer as raw rows at a fraction of
    the size.  The joins are on unique keys, so rows never multiply.
    """
    sides = _per_interface(current)

    def side(prefix: str) -> DataFrame:
        return sides.select(
            F.col("exporter_ip").alias(f"__{prefix}_exporter"),
            F.col("if_index").alias(f"__{prefix}_if"),
            F.col("in_rate").alias(f"__{prefix}_in"),
            F.col("out_rate").alias(f"__{prefix}_out"),
        )

    def matches(prefix: str, interface: Column) -> Column:
        return (F.col("exporter_ip") == F.col(f"__{prefix}_exporter")) & (interface == F.col(f"__{prefix}_if"))

    joined = df
    if direction in ("auto", "input"):
        joined = joined.join(side("i"), matches("i", F.col("input_if")), "left")
    if direction in ("auto", "output"):
        joined = joined.join(side("o"), matches("o", F.col("output_if")), "left")
    defaults = side("d").filter("__d_if = 0").drop("__d_if")
    joined = joined.join(defaults, F.col("exporter_ip") == F.col("__d_exporter"), "left")

    recorded = F.greatest(F.coalesce(F.col("sample_rate"), F.lit(1)), F.lit(1)).cast("bigint")
    in_rate = F.coalesce(F.col("__i_in"), F.col("__d_in"), recorded) if direction != "output" else None
    out_rate = F.coalesce(F.col("__o_out"), F.col("__d_out"), recorded) if direction != "input" else None
    if direction == "input":
        effective = in_rate
    elif direction == "output":
        effective = out_rate
    else:
        # An input interface without configuration falls back to the recorded rate, not to the output side.
        effective = F.when(F.col("input_if") > 0, in_rate).when(F.col("output_if") > 0, out_rate).otherwise(recorded)
    return joined.select(*df.columns, effective.cast("bigint").alias(out))


def recorded_rate(df: DataFrame, out: str = "rate") -> DataFrame:
    """The rate carried by the record itself, at least one."""
    return df.withColumn(out, F.greatest(F.coalesce(F.col("sample_rate"), F.lit(1)), F.lit(1)).cast("bigint"))


def rate_rows(sensors: DataFrame, interfaces: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """Configuration rows from sensor defaults and interface settings.

    ``sensors(sensor, exporter_ip, default_in, default_out, mode)`` and
    ``interfaces(sensor, if_index, rate_in, rate_out, override)``.  An interface uses its
    own rate when it overrides or the sensor works per interface, else the default.
    """

    def at_least_one(c: Column) -> Column:
        return F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("bigint")

    known = sensors.filter(F.coalesce(F.trim("exporter_ip"), F.lit("")) != "").select(
        "sensor",
        F.trim("exporter_ip").alias("exporter_ip"),
        at_least_one(F.col("default_in")).alias("default_in"),
        at_least_one(F.col("default_out")).alias("default_out"),
        F.coalesce(F.col("mode"), F.lit("sensor_default")).alias("mode"),
    )
    defaults = known.select(
        "exporter_ip",
        F.lit(0).cast("bigint").alias("if_index"),
        F.lit("sensor").alias("source"),
        F.col("default_in").alias("rin"),
        F.col("default_out").alias("rout"),
    )
    own = F.coalesce(F.col("override").cast("boolean"), F.lit(False)) | (F.col("mode") == "per_interface")

    def own_or_default(rate: str, default: str) -> Column:
        # A missing or zero own rate falls back to the default.
        given = F.coalesce(F.nullif(F.col(rate).cast("bigint"), F.lit(0)), F.col(default))
        return F.when(own, at_least_one(given)).otherwise(F.col(default))

    per_interface = interfaces.join(known, "sensor").select(
        "exporter_ip",
        F.col("if_index").cast("bigint").alias("if_index"),
        F.when(own, "interface").otherwise("sensor").alias("source"),
        own_or_default("rate_in", "default_in").alias("rin"),
        own_or_default("rate_out", "default_out").alias("rout"),
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit(INPUT).alias("direction"), F.col("rin").alias("sample_rate")),
            F.struct(F.lit(OUTPUT).alias("direction"), F.col("rout").alias("sample_rate")),
        )
    ).alias("side")
    stamp = updated_at if updated_at is not None else F.current_timestamp()
    return (
        defaults.unionByName(per_interface)
        .select("exporter_ip", "if_index", "source", sides)
        .select("exporter_ip", "if_index", "side.direction", "side.sample_rate", "source", F.lit(1).alias("active"),
                stamp.alias("updated_at"))
    )
