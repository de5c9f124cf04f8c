"""Windowed aggregation and detection on streams with event-time state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgauge.operators import detect, rollup
from weirgauge.session import shared_folder

LATENESS = "5 minutes"


def minute_rollup(flows: DataFrame, name: str, lateness: str = LATENESS) -> DataFrame:
    """A dashboard rollup that emits a minute once it can no longer change.

    Open minutes are held back and records later than ``lateness`` are dropped (Spark counts
    them in the query progress).  Where nothing may be dropped use the partial rollups of
    ``ingest``.
    """
    keys = [*rollup.RATE_KEYS[1:], *rollup.LAYOUTS[name]]
    return (
        flows.withWatermark("flow_time", lateness)
        .groupBy(F.window("flow_time", "1 minute").alias("w"), *keys)
        .agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.sum("flow_count").alias("flows"))
        .withColumn("minute", F.col("w.start"))
        .drop("w")
    )


def sliding_hits(
    flows: DataFrame, keys: list[str], warning: float, critical: float, metric: str = "packets_s", lateness: str = LATENESS
) -> DataFrame:
    """Groups over the threshold in a 60-second lookback that moves every 30 seconds."""
    seconds = float(detect.LOOKBACK)
    counted = (
        flows.withWatermark("flow_time", lateness)
        .groupBy(F.window("flow_time", f"{detect.LOOKBACK} seconds", f"{detect.CADENCE} seconds").alias("w"), *keys)
        .agg(
            F.sum(F.col("packets") * F.col("rate")).alias("packets"),
            F.sum(F.col("bytes") * F.col("rate")).alias("bytes"),
            F.sum("flow_count").alias("flows"),
        )
    )
    value = {
        "packets_s": F.col("packets") / seconds,
        "bits_s": F.col("bytes") * 8 / seconds,
        "flows_s": F.col("flows") / seconds,
    }[metric]
    hits = counted.withColumn("value", value).filter(F.col("value") >= warning)
    over = F.col("value") >= critical
    return hits.select(
        F.col("w.start").alias("window_start"),
        F.window_time("w").alias("seen_at"),
        *keys,
        "packets",
        "bytes",
        "flows",
        "value",
        F.when(over, F.lit(float(critical))).otherwise(F.lit(float(warning))).alias("threshold"),
        F.when(over, "critical").otherwise("warning").alias("severity"),
    )


def event_stream(hits: DataFrame, keys: list[str], quiet: int = detect.CLOSE_AFTER) -> DataFrame:
    """Events from hits, emitted when their quiet period has passed.

    The session state is one small row per open event; trigger, last and peak stay apart.
    """
    return detect.sessions(hits, keys, "seen_at", quiet)


def freshness(rollup_rows: DataFrame, keys: list[str], cutoff, bucket_seconds: int = 60) -> DataFrame:
    """Status of each series of a stored rollup: current, delayed or without data."""
    from weirgauge.operators.series import series_quality

    return series_quality(rollup_rows, keys, bucket_seconds, cutoff, "minute")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Work off what is available in append mode and return the stored result."""
    spark = stream.sparkSession
    import uuid

    root = f"{shared_folder(spark)}/weirgauge/{name}-{uuid.uuid4().hex}"
    running = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start(f"{root}/data")
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")
