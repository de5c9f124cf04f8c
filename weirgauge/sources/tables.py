"""Reading, seeding, ageing and exporting stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.functions import scalars
from weirgauge.operators.listing import first_rows

# Default age limits in days.
RETENTION_DAYS = {"flow_raw": 7, "flow_1m": 30, "flow_tops_1m": 15, "dashboard": 30}


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest row per key.  An aggregation, so a key with very many versions is reduced map-side."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.col(version)).alias("__row")
    return df.groupBy(*keys).agg(newest).select(*keys, "__row.*").select(*df.columns)


def insert_missing(existing: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key that is not stored yet; the caller appends them.

    Of repeated keys the first by ``order`` is taken, then the least by the other columns, so reruns agree.
    """
    rest = [c for c in rows.columns if c not in keys]
    new = rows.join(existing.select(*keys).distinct(), keys, "left_anti")
    if not rest:
        return new.distinct()
    ranked = [*(order or []), *[c for c in rest if c not in (order or [])]]
    first = new.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("__row"))
    return first.select(*keys, "__row.*").select(*rows.columns)


def apply_retention(df: DataFrame, ts: str, days: int | None, now: Column) -> DataFrame:
    """Rows young enough to keep; ``None`` keeps all.  A date predicate prunes whole partitions."""
    if days is None:
        return df
    floor = now - F.expr(f"INTERVAL {int(days)} DAYS")
    kept = df.filter(F.col(ts) >= floor)
    return kept.filter(F.col("flow_date") >= F.to_date(floor)) if "flow_date" in df.columns else kept


def expired_dates(df: DataFrame, days: int, now: Column) -> DataFrame:
    """Partition dates that lie wholly beyond the age limit and can be dropped as folders."""
    return df.select("flow_date").distinct().filter(F.col("flow_date") < F.to_date(now - F.expr(f"INTERVAL {int(days)} DAYS")))


def cleanup_report(df: DataFrame, ts: str, age: int, now: Column, unit: str = "DAYS") -> DataFrame:
    """What a cleanup of rows older than ``age`` days, hours or minutes would delete."""
    if unit not in ("DAYS", "HOURS", "MINUTES"):
        raise ValueError(f"unit not allowed: {unit}")
    old = F.col(ts) < now - F.expr(f"INTERVAL {int(age)} {unit}")
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(old).alias("rows_deleted"),
        F.min(F.when(old, F.col(ts))).alias("deleted_from"),
        F.max(F.when(old, F.col(ts))).alias("deleted_to"),
    )


def table_status(df: DataFrame, ts: str = "flow_time") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(ts).alias("oldest"), F.max(ts).alias("newest"))


def write_flows(flows: DataFrame, path: str, mode: str = "append") -> None:
    """Store flows by date, ordered inside each file so that row-group statistics prune.

    The rebalance hint groups rows by date and lets Spark split a heavy date into as many
    tasks, and join light ones into as few, as the advisory partition size asks for.
    """
    (
        flows.hint("rebalance", "flow_date")
        .sortWithinPartitions("flow_date", "sensor", "flow_time")
        .write.mode(mode)
        .partitionBy("flow_date")
        .parquet(path)
    )


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def case_lines(cases: DataFrame) -> DataFrame:
    """One JSON text per case: ``case_id``, ``input``, ``expected_output``, ``metadata``."""
    given = F.struct(
        "technical_report", "sensor", "interface_id", "direction", "metric",
        F.upper(F.coalesce(F.nullif("protocol", F.lit("")), F.col("dominant_protocol"), F.lit(""))).alias("protocol"),
        F.struct("peak_time_utc", "peak_time_local", "peak_value", "score").alias("peak"),
        F.struct(F.col("baseline_p95").alias("p95"), F.col("baseline_p99").alias("p99")).alias("baseline"),
        F.struct(
            F.col("dominant_dst_ip").alias("dst_ip"), F.col("dominant_dst_port").alias("dst_port"),
            F.col("dominant_protocol").alias("protocol"), F.col("dominant_unique_src_count").alias("unique_src_count"),
            F.col("dominant_share_packets").alias("share_packets"), F.col("dominant_share_bits").alias("share_bits"),
        ).alias("dominant_group"),
    )
    wanted = F.struct(
        "classification", "evidence_status", "recommended_action", "operator_label", "operator_vector", "operator_best_action"
    )
    about = F.struct(
        "created_at", "peak_time_utc", "peak_time_local", F.lit(scalars.LOCAL_ZONE).alias("timezone"), "analysis_source",
        "job_id", "run_id", "is_negative_sample", "duplicate_of_id", "operator_comment",
    )
    case = F.struct(
        F.concat(F.lit("peak-analysis-"), F.col("id").cast("string")).alias("case_id"),
        given.alias("input"),
        wanted.alias("expected_output"),
        about.alias("metadata"),
    )
    return cases.select(F.to_json(case, {"ignoreNullFields": "false"}).alias("value"))


def export_cases(cases: DataFrame, path: str, limit: int | None = None) -> None:
    """Cases as JSON lines, newest first; only the newest ``limit`` where one is set."""
    newest = first_rows(cases.orderBy(F.desc("peak_time"), F.desc("created_at"), F.desc("id")), limit)
    case_lines(newest).write.mode("overwrite").text(path)
