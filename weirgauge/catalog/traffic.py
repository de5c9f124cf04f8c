"""Rollups, series, rankings, filters and prefix joins over the projected flows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weirgauge.catalog.registry import query
from weirgauge.functions import ip, scalars
from weirgauge.operators import filters as flt
from weirgauge.operators import prefixes as pfx
from weirgauge.operators import rates, rollup, series, topn
from weirgauge.plans import specs
from weirgauge.sources import dims
from weirgauge.sources.lineitem_flows import flows, table

START, END = datetime(2026, 7, 10, 12, 0), datetime(2026, 7, 10, 14, 0)
MEASURES = "sum(bytes)::BIGINT AS bytes, sum(packets)::BIGINT AS packets, sum(flow_count)::BIGINT AS flows"
MINUTE = "date_trunc('minute', flow_time) AS minute"

# --- rollups ----------------------------------------------------------------

query(
    "flow_1m",
    f"SELECT {MINUTE}, sensor, exporter_ip, input_if, output_if, proto, {MEASURES} FROM flows GROUP BY ALL",
)(lambda s, d: rollup.flow_1m(flows(s, d)))

query(
    "flow_tops_1m",
    " UNION ALL ".join(
        f"SELECT {MINUTE}, sensor, '{c}' AS dimension, {c}::VARCHAR AS key, {MEASURES} FROM flows "
        f"{'WHERE proto = 6' if c == 'tcp_flags' else ''} GROUP BY 1, 2, 3, 4"
        for c in rollup.TOP_DIMENSIONS
    ),
)(lambda s, d: rollup.flow_tops_1m(flows(s, d)))

for _name, _columns in rollup.LAYOUTS.items():
    _where = "WHERE proto = 6 AND tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0" if _name == "syn" else ""
    _seen = ", min(flow_time) AS first_seen, max(flow_time) AS last_seen" if _name == "conversations" else ""
    query(
        f"rollup_{_name}_1m",
        f"SELECT {MINUTE}, sensor, exporter_ip, input_if, output_if, sample_rate, {', '.join(_columns)}, {MEASURES}{_seen} "
        f"FROM flows {_where} GROUP BY ALL",
    )(lambda s, d, name=_name: rollup.dash_rollup(flows(s, d), name))


@query(
    "merged_partial_rollups",
    f"SELECT {MINUTE}, sensor, exporter_ip, input_if, output_if, sample_rate, dst_port, proto, {MEASURES} FROM flows GROUP BY ALL",
)
def _merged(s, d):
    # Two inserts that share minutes leave two partial rows per key; the merge adds them up.
    rows = flows(s, d)
    odd = F.col("src_port") % 2 == 1
    parts = [rollup.dash_rollup(rows.filter(odd), "dst_port"), rollup.dash_rollup(rows.filter(~odd), "dst_port")]
    return rollup.merge_rollup(parts[0].unionByName(parts[1]))


@query(
    "hybrid_window_src_ip",
    "SELECT src_ip, sum(bytes * greatest(sample_rate, 1))::BIGINT AS bytes, sum(packets * greatest(sample_rate, 1))::BIGINT AS packets, "
    "sum(flow_count)::BIGINT AS flows FROM flows "
    "WHERE flow_time BETWEEN TIMESTAMP '2026-07-10 12:07:13' AND TIMESTAMP '2026-07-10 13:41:39' GROUP BY src_ip",
)
def _hybrid(s, d):
    rows = flows(s, d)
    window = rollup.hybrid(
        rows, rollup.dash_rollup(rows, "src_ip"), "src_ip", datetime(2026, 7, 10, 12, 7, 13), datetime(2026, 7, 10, 13, 41, 39)
    )
    return rollup.scaled(rates.recorded_rate(window), ["src_ip"])


# --- sampling rates ---------------------------------------------------------

query(
    "sample_rate_current",
    f"{dims.RATE_CTE} SELECT exporter_ip, if_index, direction, sample_rate FROM rate_now",
)(lambda s, d: rates.current_rates(dims.rate_config(s, d)))

for _side, _expr in {
    "input": "in_rate",
    "output": "out_rate",
    "auto": "CASE WHEN input_if > 0 THEN in_rate WHEN output_if > 0 THEN out_rate ELSE greatest(sample_rate, 1) END",
}.items():
    query(
        f"scaled_by_interface_{_side}",
        f"{dims.RATE_CTE} SELECT sensor, input_if, output_if, sum(bytes * ({_expr}))::BIGINT AS bytes, "
        f"sum(packets * ({_expr}))::BIGINT AS packets, sum(flow_count)::BIGINT AS flows FROM rated GROUP BY ALL",
    )(
        lambda s, d, side=_side: rollup.scaled(
            rates.with_rate(rollup.dash_rollup(flows(s, d), "series"), rates.current_rates(dims.rate_config(s, d)), side),
            ["sensor", "input_if", "output_if"],
        )
    )


@query(
    "rate_config_rows",
    """
sensors AS (SELECT 'edge-' || n_nationkey AS sensor, '198.51.100.' || n_nationkey AS exporter_ip, n_nationkey % 4 * 50 AS default_in,
  n_nationkey % 5 * 20 AS default_out, CASE WHEN n_nationkey % 2 = 0 THEN 'per_interface' ELSE 'sensor_default' END AS mode FROM nation),
ifs AS (SELECT 'edge-' || s_nationkey AS sensor, s_suppkey + 1 AS if_index, s_suppkey % 3 * 10 AS rate_in, s_suppkey % 4 * 30 AS rate_out,
  s_suppkey % 5 = 0 AS override FROM supplier),
joined AS (SELECT exporter_ip, if_index, greatest(default_in, 1) AS din, greatest(default_out, 1) AS dout, rate_in, rate_out,
  override OR mode = 'per_interface' AS own FROM ifs JOIN sensors USING (sensor))
SELECT exporter_ip, 0::BIGINT AS if_index, 1 AS direction, greatest(default_in, 1)::BIGINT AS sample_rate, 'sensor' AS source FROM sensors
UNION ALL SELECT exporter_ip, 0, 2, greatest(default_out, 1)::BIGINT, 'sensor' FROM sensors
UNION ALL SELECT exporter_ip, if_index, 1, CASE WHEN own THEN coalesce(nullif(rate_in, 0), din) ELSE din END, CASE WHEN own THEN 'interface' ELSE 'sensor' END FROM joined
UNION ALL SELECT exporter_ip, if_index, 2, CASE WHEN own THEN coalesce(nullif(rate_out, 0), dout) ELSE dout END, CASE WHEN own THEN 'interface' ELSE 'sensor' END FROM joined
""",
    with_flows=True,
)
def _rate_rows(s, d):
    sensors = table(s, d, "nation").selectExpr(
        "concat('edge-', n_nationkey) AS sensor",
        "concat('198.51.100.', n_nationkey) AS exporter_ip",
        "n_nationkey % 4 * 50 AS default_in",
        "n_nationkey % 5 * 20 AS default_out",
        "CASE WHEN n_nationkey % 2 = 0 THEN 'per_interface' ELSE 'sensor_default' END AS mode",
    )
    ifs = table(s, d, "supplier").selectExpr(
        "concat('edge-', s_nationkey) AS sensor", "s_suppkey + 1 AS if_index", "s_suppkey % 3 * 10 AS rate_in",
        "s_suppkey % 4 * 30 AS rate_out", "s_suppkey % 5 = 0 AS override",
    )
    return rates.rate_rows(sensors, ifs).select("exporter_ip", "if_index", "direction", "sample_rate", "source")


# --- series -----------------------------------------------------------------

SERIES_SQL = f"""{dims.RATE_CTE} SELECT sensor, {{interface}} AS interface_id, '{{direction}}' AS direction,
time_bucket(INTERVAL '5 seconds', flow_time, TIMESTAMP '2026-07-10') AS bucket,
round(sum(packets * {{rate}})::BIGINT / 5.0, 3)::DOUBLE AS packets_s, round(sum(bytes * {{rate}})::BIGINT * 8 / 5.0, 3)::DOUBLE AS bits_s,
sum(packets)::BIGINT AS raw_packets, sum(bytes)::BIGINT AS raw_bytes, max(sample_rate) AS db_sample_rate, max({{rate}}) AS effective_sample_rate
FROM rated GROUP BY ALL"""
for _direction, _interface, _rate in (("receives", "input_if", "in_rate"), ("sends", "output_if", "out_rate")):
    query(f"interface_series_{_direction}", SERIES_SQL.format(interface=_interface, direction=_direction, rate=_rate))(
        lambda s, d, direction=_direction: series.interface_series(
            flows(s, d), rates.current_rates(dims.rate_config(s, d)), direction
        )
        .drop("value")
        .withColumns({c: F.round(c, 3) for c in ("packets_s", "bits_s")})
    )


@query(
    "learning_series_filtered",
    "SELECT date_trunc('minute', flow_time) AS bucket, sum(packets)::BIGINT AS raw_packets, sum(bytes)::BIGINT AS raw_bytes, "
    "sum(flow_count)::BIGINT AS raw_flows, round(sum(packets)::BIGINT / 60.0, 4)::DOUBLE AS packets_s, "
    "round(sum(bytes)::BIGINT * 8 / 60.0, 4)::DOUBLE AS bits_s, round(sum(flow_count)::BIGINT / 60.0, 4)::DOUBLE AS flows_s FROM flows "
    "WHERE sensor = 'edge-1' AND proto = 17 AND (src_port = 53 OR dst_port = 53) AND (input_if = 2 OR output_if = 2) "
    "AND flow_time BETWEEN TIMESTAMP '2026-07-10 12:00:00' AND TIMESTAMP '2026-07-10 14:00:00' "
    "AND (src_ip LIKE '100.64.1.%' OR dst_ip LIKE '100.64.1.%' OR src_ip LIKE '203.0.113.%' OR dst_ip LIKE '203.0.113.%') GROUP BY 1",
)
def _learning(s, d):
    rows = flt.in_range(flows(s, d), START, END)
    rows = flt.by_protocol(flt.by_interface(flt.by_sensor(rows, "edge-1"), 2), "dns")
    rows = flt.by_cidrs(rows, ["100.64.1.0/24", "203.0.113.0/24"])
    out = series.learning_series(rows, 60)
    return out.withColumns({c: F.round(c, 4) for c in ("packets_s", "bits_s", "flows_s")})


@query(
    "traffic_series_by_protocol",
    "SELECT proto::VARCHAR AS key, time_bucket(INTERVAL '300 seconds', flow_time, TIMESTAMP '2026-07-10') AS bucket, "
    "round(sum(bytes * greatest(sample_rate, 1))::BIGINT * 8 / 300.0, 3)::DOUBLE AS value FROM flows GROUP BY ALL",
)
def _by_protocol(s, d):
    counters = rollup.scaled(rates.recorded_rate(rollup.dash_rollup(flows(s, d), "protocol")), ["minute", "proto"])
    return series.traffic_series(counters, "protocol", "bps", 300).withColumn("value", F.round("value", 3))


for _agg, _sql in {"avg": "avg(rate)", "max": "max(rate)", "min": "min(rate)", "p95": "quantile_cont(rate, 0.95)"}.items():
    query(
        f"traffic_series_{_agg}_by_sensor",
        "m AS (SELECT sensor AS key, date_trunc('minute', flow_time) AS tick, sum(packets * greatest(sample_rate, 1))::BIGINT / 60.0 AS rate "
        f"FROM flows GROUP BY ALL) SELECT key, time_bucket(INTERVAL '900 seconds', tick, TIMESTAMP '2026-07-10') AS bucket, "
        f"round({_sql}, 3)::DOUBLE AS value FROM m GROUP BY ALL",
    )(
        lambda s, d, agg=_agg: series.traffic_series(
            rollup.scaled(rates.recorded_rate(rollup.dash_rollup(flows(s, d), "series")), ["minute", "sensor"]),
            "sensor", "pps", 900, agg,
        ).withColumn("value", F.round("value", 3))
    )

def _points(s, d):
    rows = table(s, d, "lineitem").selectExpr(
        "l_orderkey*7919 + l_partkey*104729 + l_suppkey*31 + l_linenumber*17 AS h", "l_quantity", "l_extendedprice"
    )
    return rows.selectExpr(
        "CASE WHEN h % 3 = 0 THEN 'Upload' WHEN h % 3 = 1 THEN 'download' ELSE 'other' END AS direction",
        "concat('s', h % 7) AS series",
        "date_trunc('minute', TIMESTAMP '2026-07-10 12:00:00' + make_dt_interval(0, 0, 0, h % 7200)) AS ts",
        "CASE WHEN h % 5 = 0 THEN NULL ELSE l_quantity END AS value",
        "h % 11 = 0 AS partial",
        "60.0D AS bucket_duration_seconds",
        "struct(h, round(l_extendedprice, 2), l_quantity) AS seq",
    )


@query(
    "direction_consolidation",
    """
pts AS (SELECT CASE WHEN h % 3 = 0 THEN 'upload' ELSE 'download' END AS direction, 's' || (h % 7) AS series,
  date_trunc('minute', TIMESTAMP '2026-07-10 12:00:00' + to_seconds(h % 7200)) AS ts,
  CASE WHEN h % 5 = 0 THEN NULL ELSE l_quantity END AS value, h % 11 = 0 AS partial,
  row_number() OVER (PARTITION BY h % 3, h % 7, (h % 7200) // 60 ORDER BY h DESC, round(l_extendedprice, 2) DESC, l_quantity DESC) AS rn
  FROM base WHERE h % 3 <> 2)
SELECT direction, ts, round(sum(value), 2) AS value, bool_or(partial) AS partial, 60.0::DOUBLE AS bucket_duration_seconds,
  CASE WHEN direction = 'upload' THEN 0 ELSE 1 END AS series_order FROM pts WHERE rn = 1 GROUP BY direction, ts
""",
)
def _direction(s, d):
    return series.by_direction(_points(s, d))


@query(
    "direction_split_totals",
    "SELECT direction, interface_id, sum(bytes)::BIGINT AS bytes, count(*) AS n FROM (SELECT 'download' AS direction, input_if AS interface_id, bytes FROM flows "
    "UNION ALL SELECT 'upload', output_if, bytes FROM flows) WHERE interface_id > 0 GROUP BY ALL",
)
def _split(s, d):
    return series.direction_split(flows(s, d)).groupBy("direction", "interface_id").agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")
    )


_MINUTE_SERIES = (
    "m AS (SELECT sensor, date_trunc('minute', flow_time) AS ts, sum(bytes)::BIGINT AS total FROM flows GROUP BY ALL)"
)


def _minute_series(s, d):
    return (
        flows(s, d).groupBy("sensor", scalars.minute(F.col("flow_time")).alias("ts")).agg(F.sum("bytes").alias("total"))
    )


for _partial in (False, True):
    query(
        "bucket_rates_with_partial" if _partial else "bucket_rates_complete",
        f"{_MINUTE_SERIES}, e AS (SELECT *, date_diff('second', ts, TIMESTAMP '2026-07-10 13:30:25') AS el FROM m) "
        "SELECT sensor, ts, total, el < 60 AS partial, least(60.0, el)::DOUBLE AS bucket_duration_seconds, "
        f"round_even(total::DOUBLE / least(60.0, el), 2) AS rate FROM e WHERE el > 0 {'' if _partial else 'AND el >= 60'}",
    )(
        lambda s, d, partial=_partial: series.bucket_rates(
            _minute_series(s, d), {"rate": "total"}, 60, flt.ts_lit("2026-07-10 13:30:25"), include_partial=partial
        )
    )


@query(
    "series_downsampled",
    f"""{_MINUTE_SERIES}, i AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY sensor) AS n FROM m),
t AS (SELECT sensor, arg_max(i, total * 1000 - i) AS top FROM i GROUP BY sensor),
p AS (SELECT DISTINCT i.sensor, round_even(k * ((n - 1) / 16.0), 0)::BIGINT AS pick FROM i, range(17) r(k)),
q AS (SELECT t.sensor, CASE WHEN t.top IN (SELECT pick FROM p p2 WHERE p2.sensor = t.sensor) THEN p.pick
   WHEN p.pick = (SELECT max(pick) FROM p p3 WHERE p3.sensor = t.sensor) THEN t.top ELSE p.pick END AS pick FROM p JOIN t USING (sensor))
SELECT i.sensor, i.ts, i.total FROM i JOIN q ON q.sensor = i.sensor AND q.pick = i.i WHERE n > 17
UNION ALL SELECT sensor, ts, total FROM i WHERE n <= 17""",
)
def _downsampled(s, d):
    return series.downsample(_minute_series(s, d), ["sensor"], 17, value="total")


@query(
    "series_thinned",
    f"""{_MINUTE_SERIES}, i AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY sensor) AS n FROM m),
g AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN i = n - 1 THEN 11 ELSE (i * 10 + n - 3) // (n - 2) END AS g FROM i),
a AS (SELECT sensor, g, min(i) + count(*) // 2 AS mid, avg(total) AS value, min(ts) AS bucket_start, max(ts) AS bucket_end, count(*) AS sample_count FROM g GROUP BY ALL)
SELECT a.sensor, g.ts, round(a.value, 3)::DOUBLE AS value, bucket_start, bucket_end, sample_count, sample_count > 1 AS aggregated
FROM a JOIN g ON g.sensor = a.sensor AND g.g = a.g AND g.i = a.mid""",
)
def _thinned(s, d):
    rows = _minute_series(s, d).select("sensor", "ts", F.col("total").cast("double").alias("value"), F.lit("").alias("reason"))
    return series.thin(rows, ["sensor"], 12).drop("reason").withColumn("value", F.round("value", 3))


@query(
    "series_quality_by_sensor",
    f"""{_MINUTE_SERIES}, q AS (SELECT sensor, max(ts) AS last_sample_at, max(ts) AS last_complete_sample_at,
  greatest(0, date_diff('second', max(ts), TIMESTAMP '2026-07-10 14:05:30') - 60)::BIGINT AS ingestion_lag_seconds FROM m GROUP BY sensor)
SELECT *, 180 AS stale_after_seconds, CASE WHEN ingestion_lag_seconds > 180 THEN 'delayed' ELSE 'current' END AS data_status FROM q""",
)
def _quality(s, d):
    return series.series_quality(_minute_series(s, d), ["sensor"], 60, flt.ts_lit("2026-07-10 14:05:30"))


@query(
    "period_comparison",
    f"""{_MINUTE_SERIES}, a AS (SELECT sensor, ts, total FROM m WHERE ts >= TIMESTAMP '2026-07-10 13:00:00' AND ts < TIMESTAMP '2026-07-10 14:00:00'),
b AS (SELECT sensor, ts + INTERVAL 1 HOUR AS ts, total FROM m WHERE ts >= TIMESTAMP '2026-07-10 12:00:00' AND ts < TIMESTAMP '2026-07-10 13:00:00')
SELECT coalesce(a.sensor, b.sensor) AS sensor, coalesce(a.ts, b.ts) AS bucket, a.total AS value, b.total AS previous_value, a.total - b.total AS difference
FROM a FULL JOIN b ON a.sensor = b.sensor AND a.ts = b.ts""",
)
def _comparison(s, d):
    rows = _minute_series(s, d).withColumnsRenamed({"ts": "bucket", "total": "value"})
    return series.compare(rows, ["sensor"], datetime(2026, 7, 10, 13), datetime(2026, 7, 10, 14), "previous_period")


@query(
    "series_reductions",
    f"""{_MINUTE_SERIES}, v AS (SELECT sensor, ts, CASE WHEN (date_diff('minute', TIMESTAMP '2026-07-10 12:00:00', ts) + length(sensor)) % 3 = 2 THEN NULL ELSE total END AS v FROM m)
SELECT sensor, arg_max_null(v, ts) AS last, arg_max(v, ts) FILTER (v IS NOT NULL) AS last_not_null, arg_max(v, ts) FILTER (v IS NOT NULL) AS current, round(avg(v), 3) AS mean,
max(v) AS max, min(v) AS min, sum(v)::BIGINT AS total, (arg_max(v, ts) FILTER (v IS NOT NULL)) - (arg_min(v, ts) FILTER (v IS NOT NULL)) AS difference FROM v GROUP BY sensor""",
)
def _reductions(s, d):
    gap = F.expr("(timestampdiff(MINUTE, TIMESTAMP '2026-07-10 12:00:00', ts) + length(sensor)) % 3 = 2")
    rows = _minute_series(s, d).select("sensor", "ts", F.when(gap, None).otherwise(F.col("total")).alias("v"))
    out = None
    for name in ("last", "last_not_null", "current", "mean", "max", "min", "total", "difference"):
        one = series.reduce_series(rows, ["sensor"], name, "ts", "v")
        out = one if out is None else out.join(one, "sensor")
    return out.withColumn("mean", F.round("mean", 3))


@query(
    "kpi_mean_bps_by_sensor",
    "m AS (SELECT sensor, time_bucket(INTERVAL '300 seconds', flow_time, TIMESTAMP '2026-07-10') AS b, sum(bytes * greatest(sample_rate, 1))::BIGINT * 8 / 300.0 AS v FROM flows GROUP BY ALL) "
    "SELECT sensor AS key, round(avg(v), 2)::DOUBLE AS mean FROM m GROUP BY sensor",
)
def _kpi(s, d):
    counters = rollup.scaled(rates.recorded_rate(rollup.dash_rollup(flows(s, d), "series")), ["minute", "sensor"])
    points = series.traffic_series(counters, "sensor", "bps", 300)
    return series.reduce_series(points, ["key"], "mean").withColumn("mean", F.round("mean", 2))


# --- rankings ---------------------------------------------------------------

_AUTO = "CASE WHEN input_if > 0 THEN in_rate WHEN output_if > 0 THEN out_rate ELSE greatest(sample_rate, 1) END"
_METRIC_SQL = {
    "bps": "sum(bytes * rate)::BIGINT * 8 / 7200.0",
    "bytes": "sum(bytes * rate)::DOUBLE",
    "pps": "sum(packets * rate)::BIGINT / 7200.0",
    "packets": "sum(packets * rate)::DOUBLE",
    "fps": "sum(flow_count)::BIGINT / 7200.0",
    "flows": "sum(flow_count)::DOUBLE",
    "duration": "sum(duration_ms)::BIGINT / 1000.0",
    "percentage": "sum(bytes * rate)::DOUBLE",
}
_KEY_SQL = {
    "src_prefix": "'::/64'",
    "dst_prefix": "'::/64'",
    "dst_prefix24": "'203.0.113.0/24'",
    "src_prefix24": "regexp_extract(src_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.0/24'",
    "protocol": "proto::VARCHAR",
    "conversation": "src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port || '/' || proto",
}
_LABEL = "CASE key WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' WHEN '1' THEN 'ICMP' ELSE key END"


def _top_sql(dimension: str, metric: str, limit: int, configured: bool) -> str:
    key = _KEY_SQL.get(dimension, f"{dimension}::VARCHAR")
    source = f"{dims.RATE_CTE}, w AS (SELECT *, {_AUTO} AS rate FROM rated)" if configured else (
        "w AS (SELECT *, greatest(sample_rate, 1) AS rate FROM flows)")
    value = "round(value / total * 100, 2)" if metric == "percentage" else "round(value, 2)"
    return f"""{source}, g AS (SELECT {key} AS key, {_METRIC_SQL[metric]} AS value FROM w GROUP BY 1),
t AS (SELECT sum(value) AS total FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, key) AS rank FROM g)
SELECT rank::INT AS rank, key, {_LABEL if dimension == 'protocol' else 'key'} AS label, {value}::DOUBLE AS value,
round(value / total * 100, 2)::DOUBLE AS percent FROM r, t WHERE rank <= {limit}"""


TOP_QUERIES = [
    ("src_ip", "bps", 20, True), ("dst_ip", "bytes", 20, True), ("src_prefix", "packets", 10, False),
    ("dst_prefix", "bytes", 10, False), ("src_prefix24", "pps", 10, True), ("dst_prefix24", "bps", 10, False),
    ("src_asn", "pps", 15, True), ("dst_asn", "bps", 15, True), ("src_port", "flows", 25, False),
    ("dst_port", "fps", 10, False), ("protocol", "percentage", 10, True), ("tcp_flags", "packets", 10, True),
    ("input_if", "bps", 10, True), ("output_if", "duration", 10, False), ("sensor", "bps", 10, True),
    ("conversation", "bytes", 30, True),
]
for _dim, _metric, _limit, _configured in TOP_QUERIES:
    query(f"top_{_dim}_by_{_metric}", _top_sql(_dim, _metric, _limit, _configured))(
        lambda s, d, a=(_dim, _metric, _limit, _configured): topn.top_n(
            flows(s, d), a[0], a[1], 7200, a[2], rates.current_rates(dims.rate_config(s, d)) if a[3] else None
        )
    )

query("top_src_ip_from_rollup", _top_sql("src_ip", "bps", 20, True))(
    lambda s, d: topn.top_n(
        rollup.merge_rollup(rollup.dash_rollup(flows(s, d), "src_ip")),
        "src_ip", "bps", 7200, 20, rates.current_rates(dims.rate_config(s, d)),
    )
)


@query(
    "top_zone_by_bps",
    f"""{dims.ZONE_CTE}, a AS (SELECT DISTINCT src_ip, {dims.sql_ip('src_ip')} AS addr FROM flows),
z AS (SELECT src_ip, zone_name, row_number() OVER (PARTITION BY src_ip ORDER BY plen DESC, zone_name DESC, prefix_type DESC) AS rn FROM a JOIN zone ON {dims.sql_holds('addr', 'zone')} AND active),
g AS (SELECT coalesce(zone_name, 'N/D') AS key, sum(bytes * greatest(sample_rate, 1))::BIGINT * 8 / 7200.0 AS value FROM flows f LEFT JOIN z ON z.src_ip = f.src_ip AND rn = 1 GROUP BY 1),
t AS (SELECT sum(value) AS total FROM g)
SELECT row_number() OVER (ORDER BY value DESC, key)::INT AS rank, key, key AS label, round(value, 2)::DOUBLE AS value, round(value / total * 100, 2)::DOUBLE AS percent FROM g, t ORDER BY rank LIMIT 10""",
)
def _top_zone(s, d):
    # The rollup by source is what meets the prefixes, not the flows.
    small = rollup.dash_rollup(flows(s, d), "src_ip").withColumn("src_ip_key", ip.ipv4_key(F.col("src_ip")))
    zoned = pfx.with_zone(small, pfx.prefix_table(dims.zone_prefixes(s, d)), "src")
    return topn.top_n(zoned.withColumn("zone", F.coalesce("src_zone", F.lit("N/D"))), "zone", "bps", 7200)


@query(
    "ranking_with_others",
    f"""w AS (SELECT *, greatest(sample_rate, 1) AS rate FROM flows), g AS (SELECT dst_ip AS key, sum(bytes * rate)::DOUBLE AS value FROM w GROUP BY 1),
t AS (SELECT sum(value) AS total FROM g),
r AS (SELECT key, round(value, 2) AS value, round(value / total * 100, 2) AS percent, row_number() OVER (ORDER BY value DESC, key) AS rank FROM g, t),
k AS (SELECT * FROM r WHERE rank <= 50), n AS (SELECT count(*) AS n FROM k)
SELECT min(rank)::INT AS rank, CASE WHEN rank >= 8 AND n > 8 THEN '__others__' ELSE key END AS key, CASE WHEN rank >= 8 AND n > 8 THEN 'Outros' ELSE key END AS label,
round(sum(value), 2)::DOUBLE AS value, round(sum(percent), 2)::DOUBLE AS percent, CASE WHEN min(rank) >= 8 AND min(n) > 8 THEN count(*) ELSE 0 END AS grouped_items,
CASE WHEN min(rank) >= 8 AND min(n) > 8 THEN string_agg(key, ',' ORDER BY rank) ELSE '' END AS grouped_keys FROM k, n GROUP BY 2, 3""",
)
def _others(s, d):
    return topn.with_others(topn.top_n(flows(s, d), "dst_ip", "bytes", 7200, 50), 8)


_SEARCH_COLUMNS = ["flow_time", "sensor", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "bytes", "packets", "raw_bytes", "raw_packets", "duration_seconds", "bits_s", "packets_s", "rate_status"]


@query(
    "flow_search_by_rate",
    f"""{dims.RATE_CTE}, w AS (SELECT *, {_AUTO} AS rate, CASE WHEN duration_ms > 0 THEN duration_ms / 1000.0 END AS sec FROM rated WHERE dst_port = 53 AND dst_ip LIKE '203.0.113.%' AND sensor = 'edge-2')
SELECT flow_time, sensor, src_ip, dst_ip, src_port, dst_port, proto, bytes * rate AS bytes, packets * rate AS packets, bytes AS raw_bytes, packets AS raw_packets,
sec::DOUBLE AS duration_seconds, round(CASE WHEN sec >= 1 THEN bytes * rate * 8 / sec END, 3)::DOUBLE AS bits_s, round(CASE WHEN sec >= 1 THEN packets * rate / sec END, 3)::DOUBLE AS packets_s,
CASE WHEN sec >= 1 THEN 'estimated_from_flow_duration' ELSE 'unavailable_no_flow_duration' END AS rate_status
FROM w ORDER BY CASE WHEN sec >= 1 THEN bytes * rate * 8 / sec END DESC NULLS LAST, flow_time DESC, src_ip, dst_ip, src_port, dst_port, raw_bytes LIMIT 200""",
)
def _search(s, d):
    rows = flt.by_ip(flt.by_port(flt.by_sensor(flows(s, d), "edge-2"), dst="53"), "203.0.113.0/24", "dst")
    found = topn.flow_search(rows, rates.current_rates(dims.rate_config(s, d)), order_by="bits_s", limit=200)
    return found.select(*_SEARCH_COLUMNS).withColumns({c: F.round(c, 3) for c in ("bits_s", "packets_s")})


@query(
    "declarative_filters",
    """SELECT sensor, proto, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM flows WHERE proto IN (6, 17) AND NOT (src_port = 123 OR dst_port = 123)
AND (split_part(src_ip, '.', 3)::INT < 2) AND dst_port BETWEEN 20 AND 9000 AND (src_asn = 64503 OR dst_asn = 64503 OR src_asn = 0 OR dst_asn = 0)
AND NOT (input_if = 4) AND bytes > 0 AND sensor LIKE '%edge%' AND NOT (dst_ip IN ('203.0.113.16', '203.0.113.17')) GROUP BY ALL""",
)
def _filters(s, d):
    rows = flt.apply_filters(
        flows(s, d),
        [
            {"field": "protocol", "operator": "in", "value": ["tcp", 17]},
            {"field": "port", "operator": "neq", "value": 123},
            {"field": "src_prefix", "operator": "prefix_contains", "value": "100.64.0.0/23"},
            {"field": "dst_port", "operator": "between", "value": [20, 9000]},
            {"field": "asn", "operator": "in", "value": [64503, 0]},
            {"field": "input_interface", "operator": "not_in", "value": [4]},
            {"field": "sensor", "operator": "contains", "value": "edge"},
            {"field": "sensor", "operator": "exists"},
            {"field": "dst_ip", "operator": "not_in", "value": ["203.0.113.16/31"]},
            {"field": "ip_version", "operator": "eq", "value": 4},
            {"field": "exclude_internal", "value": "yes"},
        ],
    )
    return rows.groupBy("sensor", "proto").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query(
    "port_and_flag_filters",
    "SELECT dst_port, tcp_flags, count(*) AS n FROM flows WHERE dst_port NOT IN (53, 123) AND src_port <> 2000 AND proto = 6 AND tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0 GROUP BY ALL",
)
def _ports(s, d):
    rows = flt.tcp_only(flt.by_port(flows(s, d), src="!2000", dst="!53,123"))
    rows = rows.filter(flt.syn_only(F.col("proto"), F.col("tcp_flags")))
    return rows.groupBy("dst_port", "tcp_flags").agg(F.count(F.lit(1)).alias("n"))


@query(
    "series_in_resolved_range",
    """SELECT sensor AS key, to_timestamp(epoch(flow_time)::BIGINT // 120 * 120)::TIMESTAMP AS bucket, round(sum(bytes)::BIGINT * 8 / 120.0, 4)::DOUBLE AS value FROM flows
WHERE date_trunc('minute', flow_time) >= TIMESTAMP '2026-07-10 12:25:00' AND flow_time < TIMESTAMP '2026-07-10 14:00:00' GROUP BY ALL""",
)
def _resolved_range(s, d):
    # Asked for until six hours from now: clipped to now, 95 minutes in at most 50 points of a minute or more.
    start, end, _ = series.resolve_range(END, start=END - timedelta(minutes=95), end=END + timedelta(hours=6))
    size = series.choose_bucket(start, end, 50, 60)
    stored = rollup.dash_rollup(flows(s, d), "protocol").filter((F.col("minute") >= flt.ts_lit(start)) & (F.col("minute") < flt.ts_lit(end)))
    return series.traffic_series(stored, "sensor", "bps", size).withColumn("value", F.round("value", 4))


@query(
    "series_at_effective_interval",
    "SELECT input_if, to_timestamp(epoch(flow_time)::BIGINT // 72 * 72)::TIMESTAMP AS bucket, sum(packets)::BIGINT AS raw_packets, round(sum(packets)::BIGINT / 72.0, 4)::DOUBLE AS packets_s FROM flows GROUP BY ALL",
)
def _effective_interval(s, d):
    size = series.effective_interval_ms(int((END - START).total_seconds() * 1000), 1000, 100) // 1000
    out = series.learning_series(flows(s, d), size, ["input_if"])
    return out.select("input_if", "bucket", "raw_packets", F.round("packets_s", 4).alias("packets_s"))


query(
    "sensor_options",
    "SELECT sensor, max(flow_time) AS last_seen, count(*) AS row_count FROM flows WHERE sensor <> '' GROUP BY sensor",
)(lambda s, d: topn.sensor_options(flows(s, d)))

query(
    "interface_rx_tx",
    """u AS (SELECT input_if AS interface_id, max(flow_time) AS last_seen, sum(packets) AS rp, 0 AS tp, sum(bytes) AS rb, 0 AS tb FROM flows GROUP BY 1
UNION ALL SELECT output_if, max(flow_time), 0, sum(packets), 0, sum(bytes) FROM flows GROUP BY 1)
SELECT interface_id, max(last_seen) AS last_seen, sum(rp)::BIGINT AS rx_packets, sum(tp)::BIGINT AS tx_packets, sum(rb)::BIGINT AS rx_bytes, sum(tb)::BIGINT AS tx_bytes FROM u WHERE interface_id > 0 GROUP BY 1""",
)(lambda s, d: topn.interface_rx_tx(flows(s, d)))


@query(
    "interfaces_with_meta",
    """v AS (SELECT 'edge-' || (n_nationkey % 3) AS sensor, 1 + (n_nationkey // 3) % 5 AS if_index, 'if' || n_nationkey AS if_name, n_name AS if_alias,
row_number() OVER (PARTITION BY n_nationkey % 3, (n_nationkey // 3) % 5 ORDER BY n_nationkey DESC) AS rn FROM nation),
g AS (SELECT sensor, input_if AS interface_id, sum(bytes)::BIGINT AS bytes FROM flows GROUP BY ALL)
SELECT g.*, coalesce(if_name, 'if' || interface_id) AS interface_name, coalesce(if_alias, '') AS interface_alias FROM g LEFT JOIN v ON v.sensor = g.sensor AND v.if_index = g.interface_id AND rn = 1""",
)
def _meta(s, d):
    from weirgauge.sources.tables import latest

    totals = flows(s, d).groupBy("sensor", F.col("input_if").alias("interface_id")).agg(F.sum("bytes").alias("bytes"))
    return topn.with_interface_meta(totals, latest(dims.interfaces(s, d), ["sensor", "if_index"], "updated_at"))


# --- checked requests -------------------------------------------------------


def _rollups(s, d, *names):
    rows = flows(s, d)
    return {name: rollup.dash_rollup(rows, name) for name in names}


_W = "flow_time BETWEEN TIMESTAMP '2026-07-10 12:10:20' AND TIMESTAMP '2026-07-10 13:20:40'"


@query(
    "request_top_ports_from_rollup",
    f"""{dims.RATE_CTE}, w AS (SELECT *, {_AUTO} AS rate FROM rated WHERE {_W} AND proto <> 1 AND sensor IN ('edge-0', 'edge-2')), g AS (SELECT dst_port::VARCHAR AS key, sum(bytes * rate)::BIGINT * 8 / 4220.0 AS value FROM w GROUP BY 1), t AS (SELECT sum(value) AS total FROM g)
SELECT row_number() OVER (ORDER BY value DESC, key)::INT AS rank, key, key AS label, round(value, 2)::DOUBLE AS value, round(value / total * 100, 2)::DOUBLE AS percent FROM g, t ORDER BY rank LIMIT 5""",
)
def _request_top(s, d):
    spec = specs.QuerySpec(
        "top_n", datetime(2026, 7, 10, 12, 10, 20), datetime(2026, 7, 10, 13, 20, 40), "bits_per_second", "dst_port", limit=5,
        filters=[{"field": "protocol", "operator": "neq", "value": "icmp"}, {"field": "sensor", "operator": "in", "value": ["edge-0", "edge-2"]}],
    )
    return spec.run(flows(s, d), rates.current_rates(dims.rate_config(s, d)), _rollups(s, d, "dst_port"))


@query(
    "request_series_with_comparison",
    f"""{dims.RATE_CTE}, w AS (SELECT sensor AS key, time_bucket(INTERVAL '300 seconds', flow_time, TIMESTAMP '2026-07-10') AS bucket, sum(packets * in_rate)::BIGINT / 300.0 AS v FROM rated WHERE input_if > 0 AND flow_time < TIMESTAMP '2026-07-10 14:00:00' GROUP BY ALL),
a AS (SELECT * FROM w WHERE bucket >= TIMESTAMP '2026-07-10 13:00:00'), b AS (SELECT key, bucket + INTERVAL 1 HOUR AS bucket, v FROM w WHERE bucket < TIMESTAMP '2026-07-10 13:00:00')
SELECT coalesce(a.key, b.key) AS key, coalesce(a.bucket, b.bucket) AS bucket, round(a.v, 3)::DOUBLE AS value, round(b.v, 3)::DOUBLE AS previous_value FROM a FULL JOIN b ON a.key = b.key AND a.bucket = b.bucket""",
)
def _request_series(s, d):
    spec = specs.QuerySpec(
        "timeseries", datetime(2026, 7, 10, 13), datetime(2026, 7, 10, 13, 59, 59, 999999), "pps", direction="ingress", group_by="sensor", resolution=300,
        comparison="previous_period",
    )
    spec.end = datetime(2026, 7, 10, 14)
    out = spec.run(flows(s, d).filter("flow_time < TIMESTAMP '2026-07-10 14:00:00'"), rates.current_rates(dims.rate_config(s, d)))
    return out.select("key", "bucket", F.round("value", 3).alias("value"), F.round("previous_value", 3).alias("previous_value"))


@query(
    "request_kpi_peak_bps",
    f"""w AS (SELECT time_bucket(INTERVAL '60 seconds', flow_time, TIMESTAMP '2026-07-10') AS bucket, sum(bytes * greatest(sample_rate, 1))::BIGINT * 8 / 60.0 AS v FROM flows WHERE {_W} GROUP BY ALL) SELECT 'total' AS key, round(max(v), 2)::DOUBLE AS max FROM w""",
)
def _request_kpi(s, d):
    spec = specs.QuerySpec("kpi", datetime(2026, 7, 10, 12, 10, 20), datetime(2026, 7, 10, 13, 20, 40), "bps", resolution=60, calculation="max")
    return spec.run(flows(s, d), None, _rollups(s, d, "series")).withColumn("max", F.round("max", 2))


@query(
    "request_table_series",
    f"""{dims.RATE_CTE}, u AS (SELECT 'download' AS direction, proto, flow_time, bytes * in_rate AS b FROM rated WHERE input_if = 2 AND sensor = 'edge-1' UNION ALL SELECT 'download', proto, flow_time, bytes * in_rate FROM rated WHERE output_if = 2 AND input_if <> 2 AND sensor = 'edge-1' AND false)
SELECT direction, proto, time_bucket(INTERVAL '120 seconds', flow_time, TIMESTAMP '2026-07-10') AS bucket, round(sum(b)::BIGINT * 8 / 120.0, 3)::DOUBLE AS value FROM u WHERE {_W} GROUP BY ALL""",
)
def _request_table(s, d):
    request = specs.TableRequest(
        "traffic_bps", datetime(2026, 7, 10, 12, 10, 20), datetime(2026, 7, 10, 13, 20, 40), "protocol", "download", "edge-1", 2, interval_ms=120_000
    )
    out = request.run(flows(s, d), rates.current_rates(dims.rate_config(s, d)))
    return out.withColumn("value", F.round("value", 3))


@query(
    "request_series_5s_with_rollup",
    """w AS (SELECT time_bucket(INTERVAL '5 seconds', flow_time, TIMESTAMP '2026-07-10') AS bucket, sum(bytes * greatest(sample_rate, 1))::BIGINT * 8 / 5.0 AS v FROM flows WHERE flow_time BETWEEN TIMESTAMP '2026-07-10 12:10:00' AND TIMESTAMP '2026-07-10 12:25:00' GROUP BY ALL) SELECT 'total' AS key, bucket, round(v, 3)::DOUBLE AS value FROM w""",
)
def _request_series_5s(s, d):
    spec = specs.QuerySpec("timeseries", datetime(2026, 7, 10, 12, 10), datetime(2026, 7, 10, 12, 25), "bps", resolution=5)
    return spec.run(flows(s, d), None, _rollups(s, d, "series")).select("key", "bucket", F.round("value", 3).alias("value"))


@query(
    "request_series_with_rollup_gap",
    f"""w AS (SELECT time_bucket(INTERVAL '300 seconds', flow_time, TIMESTAMP '2026-07-10') AS bucket, sum(bytes * greatest(sample_rate, 1))::BIGINT * 8 / 300.0 AS v FROM flows WHERE {_W} GROUP BY ALL) SELECT 'total' AS key, bucket, round(v, 3)::DOUBLE AS value FROM w""",
)
def _request_series_gap(s, d):
    spec = specs.QuerySpec("timeseries", datetime(2026, 7, 10, 12, 10, 20), datetime(2026, 7, 10, 13, 20, 40), "bps", resolution=300)
    gap = "minute < TIMESTAMP '2026-07-10 12:30:00' OR minute >= TIMESTAMP '2026-07-10 13:00:00'"
    stored = {name: rows.filter(gap) for name, rows in _rollups(s, d, "series").items()}
    return spec.run(flows(s, d), None, stored).select("key", "bucket", F.round("value", 3).alias("value"))


@query(
    "request_table_one_interface",
    f"""{dims.RATE_CTE}, u AS (SELECT 'download' AS direction, flow_time, bytes * in_rate AS b FROM rated WHERE input_if = 1 UNION ALL SELECT 'upload', flow_time, bytes * out_rate FROM rated WHERE output_if = 1)
SELECT direction, time_bucket(INTERVAL '120 seconds', flow_time, TIMESTAMP '2026-07-10') AS bucket, round(sum(b)::BIGINT * 8 / 120.0, 3)::DOUBLE AS value FROM u WHERE {_W} GROUP BY ALL""",
)
def _request_table_interface(s, d):
    request = specs.TableRequest(
        "traffic_bps", datetime(2026, 7, 10, 12, 10, 20), datetime(2026, 7, 10, 13, 20, 40), interface=1, interval_ms=120_000
    )
    out = request.run(flows(s, d), rates.current_rates(dims.rate_config(s, d)))
    return out.withColumn("value", F.round("value", 3))


# --- prefix joins -----------------------------------------------------------


@query(
    "asn_resolution",
    f"""{dims.ASN_CTE}, a AS (SELECT DISTINCT src_ip, {dims.sql_ip('src_ip')} AS addr FROM flows),
b AS (SELECT src_ip, asn, as_name, row_number() OVER (PARTITION BY src_ip ORDER BY plen DESC, asn DESC) AS rn FROM a JOIN asnp ON {dims.sql_holds('addr', 'asnp')}),
r AS (SELECT f.*, CASE WHEN f.src_asn > 0 THEN f.src_asn ELSE coalesce(b.asn, 0) END AS src_asn_resolved, CASE WHEN f.src_asn > 0 THEN f.src_as_name ELSE coalesce(b.as_name, '') END AS src_asn_name,
CASE WHEN f.src_asn > 0 THEN 'flow' WHEN b.asn IS NOT NULL THEN 'prefix' ELSE 'unresolved' END AS src_asn_state FROM flows f LEFT JOIN b ON b.src_ip = f.src_ip AND rn = 1)
SELECT src_asn_resolved, src_asn_name, src_asn_state, CASE WHEN src_asn_name <> '' THEN src_asn_name ELSE 'AS' || src_asn_resolved END AS label, sum(bytes)::BIGINT AS bytes FROM r GROUP BY ALL""",
)
def _asn(s, d):
    small = flows(s, d).groupBy("src_ip_key", "src_asn", "src_as_name").agg(F.sum("bytes").alias("bytes"))
    out = pfx.resolve_asn(small, pfx.prefix_table(dims.asn_prefixes(s, d)), "src")
    return (
        out.withColumn("label", scalars.asn_label(F.col("src_asn_resolved"), F.col("src_asn_name")))
        .groupBy("src_asn_resolved", "src_asn_name", "src_asn_state", "label")
        .agg(F.sum("bytes").alias("bytes"))
    )


@query(
    "asn_unresolved_queue",
    f"""{dims.ASN_CTE}, u AS (SELECT src_ip AS ip, bytes FROM flows WHERE src_asn = 0 UNION ALL SELECT dst_ip, bytes FROM flows WHERE dst_asn = 0),
g AS (SELECT ip, sum(bytes)::BIGINT AS bytes, count(*) AS flows, {dims.sql_ip('ip')} AS addr FROM u GROUP BY ip)
SELECT ip, bytes, flows FROM g WHERE NOT EXISTS (SELECT 1 FROM asnp WHERE {dims.sql_holds('g.addr', 'asnp')})""",
)
def _queue(s, d):
    return pfx.asn_queue(flows(s, d), pfx.prefix_table(dims.asn_prefixes(s, d))).drop("ip_key")


@query(
    "asn_top_with_country",
    """g AS (SELECT dst_asn, sum(bytes)::BIGINT AS bytes FROM flows GROUP BY 1), c AS (SELECT 64600 + s_suppkey * 2 AS asn, ['BR','US','DE','JP'][s_nationkey % 4 + 1] AS country FROM supplier)
SELECT g.*, coalesce(country, 'N/D') AS country FROM g LEFT JOIN c ON c.asn = g.dst_asn""",
)
def _country(s, d):
    countries = table(s, d, "supplier").selectExpr(
        "64600 + s_suppkey * 2 AS asn", "array('BR', 'US', 'DE', 'JP')[s_nationkey % 4] AS country"
    )
    return pfx.with_country(flows(s, d).groupBy("dst_asn").agg(F.sum("bytes").alias("bytes")), "dst_asn", countries)


@query(
    "zone_traffic",
    f"""{dims.ZONE_CTE}, a AS (SELECT DISTINCT src_ip, {dims.sql_ip('src_ip')} AS addr FROM flows),
z AS (SELECT src_ip, zone_name, prefix_type, row_number() OVER (PARTITION BY src_ip ORDER BY plen DESC, zone_name DESC, prefix_type DESC) AS rn FROM a JOIN zone ON {dims.sql_holds('addr', 'zone')} AND active)
SELECT zone_name AS src_zone, prefix_type AS src_prefix_type, sum(bytes)::BIGINT AS bytes, sum(flow_count)::BIGINT AS flows FROM flows f LEFT JOIN z ON z.src_ip = f.src_ip AND rn = 1 GROUP BY 1, 2""",
)
def _zones(s, d):
    small = flows(s, d).groupBy("src_ip_key").agg(F.sum("bytes").alias("bytes"), F.sum("flow_count").alias("flows"))
    zoned = pfx.with_zone(small, pfx.prefix_table(dims.zone_prefixes(s, d)), "src")
    return zoned.groupBy("src_zone", "src_prefix_type").agg(F.sum("bytes").alias("bytes"), F.sum("flows").alias("flows"))


@query(
    "zone_flows_by_prefix_table",
    f"""{dims.ZONE_CTE}, a AS (SELECT DISTINCT src_ip, {dims.sql_ip('src_ip')} AS addr FROM flows),
hit AS (SELECT DISTINCT src_ip FROM a JOIN zone ON {dims.sql_holds('addr', 'zone')} AND active)
SELECT src_ip, sum(packets)::BIGINT AS packets FROM flows WHERE src_ip IN (SELECT src_ip FROM hit) GROUP BY 1""",
)
def _zone_semi(s, d):
    table_ = pfx.prefix_table(dims.zone_prefixes(s, d)).filter("active")
    small = flows(s, d).groupBy("src_ip", "src_ip_key").agg(F.sum("packets").alias("packets"))
    return pfx.keep_matching(small, "src_ip_key", table_).drop("src_ip_key")


@query(
    "whitelist_hits",
    f"""{dims.WHITELIST_CTE}, g AS (SELECT src_ip, input_if, {dims.sql_ip('src_ip')} AS addr, sum(packets)::BIGINT AS packets FROM flows GROUP BY ALL),
m AS (SELECT src_ip, input_if, name, row_number() OVER (PARTITION BY src_ip, input_if ORDER BY whitelist_id) AS rn FROM g JOIN wl ON {dims.sql_holds('addr', 'wl')}
 AND input_if <> 4 AND ((is_global AND input_if <> 3) OR (input_if = 2 AND whitelist_id IN (1, 3))))
SELECT g.src_ip, g.input_if, packets, name AS whitelist_name FROM g LEFT JOIN m ON m.src_ip = g.src_ip AND m.input_if = g.input_if AND rn = 1""",
)
def _whitelist(s, d):
    rows = flows(s, d).groupBy("src_ip", "src_ip_key", "input_if").agg(F.sum("packets").alias("packets"))
    rows = rows.withColumns(
        {
            "use_global_whitelist": F.col("input_if") != 3,
            "extra_whitelist_ids": F.when(F.col("input_if") == 2, F.array(F.lit(1), F.lit(3))),
            "bypass_whitelist": F.col("input_if") == 4,
        }
    )
    hits = pfx.whitelist_hits(rows, "src_ip_key", pfx.prefix_table(dims.whitelist(s, d)))
    return hits.select("src_ip", "input_if", "packets", "whitelist_name")


@query(
    "prefix_traffic_1m",
    f"""{dims.CUSTOMER_CTE}, u AS (SELECT {MINUTE}, sensor, 'upload' AS direction, src_ip AS ip, bytes, packets, flow_count FROM flows
UNION ALL SELECT date_trunc('minute', flow_time), sensor, 'download', dst_ip, bytes, packets, flow_count FROM flows),
a AS (SELECT DISTINCT ip, {dims.sql_ip('ip')} AS addr FROM u),
b AS (SELECT ip, customer_id, customer_name, prefix, row_number() OVER (PARTITION BY ip ORDER BY plen DESC, customer_id DESC, customer_name DESC, prefix DESC) AS rn FROM a JOIN cust ON {dims.sql_holds('addr', 'cust')} AND enabled = 1)
SELECT minute, sensor, customer_id, customer_name, prefix, direction, {MEASURES} FROM u JOIN b ON b.ip = u.ip AND rn = 1 GROUP BY ALL""",
)
def _prefix_traffic(s, d):
    return pfx.prefix_traffic_1m(flows(s, d), pfx.prefix_table(dims.customer_prefixes(s, d)))


@query(
    "geo_edges_by_city",
    f"""{dims.GEO_CTE}, a AS (SELECT DISTINCT ip, {dims.sql_ip('ip')} AS addr FROM (SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows)),
l AS (SELECT ip, city, lat, lon, row_number() OVER (PARTITION BY ip ORDER BY plen DESC, city DESC) AS rn FROM a JOIN geo ON {dims.sql_holds('addr', 'geo')}),
e AS (SELECT coalesce(s.city, 'N/D') AS src_place, coalesce(t.city, 'N/D') AS dst_place, s.lat AS slat, s.lon AS slon, t.lat AS dlat, t.lon AS dlon, proto, dst_asn,
 bytes * greatest(sample_rate, 1) AS b, packets * greatest(sample_rate, 1) AS p, flow_count FROM flows f LEFT JOIN l s ON s.ip = f.src_ip AND s.rn = 1 LEFT JOIN l t ON t.ip = f.dst_ip AND t.rn = 1),
pr AS (SELECT src_place, dst_place, proto, row_number() OVER (PARTITION BY src_place, dst_place ORDER BY sum(b) DESC, proto DESC) AS rn FROM e GROUP BY 1, 2, 3),
asn AS (SELECT src_place, dst_place, dst_asn, row_number() OVER (PARTITION BY src_place, dst_place ORDER BY sum(b) DESC, dst_asn DESC) AS rn FROM e GROUP BY 1, 2, 3),
g AS (SELECT src_place, dst_place, min(slat) AS src_lat, min(slon) AS src_lon, min(dlat) AS dst_lat, min(dlon) AS dst_lon, sum(b)::BIGINT AS bytes, sum(p)::BIGINT AS packets, sum(flow_count)::BIGINT AS flows FROM e GROUP BY 1, 2 ORDER BY bytes DESC, 1, 2 LIMIT 60)
SELECT g.src_place, g.dst_place, src_lat, src_lon, dst_lat, dst_lon, round(bytes * 8 / 7200.0, 2)::DOUBLE AS bits_s, round(packets / 7200.0, 2)::DOUBLE AS packets_s, flows,
CASE pr.proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS top_protocol, asn.dst_asn AS top_asn
FROM g JOIN pr ON pr.src_place = g.src_place AND pr.dst_place = g.dst_place AND pr.rn = 1 JOIN asn ON asn.src_place = g.src_place AND asn.dst_place = g.dst_place AND asn.rn = 1""",
)
def _geo(s, d):
    rows = rates.recorded_rate(flows(s, d))
    return pfx.geo_edges(rows, pfx.prefix_table(dims.geo_prefixes(s, d)), "city", 60, 7200)


@query(
    "top_country_by_bytes",
    f"""{dims.ASN_CTE}, a AS (SELECT DISTINCT src_ip, {dims.sql_ip('src_ip')} AS addr FROM flows),
c AS (SELECT src_ip, country, row_number() OVER (PARTITION BY src_ip ORDER BY plen DESC, country DESC) AS rn FROM a JOIN asnp ON {dims.sql_holds('addr', 'asnp')}),
g AS (SELECT coalesce(country, 'N/D') AS key, sum(bytes * greatest(sample_rate, 1))::DOUBLE AS value FROM flows f LEFT JOIN c ON c.src_ip = f.src_ip AND rn = 1 GROUP BY 1), t AS (SELECT sum(value) AS total FROM g)
SELECT row_number() OVER (ORDER BY value DESC, key)::INT AS rank, key, key AS label, round(value, 2)::DOUBLE AS value, round(value / total * 100, 2)::DOUBLE AS percent FROM g, t""",
)
def _top_country(s, d):
    small = rollup.dash_rollup(flows(s, d), "src_ip").withColumn("src_ip_key", ip.ipv4_key(F.col("src_ip")))
    placed = pfx.longest_prefix(small, "src_ip_key", pfx.prefix_table(dims.asn_prefixes(s, d)), {"country": "country"})
    return topn.top_n(placed.withColumn("country", F.coalesce("country", F.lit("N/D"))), "country", "bytes", 7200)
