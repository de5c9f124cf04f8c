"""Detection, event lifecycle, learning and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirgauge.catalog.registry import query
from weirgauge.functions import ip
from weirgauge.operators import advise, detect, learn, rates, rollup
from weirgauge.operators import prefixes as pfx
from weirgauge.operators.filters import ts_lit
from weirgauge.sources import dims
from weirgauge.sources.lineitem_flows import flows, table

RATE = "greatest(sample_rate, 1)"


def rated(s, d):
    return rates.recorded_rate(flows(s, d))


# --- grouping for detection ----------------------------------------------------------

_NET24 = "regexp_extract(src_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.0/24'"
for _name, _keys in detect.GROUPINGS.items():
    _select = ", ".join(f"{_NET24} AS subnet" if k == "subnet" else k for k in _keys)
    query(
        f"detection_groups_{_name.replace(',', '_').replace('_ip', '').replace('_port', 'port')}",
        f"""SELECT date_trunc('minute', flow_time) AS bucket, proto, {_select}, sum(bytes * {RATE})::BIGINT AS bytes, sum(packets * {RATE})::BIGINT AS packets, sum(flow_count)::BIGINT AS flows, count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT dst_port) AS unique_dst_ports, count(DISTINCT src_port) AS unique_src_ports,
arg_max(dst_port, packets * {RATE} * 100000 + dst_port) AS top_dst_port, arg_max(src_port, packets * {RATE} * 100000 + src_port) AS top_src_port, min(flow_time) AS first_seen, max(flow_time) AS last_seen, round(sum(packets * {RATE})::BIGINT / 60.0, 3)::DOUBLE AS packets_s FROM flows GROUP BY ALL""",
    )(
        lambda s, d, name=_name: detect.detect_groups(rated(s, d), name)
        .drop("window_seconds", "bits_s", "flows_s")
        .withColumn("packets_s", F.round("packets_s", 3))
    )


def rules(s, d):
    """Six rules for each zone with an active prefix."""
    zones = dims.zone_prefixes(s, d).filter("active").selectExpr("cast(zone_id AS bigint) AS z")
    return zones.selectExpr("z", "explode(sequence(0, 5)) AS k").selectExpr(
        "z * 10 + k AS rule_id", "z AS zone_id", "concat('VECTOR_', k) AS vector",
        "array('transmits','transmits','both','transmits','receives','transmits')[k] AS direction",
        "array('UDP','DNS','ALL','TCP','ALL','UDP')[k] AS protocol",
        "array('packets_s','packets_s','bits_s','flows_s','packets_s','unique_dst_ips')[k] AS metric",
        "array(50.0, 10.0, 900000.0, 0.05, 100.0, 2.0)[k] AS warning_value", "array(400.0, 300.0, 9000000.0, 0.09, 1000.0, 3.0)[k] AS critical_value",
        "array(60, 60, 300, 60, 120, 300)[k] AS window_seconds", "array('any','any','!53','any','any','!2000')[k] AS src_port",
        "array('any','53','any','80,443','!53,123','any')[k] AS dst_port", "array('src_ip','','src_ip,dst_ip','src_ip, dst_ip, dst_port, protocol','subnet','src_ip')[k] AS group_by",
        "CASE WHEN k = 1 THEN 'DNS_SINGLE_FLOW_OUTBOUND' ELSE '' END AS detection_key", "k <> 3 AS use_global_whitelist",
        "CASE WHEN k = 3 THEN array(1, 3) END AS extra_whitelist_ids", "k = 4 AS bypass_whitelist", "true AS enabled",
    )


_RULES_CTE = f"""{dims.ZONE_CTE},
zr AS (SELECT n_nationkey * 10 + k AS rule_id, n_nationkey AS zone_id, k, ['transmits','transmits','both','transmits','receives','transmits'][k + 1] AS direction, ['UDP','DNS','ALL','TCP','ALL','UDP'][k + 1] AS protocol, ['packets_s','packets_s','bits_s','flows_s','packets_s','unique_dst_ips'][k + 1] AS metric,
 [50.0, 10.0, 900000.0, 0.05, 100.0, 2.0][k + 1] AS warning_value, [400.0, 300.0, 9000000.0, 0.09, 1000.0, 3.0][k + 1] AS critical_value, [60, 60, 300, 60, 120, 300][k + 1] AS win FROM nation, range(6) r(k) WHERE n_nationkey % 6 <> 5),
sd AS (SELECT *, 'transmits' AS side, src_ip AS internal_ip FROM flows UNION ALL SELECT *, 'receives', dst_ip FROM flows),
ad AS (SELECT DISTINCT internal_ip, {dims.sql_ip('internal_ip')} AS addr FROM sd),
zz AS (SELECT internal_ip, zone_id, row_number() OVER (PARTITION BY internal_ip ORDER BY plen DESC, zone_id DESC, prefix DESC) AS rn FROM ad JOIN zone ON {dims.sql_holds('addr', 'zone')} AND active),
mt AS (SELECT sd.*, zr.*, CASE WHEN k = 1 THEN 'conversation' WHEN k IN (0, 5) THEN 'src_ip' WHEN k = 2 THEN 'src_ip,dst_ip' WHEN k = 3 THEN 'src_ip,dst_ip,dst_port' ELSE 'subnet' END AS grouping FROM sd JOIN zz ON zz.internal_ip = sd.internal_ip AND zz.rn = 1 JOIN zr ON zr.zone_id = zz.zone_id AND (zr.direction = 'both' OR zr.direction = side)
 AND CASE k WHEN 0 THEN proto = 17 WHEN 1 THEN proto = 17 AND dst_port = 53 WHEN 2 THEN src_port <> 53 WHEN 3 THEN proto = 6 AND dst_port IN (80, 443) WHEN 4 THEN dst_port NOT IN (53, 123) ELSE proto = 17 AND src_port <> 2000 END),
gr AS (SELECT rule_id, zone_id, side, grouping, to_timestamp(epoch(flow_time)::BIGINT // win * win)::TIMESTAMP AS bucket, proto, CASE WHEN grouping = 'subnet' THEN {_NET24} END AS subnet, CASE WHEN grouping <> 'subnet' THEN src_ip END AS src_ip, CASE WHEN grouping = 'conversation' THEN src_port END AS src_port,
 CASE WHEN grouping NOT IN ('subnet', 'src_ip') THEN dst_ip END AS dst_ip, CASE WHEN grouping IN ('src_ip,dst_ip,dst_port', 'conversation') THEN dst_port END AS dst_port, metric, warning_value, critical_value, win, sum(bytes * {RATE})::BIGINT AS bytes, sum(packets * {RATE})::BIGINT AS packets, sum(flow_count)::BIGINT AS flows, count(DISTINCT mt.dst_ip) AS unique_dst_ips FROM mt GROUP BY ALL),
vl AS (SELECT *, CASE metric WHEN 'bits_s' THEN bytes * 8 / win WHEN 'flows_s' THEN flows / win WHEN 'unique_dst_ips' THEN unique_dst_ips ELSE packets / win END AS metric_value FROM gr)
"""
_RULE_COLUMNS = "rule_id, zone_id, side, grouping, bucket, proto, subnet, src_ip, src_port, dst_ip, dst_port, bytes, packets, flows"


@query(
    "detection_rules",
    f"""{_RULES_CTE} SELECT {_RULE_COLUMNS}, round(metric_value, 3)::DOUBLE AS metric_value, CASE WHEN metric_value >= critical_value THEN 'critical' ELSE 'warning' END AS severity FROM vl WHERE metric_value >= warning_value""",
)
def _rules(s, d):
    zones = pfx.prefix_table(dims.zone_prefixes(s, d)).filter("active")
    hits = detect.eval_rules(rated(s, d), zones, rules(s, d), counts=False)
    return hits.select(*[c.strip() for c in _RULE_COLUMNS.split(",")], F.round("metric_value", 3).alias("metric_value"), "severity")


@query(
    "detection_rules_with_whitelist",
    f"""{_RULES_CTE.replace(
        "sd AS (SELECT *, 'transmits'", "ok AS (SELECT *, split_part(dst_ip, '.', 4)::INT AS o FROM flows), sd AS (SELECT *, 'transmits'"
    ).replace("FROM flows UNION ALL SELECT *, 'receives', dst_ip FROM flows", "FROM ok UNION ALL SELECT *, 'receives', dst_ip FROM ok").replace(
        "ELSE proto = 17 AND src_port <> 2000 END)", "ELSE proto = 17 AND src_port <> 2000 END AND NOT (o BETWEEN 0 AND 63 AND k NOT IN (3, 4)) AND NOT (o BETWEEN 64 AND 95 AND k = 3))"
    )} SELECT {_RULE_COLUMNS}, CASE WHEN metric_value >= critical_value THEN 'critical' ELSE 'warning' END AS severity FROM vl WHERE metric_value >= warning_value""",
)
def _rules_whitelisted(s, d):
    zones = pfx.prefix_table(dims.zone_prefixes(s, d)).filter("active")
    allowed = table(s, d, "region").selectExpr(
        "r_regionkey AS whitelist_id", "r_name AS name", "CASE r_regionkey WHEN 0 THEN '203.0.113.0/26' WHEN 1 THEN '203.0.113.64/27' ELSE concat('10.', r_regionkey, '.0.0/16') END AS prefix", "r_regionkey = 0 AS is_global"
    )
    hits = detect.eval_rules(rated(s, d), zones, rules(s, d), pfx.prefix_table(allowed), counts=False)
    return hits.select(*[c.strip() for c in _RULE_COLUMNS.split(",")], "severity")


@query(
    "detection_rules_sliding",
    f"""{_RULES_CTE.replace("gr AS (SELECT rule_id", "ws AS (SELECT mt.*, to_timestamp(unnest(range((epoch(flow_time)::BIGINT - win) // 30 * 30 + 30, epoch(flow_time)::BIGINT + 1, 30)))::TIMESTAMP AS bucket FROM mt),"
    " gr AS (SELECT rule_id").replace("to_timestamp(epoch(flow_time)::BIGINT // win * win)::TIMESTAMP AS bucket", "bucket").replace("count(DISTINCT mt.dst_ip)", "count(DISTINCT ws.dst_ip)").replace("FROM mt GROUP BY ALL", "FROM ws GROUP BY ALL")}
SELECT {_RULE_COLUMNS}, unique_dst_ips, CASE WHEN metric_value >= critical_value THEN 'critical' ELSE 'warning' END AS severity FROM vl WHERE metric_value >= critical_value""",
)
def _rules_sliding(s, d):
    zones = pfx.prefix_table(dims.zone_prefixes(s, d)).filter("active")
    hits = detect.eval_rules(rated(s, d), zones, rules(s, d), cadence=detect.CADENCE, counts=("dst_ip",)).filter("severity = 'critical'")
    return hits.select(*[c.strip() for c in _RULE_COLUMNS.split(",")], "unique_dst_ips", "severity")


def vectors(s, d):
    return table(s, d, "nation").selectExpr(
        "cast(n_nationkey AS bigint) AS vector_id",
        "CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE concat('203.0.113.', n_nationkey * 10, '/', 24 + n_nationkey % 5) END AS target_cidr",
        "CASE WHEN n_nationkey % 3 = 0 THEN concat('edge-', n_nationkey % 2) END AS sensor",
        "CASE WHEN n_nationkey % 5 = 0 THEN cast(1 + n_nationkey % 4 AS bigint) END AS interface_id",
        "CASE WHEN n_nationkey % 7 = 0 THEN 'sends' ELSE 'receives' END AS direction",
        "array('IP','UDP','TCP','DNS','TCP+SYN','ICMP')[n_nationkey % 6] AS decoder",
        "cast(array(60.0, 8.0, 20.0, 2.0)[n_nationkey % 4] * CASE n_nationkey % 3 WHEN 1 THEN 3000 WHEN 2 THEN 0.01 ELSE 1 END AS double) AS threshold_value",
        "array('packets_s','bits_s','flows_s')[n_nationkey % 3] AS threshold_unit",
    )


_VECTOR_CTE = f"""
ve AS (SELECT n_nationkey AS vector_id, n_nationkey % 4 = 0 AS any_target, 203::BIGINT * 16777216 + 113 * 256 + n_nationkey * 10 AS tint, 24 + n_nationkey % 5 AS tlen, CASE WHEN n_nationkey % 3 = 0 THEN 'edge-' || (n_nationkey % 2) END AS vs, CASE WHEN n_nationkey % 5 = 0 THEN 1 + n_nationkey % 4 END AS vi, CASE WHEN n_nationkey % 7 = 0 THEN 'sends' ELSE 'receives' END AS vd,
 ['IP','UDP','TCP','DNS','TCP+SYN','ICMP'][n_nationkey % 6 + 1] AS decoder, ([60.0, 8.0, 20.0, 2.0][n_nationkey % 4 + 1] * CASE n_nationkey % 3 WHEN 1 THEN 3000 WHEN 2 THEN 0.01 ELSE 1 END)::DOUBLE AS threshold_value, ['packets_s','bits_s','flows_s'][n_nationkey % 3 + 1] AS threshold_unit FROM nation),
tg AS (SELECT *, 'receives' AS direction, dst_ip AS target_ip, input_if AS interface_id FROM flows UNION ALL SELECT *, 'sends', src_ip, output_if FROM flows),
vv AS (SELECT vector_id, date_trunc('minute', flow_time) AS bucket, target_ip, threshold_value, threshold_unit, sum(bytes)::BIGINT AS bytes, sum(packets)::BIGINT AS packets, sum(flow_count)::BIGINT AS flows FROM tg JOIN ve ON vd = direction AND (vs IS NULL OR vs = sensor) AND (vi IS NULL OR vi = interface_id)
 AND (any_target OR ({dims.sql_ip('target_ip')} >> (32 - tlen)) = (tint >> (32 - tlen))) AND CASE decoder WHEN 'IP' THEN true WHEN 'UDP' THEN proto = 17 WHEN 'TCP' THEN proto = 6 WHEN 'DNS' THEN proto IN (6, 17) AND (src_port = 53 OR dst_port = 53) WHEN 'TCP+SYN' THEN proto = 6 AND tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0 ELSE proto = 1 END GROUP BY ALL),
vw AS (SELECT *, CASE threshold_unit WHEN 'bits_s' THEN bytes * 8 / 60 WHEN 'flows_s' THEN flows / 60 ELSE packets / 60 END AS value FROM vv)"""

query(
    "attack_vectors",
    f"{_VECTOR_CTE} SELECT vector_id, bucket, target_ip, round(value, 4)::DOUBLE AS value, bytes, packets, flows FROM vw WHERE value >= threshold_value",
)(
    lambda s, d: detect.eval_vectors(flows(s, d), vectors(s, d)).select(
        "vector_id", "bucket", "target_ip", F.round("value", 4).alias("value"), "bytes", "packets", "flows"
    )
)
query(
    "attack_vector_test_report",
    f"""{_VECTOR_CTE}, pk AS (SELECT vector_id, max(value) AS value, sum(flows)::BIGINT AS flows, sum(bytes)::BIGINT AS bytes, sum(packets)::BIGINT AS packets FROM vw GROUP BY 1)
SELECT ve.vector_id, round(pk.value, 4)::DOUBLE AS value, coalesce(pk.value >= threshold_value, false) AS match, CASE WHEN pk.value IS NULL THEN 'no_matching_flows' WHEN pk.value >= threshold_value THEN 'threshold_reached' ELSE 'below_threshold' END AS reason, coalesce(flows, 0) AS flows, coalesce(bytes, 0) AS bytes, coalesce(packets, 0) AS packets FROM ve LEFT JOIN pk USING (vector_id)""",
)(
    lambda s, d: detect.test_vectors(flows(s, d), vectors(s, d)).select(
        "vector_id", F.round("value", 4).alias("value"), "match", "reason", "flows", "bytes", "packets"
    )
)

query(
    "attack_vector_samples",
    f"""{_VECTOR_CTE.replace("vv AS (", "vq AS (SELECT vector_id, src_port % 5 AS slot, max({'bytes': bytes, 'packets': packets, 'flow_time': flow_time, 'src_ip': src_ip, 'src_port': src_port, 'dst_ip': dst_ip, 'dst_port': dst_port, 'proto': proto}) AS m FROM tg JOIN ve ON vd = direction AND (vs IS NULL OR vs = sensor) AND (vi IS NULL OR vi = interface_id)"
    " AND (any_target OR (" + dims.sql_ip('target_ip') + " >> (32 - tlen)) = (tint >> (32 - tlen))) AND CASE decoder WHEN 'IP' THEN true WHEN 'UDP' THEN proto = 17 WHEN 'TCP' THEN proto = 6 WHEN 'DNS' THEN proto IN (6, 17) AND (src_port = 53 OR dst_port = 53) WHEN 'TCP+SYN' THEN proto = 6 AND tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0 ELSE proto = 1 END GROUP BY ALL), vv AS (")}
SELECT vector_id, m.bytes AS bytes, m.packets AS packets, m.flow_time AS flow_time, m.src_ip AS src_ip, m.src_port AS src_port, m.dst_ip AS dst_ip, m.dst_port AS dst_port, m.proto AS proto FROM vq""",
)(
    lambda s, d: detect.test_vectors(flows(s, d), vectors(s, d)).select("vector_id", F.explode("samples").alias("m")).select("vector_id", "m.*")
)


@query(
    "distinct_counts_from_rollup",
    """SELECT sensor, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_port) AS ports, count(DISTINCT (src_ip, src_port, dst_ip, dst_port, proto)) AS conversations, true AS within_error FROM flows GROUP BY sensor""",
)
def _distinct_rollup(s, d):
    rows = flows(s, d)
    stored = rollup.distinct_1m(rows)
    told = rollup.distinct_counts(rollup.merge_rollup(stored), ["sensor"])
    exact = rows.groupBy("sensor").agg(
        F.count_distinct("src_ip").alias("sources"), F.count_distinct("dst_port").alias("ports"),
        F.count_distinct("src_ip", "src_port", "dst_ip", "dst_port", "proto").alias("conversations"),
    )
    near = [F.abs(F.col(f"t.{c}") - F.col(f"e.{c}")) <= F.col(f"e.{c}") * rollup.SKETCH_ERROR for c in ("sources", "ports", "conversations")]
    return exact.alias("e").join(told.alias("t"), "sensor").select("sensor", "e.sources", "e.ports", "e.conversations", (near[0] & near[1] & near[2]).alias("within_error"))


# --- runs and lifecycle -----------------------------------------------------------------

_POINTS_CTE = f"""
pt AS (SELECT sensor, dst_port, date_trunc('minute', flow_time) AS bucket, sum(packets * {RATE})::BIGINT / 60.0 AS value FROM flows GROUP BY ALL HAVING sum(packets * {RATE}) >= 60 * 100),
ky AS (SELECT *, 'anom:' || sha256('decoder=PORT|sensor=' || sensor || '|target=' || dst_port) AS dedupe_key FROM pt)"""


def points(s, d):
    return (
        rated(s, d).groupBy("sensor", "dst_port", F.date_trunc("minute", "flow_time").alias("bucket"))
        .agg((F.sum(F.col("packets") * F.col("rate")) / 60.0).alias("value")).filter("value >= 100")
        .withColumn("threshold", F.lit(100.0))
    )


def keyed_points(s, d):
    key = detect.dedupe_key(sensor=F.col("sensor"), target=F.col("dst_port"), decoder=F.lit("PORT"))
    return points(s, d).withColumn("dedupe_key", key)


query(
    "event_dedupe_keys",
    f"{_POINTS_CTE} SELECT sensor, dst_port, dedupe_key, count(*) AS n FROM ky GROUP BY ALL",
)(lambda s, d: keyed_points(s, d).groupBy("sensor", "dst_port", "dedupe_key").agg(F.count(F.lit(1)).alias("n")))

_RUNS = """r0 AS (SELECT *, epoch(bucket)::BIGINT // 60 - row_number() OVER (PARTITION BY sensor, dst_port ORDER BY bucket) AS island FROM pt), r1 AS (SELECT *, row_number() OVER (PARTITION BY sensor, dst_port, island ORDER BY bucket) AS run_length FROM r0)"""
query(
    "consecutive_windows",
    f"{_POINTS_CTE}, {_RUNS} SELECT sensor, dst_port, bucket, run_length, run_length >= 3 AS fires FROM r1",
)(
    lambda s, d: detect.consecutive(points(s, d), ["sensor", "dst_port"], 60, 3).select("sensor", "dst_port", "bucket", "run_length", "fires")
)
query(
    "event_cooldown",
    f"""{_POINTS_CTE}, fr AS (WITH RECURSIVE f AS (SELECT sensor, dst_port, min(bucket) AS bucket FROM pt GROUP BY 1, 2 UNION ALL SELECT f.sensor, f.dst_port, min(pt.bucket) FROM f JOIN pt ON pt.sensor = f.sensor AND pt.dst_port = f.dst_port AND date_diff('second', f.bucket, pt.bucket) >= 300 GROUP BY 1, 2) SELECT * FROM f)
SELECT pt.sensor, pt.dst_port, pt.bucket, fr.bucket IS NULL AS suppressed FROM pt LEFT JOIN fr ON fr.sensor = pt.sensor AND fr.dst_port = pt.dst_port AND fr.bucket = pt.bucket""",
)(lambda s, d: detect.cooldown(points(s, d), ["sensor", "dst_port"], 300).select("sensor", "dst_port", "bucket", "suppressed"))

_SESSION = f"""{_POINTS_CTE}, g0 AS (SELECT *, CASE WHEN date_diff('second', lag(bucket) OVER w, bucket) <= 120 THEN 0 ELSE 1 END AS opens FROM ky WINDOW w AS (PARTITION BY dedupe_key ORDER BY bucket)),
g1 AS (SELECT *, sum(opens) OVER (PARTITION BY dedupe_key ORDER BY bucket) AS n FROM g0),
ev AS (SELECT dedupe_key, n, min(bucket) AS first_seen, max(bucket) AS last_seen, arg_min(value, bucket) AS trigger_value, arg_max(value, bucket) AS last_value, max(value) AS peak_value, count(*) AS points FROM g1 GROUP BY ALL)"""
_EV = "dedupe_key, first_seen, last_seen, round(trigger_value, 3)::DOUBLE AS trigger_value, round(last_value, 3)::DOUBLE AS last_value, round(peak_value, 3)::DOUBLE AS peak_value, points"


def _shown(df):
    return df.select(
        "dedupe_key", "first_seen", "last_seen", F.round("trigger_value", 3).alias("trigger_value"), F.round("last_value", 3).alias("last_value"),
        F.round("peak_value", 3).alias("peak_value"), "points",
    )


query("event_sessions", f"{_SESSION} SELECT {_EV} FROM ev")(lambda s, d: _shown(detect.sessions(keyed_points(s, d), ["dedupe_key"])))
query(
    "events_of_minimum_duration", f"{_SESSION} SELECT {_EV} FROM ev WHERE date_diff('second', first_seen, last_seen) + 60 >= 180"
)(lambda s, d: _shown(detect.min_duration(detect.sessions(keyed_points(s, d), ["dedupe_key"]), 180)))

query(
    "anomaly_history",
    f"""{_POINTS_CTE} SELECT dedupe_key, min(bucket) AS first_seen, max(bucket) AS last_seen, round(arg_min(value, bucket), 3)::DOUBLE AS trigger_value, round(arg_max(value, bucket), 3)::DOUBLE AS last_value, round(max(value), 3)::DOUBLE AS peak_value, count(*) AS points FROM ky GROUP BY 1""",
)(
    lambda s, d: _shown(detect.anomaly_history(keyed_points(s, d).withColumnRenamed("bucket", "seen_at"), ["dedupe_key"]))
)


def event_state(s, d, until="2026-07-10 13:00:00", closed=True):
    """State after the points before a moment, closed at that moment."""
    seen = keyed_points(s, d).withColumnRenamed("bucket", "seen_at")
    early = detect.anomaly_history(seen.filter(F.col("seen_at") < ts_lit(until)), ["dedupe_key"]).withColumn("status", F.lit("active"))
    return detect.close_events(early, ts_lit(until)) if closed else early


query(
    "events_upserted",
    f"""{_POINTS_CTE}, a AS (SELECT dedupe_key, min(bucket) AS fs, max(bucket) AS ls, arg_min(value, bucket) AS tv, arg_max(value, bucket) AS lv, max(value) AS pv, count(*) AS n FROM ky WHERE bucket < TIMESTAMP '2026-07-10 13:00:00' GROUP BY 1),
b AS (SELECT dedupe_key, min(bucket) AS fs, max(bucket) AS ls, arg_min(value, bucket) AS tv, arg_max(value, bucket) AS lv, max(value) AS pv, count(*) AS n FROM ky WHERE bucket >= TIMESTAMP '2026-07-10 13:00:00' GROUP BY 1),
u AS (SELECT coalesce(a.dedupe_key, b.dedupe_key) AS dedupe_key, coalesce(a.fs, b.fs) AS first_seen, coalesce(b.ls, a.ls) AS last_seen, coalesce(a.tv, b.tv) AS tv, coalesce(b.lv, a.lv) AS lv, greatest(coalesce(a.pv, 0), coalesce(b.pv, 0)) AS pv, coalesce(a.n, 0) + coalesce(b.n, 0) AS points, CASE WHEN b.dedupe_key IS NOT NULL THEN 'active' WHEN date_diff('second', a.ls, TIMESTAMP '2026-07-10 13:00:00') > 120 THEN 'ended' ELSE 'active' END AS st FROM a FULL JOIN b USING (dedupe_key))
SELECT dedupe_key, first_seen, last_seen, round(tv, 3)::DOUBLE AS trigger_value, round(lv, 3)::DOUBLE AS last_value, round(pv, 3)::DOUBLE AS peak_value, points::BIGINT AS points, CASE WHEN st = 'active' AND date_diff('second', last_seen, TIMESTAMP '2026-07-10 14:01:00') > 120 THEN 'ended' ELSE st END AS status FROM u""",
)(
    lambda s, d: (
        lambda out: _shown(out).join(out.select("dedupe_key", "status"), "dedupe_key")
    )(
        detect.close_events(
            detect.upsert_events(
                event_state(s, d),
                keyed_points(s, d).withColumnRenamed("bucket", "seen_at").filter("seen_at >= TIMESTAMP '2026-07-10 13:00:00'"),
            ),
            ts_lit("2026-07-10 14:01:00"),
        )
    )
)

# --- event tables derived from orders ------------------------------------------------------

_EVENTS_CTE = """
ev AS (SELECT o_orderkey AS event_id, 'V' || (o_custkey % 9) AS vector, '203.0.113.' || (o_custkey % 50) AS target, ['warning','critical','info'][o_orderkey % 3 + 1] AS severity, ['active','ended','closed','rejected','active'][o_custkey % 5 + 1] AS status, TIMESTAMP '2026-07-10 12:00:00' + to_seconds(o_orderkey * 7 % 7200) AS first_seen,
 TIMESTAMP '2026-07-10 12:00:00' + to_seconds(o_orderkey * 7 % 7200 + o_custkey % 600) AS last_seen, o_totalprice AS peak_value, 'Label ' || (o_orderkey % 4) AS label, ['peaks','rules'][o_orderkey % 2 + 1] AS source, o_orderkey % 13 = 0 AS is_negative_sample, CASE WHEN o_orderkey % 4 = 0 THEN 'sent' END AS outcome, o_custkey % 4 AS points, (o_custkey % 3000)::DOUBLE AS value FROM orders)"""


def events(s, d):
    return table(s, d, "orders").selectExpr(
        "o_orderkey AS event_id", "concat('V', o_custkey % 9) AS vector", "concat('203.0.113.', o_custkey % 50) AS target",
        "array('warning','critical','info')[cast(o_orderkey % 3 AS int)] AS severity", "array('active','ended','closed','rejected','active')[cast(o_custkey % 5 AS int)] AS status",
        "TIMESTAMP '2026-07-10 12:00:00' + make_dt_interval(0, 0, 0, o_orderkey * 7 % 7200) AS first_seen",
        "TIMESTAMP '2026-07-10 12:00:00' + make_dt_interval(0, 0, 0, o_orderkey * 7 % 7200 + o_custkey % 600) AS last_seen", "o_totalprice AS peak_value",
        "concat('Label ', o_orderkey % 4) AS label", "array('peaks','rules')[cast(o_orderkey % 2 AS int)] AS source", "o_orderkey % 13 = 0 AS is_negative_sample",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'sent' END AS outcome", "o_custkey % 4 AS points", "cast(o_custkey % 3000 AS double) AS value",
    )


query(
    "active_anomaly_summary",
    f"{_EVENTS_CTE} SELECT count(*) FILTER (status = 'active') AS active_total, count(*) FILTER (status = 'active' AND severity = 'warning') AS active_warning, count(*) FILTER (status = 'active' AND severity = 'critical') AS active_critical FROM ev",
)(lambda s, d: detect.anomaly_summary(events(s, d)))
query(
    "consolidated_anomalies",
    f"""{_EVENTS_CTE} SELECT vector, target, CASE max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, bool_or(status = 'active') AS active, min(first_seen) AS first_seen, max(last_seen) AS last_seen, max(peak_value) AS peak_value, count(*) AS members FROM ev GROUP BY ALL""",
)(
    lambda s, d: detect.consolidate(events(s, d)).withColumn("active", F.col("status") == "active").drop("status", "label")
)
query(
    "recent_peak_events",
    f"{_EVENTS_CTE} SELECT event_id, last_seen, severity FROM ev WHERE source = 'peaks' AND NOT is_negative_sample ORDER BY last_seen DESC, event_id LIMIT 1000",
)(lambda s, d: detect.recent_events(events(s, d), "peaks", 1000).select("event_id", "last_seen", "severity"))
query(
    "mitigation_retries",
    f"{_EVENTS_CTE} SELECT event_id FROM ev WHERE outcome IS NULL AND (status = 'active' OR (status = 'ended' AND date_diff('second', last_seen + INTERVAL 120 SECOND, TIMESTAMP '2026-07-10 13:30:00') <= 900))",
)(
    lambda s, d: detect.retry_candidates(
        events(s, d).withColumn("ended_at", F.col("last_seen") + F.expr("INTERVAL 120 SECONDS")), ts_lit("2026-07-10 13:30:00")
    ).select("event_id")
)


@query(
    "response_shown_per_anomaly",
    f"""{_EVENTS_CTE}, rp AS (SELECT l_orderkey AS event_id, l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS response_id, ['sent','pending','failed','queued','withdrawn'][l_linenumber % 5 + 1] AS response_status, l_shipdate AS created_at FROM lineitem),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN response_status IN ('sent','queued') THEN 0 WHEN response_status = 'pending' THEN 1 ELSE 2 END, created_at DESC, response_id DESC) AS rn, count(*) OVER (PARTITION BY event_id) AS n FROM rp)
SELECT ev.event_id AS anomaly_id, rk.response_id, rk.response_status, coalesce(n, 0) AS responses FROM ev LEFT JOIN rk ON rk.event_id = ev.event_id AND rn = 1""",
)
def _responses(s, d):
    given = table(s, d, "lineitem").selectExpr(
        "l_orderkey AS anomaly_id", "l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS response_id",
        "array('sent','pending','failed','queued','withdrawn')[l_linenumber % 5] AS response_status", "cast(l_shipdate AS timestamp) AS created_at",
    )
    anomalies = events(s, d).select(F.col("event_id").alias("anomaly_id"))
    return detect.response_state(anomalies, given).select("anomaly_id", "response_id", "response_status", "responses")


query(
    "threshold_states",
    f"""{_EVENTS_CTE} SELECT event_id, CASE severity WHEN 'critical' THEN 1500.0 ELSE 500.0 END::DOUBLE AS trigger_threshold, value AS trigger_value, CASE WHEN event_id % 7 = 0 THEN 1200.0 ELSE 1500.0 END::DOUBLE AS automatic_threshold, value >= CASE severity WHEN 'critical' THEN 1500.0 ELSE 500.0 END AS condition_passed, 'packets_per_second' AS canonical_unit FROM ev""",
)(
    lambda s, d: detect.threshold_state(
        events(s, d).withColumns(
            {
                "warning_value": F.lit(500.0), "critical_value": F.lit(1500.0), "metric": F.lit("packets_s"), "metric_value": F.col("value"),
                "automatic_value": F.when(F.col("event_id") % 7 == 0, 1200.0).otherwise(0.0),
            }
        )
    ).select("event_id", "trigger_threshold", "trigger_value", "automatic_threshold", "condition_passed", "canonical_unit")
)
query(
    "automatic_policy_gate",
    f"""{_EVENTS_CTE}, g AS (SELECT event_id, concat_ws(',', CASE WHEN severity <> 'critical' THEN 'warning_manual_only' END, CASE WHEN value < 1500 THEN 'below_automatic_mitigation_threshold' END, CASE WHEN points < 2 THEN 'insufficient_time_series_evidence' END, CASE WHEN event_id % 10 = 1 THEN 'cgnat_mapping_ambiguous' END, CASE WHEN event_id % 17 = 2 THEN 'dns_destination_whitelisted' END) AS reasons FROM ev)
SELECT event_id, reasons, reasons = '' AS allowed, split_part(reasons, ',', 1) AS reason FROM g""",
)(
    lambda s, d: detect.policy_gate(
        events(s, d).withColumns(
            {
                "last_value": F.col("value"), "automatic_threshold": F.lit(1500.0),
                "addressing_block_reason": F.when(F.col("event_id") % 10 == 1, "cgnat_mapping_ambiguous").otherwise(""),
                "whitelist_name": F.when(F.col("event_id") % 17 == 2, "known"),
            }
        )
    ).select("event_id", F.array_join("reasons", ",").alias("reasons"), "allowed", "reason")
)

# --- anomalies against flows -----------------------------------------------------------------

_ANOM_CTE = """
an AS (SELECT c_custkey AS anomaly_id, '203.0.113.' || (c_custkey % 200 + 1) AS a_dst, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE ([53,80,443,123,8443,3478,22,9004][c_custkey % 8 + 1]) END AS a_port, NULL::VARCHAR AS a_src, TIMESTAMP '2026-07-10 12:00:00' + to_seconds(c_custkey * 13 % 6000) AS fs, TIMESTAMP '2026-07-10 12:05:00' + to_seconds(c_custkey * 13 % 6000) AS ls, c_custkey % 5 = 0 AS no_dns FROM customer),
rel AS (SELECT an.anomaly_id, f.* FROM flows f JOIN an ON f.dst_ip = a_dst AND flow_time BETWEEN fs - INTERVAL 60 SECOND AND ls + INTERVAL 60 SECOND AND (a_port IS NULL OR a_port = dst_port) AND NOT (no_dns AND dst_port = 53))"""


def anomalies(s, d):
    """One anomaly per customer."""
    return table(s, d, "customer").selectExpr(
        "c_custkey AS anomaly_id", "concat('203.0.113.', c_custkey % 200 + 1) AS dst_ip", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE array(53,80,443,123,8443,3478,22,9004)[cast(c_custkey % 8 AS int)] END AS dst_port",
        "cast(NULL AS string) AS src_ip", "cast(NULL AS int) AS proto", "TIMESTAMP '2026-07-10 12:00:00' + make_dt_interval(0, 0, 0, c_custkey * 13 % 6000) AS first_seen",
        "TIMESTAMP '2026-07-10 12:05:00' + make_dt_interval(0, 0, 0, c_custkey * 13 % 6000) AS last_seen", "CASE WHEN c_custkey % 5 = 0 THEN array(53) END AS excluded_ports",
    )


query(
    "anomaly_related_flows",
    f"{_ANOM_CTE} SELECT anomaly_id, flow_time, src_ip, dst_ip, dst_port, proto, bytes, packets FROM rel",
)(
    lambda s, d: detect.related_flows(anomalies(s, d), flows(s, d)).select("anomaly_id", "flow_time", "src_ip", "dst_ip", "dst_port", "proto", "bytes", "packets")
)
query(
    "anomaly_cardinalities",
    f"{_ANOM_CTE} SELECT anomaly_id, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_ip) AS destinations, count(DISTINCT src_ip || src_port || '|' || dst_ip || dst_port || '|' || proto) AS conversations FROM rel GROUP BY 1",
)(lambda s, d: detect.cardinalities(detect.related_flows(anomalies(s, d), flows(s, d), distinct=True)))
query(
    "events_filled_from_flows",
    f"""{_ANOM_CTE}, hv AS (SELECT *, row_number() OVER (PARTITION BY anomaly_id ORDER BY packets DESC, bytes DESC, src_ip DESC, dst_ip DESC, dst_port DESC, proto DESC) AS rn FROM rel)
SELECT an.anomaly_id, hv.src_ip, a_dst AS dst_ip, coalesce(a_port, hv.dst_port) AS dst_port, hv.proto FROM an LEFT JOIN hv ON hv.anomaly_id = an.anomaly_id AND rn = 1""",
)(
    lambda s, d: detect.fill_from_flows(anomalies(s, d), detect.related_flows(anomalies(s, d), flows(s, d), heaviest=True)).select(
        "anomaly_id", "src_ip", "dst_ip", "dst_port", "proto"
    )
)
query(
    "anomaly_series_scope",
    f"""{_ANOM_CTE}, sp AS (SELECT an.anomaly_id, date_trunc('minute', flow_time) AS bucket, sum(packets)::BIGINT / 60.0 AS t, sum(packets) FILTER (split_part(src_ip, '.', 3) = '1' AND false) AS c FROM flows f JOIN an ON f.dst_ip = a_dst AND flow_time BETWEEN fs - INTERVAL 15 MINUTE AND greatest(ls, fs + INTERVAL 1 HOUR) GROUP BY ALL)
SELECT anomaly_id, bucket, round(t, 4)::DOUBLE AS packets_s, 'target' AS scope FROM sp""",
)(
    lambda s, d: detect.anomaly_series(anomalies(s, d), flows(s, d)).withColumn("packets_s", F.round("packets_s", 4))
)
query(
    "mitigation_targets",
    f"""{_ANOM_CTE}, tg AS (SELECT anomaly_id, dst_ip, dst_port, proto, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes, count(DISTINCT src_ip) AS sources FROM rel GROUP BY ALL),
rj AS (SELECT *, CASE WHEN split_part(dst_ip, '.', 4)::INT BETWEEN 16 AND 31 THEN 'destination_whitelisted' WHEN packets < 30 THEN 'below_threshold' ELSE '' END AS rejection_reason FROM tg)
SELECT anomaly_id AS event_id, dst_ip || '/32' AS dst_prefix, dst_port, CASE proto WHEN 17 THEN 'udp' WHEN 6 THEN 'tcp' ELSE 'icmp' END AS protocol, packets, bytes, sources, rejection_reason, rejection_reason = '' AS accepted FROM rj""",
)(
    lambda s, d: advise.target_candidates(
        detect.related_flows(anomalies(s, d), flows(s, d), sources=True).withColumnRenamed("anomaly_id", "event_id"),
        flows(s, d).select(F.col("dst_ip_key").alias("ip_key")).filter(ip.key_in_cidr(F.col("ip_key"), "203.0.113.16/28")),
        30,
    )
)

# --- executions ----------------------------------------------------------------------------------

_EXEC_CTE = """
rq AS (SELECT l_orderkey AS anomaly_id, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS request_id, 1 + l_suppkey % 2 AS connector_id, '203.0.113.' || (l_partkey % 40) || '/32' AS dst_prefix, l_returnflag AS flag, 'flowspec_block' AS action FROM lineitem),
rd AS (SELECT DISTINCT anomaly_id, request_id, 'mit:' || sha256('action=flowspec_block|address_family=ipv4|connector_id=' || connector_id || '|destination=' || dst_prefix || '|destination_port=53|protocol=' || lower(flag) || '|source=|source_port=|tcp_flags=') AS idempotency_key FROM rq),
lx AS (SELECT idempotency_key, max(execution_id) AS execution_id FROM (SELECT idempotency_key, abs(request_id) AS execution_id, CASE WHEN request_id % 291 = 0 THEN 'active' ELSE 'withdrawn' END AS status FROM rd) WHERE status = 'active' GROUP BY 1)"""


def requests(s, d):
    rows = table(s, d, "lineitem").selectExpr(
        "l_orderkey AS anomaly_id", "l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS request_id", "1 + l_suppkey % 2 AS connector_id",
        "concat('203.0.113.', l_partkey % 40, '/32') AS dst_prefix", "l_returnflag AS protocol", "'53' AS dst_port", "'flowspec_block' AS action",
    )
    return rows.withColumn("idempotency_key", advise.mitigation_key(rows)).distinct()


def live_executions(s, d):
    return requests(s, d).selectExpr(
        "idempotency_key", "abs(request_id) AS execution_id", "CASE WHEN request_id % 291 = 0 THEN 'active' ELSE 'withdrawn' END AS status"
    )


query(
    "mitigation_requests_deduplicated",
    f"{_EXEC_CTE} SELECT idempotency_key, min(request_id) AS request_id FROM rd WHERE idempotency_key NOT IN (SELECT idempotency_key FROM lx) GROUP BY 1",
)(
    lambda s, d: advise.dedupe_mitigations(requests(s, d), live_executions(s, d))[0].select("idempotency_key", "request_id").distinct()
)
query(
    "mitigation_anomaly_associations",
    f"{_EXEC_CTE} SELECT DISTINCT anomaly_id, rd.idempotency_key, execution_id, execution_id IS NOT NULL AS deduplicated FROM rd LEFT JOIN lx USING (idempotency_key)",
)(lambda s, d: advise.dedupe_mitigations(requests(s, d), live_executions(s, d))[1])
query(
    "mitigations_expired",
    "SELECT o_orderkey AS execution_id FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 4 > 0 AND date_diff('second', o_orderdate, TIMESTAMP '2000-06-01 00:00:00') >= o_custkey % 4 * 3600",
)(
    lambda s, d: advise.expired(
        table(s, d, "orders").selectExpr("o_orderkey AS execution_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'active' ELSE 'queued' END AS status", "cast(o_orderdate AS timestamp) AS applied_at", "o_custkey % 4 * 3600 AS ttl_seconds"),
        ts_lit("2000-06-01 00:00:00"),
    ).select("execution_id")
)
query(
    "mitigation_blocking_reasons",
    """SELECT o_orderkey AS id, CASE WHEN o_custkey % 11 = 0 THEN 'candidate_not_automatic_primary' WHEN o_custkey % 13 = 0 THEN 'candidate_not_automatic_eligible' WHEN o_custkey % 7 = 0 THEN 'blocked_by_policy' WHEN o_custkey % 5 = 0 THEN 'profile_not_automatic' WHEN o_custkey % 17 = 0 THEN 'connector_not_automatic' WHEN o_orderstatus = 'F' THEN 'anomaly_not_active'
WHEN o_orderkey % 7 = 0 THEN 'connector_not_resolved' WHEN o_orderkey % 11 = 0 THEN 'connector_type_missing' WHEN o_orderkey % 13 = 0 THEN 'validation_failed' WHEN o_orderkey % 17 = 0 THEN 'invalid_ttl' WHEN o_orderkey % 19 = 0 THEN 'gate closed' WHEN o_orderkey % 19 = 1 THEN 'blocked_by_gate' ELSE '' END AS reason FROM orders""",
)(
    lambda s, d: table(s, d, "orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_custkey % 11 = 0 THEN 'manual' ELSE 'automatic_primary' END AS candidate_kind", "o_custkey % 13 <> 0 AS automatic_eligible", "o_custkey % 7 <> 0 AS auto_allowed", "true AS policy_authorized",
        "CASE WHEN o_custkey % 5 = 0 THEN 'manual' ELSE 'Auto' END AS profile_mode", "CASE WHEN o_custkey % 17 = 0 THEN 'manual' ELSE 'automatic' END AS connector_mode", "CASE WHEN o_orderstatus = 'F' THEN 'ended' ELSE 'active' END AS anomaly_status",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 END AS connector_id", "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'flowspec' END AS connector_type", "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'announce' END AS command",
        "CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 60 END AS ttl_seconds", "o_orderkey % 19 < 2 AS gate_blocking", "CASE WHEN o_orderkey % 19 = 0 THEN 'gate closed' ELSE '' END AS gate_reason",
    ).select("id", advise.blocking_reason().alias("reason"))
)

# --- learning and calibration --------------------------------------------------------------------

_DECODERS = ["IP", "TCP", "UDP", "DNS", "TCP+SYN"]
_LEARN_CTE = """
sd AS (SELECT sensor, 'receives' AS direction, input_if AS interface_id, date_trunc('minute', flow_time) AS bucket, * EXCLUDE (sensor, flow_time) FROM flows UNION ALL SELECT sensor, 'sends', output_if, date_trunc('minute', flow_time), * EXCLUDE (sensor, flow_time) FROM flows),
dc AS (SELECT *, unnest(list_filter(['IP', CASE WHEN proto = 6 THEN 'TCP' END, CASE WHEN proto = 17 THEN 'UDP' END, CASE WHEN proto IN (6, 17) AND (src_port = 53 OR dst_port = 53) THEN 'DNS' END, CASE WHEN proto = 6 AND tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0 THEN 'TCP+SYN' END], lambda x: x IS NOT NULL)) AS decoder FROM sd),
sr AS (SELECT sensor, decoder, direction, interface_id, bucket, sum(packets)::BIGINT / 60.0 AS packets_s, sum(bytes)::BIGINT * 8 / 60.0 AS bits_s, sum(flow_count)::BIGINT / 60.0 AS flows_s FROM dc GROUP BY ALL)"""
_LEARN_KEYS = ["sensor", "decoder", "direction", "interface_id"]

query(
    "decoder_series",
    f"{_LEARN_CTE} SELECT sensor, decoder, direction, interface_id, bucket, round(packets_s, 4)::DOUBLE AS packets_s, round(bits_s, 4)::DOUBLE AS bits_s, round(flows_s, 4)::DOUBLE AS flows_s FROM sr",
)(
    lambda s, d: learn.decoder_series(flows(s, d), _DECODERS).withColumns({c: F.round(c, 4) for c in ("packets_s", "bits_s", "flows_s")})
)
_LEARNED = """ln AS (SELECT sensor, decoder, direction, interface_id, unit, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, max(v) AS mx, avg(v) AS mean, count(*) AS samples FROM
(SELECT * EXCLUDE (packets_s, bits_s, flows_s), 'packets_s' AS unit, packets_s AS v FROM kept WHERE packets_s >= 1 UNION ALL SELECT * EXCLUDE (packets_s, bits_s, flows_s), 'bits_s', bits_s FROM kept WHERE bits_s >= 1000 UNION ALL SELECT * EXCLUDE (packets_s, bits_s, flows_s), 'flows_s', flows_s FROM kept WHERE flows_s >= 0.1) GROUP BY ALL)
SELECT 'learn:' || sha256('decoder=' || decoder || '|direction=' || direction || '|interface_id=' || interface_id || '|sensor=' || sensor || '|template=default|unit=' || unit) AS suggestion_key, sensor, decoder, direction, interface_id, unit, round(p95, 6)::DOUBLE AS baseline_p95, round(p99, 6)::DOUBLE AS baseline_p99, round(mx, 6)::DOUBLE AS baseline_max, round(mean, 6)::DOUBLE AS baseline_mean, samples, round(mx * 1.2, 6)::DOUBLE AS suggested_threshold FROM ln"""


def _rounded(df):
    names = ("baseline_p95", "baseline_p99", "baseline_max", "baseline_mean", "suggested_threshold")
    return df.withColumns({c: F.round(c, 6) for c in names})


query("learned_thresholds", f"{_LEARN_CTE}, kept AS (SELECT * FROM sr), {_LEARNED}")(
    lambda s, d: _rounded(learn.learn_thresholds(learn.decoder_series(flows(s, d), _DECODERS), _LEARN_KEYS))
)


@query(
    "learned_thresholds_without_peaks",
    f"{_LEARN_CTE}, kept AS (SELECT * FROM sr WHERE NOT (bucket BETWEEN TIMESTAMP '2026-07-10 12:59:00' AND TIMESTAMP '2026-07-10 13:02:00' AND interface_id % 2 = 1)), {_LEARNED}",
)
def _learned_quiet(s, d):
    points_ = learn.decoder_series(flows(s, d), _DECODERS)
    peaks_ = flows(s, d).select("sensor", F.col("input_if").alias("interface_id")).distinct().filter("interface_id % 2 = 1").selectExpr(
        "sensor", "interface_id", "TIMESTAMP '2026-07-10 12:59:20' AS start_time", "TIMESTAMP '2026-07-10 13:02:10' AS end_time"
    )
    kept = learn.exclude_intervals(points_, peaks_, ["sensor", "interface_id"], 60)
    return _rounded(learn.learn_thresholds(kept, _LEARN_KEYS))


@query(
    "merged_suggestions",
    """st AS (SELECT DISTINCT 'k' || c_nationkey AS suggestion_key, 'stored' AS origin FROM customer), nw AS (SELECT DISTINCT 'k' || (s_nationkey * 2) AS suggestion_key, 'learned' AS origin FROM supplier)
SELECT * FROM st WHERE suggestion_key NOT IN (SELECT suggestion_key FROM nw) UNION ALL SELECT * FROM nw""",
)
def _merged_suggestions(s, d):
    stored = table(s, d, "customer").selectExpr("concat('k', c_nationkey) AS suggestion_key", "'stored' AS origin").distinct()
    learned = table(s, d, "supplier").selectExpr("concat('k', s_nationkey * 2) AS suggestion_key", "'learned' AS origin").distinct()
    return learn.merge_suggestions(stored, learned)


_SNMP_CTE = f"""
mn AS (SELECT sensor, input_if AS if_index, date_trunc('minute', flow_time) AS t, sum(bytes * {RATE})::BIGINT AS b FROM flows GROUP BY ALL),
sn AS (SELECT *, sum(b * 2) OVER (PARTITION BY sensor, if_index ORDER BY t)::BIGINT % 500000000 AS in_octets FROM mn),
pr AS (SELECT *, lag(in_octets) OVER w AS po, lag(t) OVER w AS pt FROM sn WINDOW w AS (PARTITION BY sensor, if_index ORDER BY t)),
rt AS (SELECT *, CASE WHEN in_octets >= po THEN (in_octets - po) * 8 / date_diff('second', pt, t) END AS in_bps FROM pr)"""


def snmp_samples(s, d):
    """Interface counters that count twice the flow bytes and wrap at 500 MB."""
    from pyspark.sql.window import Window

    per_minute = rated(s, d).groupBy("sensor", F.col("input_if").alias("if_index"), F.date_trunc("minute", "flow_time").alias("sample_time")).agg(
        F.sum(F.col("bytes") * F.col("rate")).alias("b")
    )
    # Test data only: one row per minute and interface.
    running = Window.partitionBy("sensor", "if_index").orderBy("sample_time")
    return per_minute.withColumn("in_octets", F.sum(F.col("b") * 2).over(running) % 500000000)


query("interface_counter_rates", f"{_SNMP_CTE} SELECT sensor, if_index, t AS sample_time, in_octets, round(in_bps, 3)::DOUBLE AS in_bps FROM rt")(
    lambda s, d: learn.counter_rate(snmp_samples(s, d).drop("b"), ["sensor", "if_index"], ["in_octets"]).withColumn("in_bps", F.round("in_bps", 3))
)


@query(
    "rate_calibration",
    f"""{_SNMP_CTE}, pa AS (SELECT a.sensor, a.if_index, a.bucket, a.snmp_bps, c.flow_bps FROM (SELECT sensor, if_index, time_bucket(INTERVAL '300 seconds', t, TIMESTAMP '2026-07-10') AS bucket, avg(in_bps) AS snmp_bps FROM rt GROUP BY ALL) a JOIN (SELECT sensor, if_index, time_bucket(INTERVAL '300 seconds', t, TIMESTAMP '2026-07-10') AS bucket, avg(b * 8 / 60) AS flow_bps FROM mn GROUP BY ALL) c USING (sensor, if_index, bucket)),
us AS (SELECT *, snmp_bps / flow_bps AS ratio FROM pa WHERE snmp_bps >= 1000 AND flow_bps >= 1000), ce AS (SELECT sensor, if_index, quantile_cont(ratio, 0.5) AS c FROM us GROUP BY ALL),
nr AS (SELECT us.* FROM us JOIN ce USING (sensor, if_index) WHERE ratio <= c * 4 AND ratio >= c / 4),
ft AS (SELECT sensor, if_index, quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.5) AS q2, quantile_cont(ratio, 0.75) AS q3, count(*) AS valid_pairs FROM nr GROUP BY ALL)
SELECT sensor, if_index, round(q2, 3)::DOUBLE AS factor, valid_pairs, round(least(1.0, valid_pairs / 12.0) * greatest(0.0, 1 - (q3 - q1) / q2), 3)::DOUBLE AS confidence, q2 > 0 AND least(1.0, valid_pairs / 12.0) * greatest(0.0, 1 - (q3 - q1) / q2) >= 0.6 AS auto_apply FROM ft""",
)
def _calibration(s, d):
    samples = snmp_samples(s, d)
    snmp = learn.counter_rate(samples.drop("b"), ["sensor", "if_index"], ["in_octets"]).withColumn("snmp_bps", F.col("in_bps"))
    flow_rates = samples.select("sensor", "if_index", F.col("sample_time").alias("bucket"), (F.col("b") * 8 / 60.0).alias("flow_bps"))
    fit = learn.calibrate(learn.calibration_pairs(snmp, flow_rates, ["sensor", "if_index"], 300), ["sensor", "if_index"])
    return fit.withColumns({c: F.round(c, 3) for c in ("factor", "confidence")})
