"""Scalar functions, text ingestion, stored tables and streams."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from weirgauge.catalog.registry import query
from weirgauge.functions import ip, scalars
from weirgauge.operators import rates
from weirgauge.operators.filters import ts_lit
from weirgauge.session import shared_folder, staged
from weirgauge.sources import dims, table_log, tables, text_flows
from weirgauge.sources.lineitem_flows import flows, stream_flows, table
from weirgauge.streaming import ingest as si
from weirgauge.streaming import lifecycle
from weirgauge.streaming import windows as sw

H = "l_orderkey*7919 + l_partkey*104729 + l_suppkey*31 + l_linenumber*17"


def _numbers(s, d):
    return table(s, d, "lineitem").selectExpr(f"{H} AS h")


# --- scalar functions --------------------------------------------------------------


@query(
    "parsed_integers",
    """SELECT h % 60000 AS n, h % 5 AS k, CASE h % 5 WHEN 0 THEN h % 60000 WHEN 1 THEN h % 60000 WHEN 2 THEN h % 60000 WHEN 3 THEN 7 ELSE 0 END AS parsed, CASE h % 5 WHEN 3 THEN 7 WHEN 4 THEN 0 ELSE least(h % 60000, 1000) END AS clamped, count(*) AS c FROM base GROUP BY ALL""",
)
def _integers(s, d):
    text = F.expr("CASE h % 5 WHEN 0 THEN concat('0x', hex(h % 60000)) WHEN 1 THEN concat(h % 60000, '.9') WHEN 2 THEN cast(h % 60000 AS string) WHEN 3 THEN 'n/a' ELSE concat('-', h % 60000 + 1) END")
    rows = _numbers(s, d).withColumn("t", text).selectExpr("h % 60000 AS n", "h % 5 AS k", "t")
    return rows.select("n", "k", scalars.safe_int(F.col("t"), 7).alias("parsed"), scalars.safe_int(F.col("t"), 7, 0, 1000).alias("clamped")).groupBy(
        "n", "k", "parsed", "clamped"
    ).agg(F.count(F.lit(1)).alias("c"))


@query(
    "parsed_timestamps",
    """x AS (SELECT DISTINCT h % 5 AS k, h % 7200 AS sec FROM base) SELECT k, sec, CASE WHEN k = 4 THEN TIMESTAMP '2026-01-01 00:00:00' ELSE TIMESTAMP '2026-07-10 12:00:00' + to_seconds(sec) END AS ts,
CASE WHEN k = 4 THEN '2025-12-31T21:00:00-03:00' ELSE strftime(TIMESTAMP '2026-07-10 09:00:00' + to_seconds(sec), '%Y-%m-%dT%H:%M:%S') || '-03:00' END AS local_text FROM x""",
)
def _timestamps(s, d):
    rows = _numbers(s, d).selectExpr("h % 5 AS k", "h % 7200 AS sec").distinct()
    ts = F.timestamp_seconds(F.lit(1783684800) + F.col("sec"))
    text = (
        F.when(F.col("k") == 0, F.unix_seconds(ts).cast("string"))
        .when(F.col("k") == 1, F.unix_millis(ts).cast("string"))
        .when(F.col("k") == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("k") == 3, F.date_format(F.from_utc_timestamp(ts, "+02:00"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .otherwise("not a time")
    )
    parsed = scalars.parse_ts(text, ts_lit("2026-01-01 00:00:00"))
    return rows.select("k", "sec", parsed.alias("ts")).withColumn("local_text", scalars.local_ts(F.col("ts")))


_FLAGS = "||".join(f"CASE WHEN n & {bit} <> 0 THEN '+{name}' ELSE '' END" for name, bit in scalars.TCP_FLAG_BITS.items())


@query(
    "parsed_tcp_flags",
    f"""x AS (SELECT DISTINCT h % 256 AS n, h % 3 AS k FROM base), y AS (SELECT *, {_FLAGS} AS t FROM x) SELECT n, k, n::INT AS parsed, CASE WHEN t = '' THEN 'NONE' ELSE t[2:] END AS names, n & 2 <> 0 AS syn FROM y""",
)
def _flags(s, d):
    rows = _numbers(s, d).selectExpr("cast(h % 256 AS int) AS n", "h % 3 AS k").distinct()
    separators = F.expr("array('+', '|', ',')[cast(n % 3 AS int)]")
    text = (
        F.when(F.col("k") == 0, F.concat(F.lit("0x"), F.hex("n")))
        .when(F.col("k") == 1, F.col("n").cast("string"))
        .otherwise(F.replace(F.lower(scalars.flags_name(F.col("n"))), F.lit("+"), separators))
    )
    out = rows.withColumn("parsed", scalars.flags_num(text))
    return out.select(F.col("n").cast("bigint").alias("n"), "k", "parsed", scalars.flags_name(F.col("parsed")).alias("names"), scalars.has_flag(F.col("parsed"), "SYN").alias("syn"))


@query(
    "address_labels",
    f"""x AS (SELECT DISTINCT src_ip, dst_ip FROM flows), y AS (SELECT *, {dims.sql_ip('src_ip')} AS n FROM x)
SELECT src_ip, dst_ip, '::ffff:' || src_ip AS mapped, src_ip AS shown, src_ip || '/32' AS host, regexp_extract(dst_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.0/24' AS net24, '::/64' AS net64, '00000000000000000000ffff' || lower(printf('%08x', n)) AS key,
split_part(src_ip, '.', 1) || '.' || split_part(src_ip, '.', 2) || '.' || split_part(src_ip, '.', 3) || '.' || (split_part(src_ip, '.', 4)::INT // 16 * 16) || '/28' AS net28, true AS internal, 4 AS version FROM y""",
)
def _labels(s, d):
    rows = flows(s, d).select("src_ip", "dst_ip").distinct()
    key = ip.ip_key(F.col("src_ip"))
    return rows.select(
        "src_ip", "dst_ip", ip.to_mapped(F.col("src_ip")).alias("mapped"), ip.display_ip(ip.to_mapped(F.col("src_ip"))).alias("shown"),
        ip.host_cidr(F.col("src_ip")).alias("host"), ip.prefix24(F.col("dst_ip")).alias("net24"), ip.prefix64(key).alias("net64"), key.alias("key"),
        ip.norm_cidr(F.concat("src_ip", F.lit("/28"))).alias("net28"), ip.is_internal_key(key).alias("internal"), ip.ip_version(key).alias("version"),
    )


@query(
    "ipv6_addresses",
    """x AS (SELECT DISTINCT l_suppkey AS a, l_orderkey % 97 AS b FROM base), y AS (SELECT *, printf('%x', a) AS ha, printf('%x', b) AS hb FROM x)
SELECT a, b, '2001:db8:' || (CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN ':' ELSE ':' || hb END ELSE ha || CASE WHEN b = 0 THEN '::' ELSE '::' || hb END END) AS text, '20010db8' || lower(printf('%04x', a)) || repeat('0', 16) || lower(printf('%04x', b)) AS key, '2001:db8::/32' AS net32 FROM y""",
)
def _ipv6(s, d):
    rows = table(s, d, "lineitem").selectExpr("l_suppkey AS a", "l_orderkey % 97 AS b").distinct()
    long = F.concat(F.lit("2001:0DB8:"), F.lpad(F.hex("a"), 4, "0"), F.lit(":0:0:0:0:"), F.hex("b"))
    return rows.select(
        "a", "b", ip.safe_ip(long).alias("text"), ip.ip_key(long).alias("key"), ip.norm_cidr(F.concat(long, F.lit("/32"))).alias("net32")
    )


@query(
    "protocol_names",
    """x AS (SELECT DISTINCT h % 60 AS n FROM base) SELECT n, CASE n WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 47 THEN 'GRE' WHEN 50 THEN 'ESP' WHEN 58 THEN 'ICMPV6' ELSE 'PROTO-' || n END AS name, CASE WHEN n IN (1, 6, 17, 47, 50, 58) THEN n ELSE 0 END::INT AS back FROM x""",
)
def _protocols(s, d):
    rows = _numbers(s, d).selectExpr("h % 60 AS n").distinct()
    name = scalars.proto_name(F.col("n"))
    return rows.select("n", name.alias("name"), scalars.proto_num(name).alias("back"))


@query(
    "readable_amounts",
    """x AS (SELECT DISTINCT (h % 4000) * 100000 AS n FROM base), y AS (SELECT n, CASE WHEN n >= 1000000 THEN n / 1000000.0 WHEN n >= 1000 THEN n / 1000.0 ELSE n END AS v, CASE WHEN n >= 1000000 THEN ' Mbps' WHEN n >= 1000 THEN ' Kbps' ELSE ' bps' END AS u FROM x)
SELECT n, CASE WHEN abs(v) < 1000 AND v <> floor(v) THEN regexp_replace(printf('%.1f', v), '\\.?0+$', '') ELSE printf('%.0f', v) END || u AS bps_text, printf('%.2f', v) || CASE WHEN n >= 1000000 THEN ' Mpps' WHEN n >= 1000 THEN ' Kpps' ELSE ' pps' END AS metric_text FROM y""",
)
def _readable(s, d):
    rows = _numbers(s, d).selectExpr("(h % 4000) * 100000 AS n").distinct()
    return rows.select("n", scalars.humanize(F.col("n"), "bps").alias("bps_text"), scalars.metric_text(F.col("n"), "packets_s").alias("metric_text"))


@query(
    "time_to_live_and_keys",
    """x AS (SELECT DISTINCT h % 48 AS n, h % 5 AS k FROM base) SELECT n, k, CASE k WHEN 0 THEN n WHEN 1 THEN n * 60 WHEN 2 THEN n * 3600 WHEN 3 THEN n * 86400 END AS seconds, 'id:' || sha256('k=' || k || '|n=' || n) AS stable, 'a_b_' || n AS slug,
CASE k WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 WHEN 2 THEN 3.0 ELSE 2.0 END::DOUBLE AS factor, CASE WHEN n % 2 = 0 THEN 'Net ' || n ELSE 'AS' || n END AS asn FROM x""",
)
def _ttl(s, d):
    rows = _numbers(s, d).selectExpr("h % 48 AS n", "h % 5 AS k").distinct()
    text = F.concat(F.col("n").cast("string"), F.expr("array('s', ' M', 'h', 'D', 'weeks')[cast(k AS int)]"))
    level = F.expr("array('Alta', 'media', 'low', 'nonsense', NULL)[cast(k AS int)]")
    return rows.select(
        "n", "k", scalars.ttl_seconds(text).alias("seconds"), scalars.stable_key("id", n=F.col("n"), k=F.col("k")).alias("stable"),
        scalars.slug(F.concat(F.lit(" a b-"), F.col("n").cast("string"), F.lit("! "))).alias("slug"), scalars.sensitivity_factor(level).alias("factor"),
        scalars.asn_label(F.col("n"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("Net "), F.col("n").cast("string")))).alias("asn"),
    )


@query(
    "decoder_counts",
    """d AS (SELECT unnest(list_filter([CASE WHEN true THEN 'IP' END, CASE WHEN proto = 6 THEN 'TCP' END, CASE WHEN proto = 6 THEN 'TCP+ALL' END, CASE WHEN proto = 6 AND tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0 THEN 'TCP+SYN' END, CASE WHEN proto = 6 AND tcp_flags & 18 = 18 THEN 'TCP+SYNACK' END,
CASE WHEN proto = 6 AND tcp_flags & 16 <> 0 AND tcp_flags & 2 = 0 THEN 'TCP+ACK' END, CASE WHEN proto = 6 AND tcp_flags & 4 <> 0 THEN 'TCP+RST' END, CASE WHEN proto = 6 AND tcp_flags = 0 THEN 'TCP+NULL' END, CASE WHEN proto = 17 THEN 'UDP' END, CASE WHEN proto = 1 THEN 'ICMP' END, CASE WHEN proto IN (6, 17) AND (src_port = 53 OR dst_port = 53) THEN 'DNS' END,
CASE WHEN proto = 17 AND (src_port = 123 OR dst_port = 123) THEN 'NTP' END, CASE WHEN proto = 17 AND (src_port IN (443, 8443) OR dst_port IN (443, 8443)) THEN 'QUIC' END, CASE WHEN proto = 17 AND (src_port IN (443, 8443) OR dst_port IN (443, 8443)) THEN 'UDP+QUIC' END, CASE WHEN proto = 6 AND (src_port IN (80, 8080) OR dst_port IN (80, 8080)) THEN 'HTTP' END,
CASE WHEN proto = 6 AND (src_port IN (443, 8443) OR dst_port IN (443, 8443)) THEN 'HTTPS' END, CASE WHEN proto IN (6, 17) AND src_port IN (5060, 5061) THEN 'SIP' END, CASE WHEN proto = 17 AND src_port IN (4500) THEN 'IPSEC' END, CASE WHEN proto IN (6, 17) AND src_port = 11211 THEN 'MEMCACHED' END, CASE WHEN true THEN 'FLOWS' END], lambda x: x IS NOT NULL)) AS decoder, bytes FROM flows)
SELECT decoder, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM d GROUP BY 1""",
)
def _decoders(s, d):
    names = scalars.decoders(*[F.col(c) for c in ("proto", "src_port", "dst_port", "tcp_flags")])
    rows = flows(s, d).select("bytes", F.explode(names).alias("decoder"))
    return rows.groupBy("decoder").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query(
    "redacted_text",
    """x AS (SELECT DISTINCT src_ip, dst_ip, l_suppkey AS n FROM (SELECT src_ip, dst_ip, input_if AS l_suppkey FROM flows)) SELECT src_ip, dst_ip, n, 'from ' || regexp_extract(src_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.x to ' || regexp_extract(dst_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.x; client=ACME ' || n || '; at 2001:db8:1:2:xxxx' AS masked,
'from ' || src_ip || ' to [internal-ip]; client=ACME ' || n || '; at 2001:db8:1:2::9' AS internal, 'from ' || src_ip || ' to ' || dst_ip || '; cliente=[removido]; at 2001:db8:1:2::9' AS names FROM x""",
)
def _redacted(s, d):
    rows = flows(s, d).select("src_ip", "dst_ip", F.col("input_if").alias("n")).distinct()
    text = F.concat(F.lit("from "), "src_ip", F.lit(" to "), "dst_ip", F.lit("; client=ACME "), F.col("n").cast("string"), F.lit("; at 2001:db8:1:2::9"))
    staged_rows = rows.withColumn("t", text)
    return staged_rows.select(
        "src_ip", "dst_ip", "n", scalars.redact(F.col("t"), "mask_ips").alias("masked"), scalars.redact(F.col("t"), "remove_internal_ips").alias("internal"),
        scalars.redact(F.col("t"), "remove_client_names").alias("names"),
    )


# --- text ingestion ----------------------------------------------------------------


def land_text(lines, by: str | None = None) -> str:
    """Write lines as text files, the form in which a collector delivers them; ``by`` gives one folder per value."""
    root = f"{shared_folder(lines.sparkSession)}/weirgauge/text-{uuid.uuid4().hex}"
    writer = lines.write if by is None else lines.write.partitionBy(by)
    writer.text(root)
    return root


def land_batches(lines, batches: int) -> tuple[str, int]:
    """Lines in so many turns of files: their folder and the files of a turn.

    Files follow the tasks that read the input, so that a task's share does not grow with it;
    only input of fewer tasks than turns is dealt out.
    """
    tasks = lines.rdd.getNumPartitions()
    if tasks < batches:
        lines, tasks = lines.repartition(batches), batches
    return land_text(lines), -(-tasks // batches)


def csv_lines(s, d):
    """Header-less CSV with the odd blank, comment, short and unusable line."""
    return flows(s, d).withColumn("i", F.col("src_port")).selectExpr(
        """CASE WHEN i % 53 = 0 THEN '' WHEN i % 53 = 1 THEN '! collector restarted' WHEN i % 53 = 2 THEN concat(src_ip, ',', dst_ip)
        ELSE concat_ws(',', CASE WHEN i % 53 = 3 THEN 'bad-address' ELSE src_ip END, dst_ip, CASE WHEN i % 53 = 4 THEN '99999' ELSE cast(src_port AS string) END, dst_port,
        CASE WHEN proto = 17 THEN 'udp' WHEN i % 2 = 0 THEN cast(proto AS string) WHEN proto = 6 THEN 'TCP' ELSE 'icmp' END,
        CASE WHEN tcp_flags = 18 THEN 'SYN+ACK' WHEN tcp_flags = 2 THEN '0x02' ELSE cast(tcp_flags AS string) END, input_if, output_if, src_asn, dst_asn,
        CASE WHEN i % 3 = 0 THEN cast(unix_seconds(flow_time) AS string) WHEN i % 3 = 1 THEN cast(unix_millis(flow_time) AS string) ELSE date_format(flow_time, "yyyy-MM-dd'T'HH:mm:ss'Z'") END, packets, bytes) || CASE WHEN i % 5 = 0 THEN '' ELSE ',1' END END AS value"""
    )


_CSV_GOOD = "flows WHERE src_port % 53 > 2"


def _csv_records(s, d):
    return text_flows.parse_flow_lines(text_flows.read_lines(s, land_text(csv_lines(s, d))))


@query(
    "ingested_csv_flows",
    f"""SELECT flow_time, CASE WHEN src_port % 53 = 3 THEN '::' ELSE src_ip END AS src_ip, dst_ip, CASE WHEN src_port % 53 = 4 THEN 65535 ELSE src_port END AS src_port, dst_port, proto, tcp_flags, input_if, output_if, bytes, packets, 1::BIGINT AS flow_count, 64::BIGINT AS sample_rate, src_asn, dst_asn, 'edge-x' AS sensor FROM {_CSV_GOOD}""",
)
def _csv(s, d):
    out = text_flows.normalize_flows(_csv_records(s, d), "edge-x", "192.0.2.1", 64)
    return out.select("flow_time", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "tcp_flags", "input_if", "output_if", "bytes", "packets", "flow_count", "sample_rate", "src_asn", "dst_asn", "sensor")


@query(
    "ingest_counts",
    "SELECT count(*) FILTER (src_port % 53 > 2) AS rows_inserted, count(*) FILTER (src_port % 53 <= 2) AS rows_skipped, count(*) FILTER (src_port % 53 > 1) AS rows_read, 'ok' AS parser_status FROM flows",
)
def _counts(s, d):
    per_file = text_flows.ingest_metrics(_csv_records(s, d))
    return per_file.agg(F.sum("rows_inserted").alias("rows_inserted"), F.sum("rows_skipped").alias("rows_skipped"), F.sum("rows_read").alias("rows_read"), F.max("parser_status").alias("parser_status"))


@query(
    "ingest_quarantine",
    "SELECT 'dropped' AS record_status, src_ip || ',' || dst_ip AS value, count(*) AS n FROM flows WHERE src_port % 53 = 2 GROUP BY ALL",
)
def _quarantine(s, d):
    bad = text_flows.split_bad_rows(_csv_records(s, d))[1]
    return bad.groupBy("record_status", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ingested_json_flows",
    """SELECT flow_time, src_ip, dst_ip, src_port, dst_port, proto, bytes, packets, sample_rate, duration_ms, src_as_name FROM flows WHERE src_port % 4 <> 3
UNION ALL SELECT flow_time, src_ip, dst_ip, src_port, dst_port, proto, bytes, packets, sample_rate, duration_ms, src_as_name FROM flows WHERE src_port % 4 = 2""",
)
def _json(s, d):
    one = F.struct(
        F.col("src_ip").alias("SRC-IP"), F.col("dst_ip").alias("dstaddr"), F.col("src_port").cast("string").alias("L4 src port"), F.col("dst_port").alias("destination_port"),
        F.col("proto").alias("Protocol"), F.col("bytes").alias("octets"), F.col("packets").alias("pkts"), F.unix_seconds("flow_time").alias("first_switched"),
        F.col("sample_rate").alias("sampling_rate"), F.col("duration_ms").alias("flow_duration_ms"), F.col("src_as_name").alias("src_as_org"),
    )
    rows = flows(s, d).withColumn("j", F.to_json(one))
    k = F.col("src_port") % 4
    value = F.when(k == 2, F.concat(F.lit("["), "j", F.lit(", 5, "), "j", F.lit("]"))).when(k == 3, F.lit("[1, 2]")).otherwise(F.col("j"))
    path = land_text(rows.select(value.alias("value")))
    found = text_flows.parse_flow_lines(text_flows.read_lines(s, path), headers=False)
    out = text_flows.normalize_flows(found, "edge-x", "192.0.2.1")
    return out.select("flow_time", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "bytes", "packets", "sample_rate", "duration_ms", "src_as_name")


@query(
    "ingested_csv_with_headers",
    """x AS (SELECT c_custkey % 3 AS f, c_custkey // 3 AS i FROM customer), y AS (SELECT *, CASE WHEN f = 2 AND i < 50 THEN 0 WHEN f = 1 THEN 1 ELSE 1 + (i // 50) % 2 END AS style FROM x WHERE NOT (i % 50 = 0 AND (f <> 2 OR i > 0)))
SELECT f, i, CASE WHEN style = 0 THEN '10.9.0.1' ELSE '10.0.' || (i // 250) || '.' || (i % 250) END AS src_ip, CASE style WHEN 0 THEN 0 ELSE i * 10 END AS bytes, CASE WHEN style = 2 THEN i % 100 ELSE 0 END AS src_asn FROM y""",
)
def _headers(s, d):
    # Style 0: default layout; style 1 and 2: two headers that take turns inside a file.
    rows = table(s, d, "customer").selectExpr("c_custkey % 3 AS f", "c_custkey div 3 AS i").selectExpr(
        "*", "CASE WHEN f = 2 AND i < 50 THEN 0 WHEN f = 1 THEN 1 ELSE 1 + (i div 50) % 2 END AS style"
    )
    lines = rows.selectExpr(
        "f", "i",
        """CASE WHEN i % 50 = 0 AND style = 1 THEN 'Src IP,"octets",src_host_x,first-switched' WHEN i % 50 = 0 AND style = 2 THEN 'peer_src_as,srcaddr,timestamp,in_bytes'
        WHEN style = 1 THEN concat('10.0.', i div 250, '.', i % 250, ',', i * 10, ',"a,b",', 1783684800 + i) WHEN style = 2 THEN concat(i % 100, ',10.0.', i div 250, '.', i % 250, ',', 1783684800 + i, ',', i * 10)
        ELSE concat('10.9.0.1,10.9.0.2,1,2,6,0,1,1,0,0,', 1783684800 + i, ',5,0') END AS value""",
    )
    ordered = lines.repartition(3, "f").sortWithinPartitions("f", "i").select("f", "value")
    found = text_flows.parse_flow_lines(text_flows.read_lines(s, land_text(ordered, "f")))
    return _with_file(found)


def _with_file(found):
    keyed = found.withColumn("f", F.regexp_extract("file", "f=([0-9]+)", 1))
    out = None
    for f in ("0", "1", "2"):
        part = text_flows.normalize_flows(keyed.filter(F.col("f") == f).drop("f"), f, "192.0.2.1")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("sensor").cast("bigint").alias("f"), (F.unix_seconds("flow_time") - 1783684800).alias("i"), "src_ip", "bytes", "src_asn")


@query(
    "numbered_text_lines",
    "x AS (SELECT c_custkey % 3 AS f, c_custkey // 3 AS i FROM customer) SELECT f, i + 1 AS line_no, 'line ' || i AS raw_line FROM x",
)
def _numbered(s, d):
    rows = table(s, d, "customer").selectExpr("c_custkey % 3 AS f", "c_custkey div 3 AS i", "concat('line ', c_custkey div 3) AS value")
    path = land_text(rows.repartition(3, "f").sortWithinPartitions("f", "i").select("f", "value"), "f")
    lines = text_flows.numbered_lines(text_flows.read_lines(s, path))
    return lines.select(F.regexp_extract("file", "f=([0-9]+)", 1).cast("bigint").alias("f"), "line_no", "raw_line")


# --- stored tables -------------------------------------------------------------------

query(
    "customers_newest_version",
    """v AS (SELECT 'c' || (c_custkey % 400) AS customer_id, c_name, c_custkey AS v FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY v DESC) AS rn FROM v) SELECT customer_id, c_name FROM r WHERE rn = 1""",
)(
    lambda s, d: tables.latest(
        table(s, d, "customer").selectExpr("concat('c', c_custkey % 400) AS customer_id", "c_name", "c_custkey AS v"), ["customer_id"], "v"
    ).drop("v")
)
query(
    "seed_rows_missing",
    "SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey * 2 FROM supplier)",
)(
    lambda s, d: tables.insert_missing(
        table(s, d, "supplier").selectExpr("s_nationkey * 2 AS k"), table(s, d, "nation").selectExpr("n_nationkey AS k", "n_name"), ["k"]
    )
)
query(
    "seed_rows_first_by_order",
    "r AS (SELECT c_nationkey AS k, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS rn FROM customer) SELECT k, c_custkey, c_name FROM r WHERE rn = 1 AND k NOT IN (SELECT s_nationkey * 2 FROM supplier)",
)(
    lambda s, d: tables.insert_missing(
        table(s, d, "supplier").selectExpr("s_nationkey * 2 AS k"), table(s, d, "customer").selectExpr("c_nationkey AS k", "c_custkey", "c_name"), ["k"], ["c_name"]
    )
)
query(
    "orders_within_retention",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 400 DAY",
)(
    lambda s, d: tables.apply_retention(
        table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate")), "o_orderdate", 400, ts_lit("2001-01-01 00:00:00")
    )
)
query(
    "cleanup_report",
    """SELECT count(*) AS rows_before, count(*) FILTER (o_orderdate < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 100 DAY) AS rows_deleted, min(o_orderdate) FILTER (o_orderdate < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 100 DAY) AS deleted_from, max(o_orderdate) FILTER (o_orderdate < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 100 DAY) AS deleted_to FROM orders""",
)(
    lambda s, d: tables.cleanup_report(
        table(s, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("o_orderdate")), "o_orderdate", 100, ts_lit("2000-01-01 00:00:00")
    )
)
query("flow_table_status", "SELECT count(*) AS row_count, min(flow_time) AS oldest, max(flow_time) AS newest FROM flows")(
    lambda s, d: tables.table_status(flows(s, d))
)


@query(
    "stored_flows_pruned_by_date",
    "SELECT sensor, proto, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM flows WHERE flow_time BETWEEN TIMESTAMP '2026-07-10 12:30:00' AND TIMESTAMP '2026-07-10 13:00:00' GROUP BY ALL",
)
def _stored(s, d):
    from weirgauge.operators.filters import in_range

    root = f"{shared_folder(s)}/weirgauge/flows-{uuid.uuid4().hex}"
    tables.write_flows(flows(s, d), root)
    window = in_range(s.read.parquet(root), "2026-07-10 12:30:00", "2026-07-10 13:00:00")
    return window.groupBy("sensor", "proto").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query(
    "exported_csv_records",
    "SELECT sensor, src_ip, dst_ip, dst_port, bytes, packets FROM flows",
)
def _exported(s, d):
    root = f"{shared_folder(s)}/weirgauge/export-{uuid.uuid4().hex}"
    tables.export_csv(flows(s, d).select("sensor", "src_ip", "dst_ip", "dst_port", "bytes", "packets"), root)
    return s.read.schema("sensor string, src_ip string, dst_ip string, dst_port int, bytes bigint, packets bigint").csv(root, header=True)


@query(
    "asn_prefix_file",
    f"{dims.ASN_CTE} SELECT asn, as_name, plen + 96 AS plen, '00000000000000000000ffff' || lower(printf('%08x', (pint >> (32 - plen)) << (32 - plen))) AS net_key FROM asnp",
)
def _asn_file(s, d):
    root = f"{shared_folder(s)}/weirgauge/asn-{uuid.uuid4().hex}"
    rows = dims.asn_prefixes(s, d).selectExpr("prefix", "concat('as', asn) AS asn", "as_name", "country", "'import' AS source")
    rows.write.option("header", True).csv(root)
    return text_flows.load_asn_prefixes(s, root).select("asn", "as_name", "plen", "net_key")


# --- streams -------------------------------------------------------------------------

_ROLL = "sum(bytes)::BIGINT AS bytes, sum(packets)::BIGINT AS packets, sum(flow_count)::BIGINT AS flows"


@query(
    "stream_ingested_rollup",
    f"SELECT date_trunc('minute', flow_time) AS minute, 'edge-x' AS sensor, input_if, output_if, dst_port, proto, {_ROLL} FROM {_CSV_GOOD} GROUP BY ALL",
)
def _stream_ingest(s, d):
    root = f"{shared_folder(s)}/weirgauge/stream-{uuid.uuid4().hex}"
    folder, files = land_batches(csv_lines(s, d), 2)
    lines = si.stream_lines(s, folder, max_files=files)
    si.start_ingest(lines, f"{root}/tables", f"{root}/checkpoint", "edge-x", "192.0.2.1", 64, rollups=("dst_port",), once=True).awaitTermination()
    return si.read_table(s, f"{root}/tables", "dash_dst_port").drop("exporter_ip", "sample_rate")


@query(
    "stream_compacted_rollup",
    f"SELECT date_trunc('minute', flow_time) AS minute, input_if, output_if, dst_port, proto, {_ROLL}, 1 AS folders FROM {_CSV_GOOD} GROUP BY ALL",
)
def _stream_compacted(s, d):
    root = f"{shared_folder(s)}/weirgauge/stream-{uuid.uuid4().hex}"
    folder, files = land_batches(csv_lines(s, d), 3)
    lines = si.stream_lines(s, folder, max_files=files)
    si.start_ingest(lines, f"{root}/tables", f"{root}/checkpoint", "edge-x", "192.0.2.1", 64, rollups=("dst_port",), once=True).awaitTermination()
    stored = si.compact_tables(s, f"{root}/tables", date(2026, 7, 11))
    many = sum(f[0] == "dash_dst_port" for f in stored.live)
    return si.read_table(s, f"{root}/tables", "dash_dst_port", stored).drop("exporter_ip", "sample_rate", "sensor").withColumn("folders", F.lit(many))


@query(
    "retention_dropped_dates",
    """dt AS (SELECT CAST(flow_time - to_days((src_port % 40)::INT) AS DATE) AS flow_date, flow_count FROM flows), lim AS (SELECT * FROM (VALUES ('flow_raw', 7), ('flow_1m', 30), ('flow_tops_1m', 15), ('dash_protocol', 30)) t(table_name, days))
SELECT table_name, flow_date, sum(flow_count)::BIGINT AS flows FROM dt, lim WHERE table_name <> 'flow_tops_1m' AND flow_date >= DATE '2026-07-11' - days::INT GROUP BY ALL
UNION ALL SELECT 'flow_tops_1m', CAST(flow_time - to_days((src_port % 40)::INT) AS DATE) AS f, sum(flow_count)::BIGINT FROM flows WHERE f >= DATE '2026-07-11' - 15 GROUP BY f""",
)
def _retention_dates(s, d):
    root = f"{shared_folder(s)}/weirgauge/aged-{uuid.uuid4().hex}"
    shifted = F.expr("flow_time - make_dt_interval(src_port % 40)")
    rows = flows(s, d).withColumn("flow_time", shifted).withColumn("flow_date", F.to_date("flow_time"))
    si.store_batch(rows, 0, root, ("protocol",))
    table_log.delete_unused(s, root, si.drop_old_dates(s, root, date(2026, 7, 11)))
    out = None
    for name, count in (("flow_raw", "flow_count"), ("flow_1m", "flows"), ("flow_tops_1m", "flows"), ("dash_protocol", "flows")):
        kept = table_log.read(s, root, name)
        kept = kept.filter("dimension = 'proto'") if name == "flow_tops_1m" else kept
        part = kept.groupBy("flow_date").agg(F.sum(count).alias("flows")).select(F.lit(name).alias("table_name"), "flow_date", "flows")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "ingest_progress",
    f"""SELECT 'edge-x' AS source, count(*) FILTER (src_port % 53 >= 2) AS rows_read_total, count(*) FILTER (src_port % 53 > 2) AS rows_inserted_total, count(*) FILTER (src_port % 53 = 2) AS rows_skipped_total,
max(flow_time) FILTER (src_port % 53 > 2) AS last_flow_time, greatest(0, date_diff('second', max(flow_time) FILTER (src_port % 53 > 2), TIMESTAMP '2026-07-10 14:01:00')) AS lag_seconds, 'warning' AS status FROM flows""",
)
def _progress(s, d):
    # Lines are made once and stored with their half: a filter on it would make every line again.
    root, rows = f"{shared_folder(s)}/weirgauge/stream-{uuid.uuid4().hex}", staged(csv_lines(s, d).withColumn("first", F.xxhash64("value") % 2 == 0))
    half = F.col("first")
    folder = land_text(rows.filter(half).select("value"))

    def run():
        lines = si.stream_lines(s, folder, max_files=4)
        si.start_ingest(lines, f"{root}/tables", f"{root}/checkpoint", "edge-x", "192.0.2.1", 64, rollups=("dst_port",), once=True).awaitTermination()

    run()
    rows.filter(~half).select("value").write.mode("append").text(folder)
    run()  # goes on from the checkpoint; totals go on from the last commit
    return si.ingest_progress(s, f"{root}/tables", ts_lit("2026-07-10 14:01:00")).select(
        "source", "rows_read_total", "rows_inserted_total", "rows_skipped_total", "last_flow_time", "lag_seconds", "status"
    )


@query(
    "stream_minute_rollup_closed",
    f"""m AS (SELECT max(flow_time) AS newest FROM flows) SELECT date_trunc('minute', flow_time) AS minute, sensor, exporter_ip, input_if, output_if, sample_rate, proto, {_ROLL} FROM flows, m
WHERE date_trunc('minute', flow_time) + INTERVAL 1 MINUTE <= newest - INTERVAL 5 MINUTE GROUP BY ALL""",
)
def _stream_minutes(s, d):
    return sw.run_to_end(sw.minute_rollup(stream_flows(s, d), "protocol"), "minutes")


_HITS = """win AS (SELECT sensor, dst_ip, time_bucket(INTERVAL '30 seconds', flow_time, TIMESTAMP '2026-07-10') - to_seconds(o * 30) AS ws, packets * greatest(sample_rate, 1) AS p, bytes * greatest(sample_rate, 1) AS b, flow_count FROM flows, range(2) r(o)),
hit AS (SELECT sensor, dst_ip, ws, sum(p)::BIGINT AS packets, sum(b)::BIGINT AS bytes, sum(flow_count)::BIGINT AS flows, sum(p)::BIGINT / 60.0 AS value FROM win GROUP BY ALL HAVING sum(p) >= 1500 * 60),
done AS (SELECT hit.* FROM hit, (SELECT max(flow_time) AS newest FROM flows) m WHERE ws + INTERVAL 60 SECOND <= newest - INTERVAL 5 MINUTE)"""


def _hits(s, d):
    return sw.sliding_hits(rates.recorded_rate(stream_flows(s, d)), ["sensor", "dst_ip"], 1500.0, 4000.0)


@query(
    "stream_sliding_detection",
    f"{_HITS} SELECT sensor, dst_ip, ws AS window_start, packets, bytes, flows, round(value, 3)::DOUBLE AS value, CASE WHEN value >= 4000 THEN 'critical' ELSE 'warning' END AS severity FROM done",
)
def _stream_detection(s, d):
    out = sw.run_to_end(_hits(s, d), "detection")
    return out.select("sensor", "dst_ip", "window_start", "packets", "bytes", "flows", F.round("value", 3).alias("value"), "severity")


@query(
    "stream_series_freshness",
    """m AS (SELECT sensor, max(date_trunc('minute', flow_time)) AS t FROM flows, (SELECT max(flow_time) AS newest FROM flows) WHERE date_trunc('minute', flow_time) + INTERVAL 1 MINUTE <= newest - INTERVAL 5 MINUTE GROUP BY 1)
SELECT sensor, t AS last_complete_sample_at, greatest(0, date_diff('second', t, TIMESTAMP '2026-07-10 14:00:00') - 60) AS ingestion_lag_seconds, CASE WHEN date_diff('second', t, TIMESTAMP '2026-07-10 14:00:00') - 60 > 180 THEN 'delayed' ELSE 'current' END AS data_status FROM m""",
)
def _stream_freshness(s, d):
    stored = sw.run_to_end(sw.minute_rollup(stream_flows(s, d), "protocol"), "freshness")
    out = sw.freshness(stored, ["sensor"], ts_lit("2026-07-10 14:00:00"))
    return out.select("sensor", "last_complete_sample_at", "ingestion_lag_seconds", "data_status")


@query(
    "stream_events_by_quiet_period",
    f"""{_HITS}, st AS (SELECT *, ws + INTERVAL 60 SECOND - INTERVAL 1 MICROSECOND AS seen FROM done), g0 AS (SELECT *, CASE WHEN epoch(seen - lag(seen) OVER w) <= 120 THEN 0 ELSE 1 END AS opens FROM st WINDOW w AS (PARTITION BY sensor, dst_ip ORDER BY seen)),
g1 AS (SELECT *, sum(opens) OVER (PARTITION BY sensor, dst_ip ORDER BY seen) AS n FROM g0),
se AS (SELECT sensor, dst_ip, n, min(seen) AS first_seen, max(seen) AS last_seen, max(value) AS pv, count(*) AS points, arg_min(value, seen) AS tv, arg_max(value, seen) AS lv FROM g1 GROUP BY ALL)
SELECT sensor, dst_ip, first_seen, last_seen, round(pv, 3)::DOUBLE AS peak_value, points, round(tv, 3)::DOUBLE AS trigger_value, round(lv, 3)::DOUBLE AS last_value FROM se, (SELECT max(flow_time) AS newest FROM flows) m WHERE last_seen + INTERVAL 120 SECOND <= newest - INTERVAL 5 MINUTE""",
)
def _stream_events(s, d):
    events = sw.event_stream(_hits(s, d), ["sensor", "dst_ip"])
    out = sw.run_to_end(events, "events").select("sensor", "dst_ip", "first_seen", "last_seen", "peak_value", "points", "trigger_value", "last_value")
    return out.withColumns({c: F.round(c, 3) for c in ("peak_value", "trigger_value", "last_value")})


@query(
    "stream_event_lifecycle",
    f"""{_HITS}, st AS (SELECT *, ws + INTERVAL 60 SECOND - INTERVAL 1 MICROSECOND AS seen FROM done), g0 AS (SELECT *, CASE WHEN epoch(seen - lag(seen) OVER w) <= 120 THEN 0 ELSE 1 END AS opens FROM st WINDOW w AS (PARTITION BY sensor, dst_ip ORDER BY seen)),
g1 AS (SELECT *, sum(opens) OVER (PARTITION BY sensor, dst_ip ORDER BY seen) AS n FROM g0),
se AS (SELECT sensor, dst_ip, n, min(seen) AS first_seen, max(seen) AS last_seen, max(value) AS pv, count(*) AS points, arg_min(value, seen) AS tv, arg_max(value, seen) AS lv FROM g1 GROUP BY ALL)
SELECT sensor, dst_ip, first_seen, last_seen, round(pv, 3)::DOUBLE AS peak_value, points, round(tv, 3)::DOUBLE AS trigger_value, round(lv, 3)::DOUBLE AS last_value, CASE WHEN last_seen + INTERVAL 120 SECOND <= newest - INTERVAL 5 MINUTE THEN 'ended' ELSE 'active' END AS status FROM se, (SELECT max(flow_time) AS newest FROM flows) m""",
)
def _stream_lifecycle(s, d):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(provider, None)
    lifecycle.use_timers(s)
    try:
        log = sw.run_to_end(lifecycle.event_log(_hits(s, d), ["sensor", "dst_ip"]), "lifecycle")
    finally:
        s.conf.unset(provider) if before is None else s.conf.set(provider, before)
    out = lifecycle.current_events(log, ["sensor", "dst_ip"]).replace({"updated": "active"}, subset=["status"])
    return out.select(
        "sensor", "dst_ip", "first_seen", "last_seen", *[F.round(c, 3).alias(c) for c in ("peak_value", "trigger_value", "last_value")], "points", "status"
    )
