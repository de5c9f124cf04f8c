import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirgauge.functions import ip
from weirgauge.operators import advise, detect, grouping, learn, ordered, peaks, prefixes, rates
from weirgauge.plans import peak_analysis
from weirgauge.sources import text_flows
from weirgauge.streaming import ingest as si

T0 = datetime(2026, 7, 10, 12, 0)
RULE = {"rule_id": 1, "zone_id": 7, "vector": "DNS", "direction": "transmits", "protocol": "DNS", "metric": "packets_s", "warning_value": 0.0, "critical_value": 5000.0,
        "window_seconds": 60, "src_port": "any", "dst_port": "53", "group_by": "", "detection_key": "DNS_SINGLE_FLOW_OUTBOUND", "use_global_whitelist": True,
        "extra_whitelist_ids": None, "bypass_whitelist": False, "enabled": True}
RULE_SCHEMA = "rule_id int, zone_id int, vector string, direction string, protocol string, metric string, warning_value double, critical_value double, window_seconds int, src_port string, dst_port string, group_by string, detection_key string, use_global_whitelist boolean, extra_whitelist_ids array<int>, bypass_whitelist boolean, enabled boolean"


def flow(spark, *rows):
    """Rows of (source port, packets per second, protocol, destination port)."""
    data = [(T0 + timedelta(seconds=5), "100.64.1.9", "8.8.8.8", sp, dp, proto, pps * 60 * 100, pps * 60, 1, 1) for sp, pps, proto, dp in rows]
    df = spark.createDataFrame(data, "flow_time timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto int, bytes bigint, packets bigint, flow_count bigint, rate bigint")
    return df.withColumns({"src_ip_key": ip.ip_key(F.col("src_ip")), "dst_ip_key": ip.ip_key(F.col("dst_ip"))})


def zones(spark):
    return prefixes.prefix_table(spark.createDataFrame([(7, "100.64.0.0/16")], "zone_id int, prefix string"))


def hits(spark, *rows, **changes):
    rules = spark.createDataFrame([{**RULE, **changes}], RULE_SCHEMA)
    return detect.eval_rules(flow(spark, *rows), zones(spark), rules).collect()


def test_boundary_protocol_and_port(spark):
    assert hits(spark, (2000, 4999, 17, 53)) == []
    exact = hits(spark, (2000, 5000, 17, 53))
    assert [(r["severity"], r["metric_value"]) for r in exact] == [("critical", 5000.0)]
    assert hits(spark, (2000, 11000, 6, 53)) == [] and hits(spark, (2000, 11000, 17, 54)) == []


def test_source_ports_never_add_up(spark):
    assert hits(spark, (2000, 3000, 17, 53), (3000, 3000, 17, 53)) == []
    one = hits(spark, (2000, 6000, 17, 53), (3000, 1000, 17, 53))
    assert [(r["src_port"], r["top_src_port"], r["packets_s"]) for r in one] == [(2000, 2000, 6000.0)]


def test_free_text_grouping_takes_the_heaviest_source_port(spark):
    got = hits(spark, (2000, 4000, 17, 53), (2001, 3000, 17, 53), detection_key="", group_by="src_ip,dst_ip,dst_port,proto", warning_value=5000.0, critical_value=15000.0)
    assert [(r["severity"], r["src_port"], r["top_src_port"]) for r in got] == [("warning", None, 2000)]


def test_whitelist_controls(spark):
    listed = prefixes.prefix_table(spark.createDataFrame([(1, "resolver", "8.8.8.0/24", True)], "whitelist_id int, name string, prefix string, is_global boolean"))
    for changes, expected in (({}, 0), ({"bypass_whitelist": True}, 1), ({"use_global_whitelist": False}, 1), ({"use_global_whitelist": False, "extra_whitelist_ids": [1]}, 0)):
        rules = spark.createDataFrame([{**RULE, **changes}], RULE_SCHEMA)
        assert len(detect.eval_rules(flow(spark, (2000, 6000, 17, 53)), zones(spark), rules, listed).collect()) == expected


def point(key, minute, value, threshold):
    return (key, T0 + timedelta(minutes=minute), value, threshold)


SCHEMA = "dedupe_key string, seen_at timestamp, value double, threshold double"


def test_trigger_never_changes_while_last_and_peak_move(spark):
    first = spark.createDataFrame([point("a", 0, 7000.0, 5000.0)], SCHEMA)
    empty = detect.anomaly_history(first.limit(0), ["dedupe_key"]).withColumn("status", F.lit("active"))
    state = detect.upsert_events(empty, first)
    for minute, value, threshold in ((1, 20000.0, 18000.0), (2, 9000.0, 6000.0)):
        state = detect.upsert_events(state, spark.createDataFrame([point("a", minute, value, threshold)], SCHEMA))
    row = state.first()
    assert (row["trigger_value"], row["trigger_threshold"], row["last_value"], row["peak_value"], row["points"]) == (7000.0, 5000.0, 9000.0, 20000.0, 3)
    closed = detect.close_events(state, F.lit(T0 + timedelta(minutes=5)))
    assert closed.first()["status"] == "ended"
    reopened = detect.upsert_events(closed, spark.createDataFrame([point("a", 9, 1.0, 1.0)], SCHEMA)).first()
    assert (reopened["status"], reopened["trigger_value"]) == ("active", 7000.0)


def test_policy_gate_order(spark):
    rows = spark.createDataFrame([("warning", 7000.0, 15000.0, 1, "", None), ("critical", 20000.0, 15000.0, 1, "", None), ("critical", 21000.0, 15000.0, 2, "", None)],
                                 "severity string, last_value double, automatic_threshold double, points int, addressing_block_reason string, whitelist_name string")
    got = [(r["allowed"], r["reason"], len(r["reasons"])) for r in detect.policy_gate(rows).collect()]
    assert got == [(False, "warning_manual_only", 3), (False, "insufficient_time_series_evidence", 1), (True, "", 0)]


def test_dominant_group_and_noise(spark):
    rows = [("i", f"10.0.0.{n}", 1000 + n, "203.0.113.5", 9004, "udp", 500_000, 900, 1, T0) for n in range(3)]
    rows += [("i", "10.0.0.9", 5, "203.0.113.6", 80, "tcp", 1000, 10, 1, T0), ("i", "10.0.0.9", 5, "203.0.113.6", 80, "tcp", 1000, 10, 1, T0)]
    schema = "incident_id string, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, bytes bigint, packets bigint, flow_count bigint, flow_time timestamp"
    flows = grouping.distinct_flows(spark.createDataFrame(rows, schema))
    assert flows.count() == 4
    lead = grouping.dominant(grouping.flow_groups(flows))
    row = lead.first()
    assert (row["dst_ip"], row["unique_src_ips"], row["share_packets_percent"]) == ("203.0.113.5", 3, 99.63)
    counts = grouping.noise_counts(grouping.split_noise(flows, lead)).first()
    assert (counts["primary_flows"], counts["ignored_noise_flows_count"]) == (3, 1)
    assert grouping.dominant(grouping.flow_groups(flows), min_packets=10**9, min_bytes=10**12).count() == 0


def incident(spark, **values):
    base = {"incident_id": "x", "direction": "sends", "protocol": "udp", "src_ip": "100.64.0.5", "dst_ip": "203.0.113.9", "dst_port": 9004, "src_is_customer": True,
            "dst_is_customer": False, "dst_is_external": True, "packets": 10_000, "bytes": 5_000_000}
    row = {**base, **values}
    kinds = ", ".join(f"{k} {advise.INCIDENT[k]}" for k in row)
    return spark.createDataFrame([tuple(row.values())], kinds)


def templates(df):
    return [r["template"] for r in advise.candidates(df).orderBy("candidate_index").collect()]


def test_candidates(spark):
    assert templates(incident(spark)) == ["src_customer_32_dst_external_32_proto_dst_port", "dst_external_32_proto_dst_port", "alert_only"]
    multi = incident(spark, has_dominant=True, unique_src_count=3, dst_prefix="203.0.113.0/24", same_dst_24=True)
    assert templates(multi) == ["dst_external_32_proto_dst_port", "dst_external_prefix_proto_dst_port", "alert_only"]
    assert templates(incident(spark, top_flow_empty=True)) == ["alert_only"]
    assert templates(incident(spark, protocol="tcp", dst_port=443, tcp_flags="ack")) == ["alert_only"]
    assert templates(incident(spark, protocol="tcp", dst_port=443, tcp_flags="syn", suspected_template="possible_l7_http_https"))[0] == "dst_32_tcp_dst_port_syn"


def test_validation_and_choice(spark):
    weak = incident(spark, packets=10, peak_pps=50_000.0)
    got = advise.validate(advise.candidates(weak)).orderBy("candidate_index").collect()
    assert got[0]["violations"] == ["insufficient_flow_evidence_packets_vs_peak"] and got[-1]["valid"]
    fine = advise.recommendation(incident(spark, has_dominant=True, unique_src_count=3)).first()
    assert (fine["evidence_status"], fine["mitigation_allowed"], fine["confidence"], fine["allow_auto"]) == ("complete", True, "high", False)
    unknown = advise.recommendation(incident(spark, direction="inbound", has_dominant=True, unique_src_count=1)).first()
    assert (unknown["evidence_status"], unknown["recommended_action"]) == ("weak", "alert_only")


def test_planted_peak_is_found(spark):
    values = [100.0] * 50 + [9000.0] + [110.0] * 49
    df = spark.createDataFrame([("s", T0 + timedelta(seconds=5 * n), v) for n, v in enumerate(values)], "k string, bucket timestamp, value double")
    based = peaks.with_baseline(df, ["k"])
    marked = based.withColumn("threshold_used", peaks.threshold(F.col("baseline_p95"), F.col("baseline_p99")))
    found = peaks.top_peaks(peaks.local_peaks(marked, ["k"]), ["k"]).collect()
    assert [(r["peak_time"], r["peak_value"]) for r in found] == [(T0 + timedelta(seconds=250), 9000.0)]
    few = peaks.baseline(df.limit(2), ["k"]).first()
    assert (few["baseline_p95"], few["baseline_p99"]) == (100.0, 100.0)


def test_counter_reset_gives_no_rate(spark):
    df = spark.createDataFrame([("s", T0, 1000), ("s", T0 + timedelta(seconds=60), 61000), ("s", T0 + timedelta(seconds=120), 500)], "k string, sample_time timestamp, in_octets bigint")
    got = [r["in_bps"] for r in learn.counter_rate(df, ["k"], ["in_octets"]).orderBy("sample_time").collect()]
    assert got == [None, 8000.0, None]


def test_text_records(spark, tmp_path):
    lines = [
        "", "! note", "10.0.0.1,10.0.0.2,1,2,udp,0,1,2,0,0,1783684800,5,500", "10.0.0.1,10.0.0.2,1", '{"src_ip": "2001:DB8::1", "dstaddr": "x", "octets": "12.7", "flow_count": 0}',
        '[{"ip_src": "1.1.1.1"}, 5]', "{broken", "SrcAddr,Bytes,Dst-Port", "9.9.9.9,77,443",
    ]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    found = text_flows.parse_flow_lines(text_flows.read_lines(spark, str(tmp_path)))
    assert [r["record_status"] for r in found.collect()] == ["skipped", "skipped", "ok", "dropped", "ok", "ok", "bad", "header", "ok"]
    rows = text_flows.normalize_flows(found, "s", "192.0.2.1", 10).collect()
    assert [(r["src_ip"], r["dst_ip"], r["dst_port"], r["bytes"], r["flow_count"], r["sample_rate"]) for r in rows] == [
        ("10.0.0.1", "10.0.0.2", 2, 500, 1, 10), ("2001:db8::1", "::", 0, 12, 1, 10), ("1.1.1.1", "::", 0, 0, 1, 10), ("9.9.9.9", "::", 443, 77, 1, 10),
    ]
    metrics = text_flows.ingest_metrics(found).first()
    assert (metrics["rows_inserted"], metrics["rows_skipped"], metrics["parser_status"]) == (4, 4, "warning")


def test_stream_restart_neither_loses_nor_repeats(spark, tmp_path):
    spool, root, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    spool.mkdir()

    def land(name, ports):
        (spool / name).write_text("".join(f"10.0.0.1,10.0.0.2,{p},53,17,0,1,2,0,0,1783684800,5,500\n" for p in ports) + "bad,line\n")

    def run():
        si.start_ingest(si.stream_lines(spark, str(spool)), str(root), str(checkpoint), "s", "192.0.2.1", rollups=("dst_port",), once=True).awaitTermination()

    land("a.txt", [1, 2, 3])
    run()
    run()
    land("b.txt", [4])
    run()
    assert sorted(r["src_port"] for r in si.read_table(spark, str(root), "flow_raw").collect()) == [1, 2, 3, 4]
    merged = si.read_table(spark, str(root), "dash_dst_port").collect()
    assert [(r["packets"], r["flows"]) for r in merged] == [(20, 4)]  # the late file adds to the old minute
    assert si.read_table(spark, str(root), "quarantine").count() == 2


def test_vector_groups_count_every_source(spark):
    at = F.timestamp_seconds(F.lit(1_783_685_400))
    found = spark.range(1).select(F.lit("edge-0").alias("sensor"), F.lit(1).cast("bigint").alias("interface_id"), F.lit("receives").alias("direction"), at.alias("peak_time"))
    flows = spark.range(5000).select(
        F.lit("edge-0").alias("sensor"), F.lit("192.0.2.10").alias("exporter_ip"), at.alias("flow_time"),
        F.concat(F.lit("10.0."), F.floor(F.col("id") / 250), F.lit("."), F.col("id") % 250).alias("src_ip"), F.lit("198.51.100.7").alias("dst_ip"),
        F.lit(4000).alias("src_port"), F.lit(53).alias("dst_port"), F.lit(17).alias("proto"), F.lit(1).cast("bigint").alias("input_if"),
        F.lit(2).cast("bigint").alias("output_if"), F.lit(100).cast("bigint").alias("bytes"), F.lit(2).cast("bigint").alias("packets"),
        F.lit(1).cast("bigint").alias("flow_count"), F.lit(1).cast("bigint").alias("sample_rate"),
    )
    config = spark.createDataFrame(
        [("192.0.2.10", 1, 1, 1, 1, 1)], "exporter_ip string, if_index bigint, direction int, sample_rate bigint, active int, updated_at int"
    )
    evidence = peak_analysis.evidence_flows(flows, rates.current_rates(config), found, "receives")
    groups = peaks.vector_groups(evidence, [*peak_analysis.SERIES, "peak_time", "window_seconds"]).collect()
    assert {g["unique_src_count"] for g in groups} == {5000} and {g["total_packets"] for g in groups} == {10000}
    assert peaks.top_peak_flows(evidence, ["window_seconds"], k=3).count() == 3 * len(groups)


def test_top_port_holds_any_weight(spark):
    rows = spark.createDataFrame([(2**62, 80), (2**62, 443), (1, 65535)], "weight bigint, port int")
    assert rows.agg(detect._top_port(F.col("weight"), "port").alias("top")).first()["top"] == 443


def test_listings_return_what_is_asked(spark):
    rows = spark.range(150).selectExpr("id AS event_id", "'peaks' AS source", "timestamp_seconds(id) AS last_seen")
    assert detect.recent_events(rows, "peaks").count() == 150
    assert [r["event_id"] for r in detect.recent_events(rows, "peaks", 120).collect()] == list(range(149, 29, -1))
    with pytest.raises(ValueError, match="limit"):
        detect.recent_events(rows, "peaks", 0)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_cooldown_counts_from_the_last_event_that_fired(spark, seed):
    draw = random.Random(seed)
    rows = [("every four minutes", T0 + timedelta(minutes=4 * n)) for n in range(40)]  # over several chunks when chunks are short
    rows += [("hot", T0 + timedelta(seconds=s)) for s in sorted(draw.sample(range(0, 40_000), 900))]
    rows += [("edge", T0 + timedelta(seconds=s, microseconds=m)) for s, m in ((0, 0), (299, 999_999), (300, 0), (599, 0), (600, 1))]
    rows += [(None, T0), (None, T0 + timedelta(seconds=10)), (None, T0 + timedelta(seconds=301)), ("none", None), ("twice", T0), ("twice", T0)]
    df = spark.createDataFrame(rows, "who string, bucket timestamp")
    got = {(r["who"], r["bucket"]): r["suppressed"] for r in detect.cooldown(df, ["who"], 300).collect()}
    assert detect.cooldown(df, ["who"], 300).count() == len(rows)
    last = {}
    for who, at in sorted((r for r in set(rows) if r[1]), key=lambda r: (str(r[0]), r[1])):
        fires = who not in last or at - last[who] >= timedelta(seconds=300)
        last[who] = at if fires else last[who]
        assert got[(who, at)] == (not fires), (who, at)
    assert got[("none", None)] is False
    assert [got[("every four minutes", T0 + timedelta(minutes=4 * n))] for n in range(6)] == [False, True, False, True, False, True]
    short = ordered.spaced(df.filter("who = 'hot'"), ["who"], "bucket", 300, 1000)
    assert {r["bucket"] for r in short.collect()} == {at for (who, at), quiet in got.items() if who == "hot" and not quiet}


ANOMALY = "anomaly_id bigint, dst_ip string, dst_port int, src_ip string, proto int, first_seen timestamp, last_seen timestamp, excluded_ports array<int>"


def seconds_of_traffic(spark, n=4000):
    draw = random.Random(5)
    rows = [(T0 + timedelta(seconds=draw.randrange(5000)), f"100.64.0.{draw.randrange(4)}", draw.randrange(9), draw.choice(["8.8.8.8", "9.9.9.9", None]), draw.choice([53, 80, 443, None]), 17, draw.randrange(50), draw.randrange(20)) for _ in range(n)]
    return spark.createDataFrame(rows, "flow_time timestamp, src_ip string, src_port int, dst_ip string, dst_port int, proto int, bytes bigint, packets bigint")


def spans_of_anomalies(spark):
    draw = random.Random(6)
    rows = []
    for i in range(60):
        begin = T0 + timedelta(seconds=draw.randrange(4500))
        rows.append((i // 2 if i % 5 else None, draw.choice(["8.8.8.8", "9.9.9.9", "7.7.7.7", None]), draw.choice([None, 53, 80]), draw.choice([None, None, "100.64.0.1"]), None, begin, begin + timedelta(seconds=draw.choice([0, 1, 63, 300, 1500])), draw.choice([None, [53], [80, 443]])))
    return spark.createDataFrame(rows, ANOMALY)


def test_heaviest_flows_fill_like_all_pairs_from_few_rows(spark):
    seen, asked = seconds_of_traffic(spark), spans_of_anomalies(spark)
    fields = ["anomaly_id", "first_seen", "src_ip", "dst_ip", "dst_port", "proto"]
    told = lambda related: sorted(map(str, detect.fill_from_flows(asked, related).select(*fields).collect()))
    pairs, few = detect.related_flows(asked, seen), detect.related_flows(asked, seen, heaviest=True)
    assert told(few) == told(pairs)
    crowd = seen.crossJoin(spark.range(10)).drop("id")  # ten times the flows at the same times: no more rows meet
    assert detect.related_flows(asked, crowd, heaviest=True).count() == few.count() < pairs.count()


def test_series_of_anomalies_by_hand(spark):
    seen = seconds_of_traffic(spark)
    asked = spans_of_anomalies(spark).withColumn("excluded_ports", F.lit(None).cast("array<int>"))
    want = {}
    flows_ = seen.collect()
    for a in asked.collect():
        if a.anomaly_id is None:
            continue
        begin, end = a.first_seen - timedelta(seconds=900), max(a.last_seen, a.first_seen + timedelta(hours=1))
        for f in flows_:
            if f.dst_ip is not None and f.dst_ip == a.dst_ip and begin <= f.flow_time <= end:
                bucket = want.setdefault(a.anomaly_id, {}).setdefault(f.flow_time.replace(second=0), [0, None])
                bucket[0] += f.packets
                if f.dst_port is not None and (f.src_ip, f.dst_port) == (a.src_ip, a.dst_port):
                    bucket[1] = (bucket[1] or 0) + f.packets
    expected = set()
    for i, buckets in want.items():
        narrow = sum(c is not None for _, c in buckets.values()) >= 2
        expected |= {(i, b, round((c if narrow else t) / 60, 6), "conversation" if narrow else "target") for b, (t, c) in buckets.items() if not narrow or c is not None}
    got = detect.anomaly_series(asked, seen)
    assert {(r.anomaly_id, r.bucket, round(r.packets_s, 6), r.scope) for r in got.collect()} == expected
    assert {s for *_, s in expected} == {"conversation", "target"}


def test_series_meets_one_row_for_each_window(spark):
    asked = spans_of_anomalies(spark).filter("dst_ip = '8.8.8.8'")
    plan = detect.anomaly_series(asked, seconds_of_traffic(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "__fbin" not in plan and "__slot" in plan


def test_sliding_windows_are_formed_after_the_shuffle(spark):
    random.seed(4)
    data = [(T0 + timedelta(seconds=random.randrange(3000)), f"100.64.1.{random.randrange(2)}", f"8.8.8.{random.randrange(5)}", 2000, 53, 17, 100, random.randrange(1, 9), 1, 1) for _ in range(120)]
    df = spark.createDataFrame(data, "flow_time timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto int, bytes bigint, packets bigint, flow_count bigint, rate bigint")
    df = df.withColumns({"src_ip_key": ip.ip_key(F.col("src_ip")), "dst_ip_key": ip.ip_key(F.col("dst_ip"))})
    plain = {**RULE, "detection_key": "", "group_by": "src_ip", "window_seconds": 90, "warning_value": 0.001, "critical_value": 0.0}
    rules = spark.createDataFrame([plain, {**plain, "rule_id": 2, "metric": "unique_dst_ips", "window_seconds": 60, "warning_value": 1.0}], RULE_SCHEMA)
    found = detect.eval_rules(df, zones(spark), rules, cadence=30)
    want = {}
    for at, src, dst, *_, packets, _, _ in data:
        second = int((at - T0).total_seconds())
        for rule, window in ((1, 90), (2, 60)):
            for start in range((second - window) // 30 * 30 + 30, second + 1, 30):
                total, seen = want.get((rule, src, start), (0, frozenset()))
                want[rule, src, start] = (total + packets, seen | {dst})
    got = {(r["rule_id"], r["src_ip"], int((r["bucket"] - T0).total_seconds())): (r["packets"], r["unique_dst_ips"]) for r in found.collect()}
    assert got == {k: (total, len(seen)) for k, (total, seen) in want.items()}
    # no exchange between the windows and their sums: what is shuffled does not grow with the windows
    one = detect.eval_rules(df, zones(spark), rules.filter("rule_id = 1"), cadence=30, counts=False)
    plan = one._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("__chunk" in line for line in exchanges) and not any("bucket" in line for line in exchanges)


def test_sources_of_targets_are_counted_without_shuffling_pairs(spark):
    random.seed(5)
    data = [(T0 + timedelta(seconds=random.randrange(900)), random.choice(["100.64.1.1", "100.64.1.2", "100.64.1.3", None]), f"8.8.8.{random.randrange(2)}", random.choice([53, 80]), random.choice([6, 17]), 10, 1) for _ in range(300)]
    df = spark.createDataFrame([*data, *data[:40]], "flow_time timestamp, src_ip string, dst_ip string, dst_port int, proto int, bytes bigint, packets bigint")
    df = df.withColumn("dst_ip_key", ip.ip_key(F.col("dst_ip")))
    asked = [(i, f"8.8.8.{i % 2}", 53 if i % 3 == 0 else None, "100.64.1.2" if i % 5 == 0 else None, T0 + timedelta(seconds=i * 41), T0 + timedelta(seconds=i * 41 + i * 13), [80] if i % 4 == 0 else None) for i in range(20)]
    asked += [asked[7], asked[7], (7, *asked[9][1:]), asked[12], (None, *asked[3][1:]), (None, *asked[13][1:])]  # ids that repeat, with equal and with other spans
    anomalies = spark.createDataFrame(asked, "anomaly_id int, dst_ip string, dst_port int, src_ip string, first_seen timestamp, last_seen timestamp, excluded_ports array<int>")

    def told(**how):
        related = detect.related_flows(anomalies, df, **how).withColumnRenamed("anomaly_id", "event_id")
        return advise.target_candidates(related, None, 3)

    summed = told(sources=True)
    assert sorted(map(str, summed.collect())) == sorted(map(str, told().collect()))
    plan = summed._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]  # between the pairs and the result: no exchange of all sources
    assert not any("src_ip" in line for line in above.splitlines() if "Exchange hashpartitioning" in line)


def test_cardinalities_shuffle_no_pairs(spark):
    rng = random.Random(11)
    start = datetime(2026, 7, 10, 12, 0)
    picked = lambda *values: rng.choice(values)
    rows = [(start + timedelta(milliseconds=250 * rng.randrange(6000)), picked("a", "b", "c", None), picked(1, 2), picked("x", "y", None), picked(53, 80, None), picked(6, 17, None)) for _ in range(600)]
    seen = spark.createDataFrame(rows + rows[:30] + [(None, "a", 1, "x", 53, 6)], "flow_time timestamp, src_ip string, src_port int, dst_ip string, dst_port int, proto int")
    spans = []
    for k in range(60):
        first = start + timedelta(seconds=rng.randrange(1500))
        spans.append((k % 50 if k < 58 else None, picked("x", "y", "z", None), picked(None, 53, 80), picked(None, None, "a"), first, first + timedelta(seconds=rng.randrange(-100, 400)), picked(None, [53], [80, 53])))
    asked = spark.createDataFrame(spans, "anomaly_id int, dst_ip string, dst_port int, src_ip string, first_seen timestamp, last_seen timestamp, excluded_ports array<int>")
    related = detect.related_flows(asked, seen, distinct=True)
    want = {r["anomaly_id"]: tuple(r) for r in detect.cardinalities(detect.related_flows(asked, seen)).collect()}
    assert len(want) > 15 and {r["anomaly_id"]: tuple(r) for r in detect.cardinalities(related).collect()} == want
    once = asked.filter("anomaly_id BETWEEN 10 AND 49")
    plan = detect.cardinalities(detect.related_flows(once, seen, distinct=True))._jdf.queryExecution().executedPlan().toString()
    # Pairs are added up where they are formed: nothing that has an anomaly and an address is dealt.
    assert not [line for line in plan.splitlines() if "Expand" in line or ("Exchange" in line and "anomaly_id" in line and "src_ip" in line)]
