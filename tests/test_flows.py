"""Rates, rollups, ordered scans, series and prefix joins on planted rows."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirgauge.operators import filters, prefixes, rates, rollup, series, topn
from weirgauge.operators.ordered import ordered_scan
from weirgauge.sources import text_flows
from weirgauge.sources.lineitem_flows import flows

DATA = "/root/testdata/sf0.001"
START, END = datetime(2026, 7, 10, 12, 7, 13), datetime(2026, 7, 10, 13, 41, 39)


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_rate_precedence(spark):
    config = spark.createDataFrame(
        [("e", 0, 1, 100, 1, 1), ("e", 0, 2, 200, 1, 1), ("e", 10, 1, 999, 1, 0), ("e", 10, 1, 150, 1, 2), ("e", 10, 2, 250, 1, 1), ("e", 11, 1, 700, 0, 3), ("e", 11, 1, 600, 1, 2)],
        "exporter_ip string, if_index bigint, direction int, sample_rate bigint, active int, updated_at int",
    )
    cases = [("e", 10, 20, 1, "auto", 150), ("e", 5, 10, 1, "output", 250), ("e", 5, 0, 1, "input", 100), ("e", 0, 20, 1, "auto", 200),
             ("x", 1, 2, 512, "auto", 512), ("e", 10, 0, 7, "input", 150), ("e", 11, 0, 7, "input", 100), ("x", 0, 0, 0, "auto", 1)]
    current = rates.current_rates(config)
    for exporter, i, o, recorded, direction, expected in cases:
        row = spark.createDataFrame([(exporter, i, o, recorded)], "exporter_ip string, input_if bigint, output_if bigint, sample_rate bigint")
        assert rates.with_rate(row, current, direction).first()["rate"] == expected


def test_rollup_then_scale_equals_scale_then_sum(spark):
    raw = flows(spark, DATA)
    direct = rollup.scaled(rates.recorded_rate(raw), ["src_ip"], "flow_count")
    rolled = rollup.scaled(rates.recorded_rate(rollup.merge_rollup(rollup.dash_rollup(raw, "src_ip"))), ["src_ip"])
    assert rows_of(direct) == rows_of(rolled)


def test_hybrid_window_equals_raw_window(spark):
    raw = flows(spark, DATA)
    for start, end in ((START, END), (START, START + timedelta(seconds=20)), (datetime(2026, 7, 10, 12), datetime(2026, 7, 10, 13))):
        hybrid = rollup.hybrid(raw, rollup.dash_rollup(raw, "dst_port"), "dst_port", start, end)
        exact = filters.in_range(raw, start, end)
        keys = ["dst_port", "proto"]
        a = hybrid.groupBy(*keys).agg(F.sum("bytes"), F.sum("flows"))
        b = exact.groupBy(*keys).agg(F.sum("bytes"), F.sum("flow_count"))
        assert rows_of(a) == rows_of(b)


def test_partitioning_does_not_change_results(spark):
    raw = flows(spark, DATA)
    wide, narrow = raw.repartition(50), raw.coalesce(1)
    for make in (lambda f: topn.top_n(f, "dst_ip", "bytes", 7200, 15), rollup.flow_tops_1m, topn.interface_rx_tx):
        assert rows_of(make(wide)) == rows_of(make(narrow))


def test_ordered_scan_equals_plain_windows(spark):
    random.seed(1)
    data = [(random.choice("ab"), n, random.choice([None, random.randint(0, 9)]), random.randint(1, 50)) for n in random.sample(range(1000), 200)]
    df = spark.createDataFrame(data, "k string, n int, v int, w int")
    got = ordered_scan(
        df, ["k"], F.floor(F.col("n") / 37), ["n"],
        {"i": ("index", None), "c": ("count_all", None), "s": ("sum", F.col("w")), "m": ("max_before", F.col("w")),
         "l": ("last", F.col("v")), "p": ("prev", F.col("v")), "x": ("next", F.col("w"))},
    )
    w = Window.partitionBy("k").orderBy("n")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("k")).alias("c"), F.sum("w").over(upto).alias("s"),
        F.max("w").over(before).alias("m"), F.last("v", True).over(upto).alias("l"), F.lag("v").over(w).alias("p"), F.lead("w").over(w).alias("x"),
    )
    assert rows_of(got) == rows_of(want)


def test_downsample_and_thin_against_plain_python(spark):
    base = datetime(2026, 7, 10)
    random.seed(5)
    for size, limit in ((3, 5), (40, 7), (57, 12), (20, 2), (20, 1)):
        values = [float(random.randint(0, 500)) for _ in range(size)]
        df = spark.createDataFrame([("k", base + timedelta(minutes=9 * n), v, f"r{n % 3}") for n, v in enumerate(values)], "k string, ts timestamp, value double, reason string")
        got = [r["value"] for r in series.downsample(df, ["k"], limit).orderBy("ts").collect()]
        if size <= limit:
            expected = values
        elif limit == 1:
            expected = [max(values)]
        else:
            picks = list(dict.fromkeys(round(n * ((size - 1) / (limit - 1))) for n in range(limit)))
            top = values.index(max(values))
            if top not in picks:
                picks[-1] = top
            expected = [values[n] for n in sorted(picks)]
        assert got == expected, (size, limit)
        thinned = series.thin(df, ["k"], limit).orderBy("ts").collect()
        assert len(thinned) == min(size, limit)
        assert thinned[0]["ts"] == base
        if 2 < limit < size:
            inner, slots = values[1:-1], limit - 2
            cuts = [(g * len(inner) // slots, (g + 1) * len(inner) // slots) for g in range(slots)]
            means = [sum(inner[a:b]) / (b - a) for a, b in cuts]
            assert [r["value"] for r in thinned[1:-1]] == pytest.approx(means)
            assert [r["ts"] for r in thinned[1:-1]] == [base + timedelta(minutes=9 * (1 + a + (b - a) // 2)) for a, b in cuts]


def test_open_bucket_is_left_out_or_marked(spark):
    df = spark.createDataFrame([(datetime(2026, 7, 10, 12, 0), 600.0), (datetime(2026, 7, 10, 12, 1), 600.0), (datetime(2026, 7, 10, 12, 2), None)], "ts timestamp, n double")
    cutoff = F.to_timestamp(F.lit("2026-07-10 12:01:30"))
    assert [(r["rate"], r["partial"]) for r in series.bucket_rates(df, {"rate": "n"}, 60, cutoff).collect()] == [(10.0, False)]
    both = series.bucket_rates(df, {"rate": "n"}, 60, cutoff, include_partial=True).orderBy("ts").collect()
    assert [(r["rate"], r["partial"], r["bucket_duration_seconds"]) for r in both] == [(10.0, False, 60.0), (20.0, True, 30.0)]


def test_bucket_choice_and_ranges():
    now = datetime(2026, 7, 10, 12)
    assert series.choose_bucket(now - timedelta(hours=24), now, 1000) == 120
    assert series.choose_bucket(now - timedelta(days=400), now, 100) == 4 * 86400
    assert series.effective_interval_ms(604_800_000, 1000, 1000) == 604_800
    assert series.resolve_range(now, start=now - timedelta(hours=1), end=now + timedelta(hours=1))[1:] == (now, 60)
    with pytest.raises(ValueError):
        series.resolve_range(now, start=now, end=now - timedelta(minutes=1))


def test_longest_prefix_wins_and_overlaps_stay_exact(spark):
    table = prefixes.prefix_table(
        spark.createDataFrame([("10.0.0.0/8", "a"), ("10.1.0.0/16", "b"), ("10.1.2.0/31", "c"), ("2001:db8::/32", "d"), ("0.0.0.0/0", "e"), ("bad", "f")], "prefix string, name string")
    )
    from weirgauge.functions import ip

    df = spark.createDataFrame([("10.1.2.1",), ("10.1.2.2",), ("10.9.9.9",), ("8.8.8.8",), ("2001:db8::7",), ("2002::1",)], "t string").withColumn("key", ip.ip_key(F.col("t")))
    got = {r["t"]: r["zone"] for r in prefixes.longest_prefix(df, "key", table, {"name": "zone"}).collect()}
    assert got == {"10.1.2.1": "c", "10.1.2.2": "b", "10.9.9.9": "a", "8.8.8.8": "e", "2001:db8::7": "d", "2002::1": None}


def test_filters_refuse_what_is_not_offered():
    for bad in ({"field": "sql", "value": 1}, {"field": "port", "operator": "like", "value": 1}, {"field": "port", "value": 70000},
                {"field": "src_ip", "value": "x"}, {"field": "port", "operator": "between", "value": [1]}, {"field": "ip_version", "value": 5}):
        with pytest.raises(ValueError):
            filters.check_filter(bad)


def test_plans_have_no_nested_loops_and_prune_columns(spark):
    raw = flows(spark, DATA)
    config = rates.current_rates(spark.createDataFrame([("192.0.2.10", 1, 1, 5, 1, 1)], "exporter_ip string, if_index bigint, direction int, sample_rate bigint, active int, updated_at int"))
    plan = topn.top_n(raw, "src_ip", "bps", 60, 10, config)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "TakeOrderedAndProject" in plan
    assert "l_shipdate" not in plan and "l_extendedprice" not in plan


def test_requests_choose_a_rollup_only_when_it_fits(spark):
    from weirgauge.plans.specs import QuerySpec, TableRequest

    raw = flows(spark, DATA)
    rolled = {"dst_port": rollup.dash_rollup(raw, "dst_port")}
    spec = QuerySpec("top_n", START, END, "bytes", "dst_port", limit=8)
    assert spec.rollup_name() == "dst_port" and rollup.is_covered(rolled["dst_port"], START, END)
    assert rows_of(spec.run(raw, None, rolled)) == rows_of(spec.run(raw))
    assert QuerySpec("top_n", START, END, "bytes", "dst_port", filters=[{"field": "src_ip", "value": "10.0.0.0/8"}]).rollup_name() is None
    assert QuerySpec("top_n", START, END, "duration", "dst_port").rollup_name() is None
    assert not rollup.is_covered(rolled["dst_port"], START - timedelta(days=1), END)
    hole = F.col("minute") != F.date_trunc("minute", F.lit(START + timedelta(minutes=10)))
    assert not rollup.is_covered(rolled["dst_port"].filter(hole), START, END)
    assert QuerySpec("timeseries", START, END, resolution=60).rollup_name() == "series"
    assert QuerySpec("timeseries", START, END, resolution=5).rollup_name() is None
    for bad in (dict(kind="top_n", dimension="nope"), dict(kind="top_n", limit=101), dict(kind="timeseries", metric="bytes"), dict(kind="kpi", resolution=7), dict(kind="sql")):
        with pytest.raises(ValueError):
            QuerySpec(**{"start": START, "end": END, **bad})
    with pytest.raises(ValueError):
        TableRequest("traffic_bps", START - timedelta(days=8), END)


def test_dns_beside_numbers_in_a_protocol_list(spark):
    rows = spark.createDataFrame([(6, 1, 80), (17, 1, 53), (17, 1, 99), (1, 0, 0)], "proto int, src_port int, dst_port int")
    kept = lambda op: sorted(tuple(r) for r in filters.apply_filters(rows, [{"field": "protocol", "operator": op, "value": ["dns", "tcp"]}]).collect())
    assert kept("in") == [(6, 1, 80), (17, 1, 53)] and kept("not_in") == [(1, 0, 0), (17, 1, 99)]


def test_header_search_passes_over_cells_by_their_first_letter_and_runs_once(spark, tmp_path):
    from weirgauge.sources import text_flows

    first = {name[0] for name in text_flows.KNOWN_NAMES}
    assert all(letter.isalpha() for letter in first)
    lines = ["Src IP,\"octets\",x", " 'BYTES' ,1,2", "1.2.3.4,tcp,SYN+ACK,bytesx", "7,proto", "a,b,c", "prot,octet", "1,In-Bytes,3"]
    found = text_flows.split_lines(spark.createDataFrame([(v,) for v in lines], "value string")).select("value", "kind").collect()
    assert [r["kind"] for r in found] == ["header", "header", "csv", "header", "csv", "csv", "header"]
    spark.createDataFrame([("1.2.3.4,5.6.7.8,1,2,6,0,1,1,0,0,1783684800,5,9",)], "value string").write.text(str(tmp_path / "t"))
    plan = text_flows.parse_flow_lines(text_flows.read_lines(spark, str(tmp_path / "t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "src[-_ ]host" not in plan  # no line is a header, so none is searched a second time


@pytest.mark.parametrize("tasks, files, turn", [(7, 7, 3), (2, 3, 1)])
def test_text_of_a_stream_is_landed_by_the_tasks_that_read_it(spark, tasks, files, turn):
    from weirgauge.catalog import ingest

    lines = spark.range(0, 700, 1, tasks).selectExpr("concat('line ', id) AS value")
    folder, many = ingest.land_batches(lines, 3)
    assert many == turn and sum(name.endswith(".txt") for name in os.listdir(folder)) == files
    assert spark.read.text(folder).distinct().count() == 700


def test_fields_of_a_record_are_looked_up_outside_whole_stages(spark):
    rows = [('{"SRC-IP": "", "srcaddr": "10.0.0.1", "\'Protocol\'": "udp", "octets": "NULL", "in_bytes": 7, "pkts": null}',), ('[{"bytes": 3}, 5]',), ("[1, 2]",), ("{oops",)]
    lines = spark.createDataFrame(rows, "value string").withColumn("file", F.lit("f"))
    found = text_flows.parse_flow_lines(lines, headers=False)
    assert sorted(r[0] for r in found.select("record_status").collect()) == ["bad", "dropped", "ok", "ok"]
    out = text_flows.normalize_flows(found, "edge-x", "192.0.2.1")
    assert sorted(tuple(r) for r in out.select("src_ip", "proto", "bytes", "packets").collect()) == [("10.0.0.1", 17, 7, 0), ("::", 0, 3, 0)]
    # A whole stage's method with the names of all fields is too long to be compiled, and took several times as long.
    text = found.select("fields", "cells", "plain").withColumn("usable", F.col("cells"))
    plan = text.select(*[text_flows.pick(f).alias(f) for f in text_flows.ALIASES])._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "*(" in line and "array_position" in line]
    # One name, one lookup: the value is not looked up again to see whether it is blank.
    line = next(line for line in plan.splitlines() if "array_position" in line)
    assert line.count(", octets) as int)") == 1
