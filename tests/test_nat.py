import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirgauge.operators import nat_import as imp
from weirgauge.operators import nat_resolve as res
from weirgauge.operators import ports
from weirgauge.session import noting, staged

NETMAP = r"""# exported rules
/ip firewall nat add action=netmap chain=NAT_A protocol=tcp src-address=100.70.0.0/28 to-addresses=198.51.100.16/28 to-ports=2000-2999
/ip firewall nat add action=netmap chain=NAT_A protocol=udp src-address=100.70.0.0/28 to-addresses=198.51.100.16/28 to-ports=2000-2999
/ip firewall nat add action=netmap chain=NAT_A src-address=100.70.0.0/28 to-addresses=198.51.100.16/28
add chain="NAT_B" src-address=100.70.0.16/28 action=netmap \
    to-ports=3000-3999 to-addresses=198.51.100.16/28 protocol=tcp
add src-address=100.70.0.32/28 to-addresses=198.51.100.32/28 chain=NAT_C action=netmap to-ports=1-10 disabled=yes
"""


def lines(spark, text, name="f"):
    return spark.createDataFrame([(name, n, line) for n, line in enumerate(text.splitlines(), 1)], "file string, line_no bigint, raw_line string")


def mapped(df):
    return {(r["public_ip"], r["private_ip"], r["port_start"], r["port_end"]) for r in df.collect()}


def validated(spark, parser, text):
    source = lines(spark, text)
    rows = parser(source).withColumn("record_no", F.struct("line_number", "public_ip"))
    return imp.validate_import(rows, source)


def test_netmap_and_table_give_the_same_mappings(spark):
    table = ["IP Público    Range de Portas    IP Privado"]
    for low, first in ((2000, 0), (3000, 16)):
        table += [f"198.51.100.{16 + n}  {low} à {low + 999}  100.70.0.{first + n}" for n in range(16)]
    a, b = imp.parse_netmap(lines(spark, NETMAP)), imp.parse_expanded(lines(spark, "\n".join(table)))
    assert len(mapped(a)) == 32 and mapped(a) == mapped(b)
    for parser, text in ((imp.parse_netmap, NETMAP), (imp.parse_expanded, "\n".join(table))):
        assert {r[0] for r in validated(spark, parser, text).select("validation_status").distinct().collect()} == {"valid"}


def test_formats(spark):
    texts = {
        "netmap": NETMAP, "a10": "NAT Address: 198.51.100.1\n100.97.0.0 1024-2031", "kv": "private-address=10.0.0.1\npublic-address=1.2.3.4",
        "plain": "1.2.3.4 10.0.0.1 1000 2000 tcp", "table": "Public IP | Private IP | Port Range",
    }
    everything = None
    for name, text in texts.items():
        part = lines(spark, text, name)
        everything = part if everything is None else everything.unionByName(part)
    got = {r["file"]: r["format"] for r in imp.detect_format(everything).collect()}
    assert got == {"netmap": "mikrotik_netmap", "a10": "a10", "kv": "mikrotik", "plain": "generic", "table": "expanded_mapping_table"}


def test_a10_context_is_carried_down(spark):
    text = "Device: CG-1\nPool: OUT\nNAT Address: 198.51.100.9\n100.97.0.0   1024-2031\n100.97.0.1   2032 to 3039\nNAT Address: 198.51.100.10\n100.97.0.64  1024-2031 udp"
    got = [tuple(r) for r in imp.parse_a10(lines(spark, text)).select("public_ip", "private_ip", "port_start", "pool_name", "device_name").orderBy("line_number").collect()]
    assert got == [("198.51.100.9", "100.97.0.0", 1024, "OUT", "CG-1"), ("198.51.100.9", "100.97.0.1", 2032, "OUT", "CG-1"), ("198.51.100.10", "100.97.0.64", 1024, "OUT", "CG-1")]


def test_row_errors(spark):
    text = "1.2.3.4 10.0.0.1 5000 100\n1.2.3.999 10.0.0.2 1 70000\n1.2.3.5 10.0.0.3 10 20"
    got = {r["line_number"]: r["validation_error"] for r in validated(spark, imp.parse_generic, text).collect()}
    assert got == {1: "port_start_greater_than_port_end", 2: "port_out_of_range,public_ip_invalid", 3: ""}


def test_mapping_lines_in_all_shapes(spark):
    text = "\n".join(["router# cgnv6 fixed-nat inside ip-list IN nat ip-list P9, x", "NAT  Address :\t198.51.100.9", "Inside  User   Port Range", "", "10.0.0.1 1 - 2 TCP", "10.0.0.2\t3:4",
                      "10.0.0.3 5 TO 6", "10.0.0.4 7 8 any", "10.0.0.5 7 until 8", "2001:db8::1 9-10", "x 1 2", "10.0.0.6 1-2 3"])
    got = [tuple(r) for r in imp.parse_a10(lines(spark, text)).select("public_ip", "private_ip", "port_start", "port_end", "pool_name").orderBy("line_number").collect()]
    want = [("10.0.0.1", 1, 2), ("10.0.0.2", 3, 4), ("10.0.0.3", 5, 6), ("10.0.0.4", 7, 8), ("2001:db8::1", 9, 10)]
    assert got == [("198.51.100.9", *w, "P9") for w in want]
    text = "1.2.3.4 10.0.0.1 1000-2000 tcp\n1.2.3.4;10.0.0.2; 5 : 6\n1.2.3.4,10.0.0.3,7\nname 10.0.0.1 1 2\n2001:db8::9 10.0.0.4 8 9 ANY\n1.2.3.4 10.0.0.5 1 2 gre"
    got = [tuple(r) for r in imp.parse_generic(lines(spark, text)).select("public_ip", "private_ip", "port_start", "port_end", "protocol").orderBy("line_number").collect()]
    assert got == [("1.2.3.4", "10.0.0.1", 1000, 2000, "tcp"), ("1.2.3.4", "10.0.0.2", 5, 6, "any"), ("2001:db8::9", "10.0.0.4", 8, 9, "any")]
    text = "Public IP | Port Range | Private IP\n198.51.100.1|10..20|10.0.0.1\n198.51.100.1 21até30 10.0.0.2\n198.51.100.1 31 until 40 10.0.0.3\n198.51.100.1 41-50"
    got = [tuple(r) for r in imp.parse_expanded(lines(spark, text)).select("port_start", "port_end", F.size("prior_errors")).orderBy("line_number").collect()]
    assert got == [(10, 20, 0), (21, 30, 0), (None, None, 1), (41, 50, 1)]
    text = "private-address = 10.0.0.1\n 1x=3\npublic-address= 1.2.3.4\nport-start=5\nsubscriber-name=a = b\nport-end=6"
    got = [tuple(r) for r in imp.parse_key_value(lines(spark, text)).select("public_ip", "private_ip", "port_start", "port_end", "subscriber_name").collect()]
    assert got == [("1.2.3.4", "10.0.0.1", 5, 6, "a = b")]


def test_context_lines_are_not_ignored_lines(spark):
    text = "NAT Address: 198.51.100.9\nPool name : OUT\nHostname: x\nInside User Port Range\nPool address: 1\n10.0.0.1 1-2\nfree text"
    source = lines(spark, text)
    rows = imp.parse_a10(source).select("file", "line_number", "raw_line")
    assert sorted(r["line_no"] for r in imp.ignored_lines(source, rows).collect()) == [5, 7]


def test_long_commands(spark):
    comment = "x\\\" # '" * 25_000
    text = (
        f'add action = netmap comment="{comment}" chain=A src-address=100.70.0.0/31 to-addresses="198.51.100.0/31" to-ports=5 # {comment}\n'
        + "add action=netmap chain=B \\\n" + "comment=y \\\n" * 2_000 + "src-address=100.70.0.2/31 to-addresses=198.51.100.2/31 to-ports='7 - 9'\n"
    )
    got = {(r["private_ip"], r["port_start"], r["port_end"]) for r in imp.parse_netmap(lines(spark, text)).collect()}
    assert got == {("100.70.0.0", 5, 5), ("100.70.0.1", 5, 5), ("100.70.0.2", 7, 9), ("100.70.0.3", 7, 9)}


def overlaps(rows):
    """Plain pairwise check."""
    bad = set()
    for a in rows:
        for b in rows:
            meet = a["protocol"] == b["protocol"] or "any" in (a["protocol"], b["protocol"])
            if a["key"] == b["key"] and meet and a["port_start"] <= b["port_end"] and b["port_start"] <= a["port_end"] and a["who"] != b["who"]:
                bad |= {a["id"], b["id"]}
    return bad


@pytest.mark.parametrize("seed", range(4))
def test_conflicts_equal_a_pairwise_check(spark, seed):
    random.seed(seed)
    rows = []
    for n in range(120):
        start = random.choice([random.randint(1, 400), random.randint(1, 65000), 64, 63, 127])
        rows.append({"id": n, "key": random.choice("abc"), "protocol": random.choice(["any", "tcp", "udp", "tcp"]), "port_start": start,
                     "port_end": min(65535, start + random.choice([0, 1, 63, 64, 200])), "who": random.choice("xyz")})
    df = spark.createDataFrame(rows, "id int, key string, protocol string, port_start int, port_end int, who string")
    got = {r[0] for r in ports.conflicting_ids(df, "key", ["who"], "id").collect()}
    assert got == overlaps(rows)


def test_masks(spark):
    got = [r[0] for r in ports.with_bins(spark.createDataFrame([(60, 130)], "port_start int, port_end int")).orderBy("port_bin").select("port_mask").collect()]
    want = [sum(1 << b for b in range(60, 64)), (1 << 64) - 1, 0b111]
    assert [g % (1 << 64) for g in got] == want


def tables(spark):
    mapping = "batch_id bigint, connector_id bigint, public_ip string, private_ip string, protocol string, port_start int, port_end int, subscriber_id string, subscriber_name string, valid_from timestamp, valid_until timestamp, active boolean, confidence double"
    maps = spark.createDataFrame(
        [(1, None, "203.0.113.10", "100.64.0.1", "any", 1024, 2047, None, None, None, None, True, 1.0), (2, None, "203.0.113.10", "100.64.0.2", "udp", 2000, 2047, None, None, None, None, True, 1.0),
         (3, 5, "203.0.113.11", "100.64.0.3", "any", 1, 100, None, None, None, None, True, 1.0), (3, 5, "203.0.113.11", "100.64.0.4", "any", 1, 100, None, None, None, None, True, 1.0),
         (4, None, "203.0.113.10", "100.64.0.9", "any", 1500, 1600, None, None, None, None, False, 1.0)],
        mapping,
    )
    batches = spark.createDataFrame(
        [(1, "active", None), (2, "active", None), (3, "active", 5), (4, "approved", None)], "id bigint, status string, connector_id bigint"
    ).selectExpr("*", "timestamp'2026-01-01' AS approved_at", "cast(null AS timestamp) AS activated_at", "cast(null AS timestamp) AS deactivated_at")
    return maps, batches


def test_resolution_ranks_and_reports_ambiguity(spark):
    maps, batches = tables(spark)
    asked = spark.createDataFrame(
        [("203.0.113.10", 1100, "udp"), ("203.0.113.10", 2040, "udp"), ("203.0.113.10", 2040, "tcp"), ("203.0.113.10", 2500, "udp"), ("203.0.113.11", 50, "tcp")],
        "public_ip string, public_port int, protocol_observed string",
    ).selectExpr("*", "timestamp'2026-07-10 12:00:00' AS lookup_time", "cast(null AS bigint) AS connector")
    got = {(r["public_ip"], r["public_port"], r["protocol_observed"]): (r["matched"], r["ambiguous"], r["private_ip"]) for r in res.resolve_subscriber(asked, maps, batches).collect()}
    assert got[("203.0.113.10", 1100, "udp")] == (True, False, "100.64.0.1")
    assert got[("203.0.113.10", 2040, "udp")] == (True, False, "100.64.0.2")  # exact protocol first
    assert got[("203.0.113.10", 2040, "tcp")] == (True, False, "100.64.0.1")
    assert got[("203.0.113.10", 2500, "udp")] == (False, False, None)
    assert got[("203.0.113.11", 50, "tcp")] == (True, True, None)


def test_activation_supersedes_only_with_consent(spark):
    maps, batches = tables(spark)
    now = F.to_timestamp(F.lit("2026-07-10 12:00:00"))
    assert [r[0] for r in res.conflicting_batches(maps, 4).collect()] == [1]
    with pytest.raises(ValueError, match="requires_replace"):
        res.activate(maps, batches, 4, now)
    with pytest.raises(ValueError, match="not_found"):
        res.activate(maps, batches, 99, now)
    new_maps, new_batches = res.activate(maps, batches, 4, now, replace_existing=True)
    assert {r["id"]: r["status"] for r in new_batches.collect()} == {1: "superseded", 2: "active", 3: "active", 4: "active"}
    assert {(r["batch_id"], r["active"]) for r in new_maps.collect()} == {(1, False), (2, True), (3, True), (4, True)}
    with pytest.raises(ValueError, match="cannot_be_rejected"):
        res.reject(batches, 1)


def ranked_answer(lookup, live):
    """(matched, ambiguous, private_ip, match_count) of one lookup by trying every mapping."""
    port, proto, at, connector = lookup
    hits = [m for m in live if m["lo"] <= port <= m["hi"] and m["proto"] in (proto, "any") and (m["since"] is None or m["since"] <= at) and (m["until"] is None or m["until"] >= at)]
    if not hits:
        return False, False, None, 0
    rank = lambda m: (m["proto"] == proto, m["conn"] is not None and m["conn"] == connector, m["batch"], m["conf"])
    best = [m for m in hits if rank(m) == max(map(rank, hits))]
    who = {(m["ip"], m["lo"], m["hi"]) for m in best}
    return True, len(who) > 1, best[0]["ip"] if len(who) == 1 else None, len(hits)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cells_answer_like_trying_every_mapping(spark, seed):
    draw = random.Random(seed)
    t0 = datetime(2026, 7, 10, 12)
    times = [None, *[t0 + timedelta(seconds=s) for s in (0, 10, 20, 30)]]
    batches = {b: (draw.choice([None, 1, 2]), *sorted(draw.sample(times[1:], 2))) if draw.random() < 0.6 else (None, None, None) for b in range(1, 6)}
    live = []
    for n in range(60):
        b = draw.randrange(1, 6)
        lo = draw.randrange(0, 400)
        connector, since, until = batches[b]
        live.append({"batch": b, "conn": connector, "ip": f"10.0.0.{n}", "proto": draw.choice(["any", "tcp", "udp"]), "lo": lo, "hi": min(65535, lo + draw.randrange(0, 200)), "since": since, "until": until, "conf": draw.choice([0.5, 1.0])})
    maps = spark.createDataFrame(
        [(m["batch"], m["conn"], "203.0.113.1", m["ip"], m["proto"], m["lo"], m["hi"], None, "n", m["since"], m["until"], True, m["conf"]) for m in live],
        "batch_id bigint, connector_id bigint, public_ip string, private_ip string, protocol string, port_start int, port_end int, subscriber_id string, subscriber_name string, valid_from timestamp, valid_until timestamp, active boolean, confidence double",
    )
    told = spark.createDataFrame([(b, "active") for b in batches], "id bigint, status string").selectExpr("*", "timestamp'2026-01-01' AS approved_at", "cast(null AS timestamp) AS activated_at")
    asked = sorted({(draw.choice([draw.randrange(0, 620), 64, 63, 65535]), draw.choice(["tcp", "udp", "icmp"]), t0 + timedelta(seconds=draw.randrange(-2, 34), microseconds=draw.choice([0, 1, 999_999])), draw.choice([None, 1, 2, 3])) for _ in range(400)}, key=str)
    rows = [("203.0.113.1", *a) for a in asked] + [("203.0.113.2", 80, "tcp", t0, None), ("203.0.113.1", -1, "tcp", t0, None), ("203.0.113.1", 70_000, "tcp", t0, None)]
    lookups = spark.createDataFrame(rows, "public_ip string, public_port int, protocol_observed string, lookup_time timestamp, connector bigint")
    got = {(r["public_ip"], r["public_port"], r["protocol_observed"], r["lookup_time"], r["connector"]): (r["matched"], r["ambiguous"], r["private_ip"], r["match_count"]) for r in res.resolve_subscriber(lookups, maps, told).collect()}
    assert got.pop(rows[-3]) == got.pop(rows[-2]) == got.pop(rows[-1]) == (False, False, None, 0)
    for a in asked:
        assert got[("203.0.113.1", *a)] == ranked_answer(a, live), a


def test_deactivate_and_reject(spark):
    maps, batches = tables(spark)
    now = F.to_timestamp(F.lit("2026-07-10 12:00:00"))
    off_maps, off_batches = res.deactivate(maps, batches, 1, now)
    assert {r["id"]: r["status"] for r in off_batches.collect()}[1] == "approved"
    assert not [r for r in off_maps.collect() if r["batch_id"] == 1 and r["active"]]
    with pytest.raises(ValueError, match="batch_not_active"):
        res.deactivate(maps, batches, 4, now)
    assert {r["id"]: r["status"] for r in res.reject(batches, 4).collect()}[4] == "rejected"


def test_flows_meet_subscribers_in_one_scan(spark):
    from weirgauge.catalog import nat as catalog
    from weirgauge.sources.lineitem_flows import flows

    path = "/root/testdata/sf0.001"
    cells = res.subscriber_cells(catalog.mappings(spark, path), catalog.batches(spark, path))
    rows = res.with_subscriber(flows(spark, path), cells, catalog.looked_up())
    plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("/lineitem.parquet]") == 1
    assert rows.count() == flows(spark, path).count()


def test_checks_of_an_import_broadcast_no_side_that_grows_with_its_records(spark):
    text = "198.51.100.1,100.80.0.1,2000-2999\n198.51.100.1,100.80.0.2,2500-3499\n198.51.100.2,100.80.0.3,2000-2999"
    source = lines(spark, text)
    rows = imp.parse_generic(source).withColumn("record_no", F.col("line_number"))
    checked = staged(imp.check_rows(rows, source))
    unique = staged(imp.mark_duplicates(checked))
    marked = imp.mark_overlaps(unique)
    assert [r["validation_status"] for r in marked.orderBy("record_no").collect()] == ["overlap", "overlap", "valid"]
    valid = unique.withColumns({"__rid": F.struct("file", "record_no"), "__key": F.struct("file", "public_ip")})
    for df in (imp.mark_duplicates(checked), ports.conflicting_ids(valid, "__key", ["private_ip"], "__rid"), marked):
        joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
        assert joins and all("strategy=merge" in line for line in joins)


def test_mappings_of_one_kind_are_one_row_before_they_meet_cells(spark):
    kind = "batch_id bigint, connector_id bigint, public_ip string, private_ip string, protocol string, port_start int, port_end int, subscriber_id string, subscriber_name string, valid_from timestamp, valid_until timestamp, active boolean, confidence double"
    rows = [(1, None, "203.0.113.1", f"10.0.0.{n}", ("any", "tcp")[n % 2], 100, 199, None, None, None, None, True, 0.5) for n in range(40)]
    told = spark.createDataFrame([(1, "active")], "id bigint, status string").selectExpr("*", "timestamp'2026-01-01' AS approved_at", "cast(null AS timestamp) AS activated_at")
    with noting() as made:
        cells = res.subscriber_cells(spark.createDataFrame(rows, kind), told)
    assert spark.read.parquet(made[0]).count() == 2  # before: 40, and pairs of each with every cell
    found = {r["proto"]: (r["ambiguous"], r["match_count"]) for r in cells.answers.select(F.explode("cells").alias("c")).select("c.*").collect()}
    assert found == {"tcp": (True, 40), None: (True, 20)}
