"""Prefix joins: exact against plain arithmetic, and one scan of the facts."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from weirgauge.catalog import QUERIES
from weirgauge.functions import ip
from weirgauge.operators import prefixes as pfx
from weirgauge.session import noting

DATA = "/root/testdata/sf0.001"


def number(address):
    a = ipaddress.ip_address(address)
    return int(a) + (0xFFFF << 32 if a.version == 4 else 0)


def blocks(draw, many):
    out = ["0.0.0.0/0", "::/0", "10.0.0.0/8", "10.0.0.0/9", "10.0.0.1/32", "2001:db8::/32", "2001:db8::/33", "2001:db8::1/128", "::/1"]
    for _ in range(many):
        if draw.random() < 0.6:
            base = ipaddress.ip_address((10 << 24) + draw.randrange(1 << draw.choice([4, 12, 24])))
            out.append(f"{base}/{draw.randrange(6, 33)}")
        else:
            base = ipaddress.ip_address((0x20010DB8 << 96) + draw.randrange(1 << draw.choice([8, 64, 96])))
            out.append(f"{base}/{draw.randrange(20, 129)}")
    return out


def addresses(draw, many):
    out = ["10.0.0.1", "10.0.0.2", "9.255.255.255", "255.255.255.255", "2001:db8::1", "2001:db8:8000::", "::", "ffff::1"]
    for _ in range(many):
        out.append(str(ipaddress.ip_address((10 << 24) + draw.randrange(1 << draw.choice([4, 12, 24])))) if draw.random() < 0.5 else str(ipaddress.ip_address((0x20010DB8 << 96) + draw.randrange(1 << draw.choice([8, 64, 96])))))
    return out


def holds(block, address):
    net = ipaddress.ip_network(block, strict=False)
    low, bits = number(net.network_address), net.prefixlen + (96 if net.version == 4 else 0)
    return low >> (128 - bits) == number(address) >> (128 - bits), bits


@pytest.mark.parametrize(("seed", "dense"), [(1, 60), (2, 250), (3, 0)])
def test_longest_and_all_prefixes(spark, seed, dense):
    draw = random.Random(seed)
    listed = list(enumerate(blocks(draw, dense)[(9 if not dense else 0) :][: dense + 9] if dense else ["10.0.0.0/30"]))
    asked = addresses(draw, 150)
    table = pfx.prefix_table(spark.createDataFrame(listed, "id int, prefix string"))
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)] + [(10_000, None)], "n int, a string").withColumn("key", ip.ip_key(F.col("a")))
    got = {r["n"]: r["own"] for r in pfx.longest_prefix(df, "key", table, {"id": "own"}).collect()}
    pairs = {(r["n"], r["id"]) for r in pfx.match_prefixes(df, "key", table).collect()}
    inside = {r["n"] for r in pfx.keep_matching(df, "key", table).collect()}
    outside = {r["n"] for r in pfx.keep_matching(df, "key", table, anti=True).collect()}
    assert got.pop(10_000) is None and 10_000 in outside
    for n, a in enumerate(asked):
        hits = [(holds(b, a)[1], i) for i, b in listed if holds(b, a)[0]]
        assert got[n] == (max(hits)[1] if hits else None), a
        assert {i for m, i in pairs if m == n} == {i for _, i in hits}
        assert (n in inside) == bool(hits) and (n in outside) == (not hits)


def test_no_prefixes_at_all(spark):
    table = pfx.prefix_table(spark.createDataFrame([(1, "no address")], "id int, prefix string"))
    df = spark.createDataFrame([("10.0.0.1",)], "a string").withColumn("key", ip.ip_key(F.col("a")))
    assert [r["own"] for r in pfx.longest_prefix(df, "key", table, {"id": "own"}).collect()] == [None]
    assert pfx.match_prefixes(df, "key", table).count() == 0
    assert pfx.keep_matching(df, "key", table, anti=True).count() == 1


def test_whitelist_takes_the_lowest_entry_that_applies(spark):
    listed = [(3, "c", "10.0.0.0/8", True), (1, "a", "10.1.0.0/16", False), (2, "b", "10.1.0.0/16", False), (9, "z", "0.0.0.0/0", True)]
    table = pfx.prefix_table(spark.createDataFrame(listed, "whitelist_id int, name string, prefix string, is_global boolean"))
    rows = [("10.1.2.3", None, None, None), ("10.1.2.3", True, [2], False), ("10.1.2.3", False, [1, 2], False), ("10.1.2.3", True, [1], True), ("8.8.8.8", None, None, None), ("::1", None, None, None), ("8.8.8.8", False, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, a string, use_global_whitelist boolean, extra_whitelist_ids array<int>, bypass_whitelist boolean")
    got = {r["n"]: r["hit"] for r in pfx.whitelist_hits(df.withColumn("key", ip.ip_key(F.col("a"))), "key", table, "hit").collect()}
    assert got == {0: "c", 1: "b", 2: "a", 3: None, 4: "z", 5: None, 6: None}


@pytest.mark.parametrize("name", ["asn_resolution", "asn_unresolved_queue", "zone_traffic", "zone_flows_by_prefix_table", "whitelist_hits", "prefix_traffic_1m"])
def test_facts_are_read_once(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("/lineitem.parquet]") == 1


def test_rows_of_one_block_are_one_row_before_they_are_spread(spark):
    rows = [("10.0.0.0/26", f"c{n:02d}") for n in range(30)] + [("10.0.0.0/27", "low"), ("10.0.0.0/27", None)]
    table = pfx.prefix_table(spark.createDataFrame(rows, "prefix string, name string"))
    asked = spark.createDataFrame([("10.0.0.5",), ("10.0.0.40",), ("10.0.0.70",)], "ip string").withColumn("key", ip.ip_key(F.col("ip")))
    with noting() as made:
        named = pfx.longest_prefix(asked, "key", table, {"name": "name"})
    assert {r["ip"]: r["name"] for r in named.collect()} == {"10.0.0.5": "low", "10.0.0.40": "c29", "10.0.0.70": None}
    assert spark.read.parquet(made[0]).count() == 64
    spread = []
    real = pfx.pieces
    pfx.pieces = lambda df: spread.append(df.count()) or real(df)
    try:
        pfx.longest_prefix(asked, "key", table, {"name": "name"})
    finally:
        pfx.pieces = real
    assert spread == [2]  # before: 32
