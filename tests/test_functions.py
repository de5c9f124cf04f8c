import ipaddress
import random

from pyspark.sql import functions as F

from weirgauge.functions import ip, scalars


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


def key_of(text):
    try:
        address = ipaddress.ip_address(text.strip())
    except ValueError:
        return None
    number = int(address) + (0xFFFF << 32 if address.version == 4 else 0)
    return f"{number:032x}"


def sample_addresses():
    random.seed(7)
    values = ["1.2.3.4", " 10.0.0.1 ", "01.2.3.4", "256.1.1.1", "1.2.3", "", "x", "::", "::1", "1::", ":::", "1::2::3", "::ffff:9.8.7.6", "FE80::A"]
    values += [str(ipaddress.ip_address(random.getrandbits(32))) for _ in range(40)]
    for _ in range(120):
        groups = [random.choice([0, 0, 0, random.getrandbits(16)]) for _ in range(8)]
        address = ipaddress.IPv6Address(sum(g << (16 * (7 - n)) for n, g in enumerate(groups)))
        values += [str(address), address.exploded, ":".join(f"{g:X}" for g in groups)]
    return values


def test_keys_follow_address_order_and_match_python(spark):
    values = sample_addresses()
    assert column(spark, values, ip.ip_key) == [key_of(v) for v in values]


def test_canonical_text_matches_python(spark):
    values = [v for v in sample_addresses() if "ffff" not in v.lower()]

    def expected(v):
        try:
            return str(ipaddress.ip_address(v.strip()))
        except ValueError:
            return "::"

    assert column(spark, values, ip.safe_ip) == [expected(v) for v in values]


def test_blocks_match_python(spark):
    random.seed(3)
    cidrs = [f"{ipaddress.ip_address(random.getrandbits(32))}/{random.randint(0, 32)}" for _ in range(40)]
    cidrs += [f"{ipaddress.IPv6Address(random.getrandbits(128))}/{random.randint(0, 128)}" for _ in range(40)]
    cidrs = [c for c in cidrs if not c.startswith("::ffff")]
    assert column(spark, cidrs, ip.norm_cidr) == [str(ipaddress.ip_network(c, strict=False)) for c in cidrs]
    low = column(spark, cidrs, lambda c: ip.network_key(ip.ip_key(F.substring_index(c, "/", 1)), ip.cidr_length(c)))
    high = column(spark, cidrs, lambda c: ip.network_last_key(ip.ip_key(F.substring_index(c, "/", 1)), ip.cidr_length(c)))
    assert list(zip(low, high, strict=True)) == [ip.cidr_literal(c)[:2] for c in cidrs]
    for length in (0, 1, 7, 96, 101, 120, 127, 128):
        keys = [key_of("203.0.113.77"), key_of("2001:db8::abcd:1")]
        a = column(spark, keys, lambda k, n=length: ip.network_key_at(k, n))
        b = column(spark, keys, lambda k, n=length: ip.network_key(k, F.lit(n)))
        assert a == b


def test_integers(spark):
    values = ["0x1F", "12", " 12 ", "3.99", "-4", "abc", "", None, "nan", "1e3", "99999999999999999999", "9007199254740993"]
    got = column(spark, values, lambda c: scalars.safe_int(c, 5, 0, 10_000_000_000_000_000))
    assert got == [31, 12, 12, 3, 0, 5, 5, 5, 5, 1000, 5, 9007199254740993]


def test_flags_and_protocols(spark):
    assert column(spark, ["0x12", "18", "SYN+ACK", "syn|ack", "fin, psh", "", None, "bogus", "70000"], scalars.flags_num) == [18, 18, 18, 18, 9, 0, 0, 0, 65535]
    assert column(spark, [0, 2, 18, 255], scalars.flags_name, "int") == ["NONE", "SYN", "SYN+ACK", "FIN+SYN+RST+PSH+ACK+URG+ECE+CWR"]
    assert column(spark, ["tcp", "UDP", "17", "icmpv6", "999", "x", None], scalars.proto_num) == [6, 17, 17, 58, 255, 0, 0]
    assert column(spark, [6, 17, 99], scalars.proto_name, "int") == ["TCP", "UDP", "PROTO-99"]


def test_times(spark):
    values = ["1700000000", "1700000000500", "2023-11-14T22:13:20Z", "2023-11-14 22:13:20", "2023-11-14T19:13:20-03:00", "soon", None]
    got = column(spark, values, lambda c: F.date_format(scalars.parse_ts(c), "yyyy-MM-dd HH:mm:ss.SSS"))
    same = "2023-11-14 22:13:20.000"
    assert got == [same, "2023-11-14 22:13:20.500", same, same, same, None, None]


def test_rate_needs_a_real_duration(spark):
    rows = spark.createDataFrame([(0,), (500,), (2000,)], "ms bigint").select(
        scalars.duration_seconds(F.col("ms"), F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp")).alias("s")
    )
    got = rows.select(scalars.flow_rate(F.lit(9_000_000 * 8), F.col("s")), scalars.flow_rate(F.lit(150_000), F.col("s")), scalars.rate_status(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [
        (None, None, scalars.RATE_UNAVAILABLE), (None, None, scalars.RATE_UNAVAILABLE), (36_000_000.0, 75_000.0, scalars.RATE_ESTIMATED),
    ]


def test_ports(spark):
    rows = spark.createDataFrame([(53,), (123,), (80,)], "p int")
    for text, expected in {"any": [1, 1, 1], "53": [1, 0, 0], "53, 123": [1, 1, 0], "!53": [0, 1, 1], "!53,123": [0, 0, 1]}.items():
        a = [int(r[0]) for r in rows.select(scalars.port_matches(text, F.col("p"))).collect()]
        b = [int(r[0]) for r in rows.select(scalars.port_matches_column(F.lit(text), F.col("p"))).collect()]
        assert a == b == expected


def test_readable_text(spark):
    assert column(spark, [7000.0, 15000.0, 2_500_000.0, 12.0], lambda c: scalars.humanize(c, "pps"), "double") == ["7 Kpps", "15 Kpps", "2.5 Mpps", "12 pps"]
    assert column(spark, ["2h", "30m", "1d", "45s", "soon"], scalars.ttl_seconds) == [7200, 1800, 86400, 45, None]


def test_redaction(spark):
    text = "10.1.2.3 to 8.8.8.8; client=ACME; description: core link"
    assert column(spark, [text], lambda c: scalars.redact(c, "mask_ips"))[0].startswith("10.1.2.x to 8.8.8.x")
    assert "[internal-ip] to 8.8.8.8" in column(spark, [text], lambda c: scalars.redact(c, "remove_internal_ips"))[0]
    assert "ACME" not in column(spark, [text], lambda c: scalars.redact(c, "aggregates_only"))[0]
