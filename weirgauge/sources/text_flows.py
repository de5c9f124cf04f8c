"""Collector text (CSV or JSON lines) to normalised flow rows.

A line becomes a pair of arrays, field names and cells; from there CSV and JSON share one
path of Column expressions.  Nothing is inferred and nothing runs in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.functions import ip, scalars
from weirgauge.operators.ordered import ordered_scan
from weirgauge.session import staged

# Field order of header-less CSV, and the names accepted for each field.
DEFAULT_FIELDS = [
    "src_host", "dst_host", "src_port", "dst_port", "proto", "tcpflags", "in_iface", "out_iface", "src_as", "dst_as",
    "timestamp", "packets", "bytes", "flows",
]
ALIASES = {
    "src_host": ["src_host", "src_ip", "ip_src", "srcaddr", "ipv4_src_addr", "ipv6_src_addr", "srcaddr6"],
    "dst_host": ["dst_host", "dst_ip", "ip_dst", "dstaddr", "ipv4_dst_addr", "ipv6_dst_addr", "dstaddr6"],
    "src_port": ["src_port", "l4_src_port", "srcport", "source_port"],
    "dst_port": ["dst_port", "l4_dst_port", "dstport", "destination_port"],
    "proto": ["proto", "protocol", "ip_proto", "protocol_identifier"],
    "tcpflags": ["tcpflags", "tcp_flags", "tcpflags_sum", "tcp_flags_sum"],
    "in_iface": ["in_iface", "input_if", "input_snmp", "ingress_if", "ifindex_in"],
    "out_iface": ["out_iface", "output_if", "output_snmp", "egress_if", "ifindex_out"],
    "packets": ["packets", "pkt", "pkts", "packet_count", "in_packets"],
    "bytes": ["bytes", "octets", "in_bytes", "byte_count"],
    "flows": ["flows", "flow_count", "records"],
    "timestamp": ["timestamp", "timestamp_start", "stamp_inserted", "stamp_updated", "first_switched", "flow_start"],
    "flow_start": ["flow_start", "timestamp_start", "flow_begin", "start_time"],
    "flow_end": ["flow_end", "timestamp_end", "flow_finish", "end_time"],
    "duration_ms": ["duration_ms", "flow_duration_ms", "duration_msec", "duration_milliseconds"],
    "sample_rate": ["sample_rate", "sampling_rate", "samplinginterval"],
    "src_as": ["src_as", "src_asn", "src_as_number", "src_asnum", "peer_src_as"],
    "dst_as": ["dst_as", "dst_asn", "dst_as_number", "dst_asnum", "peer_dst_as"],
    "src_as_name": ["src_as_name", "src_as_org", "src_as_description"],
    "dst_as_name": ["dst_as_name", "dst_as_org", "dst_as_description"],
}
OPTIONAL_TAIL = ["flows", "flow_count", "records"]
KNOWN_NAMES = sorted({alias for listed in ALIASES.values() for alias in listed})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(file, block, seq, value)``.

    ``block`` is the byte offset at which the reading task started and ``seq`` rises inside
    it, so the two order the lines of a file although it is read by many tasks.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``(file, line_no, raw_line)`` with 1-based numbers over the whole file."""
    counted = ordered_scan(lines, ["file"], F.col("block"), ["block", "seq"], {"__i": ("index", None)})
    return counted.select("file", (F.col("__i") + 1).alias("line_no"), F.col("value").alias("raw_line"))


# --- splitting ------------------------------------------------------------------


def normal_name(name: Column) -> Column:
    """Field name trimmed, without quotes, lowercase, with ``-`` and space as ``_``."""
    quoted = name.contains('"') | name.contains("'")
    bare = F.when(quoted, F.regexp_replace(F.trim(name), r"""^["']+|["']+$""", "")).otherwise(F.trim(name))
    return F.translate(F.lower(bare), "- ", "__")


def _cells(line: Column, delimiter: str) -> Column:
    """Cells of a CSV line; only lines with quotes take the slower quoted path."""
    sep = "\\" + delimiter if delimiter in r"|.*+?^$()[]{}\\" else delimiter
    quoted = F.regexp_extract_all(line, F.lit(rf'((?<=^|{sep})(?:"(?:[^"]++|"")*+"|[^{sep}]*+))(?={sep}|$)'), 1)
    bare = F.transform(quoted, lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'))
    return F.when(line.contains('"'), bare).otherwise(F.split(line, sep, -1))


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _header_pattern(delimiter: str) -> str:
    """Matches a line in which some cell is a known field name: one scan, no splitting.

    A look at the first letter settles nearly all cells before any name is tried.
    """
    sep = re.escape(delimiter)
    first = "".join(sorted({name[0] for name in KNOWN_NAMES}))
    names = "|".join(name.replace("_", "[-_ ]") for name in KNOWN_NAMES)
    return rf"""(?i)(?:^|{sep})[\s"']*(?=[{first}])(?:{names})[\s"']*(?:{sep}|$)"""


def split_lines(lines: DataFrame, output_format: str = "auto", delimiter: str = ",") -> DataFrame:
    """Add ``kind`` (blank, json, header, csv), the same without the search for headers as ``form``, and the ``cells`` of CSV lines."""
    text = F.trim("value")
    json = F.lit(True) if output_format == "json" else text.rlike(r"^[{\[]")
    staged = lines.withColumn("value", text).withColumn(
        "form", F.when((text == "") | text.startswith("!"), "blank").when(json, "json").otherwise("csv")
    )
    header = (F.col("form") == "csv") & F.col("value").rlike(_header_pattern(delimiter))
    marked = staged.withColumn("kind", F.when(header, "header").otherwise(F.col("form")))
    return marked.withColumn("cells", F.when(F.col("form") == "csv", _cells(F.col("value"), delimiter)))


def carry_headers(split: DataFrame) -> DataFrame:
    """Add ``names``: the header in force on each line, null before the first one.

    One pass that looks at header lines only gives a small stored table with a row per file
    that has any.  Without such files nothing more is done; files that keep one header are
    settled by a join; only files whose header changes are ordered.
    """
    at = F.struct("block", "seq")
    named = F.transform("cells", normal_name)
    headers = staged(
        split.filter("kind = 'header'").groupBy(F.col("file").alias("__file"))
        .agg(F.min(at).alias("__from"), F.min(named).alias("__low"), F.max(named).alias("__high"))
    )
    if headers.isEmpty():  # no line is one, so none is searched a second time
        return split.withColumns({"kind": F.col("form"), "names": F.lit(None).cast("array<string>")})
    extra = ["__file", "__from", "__low", "__high"]
    if headers.filter("__low != __high").isEmpty():
        joined = split.join(headers, F.col("file") == F.col("__file"), "left")
        return joined.withColumn("names", F.when(at > F.col("__from"), F.col("__low"))).drop(*extra)
    changing = headers.filter("__low != __high").select("__file")
    apart = F.col("file") == F.col("__file")
    steady = split.join(changing, apart, "left_anti").join(headers, apart, "left")
    simple = steady.withColumn("names", F.when(at > F.col("__from"), F.col("__low"))).drop(*extra)
    scanned = ordered_scan(
        split.join(changing, apart, "left_semi"), ["file"], F.col("block"), ["block", "seq"],
        {"names": ("last", F.when(F.col("kind") == "header", named))},
    )
    return simple.unionByName(scanned)


def records(split: DataFrame, fallback: list[str] | None = None) -> DataFrame:
    """One row per record with ``fields`` and ``cells``; unusable lines keep ``record_status`` bad.

    A CSV row may be short only by the flow count.  JSON lines hold an object or an array
    whose objects count.
    """
    fallback = fallback or DEFAULT_FIELDS
    names = F.col("names") if "names" in split.columns else F.lit(None).cast("array<string>")
    fields = F.coalesce(names, _names(fallback))
    missing = F.slice(fields, F.size("cells") + 1, F.greatest(F.size(fields) - F.size("cells"), F.lit(0)))
    short_ok = F.size(F.array_except(missing, _names(OPTIONAL_TAIL))) == 0
    items = F.from_json(
        F.when(F.col("value").startswith("{"), F.concat(F.lit("["), F.col("value"), F.lit("]"))).otherwise(F.col("value")),
        "array<string>",
    )
    objects = F.transform(
        F.filter(items, lambda x: F.trim(x).startswith("{")), lambda x: F.from_json(x, "map<string,string>")
    )
    from_json = F.transform(
        F.filter(objects, lambda m: m.isNotNull()),
        lambda m: F.struct(F.transform(F.map_keys(m), normal_name).alias("fields"), F.map_values(m).alias("cells"), F.lit(False).alias("plain")),
    )
    empty = F.array().cast("array<struct<fields:array<string>,cells:array<string>,plain:boolean>>")
    from_csv = F.when(short_ok, F.array(F.struct(fields.alias("fields"), F.col("cells").alias("cells"), names.isNull().alias("plain")))).otherwise(empty)
    found = F.when(F.col("kind") == "json", F.coalesce(from_json, empty)).when(F.col("kind") == "csv", from_csv).otherwise(empty)
    # Told of lines without records alone, so that JSON with some is not parsed a second time for it.
    status = (
        F.when(F.col("kind") == "blank", "skipped").when(F.col("kind") == "header", "header")
        .when((F.col("kind") == "json") & (F.size("__found") == 0) & items.isNull(), "bad").otherwise("dropped")
    )
    marked = split.withColumn("__found", found).withColumn("__else", status)
    # The status hangs on the exploded record, so that a filter on it is not pushed down to
    # where the line would be split a second time.
    return marked.select("file", "value", "__else", F.explode_outer("__found").alias("r")).select(
        "file", "value", F.when(F.col("r").isNotNull(), "ok").otherwise(F.col("__else")).alias("record_status"),
        "r.fields", "r.cells", "r.plain",
    )


# --- normalising ----------------------------------------------------------------


def pick(field: str, fallback: list[str] | None = None) -> Column:
    """First usable value among the names of a field.

    Rows in the default layout read a fixed position; others look the name up.  ``usable``
    cells hold null where nothing is given, so a name is looked up once and the first found ends it.
    """
    fallback = fallback or DEFAULT_FIELDS
    fixed = [F.get("usable", F.lit(fallback.index(a))) for a in ALIASES[field] if a in fallback]
    direct = F.coalesce(*fixed) if fixed else F.lit(None).cast("string")
    # A missing name has position 0, hence index -1, which ``get`` reads as null.
    named = [F.get("usable", F.array_position("fields", a).cast("int") - 1) for a in ALIASES[field]]
    # A lambda keeps the lookups of all fields out of the one method of a whole stage, which would
    # be too long for the JVM to compile; they are then compiled in pieces.
    return F.when(scalars.bind(F.col("plain"), lambda p: p), direct).otherwise(F.coalesce(*named))


def normalize_flows(
    found: DataFrame, sensor: str, exporter_ip: str, sample_rate: int = 1, now: Column | None = None, fallback: list[str] | None = None,
    name_length: int | None = None,
) -> DataFrame:
    """Records to the flow layout with defaults, clamps and UTC timestamps.

    Names of autonomous systems stay whole unless ``name_length`` says where to cut them.
    """
    now = now if now is not None else F.current_timestamp()

    def get(field: str) -> Column:
        return pick(field, fallback)

    def name(field: str) -> Column:
        given = F.coalesce(F.col(field), F.lit(""))
        return (given if name_length is None else F.substring(given, 1, name_length)).alias(field)

    ok = found.filter("fields IS NOT NULL").withColumn("usable", F.transform("cells", scalars.blank_to_null))
    text = ok.select("file", *[get(f).alias(f) for f in ALIASES])
    start, end = scalars.parse_ts(F.col("flow_start")), scalars.parse_ts(F.col("flow_end"))
    # A present but unreadable optional time counts as now, like the record's own time.
    start = F.when(F.col("flow_start").isNotNull(), F.coalesce(start, now))
    end = F.when(F.col("flow_end").isNotNull(), F.coalesce(end, now))
    rate = F.lit(int(sample_rate))
    flow_time = scalars.parse_ts(F.col("timestamp"), now)
    out = text.select(
        flow_time.alias("flow_time"),
        now.alias("received_at"),
        F.lit(sensor).alias("sensor"),
        ip.safe_ip(F.lit(exporter_ip)).alias("exporter_ip"),
        ip.safe_ip(F.col("src_host")).alias("src_ip"),
        ip.safe_ip(F.col("dst_host")).alias("dst_ip"),
        scalars.safe_int(F.col("src_port"), 0, 0, 65535).cast("int").alias("src_port"),
        scalars.safe_int(F.col("dst_port"), 0, 0, 65535).cast("int").alias("dst_port"),
        scalars.proto_num(F.col("proto")).alias("proto"),
        scalars.flags_num(F.col("tcpflags")).alias("tcp_flags"),
        scalars.safe_int(F.col("in_iface")).alias("input_if"),
        scalars.safe_int(F.col("out_iface")).alias("output_if"),
        scalars.safe_int(F.col("bytes")).alias("bytes"),
        scalars.safe_int(F.col("packets")).alias("packets"),
        scalars.safe_int(F.col("flows"), 1, 1).alias("flow_count"),
        F.lit("netflow-v9").alias("flow_type"),
        scalars.safe_int(F.coalesce("sample_rate", rate.cast("string")), int(sample_rate), 1).alias("sample_rate"),
        start.alias("flow_start"),
        end.alias("flow_end"),
        scalars.parse_duration_ms(F.col("duration_ms"), start, end).alias("duration_ms"),
        scalars.safe_int(F.col("src_as")).alias("src_asn"),
        scalars.safe_int(F.col("dst_as")).alias("dst_asn"),
        name("src_as_name"),
        name("dst_as_name"),
    )
    return out.withColumns(
        {"src_ip_key": ip.ip_key(F.col("src_ip")), "dst_ip_key": ip.ip_key(F.col("dst_ip")), "flow_date": F.to_date("flow_time")}
    )


def parse_flow_lines(
    lines: DataFrame, output_format: str = "auto", delimiter: str = ",", headers: bool = True, fallback: list[str] | None = None
) -> DataFrame:
    """Lines to records; ``headers=False`` skips the search for header lines."""
    split = split_lines(lines, output_format, delimiter)
    return records(carry_headers(split) if headers else split, fallback)


def split_bad_rows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)``; blank and header lines belong to neither."""
    return found.filter("record_status = 'ok'"), found.filter("record_status IN ('bad', 'dropped')").select("file", "value", "record_status")


def ingest_metrics(found: DataFrame, flows_time: Column | None = None) -> DataFrame:
    """Lines read, records taken and lines skipped per file, with an overall status."""
    ok, skipped = F.col("record_status") == "ok", F.col("record_status").isin("skipped", "dropped", "bad")
    bad = F.count_if(F.col("record_status") == "bad")
    extra = [F.max(flows_time).alias("last_flow_time")] if flows_time is not None else []
    return found.groupBy("file").agg(
        F.count_if(~F.col("record_status").isin("skipped")).alias("rows_read"),
        F.count_if(ok).alias("rows_inserted"),
        F.count_if(skipped).alias("rows_skipped"),
        F.when(bad > 0, "warning").otherwise("ok").alias("parser_status"),
        *extra,
    )


def load_asn_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """ASN prefix file ``prefix,asn,as_name,country,source`` as a prefix table."""
    from weirgauge.operators.prefixes import prefix_table

    raw = spark.read.schema("prefix string, asn string, as_name string, country string, source string").csv(path, header=True)
    typed = raw.withColumn("asn", F.regexp_replace(F.upper(F.trim("asn")), "^AS", "").try_cast("bigint"))
    return prefix_table(typed.filter("asn IS NOT NULL").withColumn("prefix", F.trim("prefix")))
