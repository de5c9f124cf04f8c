"""Threshold detection, event lifecycle and policy gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirgauge.functions import ip, scalars
from weirgauge.operators import prefixes as pfx
from weirgauge.operators.listing import first_rows
from weirgauge.operators.ordered import ordered_scan, spaced, time_chunk
from weirgauge.operators.panes import merged_sums, pane_seconds, pane_sums, window_starts
from weirgauge.session import staged

# Detection timing in seconds.
LOOKBACK, CADENCE, MIN_DURATION, CLOSE_AFTER, RETRY_WINDOW = 60, 30, 30, 120, 900
MIN_POINTS = 2

# What each grouping of a rule keeps apart.
GROUPINGS = {
    "subnet": ["subnet"],
    "src_ip": ["src_ip"],
    "src_ip,dst_ip": ["src_ip", "dst_ip"],
    "src_ip,dst_ip,dst_port": ["src_ip", "dst_ip", "dst_port"],
    "conversation": ["src_ip", "src_port", "dst_ip", "dst_port"],
}
PARTS = ["subnet", "src_ip", "src_port", "dst_ip", "dst_port"]
SINGLE_FLOW_KEY = "DNS_SINGLE_FLOW_OUTBOUND"


def grouping_of(group_by: Column, detection_key: Column | None = None) -> Column:
    """Canonical grouping of a rule's free text; a single-flow detection key forces the conversation."""
    text = F.regexp_replace(F.lower(F.coalesce(group_by, F.lit(""))), r"\s|,?proto(col)?\b", "")
    parts = F.split(text, ",")
    has = lambda name: F.array_contains(parts, name)
    by_text = (
        F.when(has("src_port"), "conversation")
        .when(has("dst_port"), "src_ip,dst_ip,dst_port")
        .when(has("dst_ip"), "src_ip,dst_ip")
        .when(has("subnet") | has("prefix"), "subnet")
        .otherwise("src_ip")
    )
    if detection_key is None:
        return by_text
    return F.when(F.upper(F.coalesce(detection_key, F.lit(""))).contains("SINGLE_FLOW"), "conversation").otherwise(by_text)


def _top_port(weight: Column, port: str) -> Column:
    """Port of the heaviest row, the higher port on a tie.

    Weight and port share one number, so this is a plain maximum and the aggregation
    stays a hash aggregation; a decimal holds any weight.
    """
    return _port_of(F.max(_ranked(weight, port)))


def _ranked(weight: Column, port: str) -> Column:
    return weight.cast("decimal(20,0)") * 65536 + F.col(port)


def _port_of(ranked: Column) -> Column:
    return (ranked % 65536).cast("int")


def _group_sums(seconds: Column, fixed: list[str] | None = None) -> list[Column]:
    """Measures of a detection group.

    A part that belongs to the key (``fixed``) has one value per group; leaving its distinct
    count out spares a copy of every row.
    """

    def distinct(part: str) -> Column:
        return F.max(F.lit(1).cast("bigint")) if part in (fixed or []) else F.count_distinct(f"{part}_all")

    packets, size = F.col("packets") * F.col("rate"), F.col("bytes") * F.col("rate")
    return [
        F.sum(size).alias("bytes"),
        F.sum(packets).alias("packets"),
        F.sum("flow_count").alias("flows"),
        distinct("dst_ip").alias("unique_dst_ips"),
        distinct("dst_port").alias("unique_dst_ports"),
        distinct("src_port").alias("unique_src_ports"),
        _top_port(packets, "dst_port_all").alias("top_dst_port"),
        _top_port(packets, "src_port_all").alias("top_src_port"),
        F.min("flow_time").alias("first_seen"),
        F.max("flow_time").alias("last_seen"),
        F.max(seconds).alias("window_seconds"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    seconds = F.col("window_seconds")
    return df.withColumns(
        {"bits_s": F.col("bytes") * 8 / seconds, "packets_s": F.col("packets") / seconds, "flows_s": F.col("flows") / seconds}
    )


def _whole_copies(df: DataFrame) -> DataFrame:
    """Copies for the distinct counts and top ports; the grouping may blank the originals."""
    return df.withColumns({f"{c}_all": F.col(c) for c in ("dst_ip", "dst_port", "src_port")})


def detect_groups(flows: DataFrame, grouping: str, window_seconds: int = 60) -> DataFrame:
    """Scaled sums, rates, distinct counts and heaviest ports per bucket, protocol and group.

    ``flows`` carry ``rate``; ``subnet`` is the ``/24`` of the source.
    """
    rows = _whole_copies(flows.withColumn("subnet", ip.prefix24(F.col("src_ip"))))
    keys = GROUPINGS[grouping]
    grouped = rows.groupBy(scalars.bucket(F.col("flow_time"), window_seconds).alias("bucket"), "proto", *keys).agg(
        *_group_sums(F.lit(window_seconds), keys)
    )
    return _rates(grouped)


def with_sides(flows: DataFrame, zone_prefixes: DataFrame) -> DataFrame:
    """Each flow once per side that lies in a zone, with the zone and the internal address.

    The source side is traffic the zone transmits, the destination side what it receives.
    """
    sides = F.explode(
        F.array(
            F.struct(F.lit("transmits").alias("side"), F.col("src_ip").alias("internal_ip"), F.col("src_ip_key").alias("internal_key")),
            F.struct(F.lit("receives").alias("side"), F.col("dst_ip").alias("internal_ip"), F.col("dst_ip_key").alias("internal_key")),
        )
    ).alias("__s")
    split = flows.select("*", sides).select(*flows.columns, "__s.*")
    zoned = pfx.longest_prefix(split, "internal_key", zone_prefixes, {"zone_id": "zone_id", "prefix": "zone_prefix"})
    return zoned.filter("zone_id IS NOT NULL")


def _prepared(rules: DataFrame) -> DataFrame:
    """Rules with their free-text fields resolved once, and one row per side they look at.

    Columns carry the prefix ``r_``.  What is left for each pair of flow and rule is a
    comparison of numbers and a lookup in a short list.
    """
    enabled = rules.filter(F.coalesce(F.col("enabled").cast("boolean"), F.lit(True)))
    out = enabled.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    both = F.array(F.lit("transmits"), F.lit("receives"))
    proto = F.upper(F.trim(F.coalesce("r_protocol", F.lit("ALL"))))
    columns = {
        "r_side": F.explode(F.when(F.col("r_direction") == "both", both).otherwise(F.array("r_direction"))),
        "r_dns": proto == "DNS",
        "r_proto": F.when(proto.isin("ALL", "ANY", "", "DNS"), None).otherwise(scalars.proto_num(F.lower(proto))),
        "r_grouping": grouping_of(F.col("r_group_by"), F.col("r_detection_key")),
    }
    for side in ("src", "dst"):
        text = F.lower(F.regexp_replace(F.coalesce(F.col(f"r_{side}_port"), F.lit("any")), r"\s", ""))
        listed = F.transform(F.split(F.replace(text, F.lit("!"), F.lit("")), ","), lambda x: x.try_cast("int"))
        columns[f"r_{side}_any"] = text.isin("", "any", "all", "*")
        columns[f"r_{side}_not"] = text.startswith("!")
        columns[f"r_{side}_list"] = listed
    return out.withColumns(columns)


def _rule_applies() -> Column:
    """Whether a prepared rule applies to a flow row."""
    dns = (F.col("proto") == 17) & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))
    protocol = F.col("r_proto").isNull() | (F.col("r_proto") == F.col("proto"))

    def port(side: str) -> Column:
        hit = F.coalesce(F.array_contains(F.col(f"r_{side}_list"), F.col(f"{side}_port")), F.lit(False))
        return F.col(f"r_{side}_any") | (hit != F.col(f"r_{side}_not"))

    return protocol & (~F.col("r_dns") | dns) & port("src") & port("dst")


def _met(panes: DataFrame, zone_prefixes: DataFrame, prepared: DataFrame, whitelist: DataFrame | None) -> DataFrame:
    """Panes with each rule that looks at them; a grouping keeps only the parts it names."""
    zoned = with_sides(panes, zone_prefixes)
    met = zoned.join(prepared, (F.col("zone_id") == F.col("r_zone_id")) & (F.col("side") == F.col("r_side")) & _rule_applies())
    if whitelist is not None:
        controls = {c: F.col(f"r_{c}") for c in pfx.CONTROLS}
        met = pfx.drop_whitelisted(met.withColumns(controls), "dst_ip_key", whitelist).drop(*controls)
    rows = _whole_copies(met).withColumns({"grouping": F.col("r_grouping"), "subnet": ip.prefix24(F.col("src_ip"))})
    kept = {
        part: F.when(F.col("grouping").isin(*[g for g, parts in GROUPINGS.items() if part in parts]), F.col(part)) for part in PARTS
    }
    return rows.withColumns(kept).withColumnRenamed("r_rule_id", "rule_id").withColumnRenamed("r_window_seconds", "window_seconds")


KEYS = ["rule_id", "zone_id", "side", "grouping", "proto", *PARTS]
GROUP = ["rule_id", "zone_id", "side", "grouping", "bucket", "proto", *PARTS]
COUNTED = ("dst_ip", "dst_port", "src_port")
CHUNK = 8  # longest windows of a chunk
SLICES = 16  # tasks that the distinct values of one group and chunk are dealt to
PANES = 50_000  # panes of a task, before rules and windows multiply them


def _chunk(start: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(start) / F.lit(seconds * 1_000_000)).cast("bigint")


def _chunked(panes: DataFrame, cadence: int | None, seconds: int) -> DataFrame:
    """Panes once for each chunk of time (``__chunk``) in which windows that hold them start: one, or two at its edges."""
    starts = window_starts(F.col("pane"), F.col("window_seconds"), cadence)
    return panes.withColumn("__chunk", F.explode(F.array_distinct(F.transform(starts, lambda w: _chunk(w, seconds)))))


def _windows(dealt: DataFrame, cadence: int | None, seconds: int) -> DataFrame:
    """Panes of a chunk once for each window (``bucket``) that starts in it."""
    starts = window_starts(F.col("pane"), F.col("window_seconds"), cadence)
    return dealt.withColumn("bucket", F.explode(F.filter(starts, lambda w: _chunk(w, seconds) == F.col("__chunk"))))


def _heaviest(weight: Callable[[str], Column]) -> list[Column]:
    return [F.max(weight(p)).alias(f"heaviest_{p}") for p in ("dst_port", "src_port")]


def _sums(met: DataFrame, cadence: int | None, seconds: int, tasks: int, counted: str | None = None) -> DataFrame:
    """Merged panes of every group and window, with the distinct values of one part where a metric asks for them.

    Windows that overlap hold a pane many times.  So panes of a group are added up and dealt
    by group and chunk first, and spread to their windows where they are merged: what is
    shuffled does not grow with the number of windows.  Distinct values are dealt in slices.
    """
    none = {f"unique_{p}s": F.lit(None).cast("bigint") for p in COUNTED if p != counted}
    ranked = _heaviest(lambda p: _ranked(F.col("heaviest"), f"{p}_all"))
    again = _heaviest(lambda p: F.col(f"heaviest_{p}"))
    tops = {f"top_{p}": _port_of(F.col(f"heaviest_{p}")) for p in ("dst_port", "src_port")}
    longest = F.max("window_seconds").alias("window_seconds")
    unique = [F.count_distinct(f"{counted}_all").alias(f"unique_{counted}s")] if counted else []
    if cadence is None:
        rows = met.withColumn("bucket", window_starts(F.col("pane"), F.col("window_seconds"))[0])
        out = rows.groupBy(*GROUP).agg(*merged_sums(), *ranked, longest, *unique)
    else:
        value = [f"{counted}_all"] if counted else []
        panes = met.groupBy(*KEYS, "window_seconds", "pane", *value).agg(*merged_sums(), *ranked)
        part = ["__slice"] if counted else []
        sliced = panes.withColumn("__slice", F.pmod(F.xxhash64(*value), F.lit(SLICES))) if counted else panes
        dealt = _chunked(sliced, cadence, seconds).repartition(tasks, *KEYS, "__chunk", *part)
        out = _windows(dealt, cadence, seconds).groupBy(*GROUP, "__chunk", *part).agg(*merged_sums(), *again, longest, *unique)
        if counted:
            out = out.groupBy(*GROUP).agg(*merged_sums(), *again, longest, F.sum(f"unique_{counted}s").alias(f"unique_{counted}s"))
    return out.withColumns({**tops, **none}).drop(*[f"heaviest_{p}" for p in ("dst_port", "src_port")], "__chunk")


def _distinct_counts(met: DataFrame, wanted: DataFrame, parts: list[str], cadence: int | None, seconds: int, tasks: int) -> DataFrame:
    """Distinct values of ``parts`` in the wanted groups and windows, with the keys of ``GROUP`` as ``__<key>``.

    Each value of a group is one row of a pane; only chunks with a wanted window go on to windows.
    """
    values = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_all").cast("string").alias("value")) for p in parts]))
    rows = met.select(*KEYS, "window_seconds", "pane", values.alias("__v")).select(*KEYS, "window_seconds", "pane", "__v.*").distinct()
    asked = wanted.select(*[F.col(c).alias(f"__{c}") for c in KEYS], _chunk(F.col("bucket"), seconds).alias("__asked")).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in KEYS]
    near = _chunked(rows, cadence, seconds).join(asked, [*same, F.col("__chunk") == F.col("__asked")], "left_semi")
    dealt = near.withColumn("__slice", F.pmod(F.xxhash64("part", "value"), F.lit(SLICES))).repartition(tasks, *KEYS, "__chunk", "__slice")
    each = _windows(dealt, cadence, seconds).groupBy(*GROUP, "__chunk", "__slice", "part").agg(F.count_distinct("value").alias("n"))
    return each.groupBy(*[F.col(c).alias(f"__{c}") for c in GROUP]).agg(
        *[F.sum(F.when(F.col("part") == p, F.col("n"))).alias(f"unique_{p}s") for p in parts]
    )


def eval_rules(
    flows: DataFrame, zone_prefixes: DataFrame, rules: DataFrame, whitelist: DataFrame | None = None, cadence: int | None = None,
    counts: bool | tuple[str, ...] = True,
) -> DataFrame:
    """Groups that reach the warning value of a rule, with their severity.

    ``rules`` hold ``rule_id, zone_id, vector, direction, protocol, metric, warning_value,
    critical_value, window_seconds, src_port, dst_port, group_by, detection_key`` and the
    whitelist controls.  Flows are added up once for each conversation and pane; a rule
    meets panes on ``zone_id`` and adds them up to its windows, which follow one another or
    with ``cadence`` begin every so many seconds.  Each grouping keeps only the parts it
    names, so rules of any grouping share a pass; rules on distinct counts have one for each
    counted part.  With ``counts`` every hit is given its distinct counts (of all ``COUNTED``
    parts, or of those named): only hits are looked at again, in the stored panes; those
    not asked for are null, without ``counts`` all that decide nothing.
    """
    five = ["src_ip", "src_ip_key", "src_port", "dst_ip", "dst_ip_key", "dst_port", "proto"]
    prepared = staged(_prepared(rules))
    panes = staged(pane_sums(flows, five, pane_seconds(prepared, "r_window_seconds", cadence)))
    seconds = CHUNK * max(1, int(prepared.agg(F.max(F.col("r_window_seconds").cast("bigint"))).first()[0] or 1))
    # Rows multiply after the shuffle, where Spark cannot see it: the number of tasks follows the panes and is not merged down.
    tasks = max(int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-panes.count() // PANES))
    # Rule attributes come back by a join on few groups: carried through the aggregation they
    # would turn it from a hash into a sort aggregation.
    traits = rules.select("rule_id", "vector", "metric", "warning_value", "critical_value", "detection_key")
    metrics = {r[0] for r in prepared.select("r_metric").distinct().collect()}  # names of metrics
    decides = {f"unique_{p}s": p for p in COUNTED if f"unique_{p}s" in metrics}
    hits = None
    for metric, part in [(None, None), *decides.items()]:
        own = F.col("r_metric") == metric if metric else ~F.coalesce(F.col("r_metric").isin(*decides), F.lit(False))
        met = _met(panes, zone_prefixes, prepared.filter(own), whitelist)
        found = threshold_hits(_rates(_sums(met, cadence, seconds, tasks, part).join(traits, "rule_id")))
        hits = found if hits is None else hits.unionByName(found)
    if not counts:
        return hits
    parts = [p for p in COUNTED if counts is True or p in counts]
    wanted = staged(hits.drop(*[f"unique_{p}s" for p in COUNTED]))
    met = _met(panes, zone_prefixes, prepared, whitelist)
    counted = _distinct_counts(met, wanted, parts, cadence, seconds, tasks)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in GROUP]
    none = {f"unique_{p}s": F.lit(None).cast("bigint") for p in COUNTED if p not in parts}
    return wanted.join(counted, same).drop(*[f"__{c}" for c in GROUP]).withColumns(none)


def threshold_hits(groups: DataFrame) -> DataFrame:
    """Rows at or above ``warning_value`` with the highest severity they reach; both bounds are inclusive."""
    value = (
        F.when(F.col("metric") == "bits_s", F.col("bits_s"))
        .when(F.col("metric") == "flows_s", F.col("flows_s"))
        .when(F.col("metric") == "unique_dst_ips", F.col("unique_dst_ips"))
        .when(F.col("metric") == "unique_dst_ports", F.col("unique_dst_ports"))
        .when(F.col("metric") == "unique_src_ports", F.col("unique_src_ports"))
        .otherwise(F.col("packets_s"))
    )
    critical = (F.col("critical_value") > 0) & (F.col("metric_value") >= F.col("critical_value"))
    warning = (F.col("warning_value") > 0) & (F.col("metric_value") >= F.col("warning_value"))
    return (
        groups.withColumn("metric_value", value.cast("double"))
        .filter(critical | warning)
        .withColumns(
            {
                "severity": F.when(critical, "critical").otherwise("warning"),
                "trigger_threshold": F.when(critical, F.col("critical_value")).otherwise(F.col("warning_value")),
            }
        )
    )


SAMPLE = ["bytes", "packets", "flow_time", "src_ip", "src_port", "dst_ip", "dst_port", "proto"]


def vector_values(flows: DataFrame, vectors: DataFrame, lookback: int = LOOKBACK, samples: int = 0) -> DataFrame:
    """Value of every attack vector for every target in every lookback window.

    ``vectors(vector_id, target_cidr, sensor, interface_id, direction, decoder,
    threshold_value, threshold_unit)``; null sensor, interface or target mean any.  Flows
    are reduced per target and decoder first and meet vectors on ``(block, decoder, direction)``.

    With ``samples`` each row carries so many flows in ``sample_<n>``: the heaviest of those
    whose source port leaves the remainder n.  They are maxima, so they are reduced with the sums.
    """
    numbered = [f"sample_{n}" for n in range(samples)]
    sample = F.struct(*SAMPLE)
    picked = [F.max(F.when(F.pmod(F.col("src_port"), F.lit(samples)) == n, F.col("__sample"))).alias(c) for n, c in enumerate(numbered)]
    looks = ["proto", "src_port", "dst_port", "tcp_flags"]
    names = [r[0] for r in vectors.select("decoder").distinct().collect()]  # at most the 23 decoder names
    wanted = F.array_intersect(scalars.decoders(*[F.col(c) for c in looks]), F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    sides = F.explode(
        F.array(
            F.struct(F.lit("receives").alias("direction"), F.col("dst_ip").alias("target_ip"), F.col("dst_ip_key").alias("target_key"), F.col("input_if").alias("interface_id")),
            F.struct(F.lit("sends").alias("direction"), F.col("src_ip").alias("target_ip"), F.col("src_ip_key").alias("target_key"), F.col("output_if").alias("interface_id")),
        )
    ).alias("__t")
    spread = flows.select("*", F.explode(wanted).alias("decoder")).select(
        scalars.bucket(F.col("flow_time"), lookback).alias("bucket"), "sensor", "decoder", "bytes", "packets", "flow_count", sides,
        *(["src_port", sample.alias("__sample")] if samples else []),
    )
    reduced = spread.groupBy("bucket", "sensor", "decoder", "__t.direction", "__t.target_ip", "__t.target_key", "__t.interface_id").agg(
        F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.sum("flow_count").alias("flows"), *picked
    )
    both = F.array(F.lit("receives"), F.lit("sends"))
    bounds = pfx.prefix_table(vectors.withColumn("__cidr", F.coalesce("target_cidr", F.lit("::/0"))), "__cidr")
    v = bounds.select(
        "vector_id", F.col("sensor").alias("__sensor"), F.col("interface_id").alias("__if"), F.col("decoder").alias("__dec"),
        F.explode(F.when(F.col("direction") == "both", both).otherwise(F.array("direction"))).alias("__dir"),
        "threshold_value", "threshold_unit", "plen", "net_key",
    )
    # Block, decoder and direction are the join key; sensor and interface may be any.
    met = pfx.match_prefixes(
        reduced, "target_key", v,
        (F.col("decoder") == F.col("__dec"))
        & (F.col("direction") == F.col("__dir"))
        & (F.col("__sensor").isNull() | (F.col("sensor") == F.col("__sensor")))
        & (F.col("__if").isNull() | (F.col("interface_id") == F.col("__if"))),
    )
    seconds = float(lookback)
    totals = met.groupBy("vector_id", "bucket", "target_ip", "direction", "decoder", "threshold_value", "threshold_unit").agg(
        F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.sum("flows").alias("flows"), *[F.max(c).alias(c) for c in numbered]
    )
    return totals.withColumns(
        {
            "value": F.when(F.col("threshold_unit") == "bits_s", F.col("bytes") * 8 / seconds)
            .when(F.col("threshold_unit") == "flows_s", F.col("flows") / seconds)
            .otherwise(F.col("packets") / seconds)
        }
    )


def eval_vectors(flows: DataFrame, vectors: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Targets that reach the threshold of a vector."""
    return vector_values(flows, vectors, lookback).filter(F.col("value") >= F.col("threshold_value"))


def test_vectors(flows: DataFrame, vectors: DataFrame, lookback: int = LOOKBACK, samples: int = 5) -> DataFrame:
    """Report per vector: highest value, threshold, whether it matches and why, the traffic behind it and samples of it."""
    values = vector_values(flows, vectors, lookback, samples)
    numbered = [f"sample_{n}" for n in range(samples)]
    peak = values.groupBy("vector_id").agg(
        F.max("value").alias("value"), F.sum("flows").alias("flows"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"),
        F.max_by("target_ip", F.struct("value", "target_ip")).alias("top_target"), *[F.max(c).alias(c) for c in numbered],
    )
    if samples:
        peak = peak.withColumn("samples", F.sort_array(F.array_compact(F.array(*numbered)), asc=False)).drop(*numbered)
    known = vectors.select("vector_id", "threshold_value", "threshold_unit")
    out = known.join(peak, "vector_id", "left")
    match = F.coalesce(F.col("value") >= F.col("threshold_value"), F.lit(False))
    return out.withColumns(
        {
            "match": match,
            "reason": F.when(F.col("value").isNull(), "no_matching_flows").when(match, "threshold_reached").otherwise("below_threshold"),
            **{c: F.coalesce(c, F.lit(0)) for c in ("flows", "bytes", "packets")},
        }
    )


# --- keys, runs and lifecycle -------------------------------------------------------


def dedupe_key(**parts: Column) -> Column:
    """Event identity.  Give it vector, target, sensor, interface, decoder, direction and, for
    rules, the detection key; display labels never take part."""
    return scalars.stable_key("anom", **parts)


def consecutive(points: DataFrame, keys: list[str], window_seconds: int, needed: int, ts: str = "bucket") -> DataFrame:
    """Length of the run of adjoining windows that ends at each point; it fires from ``needed`` on."""
    at = F.unix_seconds(F.col(ts))
    before = ordered_scan(points, keys, time_chunk(ts, 6 * 3600), [ts], {"__prev": ("prev", at)})
    begins = F.col("__prev").isNull() | (at - F.col("__prev") != window_seconds)
    runs = ordered_scan(before, keys, time_chunk(ts, 6 * 3600), [ts], {"__start": ("last", F.when(begins, at))})
    length = ((at - F.col("__start")) / window_seconds).cast("bigint") + 1
    return runs.withColumns({"run_length": length, "fires": length >= needed}).drop("__prev", "__start")


def cooldown(events: DataFrame, keys: list[str], seconds: int, ts: str = "bucket") -> DataFrame:
    """Suppress events within the cooldown after the last one of their key that fired.

    A suppressed event does not prolong the cooldown, so a recurring one fires again.  Events
    of a key at one time share the verdict; one without a time is never suppressed.
    """
    fired = spaced(events, keys, ts, seconds, 6 * 3600).withColumn("__fires", F.lit(True))
    named = fired.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(ts).alias("__at"), "__fires")
    same = F.col(ts).cast("timestamp") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    verdict = F.col("__fires").isNull() & F.col(ts).isNotNull()
    return events.join(named, same, "left").withColumn("suppressed", verdict).select(*events.columns, "suppressed")


def event_sessions(points: DataFrame, keys: list[str], ts: str = "bucket", quiet: int = CLOSE_AFTER) -> DataFrame:
    """Events from matching windows: one stays open until ``quiet`` seconds pass without a match.

    Points need ``value`` and ``threshold``.  Trigger, last and peak are kept apart.
    """
    return (
        points.groupBy(*keys, F.session_window(F.col(ts), f"{int(quiet)} seconds").alias("session"))
        .agg(*_history(ts))
        .withColumns({"closes_at": F.col("session.end")})
        .drop("session")
    )


def _history(ts: str = "seen_at") -> list[Column]:
    point = F.struct("value", "threshold")
    return [
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.min_by(point, F.struct(F.col(ts), F.col("value"))).alias("__trigger"),
        F.max_by(point, F.struct(F.col(ts), F.col("value"))).alias("__last"),
        F.max("value").alias("peak_value"),
        F.count(F.lit(1)).alias("points"),
    ]


HISTORY = ["trigger_value", "trigger_threshold", "last_value", "last_threshold"]


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "trigger_value": F.col("__trigger.value"), "trigger_threshold": F.col("__trigger.threshold"),
            "last_value": F.col("__last.value"), "last_threshold": F.col("__last.threshold"),
        }
    ).drop("__trigger", "__last")


def sessions(points: DataFrame, keys: list[str], ts: str = "bucket", quiet: int = CLOSE_AFTER) -> DataFrame:
    return _flat(event_sessions(points, keys, ts, quiet))


def min_duration(events: DataFrame, seconds: int = MIN_DURATION, window_seconds: int = LOOKBACK) -> DataFrame:
    """Events that lasted long enough, the last window included."""
    lasted = F.unix_seconds("last_seen") - F.unix_seconds("first_seen") + window_seconds
    return events.filter(lasted >= seconds)


def anomaly_history(points: DataFrame, keys: list[str], ts: str = "seen_at") -> DataFrame:
    """Trigger, last and peak of each event key, kept independently, with the number of points."""
    out = _flat(points.groupBy(*keys).agg(*_history(ts)))
    return out.withColumn("enough_points", F.col("points") >= MIN_POINTS)


STATE = ["dedupe_key", "first_seen", "last_seen", "trigger_value", "trigger_threshold", "last_value", "last_threshold",
         "peak_value", "points", "status"]


def upsert_events(state: DataFrame, points: DataFrame, ts: str = "seen_at") -> DataFrame:
    """Stored events merged with a batch of points.

    Existing events keep their trigger; last, peak and counts move on, and an event that
    had ended becomes active again.
    """
    fresh = _flat(points.groupBy("dedupe_key").agg(*_history(ts))).withColumns({"status": F.lit("active"), "__new": F.lit(1)})
    known = state.select(*STATE).withColumn("__new", F.lit(0))
    rows = known.unionByName(fresh.select(*STATE, "__new"))
    merged = rows.groupBy("dedupe_key").agg(
        F.min_by(F.struct("first_seen", "trigger_value", "trigger_threshold"), F.struct("__new", "first_seen")).alias("t"),
        F.max_by(F.struct("last_seen", "last_value", "last_threshold"), F.struct("last_seen", "__new")).alias("l"),
        F.max("peak_value").alias("peak_value"),
        F.sum("points").alias("points"),
        F.max_by("status", "__new").alias("status"),
    )
    return merged.select(
        "dedupe_key", "t.first_seen", "l.last_seen", "t.trigger_value", "t.trigger_threshold", "l.last_value", "l.last_threshold",
        "peak_value", "points", "status",
    )


def close_events(state: DataFrame, now: Column, quiet: int = CLOSE_AFTER) -> DataFrame:
    """Active events without a match for more than ``quiet`` seconds end."""
    silent = F.unix_seconds(now) - F.unix_seconds("last_seen") > quiet
    ended = (F.col("status") == "active") & silent
    return state.withColumns(
        {
            "ended_at": F.when(ended, F.timestamp_micros(F.unix_micros("last_seen") + F.lit(quiet * 1_000_000))),
            "status": F.when(ended, "ended").otherwise(F.col("status")),
        }
    )


def threshold_state(candidates: DataFrame) -> DataFrame:
    """Thresholds of a candidate with the snapshot that triggered it."""
    automatic = F.coalesce(F.nullif("automatic_value", F.lit(0.0)), F.nullif("critical_value", F.lit(0.0)))
    critical = F.col("severity") == "critical"
    trigger = F.when(critical, F.col("critical_value")).otherwise(F.col("warning_value"))
    unit = (
        F.when(F.col("metric") == "packets_s", "packets_per_second").when(F.col("metric") == "bits_s", "bits_per_second")
        .when(F.col("metric") == "flows_s", "flows_per_second").otherwise(F.col("metric"))
    )
    return candidates.withColumns(
        {
            "automatic_threshold": automatic,
            "trigger_threshold": trigger,
            "trigger_value": F.col("metric_value"),
            "triggered_severity": F.col("severity"),
            "canonical_unit": unit,
            "condition_passed": F.col("metric_value") >= trigger,
        }
    )


def policy_gate(events: DataFrame) -> DataFrame:
    """Reasons that keep an event from automatic action, in fixed order; none means it may go on."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("severity") != "critical", "warning_manual_only"),
            F.when(F.coalesce(F.col("last_value") < F.col("automatic_threshold"), F.lit(False)), "below_automatic_mitigation_threshold"),
            F.when(F.col("points") < MIN_POINTS, "insufficient_time_series_evidence"),
            F.nullif("addressing_block_reason", F.lit("")),
            F.when(F.col("whitelist_name").isNotNull(), "dns_destination_whitelisted"),
        )
    )
    return events.withColumn("reasons", reasons).withColumns(
        {
            "allowed": F.size("reasons") == 0,
            "reason": F.coalesce(F.get("reasons", 0), F.lit("")),
            "analysis_mode": F.when(F.size("reasons") == 0, "automatic_authorization").otherwise("informational"),
        }
    )


# --- event queries ------------------------------------------------------------------

CLOSED = ("ended", "closed", "rejected", "ignored")


def anomaly_summary(events: DataFrame) -> DataFrame:
    """Active totals by severity in one row."""
    live = ~F.lower("status").isin(*CLOSED)
    return events.agg(
        F.count_if(live).alias("active_total"),
        F.count_if(live & (F.col("severity") == "warning")).alias("active_warning"),
        F.count_if(live & (F.col("severity") == "critical")).alias("active_critical"),
    )


def consolidate(events: DataFrame) -> DataFrame:
    """One row per vector and target: active while any member is, with the widest span and stable label."""
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    live = F.col("status") == "active"
    return events.groupBy("vector", "target").agg(
        F.max_by("severity", rank).alias("severity"),
        F.when(F.max(live), "active").otherwise(F.max_by("status", F.struct("last_seen", "status"))).alias("status"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("peak_value").alias("peak_value"),
        F.min_by("label", F.struct("first_seen", "label")).alias("label"),
        F.count(F.lit(1)).alias("members"),
    )


def recent_events(events: DataFrame, source: str, limit: int | None = None, ts: str = "last_seen") -> DataFrame:
    """Newest events of a source; peak sources leave negative samples out."""
    rows = events.filter(F.col("source") == source)
    if "is_negative_sample" in events.columns:
        rows = rows.filter(~F.coalesce(F.col("is_negative_sample"), F.lit(False)))
    return first_rows(rows.orderBy(F.desc(ts), "event_id"), limit)


SENT, PENDING = ("sent", "queued"), ("pending", "awaiting_approval", "proposed")


def response_state(anomalies: DataFrame, responses: DataFrame) -> DataFrame:
    """The response shown per anomaly: sent or queued first, then pending, then the rest; newest inside a tier."""
    status = F.lower("response_status")
    tier = F.when(status.isin(*SENT), 0).when(status.isin(*PENDING), 1).otherwise(2)
    shown = responses.groupBy("anomaly_id").agg(
        F.min_by(
            F.struct("response_id", "response_status", "created_at"),
            F.struct(tier.alias("t"), (-F.unix_micros("created_at")).alias("c"), (-F.col("response_id")).alias("i")),
        ).alias("r"),
        F.count(F.lit(1)).alias("responses"),
    )
    return anomalies.join(shown, "anomaly_id", "left").select(
        *anomalies.columns, "r.response_id", "r.response_status", F.coalesce("responses", F.lit(0)).alias("responses")
    )


def retry_candidates(events: DataFrame, now: Column, window: int = RETRY_WINDOW) -> DataFrame:
    """Events without an outcome that are active or ended not long ago."""
    recent = (F.col("status") == "ended") & (F.unix_seconds(now) - F.unix_seconds("ended_at") <= window)
    return events.filter(F.col("outcome").isNull() & ((F.col("status") == "active") | recent))


def related_flows(anomalies: DataFrame, flows: DataFrame, margin: int = 60, bin_seconds: int = 300, heaviest: bool = False, sources: bool = False, distinct: bool = False) -> DataFrame:
    """Flows of each anomaly: same destination (and port, source, protocol where given) inside its span.

    Anomalies list the time bins they touch, so the join is on ``(dst_ip, bin)``; excluded
    ports and the exact bounds are checked on what meets.  The result has a row for each pair.

    With ``heaviest`` only the flows are given among which each anomaly has its heaviest one
    (see ``_heaviest_flows``): their number follows the anomalies, not the pairs.

    With ``sources`` flows are added up by second and carry ``new_source``: whether the source is
    met for the first time in the anomaly's span, towards that target, port and protocol.  Distinct
    sources are then a sum, which Spark takes where pairs are formed: no pair is shuffled.  Only of
    ids that stand for several spans, which may share sources, the first rows are named in ``source``.

    With ``distinct`` the result is what ``cardinalities`` adds up (see ``_first_met``): rows of seconds
    with the sources and conversations met for the first time in the span, and pairs only of ids that
    stand for several spans.
    """
    start, end = F.unix_seconds("first_seen") - margin, F.unix_seconds("last_seen") + margin
    asked = anomalies.withColumns({"__start": start, "__end": end}).select(
        "anomaly_id", F.col("dst_ip").alias("a_dst_ip"), F.col("dst_port").alias("a_dst_port"), F.col("src_ip").alias("a_src_ip"),
        F.col("excluded_ports").alias("a_excluded"), "__start", "__end",
    )
    port = (F.col("a_dst_port").isNull() | (F.col("dst_port") == F.col("a_dst_port"))) & ~F.coalesce(
        F.array_contains("a_excluded", F.col("dst_port")), F.lit(False)
    )
    if heaviest:
        return _heaviest_flows(asked, flows, port)
    at = F.unix_seconds("flow_time")
    if distinct:
        named = staged(_once(asked.filter("a_dst_ip IS NOT NULL")))
        single = _first_met(named.filter("NOT __several"), flows, port, bin_seconds)
        if named.filter("__several").isEmpty():
            return single
        several = anomalies.join(named.filter("__several").select(F.col("anomaly_id").alias("__of")).distinct(), F.col("anomaly_id").eqNullSafe(F.col("__of")), "left_semi")
        pairs = related_flows(several, flows, margin, bin_seconds).select("anomaly_id", *FIVE, F.lit(False).alias("marked"))
        return single.unionByName(pairs, allowMissingColumns=True)
    if sources:
        flows, at, asked = _by_second(flows), F.col("__second"), _once(asked)
        fresh = F.col("src_ip").isNotNull() & (F.col("__before").isNull() | (F.col("__before") < F.col("__start")))
    spans = asked.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__start") / bin_seconds), F.floor(F.col("__end") / bin_seconds))))
    met = flows.withColumn("__fbin", F.floor(at / bin_seconds)).join(
        spans,
        (F.col("dst_ip") == F.col("a_dst_ip")) & (F.col("__fbin") == F.col("__bin")) & at.between(F.col("__start"), F.col("__end"))
        & (F.col("a_src_ip").isNull() | (F.col("src_ip") == F.col("a_src_ip")))
        & port,
    )
    if sources:
        return met.select(
            "anomaly_id", *SENT_TO, *[(F.col(c) * F.col("__times")).alias(c) for c in ("packets", "bytes")],
            (fresh & ~F.col("__several")).alias("new_source"), F.when(fresh & F.col("__several"), F.col("src_ip")).alias("source"),
        )
    return met.select("anomaly_id", *flows.columns)


SENT_TO = ["dst_ip", "dst_ip_key", "dst_port", "proto", "src_ip"]


def _once(asked: DataFrame) -> DataFrame:
    """Equal spans as one row with their number (``__times``) and whether their id has others (``__several``)."""
    spans = asked.groupBy(*asked.columns).agg(F.count(F.lit(1)).alias("__times"))
    others = spans.groupBy(F.col("anomaly_id").alias("__of")).agg(F.count(F.lit(1)).alias("__spans")).filter("__spans > 1")
    named = spans.join(others, F.col("anomaly_id").eqNullSafe(F.col("__of")), "left")
    return named.withColumn("__several", F.col("__spans").isNotNull()).drop("__of", "__spans")


def _by_second(flows: DataFrame) -> DataFrame:
    """Packets and bytes of each source, target, port and protocol by ``__second``, with its second ``__before`` that one.

    A window holds at most one row for each second of time, however many flows there are.
    """
    each = flows.filter("flow_time IS NOT NULL").groupBy(*SENT_TO, F.unix_seconds("flow_time").alias("__second")).agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes")
    )
    return each.withColumn("__before", F.lag("__second").over(Window.partitionBy(*SENT_TO).orderBy("__second")))


FIVE = ["src_ip", "src_port", "dst_ip", "dst_port", "proto"]


def _first_met(asked: DataFrame, flows: DataFrame, port: Column, bin_seconds: int) -> DataFrame:
    """(anomaly_id, new_sources, new_conversations) of every second of a span, each anomaly with one span.

    Anomalies that ask for the same target, port, source and exclusions are of one kind.  A flow
    knows when its source and its conversation were last met by the kind; rows of one second and
    one last meeting are counted before anomalies meet them.  In a span, those not met since its
    start are new, so distinct values are a sum, which Spark takes where pairs are formed.
    """
    wish = ["a_dst_ip", "a_dst_port", "a_src_ip", "a_excluded"]
    kinds = staged(asked.select(*wish).distinct().withColumn("__kind", F.monotonically_increasing_id()))
    of_kind = asked.join(kinds.select("__kind", *[F.col(c).alias(f"__{c}") for c in wish]), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in wish])
    bins = F.explode(F.sequence(F.floor(F.col("__start") / bin_seconds), F.floor(F.col("__end") / bin_seconds))).alias("__bin")
    spans = of_kind.filter("__start <= __end").select("anomaly_id", "__kind", "__start", "__end", bins)
    # Only bins that some span of the kind touches: nothing outside can be met by one.
    near = staged(spans.select("__kind", "__bin").distinct().join(kinds, "__kind"))
    second = F.unix_seconds("flow_time")
    seen = flows.select(*FIVE, second.alias("__second"), F.floor(second / bin_seconds).alias("__fbin")).join(
        near,
        (F.col("dst_ip") == F.col("a_dst_ip")) & (F.col("__fbin") == F.col("__bin")) & (F.col("a_src_ip").isNull() | (F.col("src_ip") == F.col("a_src_ip"))) & port,
    )

    def dealt(rows: DataFrame, key: list[str]) -> DataFrame:
        """One row of each key and second, dealt by the key: its order in time takes no second shuffle."""
        return rows.repartition("__kind", *key).select("__kind", *key, "__second").distinct()

    def met(rows: DataFrame, key: list[str], counted: Column) -> DataFrame:
        before = rows.withColumn("__before", F.lag("__second").over(Window.partitionBy("__kind", *key).orderBy("__second")))
        return before.groupBy(F.col("__kind").alias("__of"), "__second", "__before").agg(F.count(counted).alias("__n"))

    rest = [c for c in FIVE if c != "dst_ip"]  # a kind has one target
    talks = dealt(seen, rest)
    sources = met(dealt(talks, ["src_ip"]), ["src_ip"], F.col("src_ip")).withColumn("__talks", F.lit(False))
    marks = sources.unionByName(met(talks, rest, F.lit(1)).withColumn("__talks", F.lit(True)))
    found = marks.withColumn("__fbin", F.floor(F.col("__second") / bin_seconds)).join(
        spans, (F.col("__of") == F.col("__kind")) & (F.col("__fbin") == F.col("__bin")) & F.col("__second").between(F.col("__start"), F.col("__end"))
    )
    new = F.when(F.col("__before").isNull() | (F.col("__before") < F.col("__start")), F.col("__n")).otherwise(0)
    return found.select(
        "anomaly_id", F.when(~F.col("__talks"), new).alias("new_sources"), F.when(F.col("__talks"), new).alias("new_conversations"), F.lit(True).alias("marked")
    )


HEAVIEST = ["packets", "bytes", "src_ip", "dst_ip", "dst_port", "proto"]


def _blocks(levels: int) -> Column:
    """The fewest aligned blocks of 1, 4, 16, ... seconds that make up ``__start`` to ``__end``, as (level, block)."""
    parts = []
    first, after = F.col("__start"), F.col("__end") + 1
    for level in range(levels):
        size = 4**level
        low, high = F.ceil(first / size).cast("bigint"), F.floor(after / size).cast("bigint")
        up, down = F.ceil(first / (size * 4)).cast("bigint") * 4, F.floor(after / (size * 4)).cast("bigint") * 4
        some = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        whole = some(low, high)
        # What whole blocks of the next size cover is theirs.
        here = whole if level == levels - 1 else F.when(up < down, F.concat(some(low, up), some(down, high))).otherwise(whole)
        parts.append(F.arrays_zip(F.transform(here, _as(level)).alias("level"), here.alias("block")))
    return F.concat(*parts)


def _as(value: int) -> Callable[[Column], Column]:
    return lambda _: F.lit(value)


def _heaviest_flows(asked: DataFrame, flows: DataFrame, port: Column) -> DataFrame:
    """The heaviest flow of every port in each block of an anomaly's span.

    Flows are reduced to one for each target, port and second, and those to one for each
    block of seconds that spans are made of.  A span of n seconds has at most 6 log4(n)
    blocks, so an anomaly meets few rows, however many flows its target received.
    """
    spans = staged(asked.filter("a_dst_ip IS NOT NULL AND __start <= __end"))
    widest, sources = spans.agg(F.max(F.col("__end") - F.col("__start") + 1), F.count("a_src_ip")).first()
    levels = max(1, (int(widest or 1).bit_length() + 1) // 2)
    targets = staged(spans.select(F.col("a_dst_ip").alias("dst_ip")).distinct())
    anyone = F.struct(F.lit(False).alias("own"), F.lit(None).cast("string").alias("of"))
    one = F.struct(F.lit(True).alias("own"), F.col("src_ip").alias("of"))
    scopes = F.explode(F.array(anyone, one) if sources else F.array(anyone)).alias("__s")
    near = flows.join(targets, "dst_ip", "left_semi").select(*HEAVIEST, F.unix_seconds("flow_time").alias("__second"), scopes)
    key = ["dst_ip", "dst_port", "own", "of"]
    best = F.max(F.struct(*HEAVIEST)).alias("best")
    seconds = near.groupBy("dst_ip", "dst_port", "__s.own", "__s.of", "__second").agg(best)
    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("__second") / 4**n).alias("block")) for n in range(levels)]))
    blocks = seconds.select(*key, "best", sizes.alias("__b")).groupBy(*key, "__b.level", "__b.block").agg(F.max("best").alias("best"))
    wanted = spans.withColumn("__b", F.explode(_blocks(levels))).select(
        "anomaly_id", "a_dst_ip", "a_dst_port", "a_src_ip", "a_excluded", F.col("__b.level").alias("a_level"), F.col("__b.block").alias("a_block")
    )
    # Many more rows than the stored spans whose file size Spark goes by: not to be broadcast.
    met = blocks.join(
        wanted.hint("merge"),
        (F.col("dst_ip") == F.col("a_dst_ip")) & (F.col("level") == F.col("a_level")) & (F.col("block") == F.col("a_block"))
        & (F.col("own") == F.col("a_src_ip").isNotNull()) & F.col("of").eqNullSafe(F.col("a_src_ip")) & port,
    )
    return met.select("anomaly_id", *[F.col(f"best.{c}").alias(c) for c in HEAVIEST])


def fill_from_flows(events: DataFrame, related: DataFrame) -> DataFrame:
    """Empty targets of events taken from their heaviest related flow."""
    heavy = related.groupBy("anomaly_id").agg(
        F.max_by(
            F.struct("src_ip", "dst_ip", "dst_port", "proto"), F.struct("packets", "bytes", "src_ip", "dst_ip", "dst_port", "proto")
        ).alias("f")
    )
    joined = events.join(heavy, "anomaly_id", "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"f.{c}")) for c in ("src_ip", "dst_ip", "dst_port", "proto")}
    return joined.withColumns(filled).drop("f")


def cardinalities(related: DataFrame, key: str = "anomaly_id", approximate: bool = False) -> DataFrame:
    """Distinct sources, destinations and conversations per event; optionally by sketch.

    Rows of ``related_flows(distinct=True)`` are added up; their flows go to the one target of the event.
    """
    if "marked" in related.columns:
        marked = related.filter("marked").groupBy(key).agg(
            F.coalesce(F.sum("new_sources"), F.lit(0)).alias("sources"), F.max(F.lit(1).cast("bigint")).alias("destinations"), F.sum("new_conversations").alias("conversations")
        )
        return marked.unionByName(cardinalities(related.filter("NOT marked").drop("marked"), key, approximate)) if "src_ip" in related.columns else marked
    count = F.approx_count_distinct if approximate else F.count_distinct
    five = F.struct(*FIVE)
    return related.groupBy(key).agg(
        count("src_ip").alias("sources"), count("dst_ip").alias("destinations"), count(five).alias("conversations")
    )


def anomaly_series(anomalies: DataFrame, flows: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Series around each anomaly: from 15 minutes before to at least an hour after its start.

    The conversation is shown when it has two points or more, otherwise the whole target.
    """
    start = F.unix_seconds("first_seen") - 900
    end = F.greatest(F.unix_seconds("last_seen"), F.unix_seconds("first_seen") + 3600)
    whole = staged(
        anomalies.select("anomaly_id", F.col("dst_ip").alias("a_dst"), F.col("src_ip").alias("a_src"), F.col("dst_port").alias("a_port"), start.alias("__start"), end.alias("__end"))
    )
    whole = whole.filter("a_dst IS NOT NULL AND __start <= __end")
    slot = lambda c: F.floor(c / window_seconds)
    second = F.unix_seconds("flow_time")

    def slots(keys: list[str], wanted: DataFrame) -> DataFrame:
        """Packets of each key and window, whole and by seconds (as many as a window has at most)."""
        near = flows.join(staged(wanted.distinct()), keys, "left_semi")
        each = near.groupBy(*keys, second.alias("second")).agg(F.sum("packets").alias("packets"))
        return each.groupBy(*keys, slot(F.col("second")).alias("slot")).agg(
            F.sum("packets").alias("packets"), F.collect_list(F.struct("second", "packets")).alias("seconds")
        )

    def inside(side: str) -> Column:
        """Packets of a window that lie in the span: all of them unless the span cuts it."""
        kept = F.filter(F.col(f"{side}.seconds"), lambda x: x["second"].between(F.col("__start"), F.col("__end")))
        none = F.col(f"{side}.packets") * F.lit(None).cast("bigint")
        cut = F.aggregate(kept, none, lambda total, x: F.when(total.isNull(), x["packets"]).otherwise(total + F.coalesce(x["packets"], F.lit(0))))
        full = (F.col("__slot") * window_seconds >= F.col("__start")) & ((F.col("__slot") + 1) * window_seconds - 1 <= F.col("__end"))
        return F.when(full, F.col(f"{side}.packets")).otherwise(cut)

    # Flows are added up for each target and window, and for each conversation that an anomaly names,
    # before anomalies meet them: one row for each window of an anomaly, however many flows it has.
    targets = slots(["dst_ip"], whole.select(F.col("a_dst").alias("dst_ip")))
    named = whole.filter("a_src IS NOT NULL AND a_port IS NOT NULL").select(F.col("a_dst").alias("dst_ip"), F.col("a_src").alias("src_ip"), F.col("a_port").alias("dst_port"))
    talks = slots(["dst_ip", "src_ip", "dst_port"], named)
    spans = whole.withColumn("__slot", F.explode(F.sequence(slot(F.col("__start")), slot(F.col("__end")))))
    # Many more rows than the stored spans whose file size Spark goes by: not to be broadcast.
    met = spans.hint("merge").join(targets.alias("t"), (F.col("t.dst_ip") == F.col("a_dst")) & (F.col("t.slot") == F.col("__slot"))).join(
        talks.alias("c"),
        (F.col("c.dst_ip") == F.col("a_dst")) & (F.col("c.src_ip") == F.col("a_src")) & (F.col("c.dst_port") == F.col("a_port")) & (F.col("c.slot") == F.col("__slot")),
        "left",
    )
    seconds = float(window_seconds)
    points = met.filter("anomaly_id IS NOT NULL").select("anomaly_id", "__slot", inside("t").alias("target"), inside("c").alias("talk")).groupBy("anomaly_id", "__slot").agg(
        (F.sum("target") / seconds).alias("target_packets_s"), (F.sum("talk") / seconds).alias("conversation_packets_s")
    )
    own = Window.partitionBy("anomaly_id")  # an anomaly's own windows
    scoped = points.withColumn("narrow", F.count("conversation_packets_s").over(own) >= 2)
    value = F.when(F.col("narrow"), F.col("conversation_packets_s")).otherwise(F.col("target_packets_s"))
    return scoped.select(
        "anomaly_id", F.timestamp_seconds(F.col("__slot") * window_seconds).alias("bucket"), value.alias("packets_s"),
        F.when(F.col("narrow"), "conversation").otherwise("target").alias("scope"),
    ).filter("packets_s IS NOT NULL")
