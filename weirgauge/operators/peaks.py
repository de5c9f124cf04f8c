"""Peak analysis for every series at once: baseline, local peaks, evidence, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirgauge.functions import scalars
from weirgauge.operators import rates
from weirgauge.operators.filters import SENDS, interface_column, valid_vector
from weirgauge.operators.ordered import ordered_scan, time_chunk
from weirgauge.operators.series import SCAN_CHUNK_SECONDS
from weirgauge.session import staged

# Evidence floors, evidence windows and result limits.
MIN_EVIDENCE_SHARE = 20.0
MIN_EVIDENCE_PACKETS = 1000
MIN_EVIDENCE_BYTES = 1_000_000
EVIDENCE_WINDOWS = (5, 15, 30, 60)
MAX_PEAK_FLOWS = 200
MAX_ENDPOINTS = 20
DUPLICATE_SECONDS = 300

# Operator labels accepted as feedback.
OPERATOR_LABELS = ("attack", "false_positive", "noise_or_unclear", "infected_customer", "normal_traffic",
                   "mitigation_correct", "mitigation_wrong", "unknown")


# --- baseline and local peaks -----------------------------------------------


def baseline(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """p95 and p99 by linear interpolation; under three points the maximum.

    A series has one row per time bucket, so the exact percentile holds few values.
    """
    number = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    few = F.count(F.lit(1)) < 3
    cuts = F.percentile(number, F.array(F.lit(0.95), F.lit(0.99)))
    return series.groupBy(*keys).agg(
        F.when(few, F.max(number)).otherwise(cuts[0]).alias("baseline_p95"),
        F.when(few, F.max(number)).otherwise(cuts[1]).alias("baseline_p99"),
    )


def with_baseline(series: DataFrame, keys: list[str], override: float | tuple[float, float] | None = None) -> DataFrame:
    """Series rows with their baseline; an override replaces the learned one."""
    if override is not None:
        p95, p99 = override if isinstance(override, tuple) else (override, override)
        return series.withColumns({"baseline_p95": F.lit(float(p95)), "baseline_p99": F.lit(float(p99 or p95))})
    return series.join(baseline(series, keys), keys, "left")


def threshold(p95: Column, p99: Column, explicit: Column | None = None, sensitivity: str = "medium") -> Column:
    """An explicit positive threshold, else the larger of p99 and p95 times the sensitivity factor."""
    learned = F.greatest(p99, p95 * F.lit(scalars.sensitivity_factor_literal(sensitivity)))
    return learned if explicit is None else F.when(explicit > 0, explicit.cast("double")).otherwise(learned)


def local_peaks(series: DataFrame, keys: list[str], ts: str = "bucket", value: str = "value") -> DataFrame:
    """Points at or above ``threshold_used`` that no neighbour exceeds; a plateau gives several rows."""
    number = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    around = ordered_scan(
        series, keys, time_chunk(ts, SCAN_CHUNK_SECONDS), [ts], {"__prev": ("prev", number), "__next": ("next", number)}
    )
    is_peak = (
        (number >= F.col("threshold_used"))
        & (number >= F.coalesce("__prev", F.lit(-1.0)))
        & (number >= F.coalesce("__next", F.lit(-1.0)))
    )
    score = F.when(F.col("baseline_p95") > 0, number / F.col("baseline_p95")).otherwise(number)
    return (
        around.filter(is_peak)
        .withColumns({"peak_value": number, "score": F.bround(score, 3), "peak_time": F.col(ts)})
        .drop("__prev", "__next")
    )


def top_peaks(peaks: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """Peaks ranked within their series; with ``k`` the best ones, of which Spark keeps ``k`` per key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("peak_value"), "peak_time")
    ranked = peaks.withColumn("peak_rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("peak_rank") <= max(1, int(k)))


# --- evidence ----------------------------------------------------------------

PEAK_KEYS = ["sensor", "interface_id", "direction", "peak_time"]


def vector_cells(flows: DataFrame, grid_seconds: int) -> DataFrame:
    """Packets and bytes of each vector, pair of interfaces and recorded rate by ``__cell`` of time.

    Cells are the points of a grid of time and the open spans between them, numbered in turn: a
    window whose ends lie on the grid is a run of whole cells, whatever times its flows have.
    """
    micros, step = F.unix_micros("flow_time"), int(grid_seconds) * 1_000_000
    past = F.pmod(micros, F.lit(step))
    cell = ((micros - past) / step).cast("bigint") * 2 + F.when(past > 0, 1).otherwise(0)
    named = valid_vector(flows.withColumn("protocol", scalars.vector_protocol(F.col("proto"))))
    return named.groupBy("sensor", "exporter_ip", "input_if", "output_if", "sample_rate", "proto", "dst_ip", "dst_port", cell.alias("__cell")).agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes")
    )


def leading_vectors(
    peaks: DataFrame, cells: DataFrame, current: DataFrame, direction: str, grid_seconds: int, windows: tuple[int, ...] = EVIDENCE_WINDOWS
) -> DataFrame:
    """The vectors with the largest share of packets or bytes around each peak, all that tie, with the totals of the window.

    ``cells`` come from ``vector_cells``; peaks lie on its grid and so do ``windows``.  A vector has
    running sums over its cells in each bin of peaks, so a window is the difference of two of them
    and no flow meets a peak: there is a row for each vector, peak and window, however many flows.
    ``peaks`` carry ``whole`` and ``protocols`` as in ``peak_evidence``.
    """
    side = interface_column(direction)
    widest, grid = max(windows), int(grid_seconds)
    size = 4 * widest
    each_bin, margin = 2 * size // grid, 2 * widest // grid
    length = each_bin + 2 * margin
    place = ["sensor", "interface_id", "__bin"]
    same = lambda other: [F.col(c) == F.col(f"__{other}_{c}") for c in place]
    named = lambda other: [F.col(c).alias(f"__{other}_{c}") for c in place]
    asked = staged(peaks.select("sensor", "interface_id", F.floor(F.unix_seconds("peak_time") / size).alias("__bin"), "peak_time", "whole", "protocols"))
    rated = rates.with_rate(cells, current, "output" if side == "output_if" else "input")
    bins = F.sequence(F.floor((F.col("__cell") - margin) / each_bin), F.floor((F.col("__cell") + margin) / each_bin))
    scaled = lambda c: F.coalesce(F.col(c) * F.col("rate"), F.lit(0))
    key = [*place, "proto", "dst_ip", "dst_port"]
    spread = rated.select(
        "sensor", F.col(side).alias("interface_id"), "proto", "dst_ip", "dst_port", "__cell", scaled("packets").alias("p"), scaled("bytes").alias("b"), F.explode(bins).alias("__bin")
    )
    near = spread.join(asked.select(*named("a")).distinct(), same("a"), "left_semi")
    at = (F.col("__cell") - F.col("__bin") * each_bin + margin).cast("int").alias("at")
    each = near.repartition(*key).groupBy(*key, at).agg(F.sum("p").alias("p"), F.sum("b").alias("b"))
    own = Window.partitionBy(*key).orderBy("at")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = each.select(
        *key, "at", (F.coalesce(F.lead("at").over(own), F.lit(length)) - F.col("at")).alias("n"), F.row_number().over(own).cast("bigint").alias("rows"),
        F.sum("p").over(upto).alias("packets"), F.sum("b").over(upto).alias("bytes"),
    )
    lists = steps.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "n", "rows", "packets", "bytes"))).alias("__steps"))
    before = F.array_repeat(F.lit(0).cast("bigint"), F.col("__steps")[0]["at"] + 1)
    held = lambda c: F.transform("__steps", lambda x: F.array_repeat(x[c], x["n"]))
    measures = ["rows", "packets", "bytes"]
    running = [F.concat(before, F.flatten(held(c))).alias(f"__{c}") for c in measures]
    sums = staged(lists.select(*key, *running))
    # A bin holds as many peaks as buckets, and a peak as many protocols as there are.
    none = F.array().cast("array<int>")
    scopes = F.concat(F.when(F.coalesce("whole", F.lit(False)), F.array(F.lit(-1))).otherwise(none), F.array_remove(F.coalesce("protocols", none), -1))
    centre = (F.unix_micros("peak_time") / (grid * 1_000_000)).cast("bigint") * 2 - F.col("__bin") * each_bin + margin
    reach = (F.col("window_seconds") * 2 / grid).cast("int")
    found = ["scope", "peak_time", "window_seconds"]
    spans = asked.select(*place, "peak_time", F.explode(scopes).alias("scope")).select("*", F.explode(F.array(*[F.lit(w) for w in windows])).alias("window_seconds"))
    spans = spans.select(*place, *found, (centre - reach).cast("int").alias("low"), (centre + reach + 1).cast("int").alias("high"))

    def around(rows: DataFrame, told: list[str]) -> DataFrame:
        """Sums of every vector in the windows of ``rows`` that hold some of its flows."""
        listed = staged(rows.groupBy(*named("w")).agg(F.collect_list(F.struct(*found, *told, "low", "high")).alias("__wanted")))
        met = sums.join(listed, same("w")).select(*key, *[f"__{c}" for c in measures], F.explode("__wanted").alias("__w"))
        own = met.filter((F.col("__w.scope") == -1) | (F.col("__w.scope") == F.col("proto").cast("int")))
        inside = F.struct(*[(F.col(f"__{c}")[F.col("__w.high")] - F.col(f"__{c}")[F.col("__w.low")]).alias(c) for c in measures])
        # Taken as a row of its own, sums are not worked out again by each condition on them.
        return own.select(*key, "__w", F.explode(F.array(inside)).alias("__s")).select(*key, *[f"__w.{c}" for c in [*found, *told]], "__s.*").filter("rows > 0")

    sides = ("packets", "bytes")
    totals = around(spans, []).groupBy(*place, *found).agg(
        *[f(c).alias(f"{n}_{c}") for c in sides for n, f in (("all", F.sum), ("most", F.max), ("least", F.min))]
    )
    # Shares rise with the sums, or fall where the total is negative.
    best = [F.greatest(*[scalars.pct(F.col(f"{n}_{c}"), F.col(f"all_{c}"), None) for n in ("most", "least")]).alias(f"best_{c}") for c in sides]
    limits = spans.join(totals, [*place, *found]).select(*place, *found, "low", "high", *[f"all_{c}" for c in sides], *best)
    known = around(limits, [f"{n}_{c}" for c in sides for n in ("all", "best")])
    leads = [scalars.pct(F.col(c), F.col(f"all_{c}"), None) == F.col(f"best_{c}") for c in sides]
    return known.filter(leads[0] | leads[1]).select(*place, F.lit(direction).alias("direction"), *found, "dst_ip", "dst_port", "proto", *[f"all_{c}" for c in sides])


def peak_evidence(
    peaks: DataFrame, flows: DataFrame, current: DataFrame, direction: str, windows: tuple[int, ...] = EVIDENCE_WINDOWS,
    leads: DataFrame | None = None,
) -> DataFrame:
    """5-tuple totals of the flows around each peak, once per evidence window.

    Peaks are listed for each ``(sensor, interface, time bin)``; a flow looks up its bins and
    takes along the peaks that lie near.  Flows are dealt once by interface, bin of the peaks,
    source and destination, and counted for each peak and window only where they arrive:
    pairs of flow and peak are never shuffled.

    ``peaks`` may carry ``whole`` and ``protocols``: evidence then has the column ``scope``, -1
    for peaks of all protocols (``whole``) and the number of each protocol in ``protocols``.
    It keeps ``__bin`` then: groups that hold it and the source are added up where the rows are.

    With ``leads`` (see ``leading_vectors``) evidence is that of the named vectors, peaks, scopes
    and windows alone: a flow whose vector leads nowhere near meets no peak.
    """
    side = interface_column(direction)
    widest = max(windows)
    size = 4 * widest
    if leads is not None:
        return _lead_evidence(leads, flows, current, side, widest, size)
    at = F.col("peak_time")
    scoped = "protocols" in peaks.columns
    place = ["sensor", "interface_id", "__bin"]
    asked = [F.col("whole"), F.col("protocols")] if scoped else [F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("protocols")]
    # A bin holds as many peaks as buckets, and a peak as many protocols as there are.
    lists = (
        peaks.select("sensor", "interface_id", F.floor(F.unix_seconds(at) / size).alias("__bin"), "direction", "peak_time", *asked)
        .groupBy(*[F.col(c).alias(f"__p_{c}") for c in place]).agg(F.collect_list(F.struct("direction", "peak_time", "whole", "protocols")).alias("__peaks"))
    )
    second = F.unix_seconds("flow_time")
    bins = F.sequence(F.floor((second - widest) / size), F.floor((second + widest + 1) / size))
    five = ["src_ip", "src_port", "dst_ip", "dst_port", "proto"]
    carried = ["flow_time", "exporter_ip", "input_if", "output_if", "sample_rate", "bytes", "packets", "flow_count", *five]
    spread = flows.select("sensor", F.col(side).alias("interface_id"), *carried, F.explode(bins).alias("__bin"))
    met = spread.join(lists, [F.col(c) == F.col(f"__p_{c}") for c in place])
    micros = F.unix_micros("flow_time")

    def taken(peak: Column) -> Column:
        """Time of the peak, and whether the flow counts for all protocols and for its own."""
        own = F.coalesce(F.array_contains(peak["protocols"], F.col("proto").cast("int")), F.lit(False))
        return F.struct(peak["direction"].alias("direction"), peak["peak_time"].alias("peak_time"), peak["whole"].alias("whole"), own.alias("own"))

    near = F.filter("__peaks", lambda p: F.abs(micros - F.unix_micros(p["peak_time"])) <= widest * 1_000_000)
    told = F.filter(F.transform(near, taken), lambda p: p["whole"] | p["own"])
    looked = met.select(*place, *carried, told.alias("__near")).filter(F.size("__near") > 0)
    rated = rates.with_rate(looked, current, "output" if side == "output_if" else "input")
    dealt = rated.repartition(*place, "src_ip", "dst_ip", "dst_port")
    pairs = dealt.select("*", F.explode("__near").alias("__p")).select(*place, *carried, "rate", "__p.*")
    distance = F.abs(micros - F.unix_micros("peak_time")) / F.lit(1_000_000)
    covering = F.filter(F.array(*[F.lit(w) for w in sorted(windows)]), lambda w: distance <= w)
    scopes = F.array_compact(F.array(F.when(F.col("whole"), F.lit(-1)), F.when(F.col("own"), F.col("proto").cast("int"))))
    counted = pairs.withColumn("window_seconds", F.explode(covering))
    sums = _evidence_sums(counted, [*place, "direction", "peak_time", "window_seconds", "whole", "own", *five])
    if scoped:
        return sums.withColumn("scope", F.explode(scopes)).drop("whole", "own")
    return sums.drop("__bin", "whole", "own")


def _evidence_sums(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of each 5-tuple; ``counted`` carry ``rate`` and ``window_seconds``."""
    seconds = F.col("window_seconds") * 2
    return (
        counted.groupBy(*keys)
        .agg(
            F.min("input_if").alias("input_if"),
            F.min("output_if").alias("output_if"),
            F.min("flow_time").alias("first_seen"),
            F.max("flow_time").alias("last_seen"),
            F.sum("bytes").alias("raw_bytes"),
            F.sum("packets").alias("raw_packets"),
            F.max("sample_rate").alias("db_sample_rate"),
            F.max("rate").alias("effective_sample_rate"),
            F.sum(F.col("bytes") * F.col("rate")).alias("bytes"),
            F.sum(F.col("packets") * F.col("rate")).alias("packets"),
            F.sum("flow_count").alias("flow_count"),
        )
        .withColumns({"packets_s": F.col("packets") / seconds, "bits_s": F.col("bytes") * 8 / seconds})
    )


def _lead_evidence(leads: DataFrame, flows: DataFrame, current: DataFrame, side: str, widest: int, size: int) -> DataFrame:
    """Evidence of the windows in ``leads``: their vectors' flows, dealt once by source and target and counted where they arrive."""
    place = ["sensor", "interface_id", "__bin"]
    key = [*place, "dst_ip", "dst_port", "proto"]
    five = ["src_ip", "src_port", "dst_ip", "dst_port", "proto"]
    carried = ["flow_time", "exporter_ip", "input_if", "output_if", "sample_rate", "bytes", "packets", "flow_count", *five]
    second, micros = F.unix_seconds("flow_time"), F.unix_micros("flow_time")
    bins = F.sequence(F.floor((second - widest) / size), F.floor((second + widest + 1) / size))
    lists = staged(
        leads.groupBy(*[F.col(c).alias(f"__p_{c}") for c in key]).agg(F.collect_list(F.struct("direction", "peak_time", "scope", "window_seconds")).alias("__leads"))
    )
    # Numbers that stand for the keys, small enough to be sent to the flows; the keys are compared after.
    code = lambda prefix: F.xxhash64(*[F.col(f"{prefix}{c}").cast("string") for c in key])
    codes = staged(lists.select(code("__p_").alias("__code")).distinct())
    spread = flows.select("sensor", F.col(side).alias("interface_id"), *carried, F.explode(bins).alias("__bin"))
    few = spread.join(codes, code("") == F.col("__code"), "left_semi")
    met = few.join(lists, [F.col(c) == F.col(f"__p_{c}") for c in key])
    near = F.filter("__leads", lambda x: F.abs(micros - F.unix_micros(x["peak_time"])) <= x["window_seconds"] * 1_000_000)
    looked = met.select(*place, *carried, near.alias("__near")).filter(F.size("__near") > 0)
    rated = rates.with_rate(looked, current, "output" if side == "output_if" else "input")
    dealt = rated.repartition(*place, "src_ip", "dst_ip", "dst_port")
    counted = dealt.select("*", F.explode("__near").alias("__p")).select(*place, *carried, "rate", "__p.*")
    return _evidence_sums(counted, [*place, "direction", "peak_time", "window_seconds", "scope", *five])


def top_peak_flows(evidence: DataFrame, keys: list[str], metric: str = "packets_s", k: int = MAX_PEAK_FLOWS) -> DataFrame:
    """A listing of the ``k`` heaviest 5-tuples per peak and window; totals and classes take all evidence."""
    order = Window.partitionBy(*keys).orderBy(
        F.desc(metric), F.desc("packets"), F.desc("bytes"), "src_ip", "src_port", "dst_ip", "dst_port", "proto"
    )
    return evidence.withColumn("flow_rank", F.row_number().over(order)).filter(F.col("flow_rank") <= k)


def vector_sums(flows: DataFrame, keys: list[str]) -> DataFrame:
    """Attack-vector groups by destination, port and protocol with totals and peak rates."""
    named = valid_vector(flows.withColumn("protocol", scalars.vector_protocol(F.col("proto"))))
    vector = [*keys, "dst_ip", "dst_port", "protocol"]
    return named.groupBy(*vector).agg(
        F.sum("packets").alias("total_packets"),
        F.sum("bytes").alias("total_bytes"),
        F.sum("raw_packets").alias("raw_packets"),
        F.sum("raw_bytes").alias("raw_bytes"),
        F.max("packets_s").alias("max_packets_s"),
        F.max("bits_s").alias("max_bits_s"),
        F.max("effective_sample_rate").alias("effective_sample_rate"),
        F.count_distinct("src_ip").alias("unique_src_count"),
    )


def vector_groups(flows: DataFrame, keys: list[str], metric: str = "packets_s") -> DataFrame:
    """Attack-vector groups by destination, port and protocol with totals, peak rates and shares.

    ``flows`` are evidence rows; ``window_seconds`` x 2 is the time they span.  The
    list of sources belongs to ``vector_sources``; here they are counted.
    """
    return with_shares(vector_sums(flows, keys), keys)


def with_shares(groups: DataFrame, keys: list[str], totals: DataFrame | None = None) -> DataFrame:
    """``vector_sums`` with the share of each group and its mean rates; ``totals`` where ``groups`` are not all."""
    if totals is None:
        totals = groups.groupBy(*keys).agg(
            F.sum("total_packets").alias("all_packets"), F.sum("total_bytes").alias("all_bytes")
        )
    span = F.col("window_seconds") * 2 if "window_seconds" in keys else F.lit(1)
    return groups.join(totals, keys).withColumns(
        {
            "total_bits": F.col("total_bytes") * 8,
            "share_packets": scalars.pct(F.col("total_packets"), F.col("all_packets"), None),
            "share_bits": scalars.pct(F.col("total_bytes"), F.col("all_bytes"), None),
            "avg_packets_s": F.col("total_packets") / span,
            "avg_bits_s": F.col("total_bytes") * 8 / span,
        }
    )


def vector_sources(flows: DataFrame, keys: list[str]) -> DataFrame:
    """Sources of each vector group, one row each: never a list that grows with the attack."""
    named = valid_vector(flows.withColumn("protocol", scalars.vector_protocol(F.col("proto"))))
    return named.groupBy(*keys, "dst_ip", "dst_port", "protocol", "src_ip").agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes")
    )


def top_endpoints(flows: DataFrame, keys: list[str], side: str = "src_ip", k: int = MAX_ENDPOINTS) -> DataFrame:
    """The ``k`` heaviest sources or destinations per key with their shares."""
    by_end = flows.filter(F.coalesce(F.col(side), F.lit("")) != "").groupBy(*keys, side).agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes")
    )
    totals = by_end.groupBy(*keys).agg(F.sum("packets").alias("__p"), F.sum("bytes").alias("__b"))
    order = Window.partitionBy(*keys).orderBy(F.desc("bytes"), F.desc("packets"), side)
    return (
        by_end.withColumn("endpoint_rank", F.row_number().over(order))
        .filter(F.col("endpoint_rank") <= k)
        .join(totals, keys)
        .withColumns(
            {
                "share_packets": scalars.pct(F.col("packets"), F.col("__p")),
                "share_bytes": scalars.pct(F.col("bytes"), F.col("__b")),
            }
        )
        .drop("__p", "__b")
    )


def sufficient(share: Column, packets: Column, size: Column) -> Column:
    return (share >= MIN_EVIDENCE_SHARE) & ((packets >= MIN_EVIDENCE_PACKETS) | (size >= MIN_EVIDENCE_BYTES))


def classify(complete: Column, protocol: Column, dst_port: Column, sources: Column, direction: Column) -> Column:
    """Class of a dominant group; anything without complete evidence stays unclassified."""
    sends = direction.isin(*sorted(SENDS))
    udp = protocol == "udp"
    return (
        F.when(~F.coalesce(complete, F.lit(False)), "insufficient_flow_evidence")
        .when(udp & (dst_port == 53) & sends, "dns_udp_abuse_outbound")
        .when(udp & (sources >= 2) & sends, "udp_flood_outbound_to_single_destination_port")
        .when(protocol == "tcp", "tcp_syn_flood_to_single_destination_port")
        .when(protocol == "icmp", "icmp_flood")
        .when(udp, "aggregate_udp_without_dominant_vector")
        .otherwise("insufficient_flow_evidence")
    )


def dominant_groups(groups: DataFrame, keys: list[str], metric: str = "packets_s") -> DataFrame:
    """The leading group per key with evidence status and class."""
    share, top = ("share_bits", "max_bits_s") if metric == "bits_s" else ("share_packets", "max_packets_s")
    order = Window.partitionBy(*keys).orderBy(F.desc(share), F.desc(top), "dst_ip", "dst_port", "protocol")
    lead = groups.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")
    complete = sufficient(F.col(share), F.col("total_packets"), F.col("total_bytes"))
    return lead.withColumns(
        {
            "dominant_share": F.col(share),
            "evidence_status": F.when(complete, "complete").otherwise("insufficient"),
            "classification": classify(
                complete, F.col("protocol"), F.col("dst_port"), F.col("unique_src_count"), F.col("direction")
            ),
        }
    )


def best_window(dominants: DataFrame, keys: list[str]) -> DataFrame:
    """Narrowest window with complete evidence, else the one with the largest share (earlier wins ties)."""
    complete = F.col("evidence_status") == "complete"
    order = F.struct(
        (~complete).alias("a"),
        F.when(complete, F.col("window_seconds")).otherwise(0).alias("b"),
        (-F.col("dominant_share")).alias("c"),
        F.col("window_seconds").alias("d"),
    )
    rest = [c for c in dominants.columns if c not in keys]
    best = dominants.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("w"))
    return best.select(*keys, *[F.col(f"w.{c}").alias("evidence_window_used" if c == "window_seconds" else c) for c in rest])


def best_peak(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """One peak per series: complete evidence first, then the highest score."""
    order = F.struct(
        (F.col("evidence_status") != "complete").alias("a"), (-F.col("score")).alias("b"),
        (-F.col("peak_value")).alias("c"), F.col("peak_time").alias("d"),
    )
    rest = [c for c in peaks.columns if c not in keys]
    return peaks.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("p")).select(*keys, "p.*")


# Recommendation reasons.
REASON_NO_EVIDENCE = "Sem evidencia de flow suficiente para identificar vetor dominante."
REASON_SAFE = "Candidato seguro gerado para revisao manual; aplicacao automatica desativada."
REASON_INVALID = "Grupo dominante encontrado, mas candidato nao passou na validacao."


def recommend(status: Column, allowed: Column) -> dict[str, Column]:
    complete = F.coalesce(status == "complete", F.lit(False))
    allowed = F.coalesce(allowed, F.lit(False))
    return {
        "recommended_action": F.when(complete & allowed, "manual_review").otherwise("alert_only"),
        "recommendation_reason": F.when(~complete, REASON_NO_EVIDENCE)
        .when(allowed, REASON_SAFE)
        .otherwise(REASON_INVALID),
    }


# --- cases -------------------------------------------------------------------


def case_record(peaks: DataFrame, metric: str, protocol: str = "") -> DataFrame:
    """Case history rows: request, peak, verdict and the flattened dominant group."""
    zero = F.lit(0.0)
    return peaks.select(
        scalars.stable_key(
            "case", sensor=F.col("sensor"), interface_id=F.col("interface_id"), direction=F.col("direction"),
            metric=F.lit(metric), peak_time=scalars.utc_text(F.col("peak_time")),
        ).alias("case_key"),
        "peak_time",
        scalars.utc_text(F.col("peak_time")).alias("peak_time_utc"),
        scalars.local_ts(F.col("peak_time")).alias("peak_time_local"),
        F.lit(scalars.LOCAL_ZONE).alias("timezone"),
        "sensor",
        "interface_id",
        "direction",
        F.lit(metric).alias("metric"),
        F.lit(protocol).alias("protocol"),
        F.coalesce("peak_value", zero).alias("peak_value"),
        F.coalesce("baseline_p95", zero).alias("baseline_p95"),
        F.coalesce("baseline_p99", zero).alias("baseline_p99"),
        F.coalesce("threshold_used", zero).alias("threshold_used"),
        F.coalesce("score", zero).alias("score"),
        F.coalesce("evidence_status", F.lit("insufficient")).alias("evidence_status"),
        F.coalesce("classification", F.lit("insufficient_flow_evidence")).alias("classification"),
        F.coalesce("mitigation_allowed", F.lit(False)).alias("mitigation_allowed"),
        "recommended_action",
        "evidence_window_used",
        F.coalesce("dst_ip", F.lit("")).alias("dominant_dst_ip"),
        F.col("dst_port").alias("dominant_dst_port"),
        F.coalesce("protocol", F.lit("")).alias("dominant_protocol"),
        F.coalesce("unique_src_count", F.lit(0)).alias("dominant_unique_src_count"),
        F.coalesce("share_packets", zero).alias("dominant_share_packets"),
        F.coalesce("share_bits", zero).alias("dominant_share_bits"),
        F.lit("manual").alias("analysis_source"),
        F.lit(False).alias("is_negative_sample"),
    )


SERIES_KEYS = ["sensor", "interface_id", "direction", "metric", "classification"]


def dedupe_peaks(new: DataFrame, history: DataFrame, seconds: int = DUPLICATE_SECONDS) -> DataFrame:
    """Mark new peaks that repeat a stored case of the same series and class within five minutes.

    The join key includes a time bin; each stored case is listed under its own and the two
    neighbouring bins, so the exact bounds are checked on candidates only.
    """
    bin_of = F.floor(F.unix_seconds("peak_time") / seconds)
    stored = history.select(
        *[F.col(k).alias(f"__{k}") for k in SERIES_KEYS],
        F.col("peak_time").alias("__time"),
        F.col("id").alias("__id"),
        F.explode(F.sequence(bin_of - 1, bin_of + 1)).alias("__bin"),
    )
    dated = new.withColumn("__new_bin", bin_of)
    same = F.col("__new_bin") == F.col("__bin")
    for k in SERIES_KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    apart = F.abs(F.unix_micros("peak_time") - F.unix_micros("__time")) <= seconds * 1_000_000
    # Reduce the matches to one stored id per new peak before attaching it.
    hits = dated.join(stored, same & apart).groupBy(*SERIES_KEYS, "peak_time").agg(F.min("__id").alias("duplicate_of_id"))
    key = [F.col(f"n.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*SERIES_KEYS, "peak_time"]]
    return new.alias("n").join(hits.alias("h"), key, "left").select("n.*", "h.duplicate_of_id")


def batch_duplicates(new: DataFrame, seconds: int = DUPLICATE_SECONDS) -> DataFrame:
    """Inside one batch, keep the first peak of each run whose neighbours are at most five minutes apart."""
    before = ordered_scan(
        new, SERIES_KEYS, time_chunk("peak_time", SCAN_CHUNK_SECONDS), ["peak_time"], {"__prev": ("prev", F.col("peak_time"))}
    )
    gap = F.unix_seconds("peak_time") - F.unix_seconds("__prev")
    return before.withColumn("is_duplicate", F.coalesce(gap <= seconds, F.lit(False))).drop("__prev")


def history(cases: DataFrame, filters: dict, limit: int | None = None) -> DataFrame:
    """Stored cases by equality filters and a time range, newest first; all of them unless a limit is asked for."""
    text = ("sensor", "direction", "metric", "protocol", "evidence_status", "classification", "operator_label", "analysis_source")
    for column in text:
        if str(filters.get(column) or "").strip():
            cases = cases.filter(F.col(column) == str(filters[column]).strip())
    for column in ("mitigation_allowed", "is_negative_sample"):
        if filters.get(column) not in (None, ""):
            wanted = filters[column] in (True, 1, "1", "true", "True", "sim", "yes")
            cases = cases.filter(F.col(column).cast("boolean") == wanted)
    for column in ("interface_id", "job_id", "run_id"):
        if filters.get(column) not in (None, ""):
            cases = cases.filter(F.col(column) == int(filters[column]))
    if filters.get("start_time"):
        cases = cases.filter(F.col("peak_time") >= F.to_timestamp(F.lit(str(filters["start_time"]))))
    if filters.get("end_time"):
        cases = cases.filter(F.col("peak_time") <= F.to_timestamp(F.lit(str(filters["end_time"]))))
    ties = [F.desc(c) for c in ("created_at", "id", "case_key") if c in cases.columns]
    ordered = cases.orderBy(F.desc("peak_time"), *ties)
    return ordered if limit is None else ordered.limit(max(1, int(limit)))


def apply_feedback(cases: DataFrame, feedback: DataFrame) -> DataFrame:
    """Newest valid operator feedback per case; unknown labels are refused, not stored."""
    fields = ["operator_label", "operator_vector", "operator_best_action", "operator_comment", "resolved_by_mitigation"]
    label = F.trim(F.coalesce("operator_label", F.lit("")))
    valid = feedback.filter((label == "") | label.isin(*OPERATOR_LABELS))
    newest = valid.groupBy(F.col("id").alias("__id")).agg(
        F.max_by(F.struct(*fields, "feedback_updated_at"), "feedback_updated_at").alias("__f")
    )
    kept = [c for c in cases.columns if c not in [*fields, "feedback_updated_at"]]
    joined = cases.join(newest, F.col("id") == F.col("__id"), "left")
    return joined.select(*kept, *[F.col(f"__f.{c}").alias(c) for c in [*fields, "feedback_updated_at"]])


def draft_reason(cases: DataFrame, needs_candidate: bool = False) -> Column:
    """Why a stored case may not become an action; null when it may.

    A safe candidate is one whose action is more than an alert: ``candidate_action`` where cases
    have it, else the verdict ``mitigation_allowed``.  A technical report is asked for where
    cases have the column.
    """
    reason = (
        F.when(F.col("evidence_status").isin("insufficient", "no_peak"), "insufficient_evidence")
        .when(F.coalesce("dominant_dst_ip", F.lit("")) == "", "no_dominant_group")
        .when(F.coalesce("classification", F.lit("")) == "", "no_classification")
    )
    if needs_candidate:
        if "candidate_action" in cases.columns:
            safe = F.coalesce("candidate_action", F.lit("alert_only")) != "alert_only"
        else:
            safe = F.coalesce("mitigation_allowed", F.lit(False))
        reason = reason.when(~safe, "no_safe_candidate")
    if "technical_report" in cases.columns:
        reason = reason.when(F.coalesce("technical_report", F.lit("")) == "", "no_technical_report")
    return reason


def draft_rules(cases: DataFrame) -> DataFrame:
    """Disabled draft detection rules from stored cases; a case that may not become one carries a reason."""
    sends = F.col("direction").isin(*sorted(SENDS))
    aggregate = F.col("classification") == "aggregate_udp_without_dominant_vector"
    p99, peak = F.coalesce("baseline_p99", F.lit(0.0)), F.coalesce("peak_value", F.lit(0.0))
    proto = F.upper(F.coalesce(F.nullif("dominant_protocol", F.lit("")), F.lit("udp")))
    port = F.when(F.col("dominant_dst_port") > 0, F.col("dominant_dst_port"))
    known = F.when(proto.isin("UDP", "TCP", "ICMP"), proto).otherwise("ALL")
    name = F.concat_ws("_", F.lit("PH_RULE"), F.nullif(scalars.slug(F.col("classification")), F.lit("")), port.cast("string"),
                       scalars.slug(F.lower(known)))
    interface = F.col("interface_id").cast("string")
    return cases.select(
        F.col("case_key").alias("source_case"),
        draft_reason(cases).alias("reason"),
        name.alias("vector"),
        F.when(sends, "internal_ip_to_dst").otherwise("internal_ip").alias("domain"),
        F.when(sends, "transmits").otherwise("receives").alias("direction"),
        known.alias("protocol"),
        "metric",
        F.lit("over").alias("comparison"),
        F.bround(F.greatest(p99 * 1.2, peak * 0.5), 2).alias("warning_value"),
        F.bround(F.greatest(p99 * 1.5, peak * 0.8), 2).alias("critical_value"),
        F.coalesce("evidence_window_used", F.lit(60)).alias("window_seconds"),
        F.lit(False).alias("enabled"),
        F.concat(F.col("dominant_dst_ip"), F.lit("/32")).alias("dst_cidr"),
        F.coalesce(port.cast("string"), F.lit("any")).alias("dst_port"),
        F.when(aggregate, "src_ip,dst_ip,dst_port,protocol").otherwise("dst_ip,dst_port,protocol").alias("group_by"),
        F.when(sends, F.lit("")).otherwise(interface).alias("input_if"),
        F.when(sends, interface).otherwise(F.lit("")).alias("output_if"),
        F.lit("manual_review").alias("mitigation_mode"),
        F.lit(1800).alias("ttl_seconds"),
    )


def draft_profiles(cases: DataFrame) -> DataFrame:
    """Disabled draft response profiles: what a manual block would select; it takes a safe candidate."""
    kind, proto = F.col("classification"), F.lower(F.coalesce(F.nullif("dominant_protocol", F.lit("")), F.lit("udp")))
    dns = kind == "dns_udp_abuse_outbound"
    aggregate = kind == "aggregate_udp_without_dominant_vector"
    port = F.when(F.col("dominant_dst_port") > 0, F.col("dominant_dst_port").cast("string"))
    protocol = (
        F.when(dns | aggregate | (kind == "udp_flood_outbound_to_single_destination_port"), "udp")
        .when(kind.contains("tcp"), "tcp")
        .when(kind.contains("icmp"), "icmp")
        .otherwise(proto)
    )
    icmp = ~dns & ~aggregate & ~kind.contains("tcp") & kind.contains("icmp")
    return cases.select(
        F.col("case_key").alias("source_case"),
        draft_reason(cases, needs_candidate=True).alias("reason"),
        F.concat_ws("_", F.lit("PH"), scalars.slug(kind), port, scalars.slug(proto)).alias("name"),
        F.when(aggregate, "src_and_dst_ip").otherwise("dst_ip").alias("target_selector"),
        F.when(protocol.isin("udp", "tcp", "icmp"), protocol).otherwise("anomaly_protocol").alias("protocol_selector"),
        F.when(icmp, "any").when(dns, "fixed").when(aggregate | port.isNull(), "anomaly_dst_port").otherwise("fixed").alias("dst_port_selector"),
        F.when(icmp, "").when(dns, "53").otherwise(F.coalesce(port, F.lit(""))).alias("dst_port_value"),
        F.lit("discard").alias("action"),
        F.lit("manual_approval").alias("approval_mode"),
        F.lit(1800).alias("default_duration_seconds"),
        F.lit(3600).alias("max_duration_seconds"),
        F.lit(False).alias("enabled"),
    )


def draft_vectors(rules: DataFrame) -> DataFrame:
    """Disabled draft attack vectors from draft rules, with the reason that a rule carries."""
    proto = F.lower("protocol")
    return rules.select(
        "source_case",
        "reason",
        F.col("vector").alias("name"),
        F.when(F.coalesce("dst_cidr", F.lit("")) != "", "external_ip").otherwise("any").alias("domain_type"),
        F.col("dst_cidr").alias("target_cidr"),
        "dst_port",
        F.when(proto.isin("udp", "tcp", "icmp"), proto).otherwise("any").alias("protocol"),
        F.when(F.col("direction") == "transmits", "sends").otherwise("receives").alias("direction"),
        F.when(proto.isin("udp", "tcp", "icmp"), F.upper(proto)).otherwise("IP").alias("decoder"),
        F.lit("over").alias("comparison"),
        F.col("warning_value").alias("threshold_value"),
        F.col("metric").alias("threshold_unit"),
        F.lit("warning").alias("severity"),
        F.lit("alert_only").alias("response_action"),
        "window_seconds",
        F.lit(False).alias("enabled"),
    )


def draft_playbooks(cases: DataFrame) -> DataFrame:
    """Disabled draft playbook entries; cases without evidence become investigations only."""
    aggregate = F.col("classification") == "aggregate_udp_without_dominant_vector"
    investigate = F.col("evidence_status").isin("insufficient", "no_peak") | ~F.coalesce("mitigation_allowed", F.lit(False))
    proto = F.coalesce(F.nullif("dominant_protocol", F.lit("")), F.lit("udp"))
    port = F.when(F.col("dominant_dst_port") > 0, F.col("dominant_dst_port").cast("string"))
    return cases.select(
        F.col("case_key").alias("source_case"),
        F.concat_ws("_", F.lit("PH_PLAYBOOK"), scalars.slug(F.col("classification")), port, scalars.slug(proto)).alias("name"),
        "classification",
        F.when(investigate, "manual_investigation").otherwise("complete").alias("evidence_requirement"),
        F.when(aggregate, "src_and_dst_ip").otherwise("dst_ip").alias("target_selector"),
        investigate.alias("investigation_only"),
        F.lit(False).alias("enabled"),
    )


def prefill(anomalies: DataFrame) -> DataFrame:
    """Analysis window of an anomaly: its span with two minutes around, else ten minutes about its centre."""
    span = F.col("started_at").isNotNull() & F.coalesce("ended_at", "last_seen_at").isNotNull()
    centre = F.coalesce("detected_at", "created_at", "last_seen_at")
    end_seen = F.coalesce("ended_at", "last_seen_at")
    start = F.when(span, F.col("started_at") - F.expr("INTERVAL 2 MINUTES")).otherwise(centre - F.expr("INTERVAL 5 MINUTES"))
    end = F.when(span, end_seen + F.expr("INTERVAL 2 MINUTES")).otherwise(centre + F.expr("INTERVAL 5 MINUTES"))
    fixed_end = F.when(end <= start, start + F.expr("INTERVAL 10 MINUTES")).otherwise(end)
    metric = F.when(F.col("metric").isin("packets_s", "bits_s"), F.col("metric")).otherwise("packets_s")
    direction = F.when(F.col("direction").isin("sends", "receives"), F.col("direction")).otherwise("sends")
    rest = [c for c in anomalies.columns if c not in ("metric", "direction")]
    return anomalies.select(
        *rest, metric.alias("metric"), direction.alias("direction"), start.alias("start_time"), fixed_end.alias("end_time")
    )


# --- scheduled scans ----------------------------------------------------------


def job_matrix(jobs: DataFrame, interfaces: DataFrame, now: Column) -> DataFrame:
    """Due jobs expanded to interface x direction x metric, numbered per job.

    A job without an interface takes every interface of its sensor (an equi-join on the sensor).
    """
    minutes = F.coalesce("interval_minutes", F.lit(60))
    due = F.col("last_run_at").isNull() | (F.unix_seconds(now) - F.unix_seconds("last_run_at") >= minutes * 60)
    spread = interfaces.filter("interface_id > 0").select(
        F.col("sensor").alias("__s"), F.col("interface_id").alias("__i")
    ).distinct()
    chosen = jobs.filter(due).withColumnRenamed("interface_id", "__own")
    own = chosen.filter("__own IS NOT NULL").withColumn("interface_id", F.col("__own"))
    every = chosen.filter("__own IS NULL").join(spread, F.col("sensor") == F.col("__s")).withColumn("interface_id", F.col("__i")).drop("__s", "__i")

    def both(column: str, pair: tuple[str, str]) -> Column:
        return F.explode(
            F.when(F.col(column) == "both", F.array(*[F.lit(p) for p in pair])).otherwise(F.array(F.coalesce(column, F.lit(pair[0]))))
        )

    runs = own.unionByName(every).drop("__own")
    runs = runs.withColumn("__d", both("direction", ("sends", "receives"))).withColumn("__m", both("metric", ("packets_s", "bits_s")))
    runs = runs.withColumns({"direction": F.col("__d"), "metric": F.col("__m")}).drop("__d", "__m")
    order = Window.partitionBy("job_id").orderBy("interface_id", F.desc("direction"), F.desc("metric"))
    number = F.coalesce("runs_count", F.lit(0)) + F.row_number().over(order)
    return runs.withColumns(
        {"run_number": number, "window_start": F.timestamp_micros(
            F.unix_micros(now) - F.coalesce("lookback_minutes", F.lit(60)).cast("bigint") * 60_000_000), "window_end": now}
    )


def relevant() -> Column:
    """Whether the best peak of a run reaches the job's floors."""
    return F.coalesce(
        F.col("score").isNotNull()
        & (F.col("score") >= F.coalesce("min_peak_score", F.lit(0.0)))
        & (F.col("min_peak_value").isNull() | (F.col("peak_value") >= F.col("min_peak_value"))),
        F.lit(False),
    )


def run_outcome(runs: DataFrame) -> DataFrame:
    """Status of each run from its best peak: success, skipped_duplicate, negative_sample or no_peak."""
    every = F.coalesce(F.nullif("negative_sample_interval_runs", F.lit(0)), F.lit(1))
    negative = F.coalesce(F.col("save_negative_samples").cast("boolean"), F.lit(False)) & (F.col("run_number") % every == 0)
    duplicate = F.lit(False)
    for column in ("duplicate_of_id", "duplicate_of_run"):
        if column in runs.columns:
            duplicate = duplicate | F.col(column).isNotNull()
    return runs.withColumn(
        "run_status",
        F.when(relevant() & duplicate, "skipped_duplicate").when(relevant(), "success").when(negative, "negative_sample").otherwise("no_peak"),
    )
