"""Subscribers behind carrier-grade NAT: resolution, sharing, conflicts and activation.

``mappings(batch_id, connector_id, public_ip, private_ip, protocol, port_start, port_end,
subscriber_id, subscriber_name, valid_from, valid_until, active, confidence)`` and
``batches(id, status, connector_id, approved_at, activated_at, valid_from, valid_until)``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.operators import ports
from weirgauge.operators.listing import first_rows
from weirgauge.session import staged


def live_mappings(mappings: DataFrame, batches: DataFrame) -> DataFrame:
    """Active mappings of active batches with the batch's approval time."""
    ready = batches.filter("status = 'active'").select(
        F.col("id").alias("batch_id"), F.coalesce("approved_at", "activated_at").alias("approved")
    )
    return mappings.filter(F.col("active").cast("boolean")).join(ready, "batch_id")


LOOKUP = ["public_ip", "public_port", "protocol_observed", "lookup_time", "connector"]
CELL = ["__ip", "lo", "hi", "since", "until", "proto", "conn"]


def _intervals(cuts: Column) -> Column:
    """Consecutive ``(since, until)`` between sorted cut points, open at both ends; ``until`` is not part of one."""
    kind = "array<bigint>"
    open_end = F.array(F.lit(None).cast("bigint"))
    return F.arrays_zip(F.concat(open_end.cast(kind), cuts).alias("since"), F.concat(cuts, open_end.cast(kind)).alias("until"))


class Cells(NamedTuple):
    """What any lookup answers, in two tables that a lookup meets one row of each."""

    pieces: DataFrame  # (__ip, port_bin, pieces): the pieces of ports in each bin of 64, as (lo, hi)
    answers: DataFrame  # (c_ip, c_lo, cells): for each piece, its answers by time, protocol and connector


def subscriber_cells(mappings: DataFrame, batches: DataFrame) -> Cells:
    """The answers to all lookups, from the mappings alone.

    The ports of an address are cut where a mapping begins or ends, and time where one becomes
    valid or expires.  In such a cell, for each protocol and connector that mappings
    there name (and for all others), every lookup has the same candidates.  They are ranked by
    exact protocol, exact connector, newest approval, batch and confidence; the connector
    ranks and does not filter.  The best rank with its lowest and with its highest identity
    come from two aggregates; if those differ the cell is ambiguous.
    """
    live = live_mappings(mappings, batches).withColumnRenamed("public_ip", "__ip")
    edges = live.groupBy(F.col("__ip").alias("e_ip")).agg(
        F.array_sort(F.array_union(F.collect_set("port_start"), F.collect_set(F.col("port_end") + 1))).alias("edges")  # port numbers
    )
    first, last = F.array_position("edges", F.col("port_start")), F.array_position("edges", F.col("port_end") + 1)
    spread = (
        live.join(edges, F.col("__ip") == F.col("e_ip"))
        .withColumn("i", F.explode(F.sequence(first, last - 1)))
        .withColumns(
            {
                "lo": F.get("edges", (F.col("i") - 1).cast("int")), "hi": F.get("edges", F.col("i").cast("int")) - 1,
                "e_since": F.unix_micros("valid_from"), "e_until": F.unix_micros("valid_until") + 1,
            }
        )
    )
    approved = F.coalesce(F.unix_micros("approved"), F.lit(0).cast("bigint"))
    confidence = F.coalesce("confidence", F.lit(0.0))
    who = F.struct(
        F.coalesce("private_ip", F.lit("")).alias("private_ip"), F.coalesce("subscriber_id", F.lit("")).alias("subscriber_id"),
        "port_start", "port_end",
    )
    rank = [approved, F.col("batch_id"), confidence]
    up = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], who.alias("who"), F.col("protocol").alias("p"), F.col("subscriber_name").alias("n"))
    down = F.struct(*[(-r).alias(f"r{i}") for i, r in enumerate(rank)], who.alias("who"))
    # Mappings of one span, protocol and connector answer the same cells: only their best and their number go on.
    entries = staged(
        spread.groupBy("__ip", "lo", "hi", "e_since", "e_until", "protocol", "connector_id")
        .agg(F.max(up).alias("up"), F.min(down).alias("down"), F.count(F.lit(1)).alias("n"))
    )
    ranges = entries.groupBy("__ip", "lo", "hi").agg(
        F.array_sort(F.array_union(F.collect_set("e_since"), F.collect_set("e_until"))).alias("times"),
        F.collect_set(F.when(F.col("protocol") != "any", F.col("protocol"))).alias("protocols"),
        F.collect_set(F.col("connector_id").cast("bigint")).alias("connectors"),
    )
    none = lambda kind: F.array(F.lit(None).cast(kind))
    cells = (
        ranges.withColumn("t", F.explode(_intervals(F.col("times"))))
        .withColumn("proto", F.explode(F.concat(F.col("protocols"), none("string"))))
        .withColumn("conn", F.explode(F.concat(F.col("connectors"), none("bigint"))))
        .select(F.col("__ip").alias("c_ip"), F.col("lo").alias("c_lo"), "t.since", "t.until", "proto", "conn")
    )
    match = (
        (F.col("__ip") == F.col("c_ip"))
        & (F.col("lo") == F.col("c_lo"))
        & (F.col("e_since").isNull() | F.coalesce(F.col("since") >= F.col("e_since"), F.lit(False)))
        & (F.col("e_until").isNull() | F.coalesce(F.col("until") <= F.col("e_until"), F.lit(False)))
        & ((F.col("protocol") == "any") | F.coalesce(F.col("protocol") == F.col("proto"), F.lit(False)))
    )
    exact_protocol = F.coalesce((F.col("protocol") == F.col("proto")).cast("int"), F.lit(0))
    exact_connector = F.coalesce((F.col("connector_id") == F.col("conn")).cast("int"), F.lit(0))
    best = F.max(F.struct(exact_protocol.alias("r0"), exact_connector.alias("r1"), "up"))
    least = F.min(F.struct((-exact_protocol).alias("r0"), (-exact_connector).alias("r1"), "down"))
    found = entries.join(cells, match).groupBy(*CELL).agg(
        best["up"].alias("hi_row"), least["down"].alias("lo_row"), F.sum("n").alias("match_count")
    )
    sure = F.col("hi_row.who") == F.col("lo_row.who")
    answer = F.struct(
        F.col("proto").isNull().alias("o1"), F.col("conn").isNull().alias("o2"), "since", "until", "proto", "conn",
        (~sure).alias("ambiguous"),
        F.when(sure, F.col("hi_row.who.private_ip")).alias("private_ip"),
        F.when(sure, F.nullif("hi_row.who.subscriber_id", F.lit(""))).alias("subscriber_id"),
        F.when(sure, F.col("hi_row.n")).alias("subscriber_name"),
        F.when(sure, F.col("hi_row.who.port_start")).alias("port_start"),
        F.when(sure, F.col("hi_row.who.port_end")).alias("port_end"),
        F.when(sure, F.col("hi_row.p")).alias("protocol"),
        F.when(sure, F.col("hi_row.r1")).alias("batch_id"),
        "match_count",
    )
    # Cells that name the protocol and the connector come before those for all others.
    answers = staged(found.groupBy(F.col("__ip").alias("c_ip"), F.col("lo").alias("c_lo")).agg(F.array_sort(F.collect_list(answer)).alias("cells")))
    binned = ranges.select("__ip", "lo", "hi", F.explode(ports.bins(F.col("lo"), F.col("hi"))).alias("port_bin"))
    pieces = staged(binned.groupBy("__ip", "port_bin").agg(F.collect_list(F.struct("lo", "hi")).alias("pieces")))  # 64 at most
    return Cells(pieces, answers)


def with_cell(rows: DataFrame, cells: Cells, lookup: dict[str, Column]) -> DataFrame:
    """Rows with the cell that answers them as ``__cell``, null where no mapping does.

    A row meets one row of each table at most, by address and port bin and by address and piece
    of ports: rows are read once and never multiply, and a public address that carries a
    third of the traffic is split over its bins and pieces.  The time only chooses inside a row.
    """
    named = rows.withColumns({f"__{c}": lookup[c] for c in LOOKUP})
    port, at = F.col("__public_port"), F.unix_micros("__lookup_time")
    in_range = F.when(port.between(0, 65535), ports.port_bin(port))
    placed = named.join(cells.pieces, (F.col("__public_ip") == F.col("__ip")) & (in_range == F.col("port_bin")), "left")
    piece = F.get(F.filter("pieces", lambda p: port.between(p["lo"], p["hi"])), F.lit(0))["lo"]
    joined = placed.withColumn("__lo", piece).join(cells.answers, (F.col("__public_ip") == F.col("c_ip")) & (F.col("__lo") == F.col("c_lo")), "left")

    def holds(c: Column) -> Column:
        return (
            (c["since"].isNull() | (c["since"] <= at))
            & (c["until"].isNull() | (c["until"] > at))
            & (c["proto"].isNull() | (c["proto"] == F.col("__protocol_observed")))
            & (c["conn"].isNull() | (c["conn"] == F.col("__connector")))
        )

    return joined.withColumn("__cell", F.get(F.filter("cells", holds), F.lit(0))).select(*rows.columns, "__cell")


ANSWER = ["private_ip", "subscriber_id", "subscriber_name", "port_start", "port_end", "protocol", "batch_id"]


def resolve_subscriber(lookups: DataFrame, mappings: DataFrame, batches: DataFrame) -> DataFrame:
    """The subscriber behind each distinct lookup; ``lookups`` holds the ``LOOKUP`` columns (``connector`` may be null)."""
    asked = lookups.select(*LOOKUP).distinct()
    found = with_cell(asked, subscriber_cells(mappings, batches), {c: F.col(c) for c in LOOKUP})
    return found.select(
        *LOOKUP,
        F.col("__cell").isNotNull().alias("matched"),
        F.coalesce("__cell.ambiguous", F.lit(False)).alias("ambiguous"),
        *[F.col(f"__cell.{c}").alias(c) for c in ANSWER],
        F.coalesce("__cell.match_count", F.lit(0)).alias("match_count"),
    )


def with_subscriber(flows: DataFrame, cells: Cells, lookup: dict[str, Column]) -> DataFrame:
    """Flows with the subscriber behind them, ``N/D`` where none is certain.

    ``cells`` come from ``subscriber_cells``; ``lookup`` gives each ``LOOKUP`` column as an
    expression on the flows.
    """
    who = F.coalesce("__cell.subscriber_id", "__cell.private_ip", F.lit("N/D"))
    return with_cell(flows, cells, lookup).withColumn("subscriber", who).select(*flows.columns, "subscriber")


def event_resolution(rows: DataFrame, cells: Cells, lookup: dict[str, Column], keys: list[str]) -> DataFrame:
    """``matched``, ``ambiguous`` and ``unique_private_subscribers`` of events, from the rows behind them.

    An event is matched when a row has a certain subscriber, and ambiguous when a row could
    have several.
    """
    cell = F.col("__cell")
    sure = cell.isNotNull() & ~F.coalesce(cell["ambiguous"], F.lit(False))
    who = F.concat_ws("|", F.coalesce(cell["private_ip"], F.lit("")), F.coalesce(cell["subscriber_id"], F.lit("")))
    return with_cell(rows, cells, lookup).groupBy(*keys).agg(
        F.max(sure).alias("matched"), F.max(F.coalesce(cell["ambiguous"], F.lit(False))).alias("ambiguous"),
        F.count_distinct(F.when(sure, who)).alias("unique_private_subscribers"),
    )


def shared_public_ip(lookups: DataFrame, mappings: DataFrame, batches: DataFrame) -> DataFrame:
    """Whether any live mapping of the address covers the time, on the connector or on none.

    Validity and connector belong to batches, so an address has few distinct spans: they
    are one row of the address, which each lookup meets once.
    """
    live = live_mappings(mappings, batches)
    span = F.struct(F.col("connector_id").cast("bigint").alias("connector_id"), "valid_from", "valid_until")
    spans = staged(live.groupBy(F.col("public_ip").alias("__ip")).agg(F.collect_set(span).alias("__spans")))
    asked = lookups.select("public_ip", "lookup_time", "connector").distinct()
    at = F.col("lookup_time")

    def covers(s: Column) -> Column:
        connector = F.col("connector").isNull() | s["connector_id"].isNull() | (s["connector_id"] == F.col("connector"))
        return connector & (s["valid_from"].isNull() | (s["valid_from"] <= at)) & (s["valid_until"].isNull() | (s["valid_until"] >= at))

    hit = F.coalesce(F.exists("__spans", covers), F.lit(False))
    joined = asked.join(spans, F.col("public_ip") == F.col("__ip"), "left")
    return joined.select("public_ip", "lookup_time", "connector", hit.alias("shared_public_ip"))


def addressing_mode(events: DataFrame) -> DataFrame:
    """How the subscriber of an event is addressed and what that means for automatic action.

    Expects ``configured_mode`` (direct_public, cgnat, mixed, auto), ``prefix_type`` of the zone
    prefix that holds the address (null outside), and ``matched``, ``ambiguous`` and
    ``unique_private_subscribers`` of the resolution.  ``addressing_mode`` is the short name
    that filters take: direct, cgnat or unresolved.
    """
    mode = F.coalesce("configured_mode", F.lit("auto"))
    nat_prefix = F.coalesce(F.col("prefix_type") == "public_cgnat", F.lit(False))
    mapped = F.coalesce("matched", F.lit(False))
    inside = F.col("prefix_type").isNotNull()
    effective = (
        F.when(mode.isin("direct_public", "cgnat"), mode)
        .when(mode == "mixed", F.when(nat_prefix, "cgnat").otherwise("direct_public"))
        .when(nat_prefix | mapped, "cgnat")
        .when(inside, "direct_public")
        .otherwise("unresolved")
    )
    reason = (
        F.when(mode.isin("direct_public", "cgnat"), F.concat(F.lit("configured_"), mode))
        .when(mode == "mixed", F.when(nat_prefix, "mixed_cgnat_prefix").otherwise("mixed_direct_prefix"))
        .when(nat_prefix, "auto_cgnat_zone_prefix")
        .when(mapped, "auto_cgnat_mapping")
        .when(inside, "auto_direct_zone_prefix")
        .otherwise("auto_subscriber_addressing_not_determined")
    )
    out = events.withColumns({"effective_mode": effective, "addressing_reason": reason})
    nat = F.col("effective_mode") == "cgnat"
    block = (
        F.when(F.col("effective_mode") == "unresolved", "auto_subscriber_addressing_not_determined")
        .when(nat & F.coalesce("ambiguous", F.lit(False)), "cgnat_mapping_ambiguous")
        .when(nat & ~mapped, "cgnat_subscriber_not_resolved")
        .when(nat & (F.coalesce("unique_private_subscribers", F.lit(1)) > 1), "cgnat_subscriber_not_unique")
        .otherwise("")
    )
    return out.withColumns(
        {
            "addressing_mode": F.when(F.col("effective_mode") == "direct_public", "direct").otherwise(F.col("effective_mode")),
            "cgnat_lookup_required": nat,
            "cgnat_gate": F.when(nat, F.when(block == "", "resolved").otherwise("blocked")).otherwise("not_applicable"),
            "addressing_block_reason": block,
        }
    )


def subscriber_counts(resolved: DataFrame, key: str) -> DataFrame:
    """Distinct private subscribers behind each event; ambiguous rows count for none."""
    who = F.concat_ws("|", F.coalesce("private_ip", F.lit("")), F.coalesce("subscriber_id", F.lit("")))
    known = F.col("matched") & ~F.col("ambiguous")
    return resolved.groupBy(key).agg(F.count_distinct(F.when(known, who)).alias("unique_private_subscribers"))


def conflicting_batches(mappings: DataFrame, batch_id: int) -> DataFrame:
    """Ids of active batches whose mappings collide with those of a batch.

    Both sides are first reduced per address and port bin to one mask for each
    combination of protocol, connector and validity, which belong to batches; the
    number of pairs is then the number of batches at a bin, not of mappings.
    """
    traits = ["protocol", "connector_id", "valid_from", "valid_until"]

    def masks(side: DataFrame, extra: list[str]) -> DataFrame:
        spread = ports.with_bins(side)
        return spread.groupBy("public_ip", "port_bin", *extra, *traits).agg(F.bit_or("port_mask").alias("mask"))

    fresh = masks(mappings.filter(F.col("batch_id") == batch_id), []).alias("f")
    old = masks(mappings.filter((F.col("batch_id") != batch_id) & F.col("active").cast("boolean")), ["batch_id"]).alias("o")

    def c(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    def open_or(test: Column, *columns: Column) -> Column:
        out = test
        for column in columns:
            out = out | column.isNull()
        return out

    clash = (
        (c("f", "public_ip") == c("o", "public_ip"))
        & (c("f", "port_bin") == c("o", "port_bin"))
        & ports.protocols_meet(c("f", "protocol"), c("o", "protocol"))
        & (c("f", "mask").bitwiseAND(c("o", "mask")) != 0)
        & open_or(c("f", "connector_id") == c("o", "connector_id"), c("f", "connector_id"), c("o", "connector_id"))
        & open_or(c("o", "valid_until") >= c("f", "valid_from"), c("o", "valid_until"), c("f", "valid_from"))
        & open_or(c("f", "valid_until") >= c("o", "valid_from"), c("f", "valid_until"), c("o", "valid_from"))
    )
    return fresh.join(old, clash).select(F.col("o.batch_id").alias("batch_id")).distinct()


def _status(batches: DataFrame, batch_id: int) -> str:
    row = batches.filter(F.col("id") == batch_id).select("status").first()
    if row is None:
        raise ValueError("batch_not_found")
    return row[0]


def _switch(mappings: DataFrame, batches: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Apply ``changes(batch_id, new_status, new_active)`` to both tables as new versions."""
    new_maps = mappings.join(changes.select("batch_id", "new_active"), "batch_id", "left").withColumn(
        "active", F.coalesce("new_active", F.col("active").cast("boolean"))
    )
    c = changes.select(F.col("batch_id").alias("__b"), "new_status", F.col("new_active").alias("__on"))
    joined = batches.join(c, F.col("id") == F.col("__b"), "left")
    touched = F.col("new_status").isNotNull()
    new_batches = joined.withColumns(
        {
            "activated_at": F.when(touched & F.col("__on"), now).otherwise(F.col("activated_at")),
            "deactivated_at": F.when(touched & F.col("__on"), None).when(touched, now).otherwise(F.col("deactivated_at")),
            "status": F.coalesce("new_status", "status"),
        }
    )
    return new_maps.select(*mappings.columns), new_batches.select(*batches.columns)


def activate(
    mappings: DataFrame, batches: DataFrame, batch_id: int, now: Column, replace_existing: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Activate an approved batch; colliding active batches are superseded, or refused without ``replace_existing``."""
    status = _status(batches, batch_id)
    if status == "active":
        return mappings, batches
    if status != "approved":
        raise ValueError("batch_not_approved")
    if mappings.filter(F.col("batch_id") == batch_id).isEmpty():
        raise ValueError("batch_has_no_published_mappings")
    conflicts = conflicting_batches(mappings, batch_id)
    if not replace_existing and not conflicts.isEmpty():
        raise ValueError("active_mapping_overlap_requires_replace")
    old = conflicts.select("batch_id", F.lit("superseded").alias("new_status"), F.lit(False).alias("new_active"))
    spark = mappings.sparkSession
    fresh = spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit("active").alias("new_status"), F.lit(True).alias("new_active"))
    return _switch(mappings, batches, old.unionByName(fresh), now)


def deactivate(mappings: DataFrame, batches: DataFrame, batch_id: int, now: Column) -> tuple[DataFrame, DataFrame]:
    if _status(batches, batch_id) != "active":
        raise ValueError("batch_not_active")
    change = mappings.sparkSession.range(1).select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit("approved").alias("new_status"), F.lit(False).alias("new_active")
    )
    return _switch(mappings, batches, change, now)


def reject(batches: DataFrame, batch_id: int) -> DataFrame:
    if _status(batches, batch_id) in ("active", "superseded"):
        raise ValueError("active_or_historical_batch_cannot_be_rejected")
    return batches.withColumn("status", F.when(F.col("id") == batch_id, "rejected").otherwise(F.col("status")))


def search_mappings(
    mappings: DataFrame, batches: DataFrame, search: str = "", connector_id: int | None = None, limit: int | None = None
) -> DataFrame:
    """Live mappings that contain a text in any of six columns, by address and port."""
    rows = live_mappings(mappings, batches)
    if search.strip():
        text = search.strip().lower()
        columns = ["public_ip", "private_ip", "pool_name", "device_name", "subscriber_id", "subscriber_name"]
        test = F.lit(False)
        for c in columns:
            if c in rows.columns:
                test = test | F.coalesce(F.lower(c).contains(text), F.lit(False))
        rows = rows.filter(test)
    if connector_id is not None:
        rows = rows.filter(F.col("connector_id") == connector_id)
    return first_rows(rows.orderBy("public_ip", "port_start", "port_end", "batch_id", "private_ip"), limit)
