"""Port ranges as equi-join keys.

Ports lie in 0..65535.  A range is cut into bins of 64 ports; inside a bin it is a
64-bit mask.  ``(address, bin)`` is an ordinary join or grouping key, so one busy
address is spread over up to 1024 groups, and two ranges overlap in a bin exactly
when their masks share a bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.operators.ordered import ordered_scan

BIN = 64


def port_bin(port: Column) -> Column:
    return F.floor(port / BIN).cast("int")


def bins(start: Column, end: Column) -> Column:
    return F.sequence(port_bin(start), port_bin(end))


def _ones_from(position: Column) -> Column:
    """Mask with all bits at or above ``position`` (0..63) set."""
    return F.call_function("shiftleft", F.lit(-1).cast("bigint"), position.cast("int"))


def bin_mask(start: Column, end: Column, bin_: Column) -> Column:
    """The ports of a range inside one bin as bits."""
    low = F.greatest(start - bin_ * BIN, F.lit(0))
    high = F.least(end - bin_ * BIN, F.lit(BIN - 1))
    above = F.when(high >= BIN - 1, F.lit(0).cast("bigint")).otherwise(_ones_from(F.least(high + 1, F.lit(BIN - 1))))
    return _ones_from(low).bitwiseAND(F.bitwise_not(above))


def with_bins(rows: DataFrame, start: str = "port_start", end: str = "port_end") -> DataFrame:
    """Each range once per bin it touches, with its mask there."""
    spread = rows.withColumn("port_bin", F.explode(bins(F.col(start), F.col(end))))
    return spread.withColumn("port_mask", bin_mask(F.col(start), F.col(end), F.col("port_bin")))


def protocols_meet(a: Column, b: Column) -> Column:
    return (a == b) | (a == "any") | (b == "any")


def conflicting_ids(rows: DataFrame, key: str, identity: list[str], row_id: str) -> DataFrame:
    """Ids of rows whose port range meets a range of the same ``key`` with another identity.

    No pairs of rows are formed.  Rows of a bin are first reduced to one entry per
    protocol and mask with the lowest and highest identity behind it.  A bin has at
    most 2080 masks, so the list of its entries is bounded whatever the data holds.  An
    entry conflicts when it holds two identities itself or an overlapping entry of a
    meeting protocol holds a different one.
    """
    # Addresses and bins are as many as rows, whatever the size of the file that rows come from: no side is to be broadcast.
    # Addresses whose ranges never touch are settled by one ordered pass and not cut into bins.
    touching = ordered_scan(
        rows.select(key, row_id, "port_start", "port_end"), [key], F.floor(F.col("port_start") / 1024), ["port_start", "port_end", row_id],
        {"__furthest": ("max_before", F.col("port_end"))}, many_keys=True,
    ).filter(F.col("__furthest") >= F.col("port_start")).select(key).distinct()
    rows = rows.join(touching.hint("merge"), key, "left_semi")
    who = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in identity])
    spread = with_bins(rows.select(row_id, key, "protocol", "port_start", "port_end", who.alias("who")))
    entry = [key, "port_bin", "protocol", "port_mask"]
    entries = spread.groupBy(*entry).agg(F.min("who").alias("low"), F.max("who").alias("high"))
    lists = entries.groupBy(key, "port_bin").agg(
        F.collect_list(F.struct("protocol", "port_mask", "low", "high")).alias("all"),
        F.min("low").alias("first"),
        F.max("high").alias("last"),
    )
    # Bins that belong to one identity cannot conflict; that is nearly all of them.
    mixed = lists.filter(F.col("first") != F.col("last")).withColumn("e", F.explode("all"))
    clash = F.exists(
        "all",
        lambda q: (q["port_mask"].bitwiseAND(F.col("e.port_mask")) != 0)
        & protocols_meet(q["protocol"], F.col("e.protocol"))
        & ((q["low"] != F.col("e.low")) | (q["high"] != F.col("e.high")) | (q["low"] != q["high"])),
    )
    bad = mixed.filter(clash).select(key, "port_bin", F.col("e.protocol").alias("protocol"), F.col("e.port_mask").alias("port_mask"))
    return spread.join(bad.hint("merge"), entry, "left_semi").select(row_id).distinct()
