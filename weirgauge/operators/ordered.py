"""Running values over an order, without one task per key.

A plain window puts every row of a key into one task.  Here the order is cut into
chunks (a span of time, of ports, of lines): a window runs inside each
``(key, chunk)``, each chunk is reduced to one row, a second window runs over those
few rows, and the two are put together.  A key that holds a third of all rows is
spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirgauge.session import staged

KINDS = ("index", "sum", "max_before", "last", "prev", "next", "count_all")


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    chunk: Column,
    order: list[str],
    running: dict[str, tuple[str, Column | None]],
    many_keys: bool = False,
) -> DataFrame:
    """Add running columns over ``order`` within ``keys``.

    ``chunk`` must never fall as ``order`` rises, and ``order`` must be unique within
    a key.  ``running`` maps a new column to ``(kind, value)``:

    - ``index``: 0-based position; ``count_all``: rows of the key
    - ``sum``: running total with this row; ``max_before``: maximum of earlier rows
    - ``last``: latest non-null value up to and with this row
    - ``prev`` / ``next``: value of the neighbouring row, null at the ends

    With ``many_keys`` there may be as many chunks as rows: neither side is broadcast.
    """
    rank = F.struct(*[F.col(c) for c in order])
    local_window = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    upto = local_window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local_window.rowsBetween(Window.unboundedPreceding, -1)
    chunk_window = Window.partitionBy(*[F.col(f"__k{i}") for i in range(len(keys))]).orderBy("__k_chunk")
    earlier = chunk_window.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*[F.col(f"__k{i}") for i in range(len(keys))])

    chunked = df.withColumn("__chunk", chunk)
    inputs = {f"__v_{n}": v for n, (_, v) in running.items() if v is not None}
    chunked = chunked.withColumns(inputs) if inputs else chunked
    local, totals, carry, final = {}, {}, {}, {}
    for name, (kind, _) in running.items():
        value, here, total, brought = F.col(f"__v_{name}"), f"__l_{name}", f"__t_{name}", f"__c_{name}"
        if kind == "index":
            local[here] = F.row_number().over(local_window).cast("bigint") - 1
            totals[total] = F.count(F.lit(1))
            carry[brought] = F.coalesce(F.sum(total).over(earlier), F.lit(0))
            final[name] = F.col(here) + F.col(brought)
        elif kind == "count_all":
            totals[total] = F.count(F.lit(1))
            carry[brought] = F.sum(total).over(whole)
            final[name] = F.col(brought)
        elif kind == "sum":
            local[here] = F.sum(value).over(upto)
            totals[total] = F.sum(value)
            carry[brought] = F.coalesce(F.sum(total).over(earlier), F.lit(0))
            final[name] = F.col(here) + F.col(brought)
        elif kind == "max_before":
            local[here] = F.max(value).over(before)
            totals[total] = F.max(value)
            carry[brought] = F.max(total).over(earlier)
            final[name] = F.greatest(F.col(here), F.col(brought))
        elif kind == "last":
            local[here] = F.last(value, ignorenulls=True).over(upto)
            totals[total] = F.max_by(value, F.when(value.isNotNull(), rank))
            carry[brought] = F.last(total, ignorenulls=True).over(earlier)
            final[name] = F.coalesce(F.col(here), F.col(brought))
        elif kind in ("prev", "next"):
            boxed = F.struct(value.alias("v"))
            shift = F.lag if kind == "prev" else F.lead
            pick = F.max_by if kind == "prev" else F.min_by
            local[here] = shift(boxed).over(local_window)
            totals[total] = pick(boxed, rank)
            carry[brought] = shift(total).over(chunk_window)
            final[name] = F.when(F.col(here).isNotNull(), F.col(here)["v"]).otherwise(F.col(brought)["v"])
        else:
            raise ValueError(f"unknown kind {kind!r}; expected one of {KINDS}")

    chunks = chunked.groupBy(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__chunk").alias("__k_chunk")
    ).agg(*[e.alias(n) for n, e in totals.items()])
    carried = chunks.withColumns(carry).drop(*totals)
    rows = chunked.withColumns(local) if local else chunked
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    matched = rows.join(
        carried.hint("merge") if many_keys else carried, reduce(lambda a, b: a & b, same, F.col("__chunk").eqNullSafe(F.col("__k_chunk"))), "inner"
    )
    return matched.select(*df.columns, *[e.alias(n) for n, e in final.items()])


def time_chunk(ts: str, seconds: int) -> Column:
    """Chunk of a time order: the span of ``seconds`` the row falls in."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(int(seconds)))


def spaced(df: DataFrame, keys: list[str], ts: str, gap_seconds: int, chunk_seconds: int) -> DataFrame:
    """(keys, ts) of the times that a greedy pass keeps: the first, then each first one at least the gap after the last kept.

    Which time is kept depends on all before, so no window can say it.  Every time points to
    the first one that may follow it; kept are those reached from the first.  A turn reaches
    as many times again as are known and composes the pointers with themselves, so a chain
    of n kept times takes log2(n) turns, and no turn gathers a key anywhere.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    times = df.filter(F.col(ts).isNotNull()).select(*keys, at.alias("__at")).distinct()
    gap = int(gap_seconds) * 1_000_000
    # From the last time to the first: an asked time sees the nearest event at or after it.
    events = times.select(*keys, (-F.col("__at")).alias("__back"), F.lit(0).alias("__asks"), F.col("__at").alias("__event"), F.lit(None).cast("bigint").alias("__of"))
    asked = times.select(*keys, (-F.col("__at") - gap).alias("__back"), F.lit(1).alias("__asks"), F.lit(None).cast("bigint").alias("__event"), F.col("__at").alias("__of"))
    chunk = F.floor(F.col("__back") / (int(chunk_seconds) * 1_000_000))
    seen = ordered_scan(events.unionByName(asked), keys, chunk, ["__back", "__asks"], {"__next": ("last", F.col("__event"))})
    pointers = staged(seen.filter("__asks = 1 AND __next IS NOT NULL").select(*keys, F.col("__of").alias("__at"), "__next"))
    kept = staged(times.groupBy(*keys).agg(F.min("__at").alias("__at")))

    def followed(rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with the pointer of the time in ``column`` as ``__then``."""
        named = pointers.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__at").alias("__p_at"), F.col("__next").alias("__then"))
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        return rows.join(named, reduce(lambda a, b: a & b, same, F.col(column) == F.col("__p_at")))

    while True:
        more = staged(followed(kept, "__at").select(*keys, F.col("__then").alias("__at")))
        if more.isEmpty():
            break
        kept = staged(kept.unionByName(more))
        pointers = staged(followed(pointers, "__next").select(*keys, "__at", F.col("__then").alias("__next")))
    return kept.select(*keys, F.timestamp_micros("__at").alias(ts))
