"""Sharding by extendible hashing: no shard above its byte limit.

A directory is indexed by the leading bits of a document's hash.  All documents start
in one bucket; a bucket that is too large splits on the next bit, alone, until it fits.
The directory is grown ``STEP`` bits at a time: bytes are added up by slot (at most
2**STEP sums for each bucket still too large), every slot finds the fewest bits whose
bucket fits, and only what still overflows goes on to the next bits.

Only columns and SQL functions are used.  Only sums leave the executors' partitions, so
no task holds the rows of a bucket.

Defined results: a null text has no bytes; the hash covers id and text, so null ids are
spread like others; a document above the limit is a shard of its own and flagged
``oversized``; equal rows have equal hashes and cannot be split by bits, so where copies
of one row overflow they are numbered and dealt to shards that each fit.  An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirgauge.llm.common import documents, packed, query, text_of
from weirgauge.session import staged

MAX_SHARD_BYTES = 64 << 20
BITS, STEP = 60, 12  # hash bits used, bits by which the directory grows at once
SALTS = 64  # independent numberings for copies of one row


def prefix(bits: Column, depth: Column) -> Column:
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def directory_step(active: DataFrame, known: int, limit: int) -> DataFrame:
    """Slots of ``known + STEP`` bits among ``active`` (h, bytes) with the depth of their bucket; null: too large still."""
    top = known + STEP
    slots = active.groupBy(prefix(F.col("h"), F.lit(top)).alias("slot")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")
    )
    depths = F.explode(F.sequence(F.lit(known if known == 0 else known + 1), F.lit(top)))
    each = slots.select("slot", "bytes", "docs", depths.alias("depth")).withColumn(
        "bucket", F.call_function("shiftright", F.col("slot"), F.lit(top) - F.col("depth"))
    )
    fits = each.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")).where(
        F.col("bytes") <= limit
    )
    return each.join(fits.select("depth", "bucket"), ["depth", "bucket"], "right").groupBy("slot").agg(
        F.min("depth").alias("depth")
    )


def shard_names(docs: DataFrame, limit: int = MAX_SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each input row as ``row`` with n_bytes, shard (bits as text), depth and oversized."""
    body = text_of(F.col(f"row.`{text}`"))
    key = F.concat(F.coalesce(F.col(f"row.`{doc_id}`").cast("string"), F.lit("")), F.lit(":"), body)
    rows = packed(docs).withColumns(
        {
            "h": F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("bigint"),
            "bytes": F.octet_length(body).cast("bigint"),
        }
    )
    sizes = staged(rows.select("h", "bytes"))
    placed = rows
    shard = F.lit(None).cast("string")
    active, known, found = sizes, 0, []
    while known < BITS:
        step = staged(directory_step(active, known, limit))
        top = known + STEP
        found.append((top, step))
        slot = prefix(F.col("h"), F.lit(top))
        still = active.join(step.select(F.col("slot").alias("s")), slot == F.col("s"), "left_anti")
        if still.isEmpty():
            known = top
            break
        active, known = (staged(still), top)
    for top, step in found:
        step = step.select(F.col("slot").alias(f"slot_{top}"), F.col("depth").alias(f"depth_{top}"))
        placed = placed.join(step, prefix(F.col("h"), F.lit(top)) == F.col(f"slot_{top}"), "left")
    depth = F.coalesce(*[F.col(f"depth_{top}") for top, _ in found])
    placed = placed.withColumn("depth", depth)
    stuck = F.col("depth").isNull()
    if known == BITS and not active.isEmpty() and len(found) * STEP == BITS:
        salt = F.when(stuck, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        placed = placed.withColumn("__salt", salt)
        numbered = (
            placed.where(stuck)
            .withColumn("__n", F.row_number().over(Window.partitionBy("h", "__salt").orderBy("bytes")) - 1)
            .withColumn("__part", F.call_function("div", F.col("__n"), F.greatest(F.lit(1), F.call_function("div", F.lit(limit), F.greatest(F.col("bytes"), F.lit(1))))))
        )
        placed = placed.where(~stuck).withColumns({"__n": F.lit(None).cast("int"), "__part": F.lit(None).cast("bigint")}).unionByName(numbered)
        tail = F.when(F.col("__part").isNotNull(), F.concat(F.lit("."), F.col("__salt"), F.lit("."), F.col("__part"))).otherwise("")
    else:
        tail = F.lit("")
    depth = F.coalesce("depth", F.lit(BITS))
    bits = F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix(F.col("h"), depth)), depth, F.lit("0")))
    shard = F.concat(F.lit("s"), bits, tail)
    return placed.select(
        "row", F.col("bytes").alias("n_bytes"), shard.alias("shard"), depth.alias("depth"), (F.col("bytes") > limit).alias("oversized")
    )


def shards_sql(table: str, columns: str, limit: int) -> str:
    """SQL for the shards of ``table``; 48 bits of depth are tried."""
    return f"""
WITH d AS (SELECT {columns}, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {BITS // 4}))::BIGINT AS h FROM {table}),
p AS (SELECT d.*, k::INTEGER AS depth, h >> ({BITS} - k)::INTEGER AS bucket FROM d, range(0, 49) r(k)),
b AS (SELECT depth, bucket FROM p GROUP BY ALL HAVING sum(n_bytes) <= {limit})
SELECT {columns}, n_bytes, 's' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bucket), depth, '0') END AS shard, depth, n_bytes > {limit} AS oversized
FROM p JOIN b USING (depth, bucket) QUALIFY row_number() OVER (PARTITION BY {columns}, h ORDER BY depth) = 1"""


@query("op8_sharding", shards_sql("documents", "doc_id", MAX_SHARD_BYTES))
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return shard_names(docs).select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "shard", "depth", "oversized")
