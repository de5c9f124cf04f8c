"""Mixing sources to target weights by repeating documents.

Sizes are added up by source, a target in words is set for each source, and the rate of
a source is target / size.  A document is emitted floor(rate) times plus one more copy
with the probability of the fraction, drawn from a hash of its id.

Targets share the words of the corpus by weight; none is above ``CAP`` times its source,
and what a capped source leaves is shared again by weight.

Defined results: a null text has no words and a source without words the target 0; the
null source is the last one; repeated rows draw alike, as their ids are equal; null ids
draw as the empty id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.llm.common import SQL_WORDS, documents, packed, query, ranked, unpacked, words
from weirgauge.session import staged

CAP = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets from (source, source_size): one row for each source.

    The common level (words for each unit of weight) rises until no uncapped source is
    above its cap; each turn is one aggregate of two whole numbers over the sources, and
    at least one more source is capped in it, so it ends.
    """
    placed = ranked(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    sources = staged(placed.withColumn("weight", weight.cast("bigint")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("source_size") * CAP
        held, free, now = sources.agg(
            F.sum(F.when(over, F.col("source_size") * CAP)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)
        ).first()
        if now == capped or not free:
            break
        capped = now
        level = (total - (held or 0)) / free
    share = F.col("weight") * F.lit(float(level))
    return sources.withColumn("target", F.least(share, (F.col("source_size") * CAP).cast("double")))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the hash of an id."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def mix_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Each input row as ``row`` with size, source_size, target and copies."""
    rows = packed(docs).withColumns(
        {
            "source": F.col(f"row.`{source}`").cast("string"),
            "size": F.size(words(F.col(f"row.`{text}`"))).cast("bigint"),
        }
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes).select(F.col("source").alias("of"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    once_more = draw(F.col(f"row.`{doc_id}`")) < rate - F.floor(rate)
    return rows.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").withColumn(
        "copies", F.floor(rate).cast("bigint") + once_more.cast("bigint")
    )


def mixed(docs: DataFrame, **names: str) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of the input."""
    counted = mix_counts(docs, **names).where("copies > 0")
    emitted = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unpacked(emitted, docs.columns)


def mix_sql(table: str, columns: str) -> str:
    """SQL for sizes, targets and copies on ``table``, beside ``columns`` of it."""
    return f"""
WITH d AS (SELECT {columns}, doc_id AS mix_id, source AS mix_source, len({SQL_WORDS})::BIGINT AS size FROM {table}),
s AS (SELECT mix_source, sum(size)::BIGINT AS source_size, [1, 2, 3][1 + (row_number() OVER (ORDER BY mix_source NULLS LAST) - 1) % 3] AS weight
    FROM d GROUP BY mix_source),
r AS (SELECT *, source_size * {CAP} AS cap, row_number() OVER (ORDER BY source_size * {CAP} / weight, mix_source NULLS LAST) AS k FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS total FROM r),
lv AS (SELECT min_by((total - held)::DOUBLE / free::DOUBLE, k) AS level FROM c WHERE weight * ((total - held)::DOUBLE / free::DOUBLE) <= cap),
s2 AS (SELECT s.*, s.source_size * {CAP} AS cap, level FROM s, lv),
t AS (SELECT mix_source, source_size, least(weight * level, cap::DOUBLE) AS target FROM s2),
q AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(mix_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT / {2**52}::DOUBLE AS drawn
    FROM d LEFT JOIN t ON d.mix_source IS NOT DISTINCT FROM t.mix_source)
SELECT * EXCLUDE (mix_id, mix_source, rate, drawn), floor(rate)::BIGINT + (drawn < rate - floor(rate))::BIGINT AS copies FROM q"""


@query("op4_mixing", f"SELECT doc_id, size, source_size, target, size * copies AS taken FROM ({mix_sql('documents', 'doc_id')})")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix_counts(docs).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
