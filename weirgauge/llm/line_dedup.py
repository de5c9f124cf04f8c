"""Line dedup: overlapping three-line windows that appeared before are cut out.

Every three consecutive lines of a text form a window.  Windows are hashed (128 bits),
equal ones meet by hash, and all but the first, by (doc_id, line), are later
occurrences.  A text loses the lines that its later occurrences cover together.

The first place of each window is an aggregate with map-side combine, and only hashes
that occur twice are joined back; a very common window is one key of that join, which
the runtime splits.  Texts travel once, to be cut.

Defined results: a null text has one empty line, so no window; windows without a word
are left alone; texts under three lines are kept whole; rows with the same id and text
are one document and lose the same lines; null ids count as first; an empty table gives
no rows; ``text`` of an untouched row is returned as it was, null included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.llm.common import SPACES, documents, packed, query, text_of, unpacked, wide_hash

WINDOW = 3


def cut_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each input row as ``row`` with n_lines, n_removed and kept (the text that is left)."""
    body = text_of(F.col(f"row.`{text}`"))
    rows = packed(docs).withColumns({"id": F.col(f"row.`{doc_id}`"), "content": F.xxhash64(body), "body": body})
    lines = rows.select("id", "content", F.split("body", "\n").alias("ls")).where(F.size("ls") >= WINDOW)
    windows = lines.select(
        "id",
        "content",
        F.posexplode(
            F.transform(
                F.slice("ls", 1, F.size("ls") - (WINDOW - 1)),
                lambda x, i: F.concat_ws("\n", x, F.get("ls", i + 1), F.get("ls", i + 2)),
            )
        ).alias("at", "win"),
    ).where(F.btrim("win", F.lit(SPACES)) != "")
    places = windows.select(wide_hash(F.col("win")).alias("h"), "id", "content", "at").select("h.a", "h.b", "id", "content", "at")
    place = F.struct("id", "content", "at")
    firsts = (
        places.groupBy("a", "b")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .drop("last")
    )
    covered = (
        places.join(firsts, ["a", "b"])
        .where(place != F.col("first"))
        .groupBy(F.col("id").alias("c_id"), F.col("content").alias("c_content"))
        .agg(F.collect_set("at").alias("starts"))
        .withColumn(
            "covered", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (WINDOW - 1)))))
        )
        .drop("starts")
    )
    same = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("content") == F.col("c_content"))
    joined = rows.join(covered, same, "left")
    at = F.split("body", "\n")
    joined = joined.withColumn("ls", at).withColumn(
        "left_at", F.when(F.col("covered").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "covered"))
    )
    kept = F.when(
        F.col("covered").isNotNull(), F.array_join(F.transform("left_at", lambda i: F.get("ls", i)), "\n")
    ).otherwise(F.col(f"row.`{text}`"))
    return joined.select(
        "row",
        F.size("ls").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("bigint").alias("n_removed"),
        kept.alias("kept"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with its later occurrences cut out; texts that lost every word go."""
    cut = cut_lines(docs, doc_id, text)
    alive = (F.col("n_removed") == 0) | (F.btrim("kept", F.lit(SPACES)) != "")
    return unpacked(cut.where(alive).withColumn("row", F.col("row").withField(f"`{text}`", F.col("kept"))), docs.columns)


def lines_sql(table: str, columns: str) -> str:
    """SQL for the cut texts of ``table``, beside ``columns`` of it."""
    return rf"""
WITH d AS MATERIALIZED (SELECT {columns}, doc_id AS line_id, text AS whole, row_number() OVER () AS line_row,
    string_split(coalesce(text, ''), chr(10)) AS ls FROM {table}),
w AS (SELECT line_row, line_id, md5(coalesce(whole, '')) AS content, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win
    FROM (SELECT *, unnest(range(0, len(ls) - 2)) AS pos FROM d)),
x AS (SELECT line_row, pos, struct_pack(i := line_id, c := content, p := pos) AS place, min(struct_pack(i := line_id, c := content, p := pos)) OVER (PARTITION BY win) AS first
    FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]')),
cv AS (SELECT line_row, list(DISTINCT p) AS covered FROM (SELECT line_row, unnest([pos, pos + 1, pos + 2]) AS p FROM x WHERE place <> first) GROUP BY line_row)
SELECT {columns}, len(ls)::BIGINT AS n_lines, coalesce(len(covered), 0)::BIGINT AS n_removed,
    CASE WHEN covered IS NULL THEN whole
      ELSE array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(covered, i)), lambda i: ls[i + 1]), chr(10)) END AS kept
FROM d LEFT JOIN cv USING (line_row)"""


@query("op2_line_dedup", lines_sql("documents", "doc_id"))
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return cut_lines(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "kept")
