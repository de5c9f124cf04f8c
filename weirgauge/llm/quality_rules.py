"""Quality rules whose cut-offs follow the data: quantile sketches by language and source.

Every document gets integer measures.  A sketch of a group is the count of documents in
each log-linear bucket of a measure (32 buckets for each power of two, so a value is
known to 1/32).  Sketches merge by adding counts: those of a source add up to the one of
its language and those of all languages to the one of the corpus.  A group's quartiles
give its fences; a group of few documents takes the fences of its language, and a
language of few documents those of the corpus.

Defined results: a null or empty text has no words and fails the base rule; null
languages and sources are groups of their own; repeated rows count each; an empty table
gives no rows; columns of the input keep clear of the new ones (``packed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirgauge.llm.common import SPACES, SQL_WORDS, documents, packed, query, text_of, words
from weirgauge.session import staged

MIN_WORDS = 50
MIN_GROUP = 200  # documents that a sketch needs to speak for its group
REACH = 3  # a fence lies this many quartile distances away
# measure: the quartile distance that a fence assumes at least, whether low values are judged too
MEASURES = {"symbol_rate": (20, False), "dup_line_rate": (150, False), "repeat_rate": (120, False), "word_length": (40, True)}
SYMBOLS = "#*$%&|<>"


def base_measures(df: DataFrame, text: Column) -> DataFrame:
    """Add the base columns of each text; one pass over the row, nothing is shuffled.

    Words in repeated 3-word windows are found by sorting the window hashes of the text:
    equal ones become neighbours.  Texts without a repeat skip the sort.
    """
    body = text_of(text)
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumns({"__words": words(text), "__lines": lines})
    n = F.size("__words")
    df = df.withColumns(
        {
            "n_words": n.cast("bigint"),
            "word_chars": F.char_length(F.translate(body, SPACES, "")).cast("bigint"),
            "n_symbols": (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("bigint"),
            "n_lines": F.size("__lines").cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "__hashes": F.slice(
                F.transform(
                    "__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))
                ),
                1,
                F.greatest(n - 2, F.lit(0)),
            ),
        }
    ).drop("__words", "__lines")
    repeats = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    placed = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("__sorted", F.when(repeats, F.array_sort(placed))).drop("__hashes")

    def beside(entry: Column, at: Column) -> Column:
        return F.coalesce(F.get("__sorted", at)["h"] == entry["h"], F.lit(False))

    df = df.withColumn(
        "__starts",
        F.array_sort(
            F.transform(F.filter("__sorted", lambda e, j: beside(e, j - 1) | beside(e, j + 1)), lambda e: e["i"])
        ),
    ).drop("__sorted")
    widths = F.transform("__starts", lambda s, j: F.least(F.lit(3), F.coalesce(F.get("__starts", j + 1) - s, F.lit(3))))
    return df.withColumn(
        "n_repeat_words",
        F.coalesce(F.aggregate(widths, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")),
    ).drop("__starts")


def bucket(value: Column) -> Column:
    """Sketch bucket of a non-negative integer; buckets rise with values."""
    power = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (power * 32 + F.call_function("shiftright", value, power)).cast("bigint")


def bucket_value(number: Column) -> Column:
    """Smallest value of a bucket."""
    power = F.greatest(F.floor(number / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (number - power * 32).cast("bigint"), power)


def sketches(measured: DataFrame) -> DataFrame:
    """Counts by (level, lang, source, measure, bucket); level 0 source, 1 language, 2 corpus."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES]))
    cells = (
        measured.where("n_words > 0")
        .select("lang", "source", each.alias("m"))
        .groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket(F.col("m.v")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    none = F.lit(None).cast("string")
    levels = F.explode(
        F.array(
            F.struct(F.lit(0).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")),
            F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), none.alias("source")),
            F.struct(F.lit(2).alias("level"), none.alias("lang"), none.alias("source")),
        )
    )
    merged = cells.select(levels.alias("g"), "measure", "bucket", "n").select("g.*", "measure", "bucket", "n")
    return merged.groupBy("level", "lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row for each group of each level: its documents and low and high fences."""
    group = Window.partitionBy("level", "lang", "source", "measure")
    counted = sketch.withColumns(
        {"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)}
    )

    def quartile(q: int) -> Column:
        return bucket_value(F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket"))))

    ends = counted.groupBy("level", "lang", "source", "measure").agg(
        F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3")
    )
    out = []
    for name, (least, both) in MEASURES.items():
        own = F.col("measure") == name
        reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * REACH
        out.append(F.max(F.when(own, F.col("q3") + reach)).alias(f"high_{name}"))
        low = F.col("q1") - reach if both else F.lit(0)
        out.append(F.max(F.when(own, low)).cast("bigint").alias(f"low_{name}"))
    return ends.groupBy("level", "lang", "source").agg(F.max("total").alias("docs"), *out)


def group_fences(limits: DataFrame) -> DataFrame:
    """The fences that hold for each (lang, source): of the first level with enough documents."""
    none = F.lit(None).cast("string")
    asks = limits.where("level = 0").select(
        F.col("lang").alias("g_lang"),
        F.col("source").alias("g_source"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")),
                F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), none.alias("source")),
                F.struct(F.lit(2).alias("level"), none.alias("lang"), none.alias("source")),
            )
        ).alias("a"),
    )
    same = (
        (F.col("a.level") == F.col("level"))
        & F.col("a.lang").eqNullSafe(F.col("lang"))
        & F.col("a.source").eqNullSafe(F.col("source"))
    )
    speaks = (F.col("docs") >= MIN_GROUP) | (F.col("level") == 2)
    bounds = [f"{side}_{m}" for m in MEASURES for side in ("high", "low")]
    found = asks.join(limits, same).where(speaks)
    return found.groupBy("g_lang", "g_source").agg(
        F.min_by(F.struct("level", *bounds), "level").alias("fence")
    )


def judge(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None
) -> DataFrame:
    """Verdict for each row: ``row`` (the columns in ``carry``, default all), the base columns and ``kept``.

    ``level`` tells whose fences were used (0 source, 1 language, 2 corpus; null without words).
    """
    carry = docs.columns if carry is None else carry
    rows = packed(docs).select(
        F.struct(*[F.col(f"row.`{c}`") for c in carry]).alias("row"),
        F.col(f"row.`{text}`").alias("__text"),
        F.col(f"row.`{lang}`").cast("string").alias("lang"),
        F.col(f"row.`{source}`").cast("string").alias("source"),
    )
    rate = lambda part, whole, times: F.call_function("div", F.col(part) * times, F.greatest(F.col(whole), F.lit(1)))
    measured = staged(
        base_measures(rows, F.col("__text"))
        .drop("__text")
        .withColumns(
            {
                "symbol_rate": rate("n_symbols", "n_words", 1000),
                "dup_line_rate": rate("n_dup_lines", "n_lines", 1000),
                "repeat_rate": rate("n_repeat_words", "n_words", 1000),
                "word_length": rate("word_chars", "n_words", 100),
            }
        )
    )
    # Stored, so that its size is known: a few rows, which no text has to be shuffled to meet.
    limits = staged(group_fences(fences(staged(sketches(measured)))))
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    inside = F.lit(True)
    for name in MEASURES:
        inside = inside & F.col(name).between(F.col(f"fence.low_{name}"), F.col(f"fence.high_{name}"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return (
        measured.join(limits, same, "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
        .withColumn("level", F.col("fence.level"))
    )


_RATES = """
  n_symbols * 1000 // greatest(n_words, 1) AS symbol_rate, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_rate,
  n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS word_length"""
_Q = "min(CASE WHEN upto * 4 >= total * {q} THEN bucket END)"
_EDGE = "((({b}) - 32 * greatest(({b}) // 32 - 1, 0))::BIGINT << greatest(({b}) // 32 - 1, 0)::INTEGER)"
_FENCE = ", ".join(
    f"max(CASE WHEN measure = '{m}' THEN q3 + {REACH} * greatest(q3 - q1, {least}) END) AS high_{m}, "
    + (f"max(CASE WHEN measure = '{m}' THEN q1 - {REACH} * greatest(q3 - q1, {least}) END)" if both else "0")
    + f" AS low_{m}"
    for m, (least, both) in MEASURES.items()
)
_INSIDE = " AND ".join(f"{m} BETWEEN low_{m} AND high_{m}" for m in MEASURES)


def rules_sql(table: str, columns: str) -> str:
    """SQL for the verdicts on ``table``; ``columns`` of it are kept beside the base columns."""
    return rf"""
WITH w AS MATERIALIZED (SELECT {columns}, row_number() OVER () AS rid, lang AS g_lang, source AS g_source, coalesce(text, '') AS body,
    {SQL_WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM {table}),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c
    FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY rid),
base AS (SELECT w.* EXCLUDE (ws, ls, body), len(ws)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
m AS MATERIALIZED (SELECT *, {_RATES} FROM base),
v AS (UNPIVOT (SELECT g_lang, g_source, symbol_rate, dup_line_rate, repeat_rate, word_length FROM m WHERE n_words > 0)
    ON symbol_rate, dup_line_rate, repeat_rate, word_length INTO NAME measure VALUE val),
k AS (SELECT g_lang, g_source, measure, 32 * greatest(length(bin(val)) - 6, 0) + (val >> greatest(length(bin(val)) - 6, 0)::INTEGER) AS bucket FROM v),
lv AS (SELECT 0 AS level, g_lang, g_source, measure, bucket FROM k UNION ALL SELECT 1, g_lang, NULL, measure, bucket FROM k
    UNION ALL SELECT 2, NULL, NULL, measure, bucket FROM k),
sk AS (SELECT level, g_lang, g_source, measure, bucket, count(*) AS n FROM lv GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, g_lang, g_source, measure ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, g_lang, g_source, measure) AS total FROM sk),
ends AS (SELECT level, g_lang, g_source, measure, max(total) AS total, {_Q.format(q=1)} AS b1, {_Q.format(q=3)} AS b3 FROM cum GROUP BY ALL),
qs AS (SELECT level, g_lang, g_source, measure, total, {_EDGE.format(b='b1')} AS q1, {_EDGE.format(b='b3')} AS q3 FROM ends),
lim AS (SELECT level, g_lang, g_source, max(total) AS docs, {_FENCE} FROM qs GROUP BY ALL),
own AS (SELECT a.g_lang, a.g_source, l.* EXCLUDE (g_lang, g_source) FROM lim a JOIN lim l ON a.level = 0
    AND (l.level = 0 AND l.g_lang IS NOT DISTINCT FROM a.g_lang AND l.g_source IS NOT DISTINCT FROM a.g_source
      OR l.level = 1 AND l.g_lang IS NOT DISTINCT FROM a.g_lang OR l.level = 2)
    WHERE l.docs >= {MIN_GROUP} OR l.level = 2
    QUALIFY row_number() OVER (PARTITION BY a.g_lang, a.g_source ORDER BY l.level) = 1)
SELECT m.*, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * 50 AS base_failed,
    NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * 50) AND coalesce({_INSIDE}, false) AS kept
FROM m LEFT JOIN own ON m.g_lang IS NOT DISTINCT FROM own.g_lang AND m.g_source IS NOT DISTINCT FROM own.g_source"""


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


@query("op3_quality_rules", f"SELECT doc_id, {', '.join(BASE)} FROM ({rules_sql('documents', 'doc_id')})")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir), carry=["doc_id"])
    return judged.select(F.col("row.doc_id").alias("doc_id"), *BASE)
