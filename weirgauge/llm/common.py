"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirgauge.session import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPACES = " \t\n\x0b\f\r"  # the separators of words: \x20 and \x09-\x0D
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, the text that must give the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(text: Column) -> Column:
    """The text; empty for null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.translate(text_of(text), SPACES, " " * len(SPACES)), " "), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def wide_hash(*parts: Column) -> Column:
    """128 bits in two longs; the seeds differ, so that the halves are independent."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second half"), *parts).alias("b"))


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """The whole input row as one struct column, so that no name of it can clash with a new column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpacked(df: DataFrame, columns: list[str], name: str = "row") -> DataFrame:
    """The input columns of ``packed`` again."""
    return df.select(*[F.col(f"{name}.`{c}`").alias(c) for c in columns])


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a 0-based position over the whole ``order`` without one task for all rows.

    Rows are dealt out by range, numbered inside each range, and shifted by the rows
    of the ranges before.  Rows equal under ``order`` get any order among them.
    """
    parts = staged(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = parts.groupBy("__range").count().select(
        "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start")
    )
    here = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return parts.withColumn(name, here.cast("bigint")).join(starts, "__range").select(
        *df.columns, (F.col(name) + F.col("__start")).alias(name)
    )
