"""The corpus pipeline: stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``; ``run`` writes it to the shared folder.  Once the
next stage begins, the folders that a stage made for itself are deleted, unless the new
``docs`` still read them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from weirgauge.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from weirgauge.llm.common import documents, unpacked
from weirgauge.session import noting, release, staged


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_own: list[str] = []  # folders that the last stage made for itself


def tidy(stage: Stage) -> Stage:
    """The stage, once what the one before it left behind is gone."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _own[:] = release(spark, _own, docs)
        with noting() as made:
            out = stage(spark, docs, sf_dir)
        _own.extend(made)
        return out

    return begun


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return unpacked(quality_rules.judge(docs).where("kept"), docs.columns)


@tidy
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; texts left without a word go."""
    return line_dedup.deduplicated(docs)


NEAR = ngram_join.Rule(width=5, num=4, den=5)  # five words, Jaccard of 0.8


@tidy
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.representatives(docs, rule=NEAR)


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target of their source."""
    return mixing.mixed(docs)


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix), ("best-fit packing", pack),
]

ORACLE_SQL = None  # tokenizers and packing have no SQL form; tests/llm/test_pipeline.py compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after another."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs)
    return docs
