"""Corpus pipeline: quality, near duplicates, repeated passages, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of ``documents``. Between stages the
rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from strataspark.llm import jaccard_join, mixing, packing, paragraphs, quality
from strataspark.llm.common import drop_tables, mark, materialize, release_shuffles, settle, shrinking, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before: list[str] = []  # what the last stage wrote for itself


def stage(run: Stage) -> Stage:
    """A stage that first deletes the intermediate tables of the stage before it, whose rows
    have been written by then; tables that ``docs`` still reads stay."""

    @wraps(run)
    def whole(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _before, docs)
        with shrinking():
            release_shuffles(spark)
            since = mark()
            out = run(spark, docs, sf_dir)
        _before[:] = written(since)
        return out

    return whole


@stage
def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.train(docs, labels))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the n-gram Jaccard join stays."""
    return jaccard_join.keep_one(docs)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs that stood before, in any document, are cut out."""
    return paragraphs.remove_repeats(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of equal length."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", drop_rejected),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage scores with a fitted model, the others hash and pack: not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for name, one in STAGES[:-1]:
        docs = materialize(one(spark, docs, sf_dir), f"pipeline-{name}")
        settle(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
