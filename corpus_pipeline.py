"""A training corpus from ``documents``: quality, near duplicates, personal data, mix, packing.

A stage's result is written as Parquet before the next stage begins; only then are the working
tables that it read in the shared folder of no more use, and the next stage deletes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracetrim.llm import line_quality, mixing, neardup, packing, pii
from tracetrim.llm.common import read
from tracetrim.session import remove_shared, shared_path, tables_of

_WORKING: list[str] = []


def _stage(work):
    """``work(docs)`` as a stage: the working tables of the stage before it go first, its own are noted."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _WORKING:
            remove_shared(spark, path)
        _WORKING.clear()
        with tables_of() as paths:
            out = work(docs)
        _WORKING.extend(paths)
        return out

    run_stage.__doc__ = work.__doc__
    return run_stage


@_stage
def quality(docs: DataFrame) -> DataFrame:
    """Bad lines go, then documents that fail the rules or lost too much text."""
    return line_quality.quality_stage(docs)


@_stage
def near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.dedup_stage(docs)


@_stage
def personal_data(docs: DataFrame) -> DataFrame:
    """Each span of personal data becomes its kind's mark."""
    return pii.redact(docs)


@_stage
def mixture(docs: DataFrame) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix_rows(docs)


@_stage
def packed(docs: DataFrame) -> DataFrame:
    """The pieces of every document in training sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("personal data", personal_data),
          ("source mix", mixture), ("packing", packed)]

# Sets of hashed shingles, connected components and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
