"""Parquet table access.  Column pruning and filters reach the scan through Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: Session setting: spread every table read over so many partitions (unset: as the scan splits it).
SPREAD_SETTING = "spark.tracetrim.inputPartitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows out over ``partitions`` when the caller (or the session setting) gives a number.

    The per-row work here (segmentation, auditing, rollouts) is CPU-heavy, and a table of one
    row group is read by one task.  Nothing is spread by itself: the scan's own splits stand, so a
    large table never pays for a shuffle that nobody asked for.
    """
    n = partitions or int(df.sparkSession.conf.get(SPREAD_SETTING, "0"))
    return df.repartition(n) if n > 0 else df


def read_table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), partitions)
