"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(df: DataFrame, cond: Column) -> DataFrame:
    """Filter on a condition over *expensive derived columns* without letting the
    optimizer push it below the projection that derives them.

    A plain ``where`` on such a column is pushed through the projection with the column
    replaced by its defining expression, so the whole derivation is evaluated again
    (and duplicated) inside the filter.  ``explode_outer`` of a one-element array is a
    Generate, which predicates on its output cannot cross; it costs one row copy.
    """
    return df.withColumn("_keep_", F.explode_outer(F.array(cond))).where(F.col("_keep_")).drop("_keep_")
