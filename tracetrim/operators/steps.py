"""Step tables: attach segmented steps to a text table and enumerate them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracetrim.functions.segment import segment


def with_steps(df: DataFrame, text_col: str = "text", mode: str = "auto", out: str = "steps") -> DataFrame:
    return df.withColumn(out, segment(text_col, mode))


def explode_steps(df: DataFrame, key_cols, steps_col: str = "steps") -> DataFrame:
    """One row per step with its 0-based index (rows with no steps vanish)."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    # posexplode_outer + null filter: plain posexplode makes the optimizer push a
    # size(steps) > 0 filter under the projection and segment every text twice.
    out = df.select(*keys, F.posexplode_outer(steps_col).alias("step_idx", "step"))
    return out.where(F.col("step_idx").isNotNull())
