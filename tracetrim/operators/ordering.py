"""Order-dependent helpers that never put one group in one task.

``row_number()`` / ``lead()`` windows partitioned by a key send the whole key to one
task; when one key holds a large share of the rows that task sorts it alone.  Here
positions come from one global range sort (``dense_position``), and per-group values
from equi-joins on those positions:

* rank within a group = global position - the group's first position (a map-side
  combined ``min`` per group, joined back; AQE splits a skewed probe side);
* next row within a group = join on global position + 1 (a unique key, no skew).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracetrim.session import write_shared


def dense_position(df: DataFrame, order_cols, out: str = "idx") -> DataFrame:
    """0-based position in ``order_cols`` order without a single-partition window.

    Global sort (range partitions) -> ``monotonically_increasing_id`` encodes (partition,
    row in partition).  The sorted rows and ids are written once as a table in the
    shared checkpoint folder, so the per-partition counts and the rows they number come
    from the same materialisation (two independent sorts could
    sample different range bounds).  The counts have one row per partition, a proven
    small bound, and are broadcast back as offsets.  Rows equal in ``order_cols`` get positions of
    their own, in any order; nulls come first.
    """
    ordered = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    ordered = write_shared(ordered, "positions")
    ordered = ordered.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_row", F.col("_mid").bitwiseAND((1 << 33) - 1))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_part", "_off")
    return (ordered.join(F.broadcast(offsets), "_part")
                   .withColumn(out, (F.col("_off") + F.col("_row")).cast("long"))
                   .drop("_mid", "_part", "_row", "_off"))


def rank_within(df: DataFrame, group_col: str, order_cols, out: str = "rank") -> DataFrame:
    """1-based ``row_number() OVER (PARTITION BY group ORDER BY order)`` without a per-group window.

    Each row is numbered once, whatever repeats: equal (group, order) rows get ranks of their own, and
    a null group is a group.
    """
    g = dense_position(df, [group_col, *order_cols], "_gpos")
    starts = g.groupBy(F.col(group_col).alias("_sgroup")).agg(F.min("_gpos").alias("_gstart"))
    return g.join(starts, F.col(group_col).eqNullSafe(F.col("_sgroup"))) \
            .withColumn(out, (F.col("_gpos") - F.col("_gstart") + 1).cast("long")).drop("_gpos", "_gstart", "_sgroup")


def next_within(df: DataFrame, group_col: str, order_cols, value_cols, prefix: str = "next_", this=None, following=None) -> DataFrame:
    """``lead(c) OVER (PARTITION BY group ORDER BY order)`` for each value column, as a join on the
    following global position, which is unique: repeated (group, order) rows multiply nothing.

    By default a left join (null at the end of a group).  With conditions on ``this`` row and on
    the ``following`` one, only rows that meet them are joined, so no other row's values are shuffled.
    """
    g = dense_position(df, [group_col, *order_cols], "_gpos")
    left = g if this is None else g.where(this)
    right = g if following is None else g.where(following)
    nxt = right.select((F.col("_gpos") - 1).alias("_npos"), F.col(group_col).alias("_ngroup"), *[F.col(c).alias(prefix + c) for c in value_cols])
    j = left.join(nxt, (F.col("_gpos") == F.col("_npos")) & F.col(group_col).eqNullSafe(F.col("_ngroup")),
                  "left" if following is None else "inner")
    return j.drop("_gpos", "_npos", "_ngroup")
