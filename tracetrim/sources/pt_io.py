"""Persist / load the PT dataset (A6) with an explicit schema, so an empty dataset keeps its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracetrim.session import shared_path, write_shared  # noqa: F401 - shared_path is part of this module's interface

METADATA_TYPE = T.StructType([
    T.StructField("skip_start_idx", T.IntegerType()),
    T.StructField("skip_end_idx", T.IntegerType()),
    T.StructField("original_step_count", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("source_dataset", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
])

PT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("input_x", T.StringType()),
    T.StructField("target_y", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("skipped_steps", T.ArrayType(T.StringType())),
    T.StructField("skip_reason", T.StringType()),
    T.StructField("generator_model", T.StringType()),
    T.StructField("decision_model", T.StringType()),
    T.StructField("metadata", METADATA_TYPE),
    T.StructField("split", T.StringType()),
])


def to_pt_rows(transitions: DataFrame, split: str = "train") -> DataFrame:
    """Shape transitions (with optional provenance columns) into the PT schema."""
    cols = set(transitions.columns)

    def opt(name, dtype="string"):
        return F.col(name).cast(dtype) if name in cols else F.lit(None).cast(dtype)

    return transitions.select(
        "id", "question", "input_x", "target_y", F.col("depth").cast("int").alias("depth"), "skipped_steps",
        "skip_reason", opt("generator_model").alias("generator_model"), opt("decision_model").alias("decision_model"),
        F.struct(opt("skip_start_idx", "int").alias("skip_start_idx"), opt("skip_end_idx", "int").alias("skip_end_idx"),
                 opt("original_step_count", "int").alias("original_step_count"), opt("category").alias("category"),
                 opt("source_dataset").alias("source_dataset"), opt("ground_truth").alias("ground_truth")).alias("metadata"),
        F.lit(split).alias("split"),
    )


def save_pt(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("split").parquet(path)


def load_pt(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read with the explicit schema; the requested split, else "train" if present, else the first.
    The split choice is a partition filter, so only that folder is listed and read.  An Arrow dataset folder is
    read as one (a single dataset has no splits: it is read whole, as ``split`` or "train")."""
    from tracetrim.sources import arrow_folder

    if arrow_folder.is_arrow_folder(path):
        chosen = arrow_folder.choose_split(path, split)
        name = chosen.rsplit("/", 1)[1] if chosen != path else split or "train"
        return as_pt(arrow_folder.read_arrow(spark, chosen), name)
    df = spark.read.schema(PT_SCHEMA).parquet(path)
    if split is None:
        splits = sorted(r[0] for r in df.select("split").distinct().collect())  # partition values only
        if not splits:
            return df
        split = "train" if "train" in splits else splits[0]
    return df.where(F.col("split") == split)


def save_pt_arrow(df: DataFrame, path: str, shard_mb: int = 500) -> None:
    """The PT rows as a folder of Arrow datasets, one per value of ``split``, with the ``split`` column left out.

    The split names are few by nature (a dataset has a handful), and each is one pass over the rows, which are
    worked out once and written to the shared folder first; without rows there is one empty split, "train".
    """
    from tracetrim.sources.arrow_folder import write_arrow_splits

    df = write_shared(df, "pt-rows")
    names = sorted(r[0] for r in df.select(F.coalesce("split", F.lit("train"))).distinct().collect()) or ["train"]
    own = F.coalesce("split", F.lit("train"))
    write_arrow_splits({n: df.where(own == n).drop("split") for n in names}, path, shard_mb)


def as_pt(df: DataFrame, split: str) -> DataFrame:
    """The rows of a dataset written elsewhere in the PT schema: columns and ``metadata`` fields by name, what is missing is null."""
    def fitted(name: str, kind: T.DataType, have: T.StructType, inside: str = ""):
        if name not in have.fieldNames():
            return F.lit(None).cast(kind).alias(name)
        if isinstance(kind, T.StructType):
            own = have[name].dataType
            own = own if isinstance(own, T.StructType) else T.StructType()
            return F.struct(*[fitted(f.name, f.dataType, own, f"{inside}{name}.") for f in kind]).alias(name)
        return F.col(f"{inside}{name}").cast(kind).alias(name)

    cols = [fitted(f.name, f.dataType, df.schema) for f in PT_SCHEMA if f.name != "split"]
    return df.select(*cols, F.lit(split).alias("split"))
