"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, whatever else ``df`` holds.

    Spark resolves names without regard to case, so an extra column ``Text`` beside
    ``text`` makes a plain select ambiguous; positions never are.
    """
    at = [_index(df, n) for n in names]
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names)])


def _index(df: DataFrame, name: str) -> int:
    if name not in df.columns:
        raise ValueError(f"column {name!r} is missing; there are {df.columns}")
    return df.columns.index(name)


class Carried:
    """Carries a frame's whole rows through an operator whose own columns may clash.

    ``frame`` holds the asked columns under their names and the whole row as ``_row``;
    ``restore`` turns ``_row`` back into the first columns, with replacements by name.
    """

    def __init__(self, df: DataFrame, *names: str):
        self.columns = list(df.columns)
        at = {n: _index(df, n) for n in names}
        inner = [f"_c{i}" for i in range(len(self.columns))]
        plain = df.toDF(*inner)
        self.frame = plain.select(*[F.col(f"_c{at[n]}").alias(n) for n in names], F.struct(*inner).alias("_row"))

    def field(self, name: str) -> Column:
        """A column of the carried row: no second copy of it need travel along."""
        return F.col(f"_row._c{self.columns.index(name)}")

    def restore(self, df: DataFrame, **replaced: Column) -> DataFrame:
        """Unknown names in ``replaced`` are left out, so that an input without the column stays as it is."""
        cols = [replaced[n] if n in replaced else F.col(f"_row._c{i}") for i, n in enumerate(self.columns)]
        return df.select(*[c.alias(f"_c{i}") for i, c in enumerate(cols)]).toDF(*self.columns)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def id_remainder(divisor: int, c: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))
