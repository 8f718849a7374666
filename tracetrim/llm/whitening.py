"""Embedding whitening by a weighted covariance over the distinct vectors.

1. Entries become whole numbers x = floor(64 * entry) + 1,000,000.  Rows with the same x form one
   vector with a multiplicity, counted before the shuffle, so a vector that a third of all rows hold
   is one row from there on.
2. The fit weight of a vector is its multiplicity (``weights="counts"``: the fit list is all rows) or
   one (``weights="one"``: the distinct vectors).  Sums per dimension are exact whole numbers.
3. Covariance: each batch of vectors is centred (n*x - sum, exact, over n), weighted and multiplied as
   a matrix; the batches' products are added up.  Divisor n.
4. Its eigenvectors, by falling eigenvalue, come from the driver: the matrix is dimensions squared,
   whatever the number of rows.
5. Each distinct vector is projected once, and joined back to its rows.  Vectors that make up more than
   a thousandth of all rows, so at most 1,000 of them, are joined by broadcast, the rest by shuffle.
6. ``identity_error`` comes from the covariance of the whitened vectors, centred and weighted alike.

Defined results: a vector that is null or holds a null, NaN or infinite entry is left out; vectors of
different length are lists of their own, each with its own fit; an empty vector has no components;
directions without variance (an eigenvalue at rounding size) have no unit of scale and are left out, so
a table with one distinct vector gives no rows; an entry beyond 2^50 / 64 counts as that; a
``deviation`` that passes a long is null; repeated rows and null ids come out each; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracetrim.llm.common import pick
from tracetrim.session import ship_package, shared_table

SCALE, SHIFT, LIMIT = 64, 1_000_000, float(1 << 50)
_LONG = (1 << 63) - 1


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))).cast("long") + SHIFT)


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def _matrix(column, kind) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (rows, matrix) of a list column without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum([0, *sizes])
    out = {}
    for k in np.unique(sizes):
        if k:
            at = np.flatnonzero(sizes == k)
            out[int(k)] = at, flat[starts[at][:, None] + np.arange(k)]
    return out


def _exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - sums as whole numbers; beyond 62 bits as Python's own."""
    if max(n * int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0)) >= 1 << 61:
        x = x.astype(object)
    return x * n - np.array(sums, dtype=x.dtype)


def _centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    if x.dtype == np.float64:
        return x - np.array(sums) / n
    return _exact(x, n, sums).astype(np.float64) / n


def _totals(vectors: DataFrame, column: str, weight: str) -> dict[int, tuple[int, list]]:
    """length -> (sum of weights, weighted sum per dimension) of an array column; whole numbers stay exact."""
    exact = dict(vectors.dtypes)[column] == "array<bigint>"

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            w = batch.column(1).to_numpy(zero_copy_only=False)
            for k, (at, x) in _matrix(batch.column(0), np.int64 if exact else np.float64).items():
                own = w[at]
                if exact and int(np.abs(x).max(initial=0)) * int(own.sum()) >= 1 << 62:
                    x = x.astype(object)
                sums = (x * own[:, None]).sum(axis=0)
                total = held.setdefault(k, [0, [0] * k])
                total[0] += int(own.sum())
                total[1] = [a + (int(b) if exact else float(b)) for a, b in zip(total[1], sums)]
        for k, (n, sums) in held.items():
            yield pa.record_batch({"k": pa.array([k] * k, pa.int32()), "i": pa.array(range(k), pa.int32()),
                                   "n": pa.array([n] * k, pa.int64()), "s": pa.array([repr(s) for s in sums], pa.string())})

    parts = vectors.select(column, weight).mapInArrow(run, "k int, i int, n long, s string")
    found: dict[int, tuple[int, list]] = {}
    kind = "decimal(38,0)" if exact else "double"
    for r in parts.groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(kind)).alias("s")).orderBy("k", "i").collect():
        found.setdefault(r["k"], (r["n"], []))[1].append(int(r["s"]) if exact else r["s"])
    return found


def weighted_covariance(vectors: DataFrame, column: str, weight: str, totals: dict[int, tuple[int, list]]) -> dict[int, np.ndarray]:
    """length -> covariance, divisor the sum of weights, each batch centred before it is multiplied."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            w = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            whole = pa.types.is_integer(batch.column(0).type.value_type)
            for k, (at, x) in _matrix(batch.column(0), np.int64 if whole else np.float64).items():
                c = _centred(x, *totals[k])
                held[k] = held.get(k, 0) + (c * w[at][:, None]).T @ c
        for k, m in held.items():
            yield pa.record_batch({"k": pa.array([k] * k, pa.int32()), "i": pa.array(range(k), pa.int32()),
                                   "row": pa.array(m.tolist(), pa.list_(pa.float64()))})

    parts = vectors.select(column, weight).mapInArrow(run, "k int, i int, row array<double>")
    cells = parts.select("k", "i", F.posexplode("row").alias("j", "v")).groupBy("k", "i", "j").agg(F.sum("v").alias("v"))
    out = {k: np.zeros((k, k)) for k in totals}
    for r in cells.toArrow().to_pylist():
        out[r["k"]][r["i"], r["j"]] = r["v"] / totals[r["k"]][0]
    return out


class Axes:
    """The unit eigenvectors of one covariance with variance in them, by falling eigenvalue."""

    def __init__(self, covariance: np.ndarray, most: int):
        e, v = np.linalg.eigh((covariance + covariance.T) / 2)
        e, v = e[::-1], v[:, ::-1]
        trace = float(np.trace(covariance))
        good = int((e[:most] > len(e) * np.finfo(float).eps * max(e[0], 0.0)).sum())
        self.values, self.vectors = e[:good], v[:, :good]
        self.explained = [float(x) / trace for x in self.values]


def whiten(df: DataFrame, weights: str = "counts", components: int = 32) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of (vec_id, embedding)."""
    if weights not in ("counts", "one"):
        raise ValueError(f"weights are 'counts' or 'one', not {weights!r}")
    spark = df.sparkSession
    ship_package(spark)
    rows = pick(df, "vec_id", "embedding").where(finite(F.col("embedding"))).select("vec_id", whole_numbers(F.col("embedding")).alias("x"))
    vectors, _ = shared_table(rows.groupBy("x").agg(F.count("*").alias("m")).withColumn("w", F.col("m") if weights == "counts" else F.lit(1).cast("long")), "distinct-vectors")
    totals = _totals(vectors, "x", "w")
    axes = {k: Axes(c, components) for k, c in weighted_covariance(vectors, "x", "w", totals).items()}
    held = spark.sparkContext.broadcast({k: (totals[k], a.vectors / np.sqrt(a.values)) for k, a in axes.items()})

    def project(batches):
        for batch in batches:
            white, deviation = [[]] * batch.num_rows, [0] * batch.num_rows
            for k, (at, x) in _matrix(batch.column(0), np.int64).items():
                (n, sums), axis = held.value[k]
                z = _exact(x, n, sums)
                if len(z) and int(np.abs(z).max()) ** 2 * k >= _LONG:
                    z = z.astype(object)
                for i, y, d in zip(at, ((z.astype(np.float64) / n) @ axis).tolist(), (z * z).sum(axis=1).tolist()):
                    white[i], deviation[i] = y, d if d <= _LONG else None
            yield pa.record_batch([*batch.columns, pa.array(white, pa.list_(pa.float64())), pa.array(deviation, pa.int64())],
                                  names=["x", "m", "w", "y", "deviation"])

    done, _ = shared_table(vectors.mapInArrow(project, "x array<long>, m long, w long, y array<double>, deviation long"), "whitened-vectors")
    seen = done.where(F.size("y") > 0)
    errors = _identity_errors(seen)
    n_rows = vectors.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    heavy = F.col("m") > n_rows / 1000
    values = seen.select(F.xxhash64("x").alias("h"), "x", "m", "y", "deviation")
    own = rows.withColumn("h", F.xxhash64("x"))
    few = F.broadcast(values.where(heavy).drop("m"))
    joined = own.join(few, ["h", "x"]).unionByName(
        own.join(few.select("h", "x"), ["h", "x"], "left_anti").join(values.where(~heavy).drop("m"), ["h", "x"]))
    about = [(k, i + 1, totals[k][0], a.explained[i], errors[k]) for k, a in axes.items() for i in range(len(a.values))]
    facts = spark.createDataFrame(about, "k int, component int, n long, explained double, identity_error double")
    return (joined.select("vec_id", F.size("x").alias("k"), "deviation", F.posexplode("y").alias("at", "whitened"))
            .withColumn("component", F.col("at") + 1).join(F.broadcast(facts), ["k", "component"])
            .select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"))


def _identity_errors(seen: DataFrame) -> dict[int, float]:
    """length of x -> largest entry of the whitened vectors' covariance less the identity."""
    out = {}
    for (k,) in seen.select(F.size("x")).distinct().collect():
        own = seen.where(F.size("x") == k)
        totals = _totals(own, "y", "w")
        out[k] = max(float(np.abs(c - np.eye(len(c))).max()) for c in weighted_covariance(own, "y", "w", totals).values())
    return out
