import math
import random
from fractions import Fraction

import numpy as np
import pytest
from helpers import clashing
from pyspark.sql import functions as F

from tracetrim.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=300, d=6, seed=2):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d))
    base = (r.normal(size=(n, d)) @ mix / 4 + 0.3).astype(np.float32)
    base[: n // 3] = base[0]  # a third of all rows hold one vector
    return [(i, [float(c) for c in v], 0) for i, v in enumerate(base)]


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def expected(x, weight):
    """mean, covariance, eigenvalues and axes worked out plainly, sums in fractions."""
    n, d = sum(weight), len(x[0])
    mean = [Fraction(sum(w * v[i] for v, w in zip(x, weight)), n) for i in range(d)]
    c = np.array([[float(v[i] - mean[i]) for i in range(d)] for v in x])
    cov = (c * np.array(weight)[:, None]).T @ c / n
    e, axes = np.linalg.eigh(cov)
    return n, mean, e[::-1], axes[:, ::-1]


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_against_plain_numpy(spark, weights):
    rows = vectors()
    got = by_id(whitening.whiten(spark.createDataFrame(rows, VECTORS), weights=weights))
    x = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v, _ in rows}
    distinct = sorted(set(x.values()))
    held = list(x.values()) if weights == "counts" else distinct
    n, mean, e, axes = expected(held, [1] * len(held))
    assert set(got) == set(x) and all(set(v) == set(range(1, 7)) for v in got.values())
    sums = [m * n for m in mean]
    signs = None
    for i, v in x.items():
        want = np.array([float(c - m) for c, m in zip(v, mean)]) @ axes / np.sqrt(e)
        have = np.array([got[i][k]["whitened"] for k in range(1, 7)])
        signs = np.sign(want * have) if signs is None else signs
        assert np.allclose(have, signs * want, atol=1e-9)
        assert {r["deviation"] for r in got[i].values()} == {int(sum((n * c - s) ** 2 for c, s in zip(v, sums)))}
    share = e / e.sum()
    r = got[0]
    assert all(abs(r[k]["explained"] / share[k - 1] - 1) < 1e-9 and r[k]["n"] == n and r[k]["identity_error"] < 1e-9 for k in r)


def test_only_the_first_components(spark):
    got = by_id(whitening.whiten(spark.createDataFrame(vectors(d=40), VECTORS)))
    assert all(set(v) == set(range(1, 33)) for v in got.values())
    assert max(r["identity_error"] for v in got.values() for r in v.values()) < 1e-9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(900, None, 0), (901, [1.0, nan], 0), (902, [inf, 0.0], 0), (903, [1.0, None], 0), (904, [], 0), (905, [0.5], 0), (906, [0.5], 0),
           (907, [0.5, 0.25], 1), (907, [0.5, 0.25], 1), (None, [1.0, -0.5], 1), (908, [1e30, -1e30], 1)]
    df = spark.createDataFrame(odd, VECTORS)
    got = by_id(whitening.whiten(clashing(df.withColumn("x", F.lit("clash")))))
    # one-entry vectors are all alike: no direction; four rows of two entries
    assert set(got) == {907, None, 908}
    assert {r["n"] for v in got.values() for r in v.values()} == {4}
    assert whitening.whiten(df).count() == 2 * sum(len(v) for v in [got[907]]) + len(got[None]) + len(got[908])
    assert got[908][1]["deviation"] is None
    assert whitening.whiten(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(df, weights="none")


def test_two_lengths_are_two_lists(spark):
    r = random.Random(4)
    rows = [(i, [r.random() for _ in range(3 if i % 2 else 5)], 0) for i in range(100)]
    got = by_id(whitening.whiten(spark.createDataFrame(rows, VECTORS)))
    assert {(i % 2, len(v), v[1]["n"]) for i, v in got.items()} == {(1, 3, 50), (0, 5, 50)}
    assert max(v[1]["identity_error"] for v in got.values()) < 1e-9


def test_rank_below_dimension(spark):
    rows = [(i, [float(i), float(i), 1.0], 0) for i in range(20)]
    got = by_id(whitening.whiten(spark.createDataFrame(rows, VECTORS)))
    assert all(set(v) == {1} and abs(v[1]["explained"] - 1) < 1e-12 for v in got.values())


def test_each_distinct_vector_is_projected_once(spark):
    rows = spark.createDataFrame(vectors(), VECTORS)
    got = whitening.whiten(rows.unionByName(rows))
    n = len({tuple(v) for _, v, _ in vectors()})
    assert got.count() == 2 * 300 * 6
    assert got.select("deviation", "component", "whitened").distinct().count() == n * 6
